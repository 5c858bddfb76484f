"""Entity deduplication: exact normal forms, then a similarity join of the rest, then components.

Candidates of the similarity join come from an exact prefix filter on character shingles (rarest
first), so no pair at or above the threshold is lost and no bucket is compared with itself whole
beyond what shares a rare shingle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import jaro_winkler, jaro_winkler_of, one_edit_of, shannon_bits, shingles
from weftgraph.operators import alike as L
from weftgraph.operators.build import least_rows
from weftgraph.operators.components import connected_components
from weftgraph.scratch import Scratch

ENTROPY, JACCARD, JW, SHORT, BOOST = 2.5, 0.7, 0.92, 12, 0.05
#: Pairs from here up to the threshold go to a judge, so many at a time.
TIE, TIE_BATCH, BLOCK_LABELS = 0.75, 30, 1000


def variant_pair(a: Column, b: Column) -> Column:
    """Both labels short, of one stem and different endings (a number, or letters): models, versions."""
    pattern = "^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"
    stem = lambda c: F.regexp_extract(c, pattern, 1)
    end = lambda c: F.regexp_extract(c, pattern, 2)
    return (a != b) & (F.greatest(F.length(a), F.length(b)) < SHORT) & (stem(a) != "") & (stem(a) == stem(b)) & (end(a) != end(b))


def short_blocked(a: Column, b: Column, jw: Column) -> Column:
    """Two short labels pass only if of equal length, nearly equal and one edit or swap apart."""
    short = F.greatest(F.length(a), F.length(b)) < SHORT
    return short & ~((jw >= 0.97) & (F.length(a) == F.length(b)) & one_edit_of(a, b))


def jaccard_pairs(items: DataFrame, threshold: float = JACCARD, k: int = 3) -> DataFrame:
    """(a, b, jaccard) of keys a < b whose shingle sets reach the threshold. ``items``: (key, text)."""
    s = items.select("key", shingles(F.replace(F.col("text"), F.lit(" "), F.lit("")), k).alias("g")).where("size(g) > 0")
    flat = s.select("key", F.size("g").alias("n"), F.explode("g").alias("x"))
    df = flat.groupBy("x").agg(F.count("*").alias("df"))
    ranked = flat.join(df, "x").groupBy("key", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "x"))), lambda e: e["x"]).alias("g"))  # a label's shingles
    need = F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1
    pre = ranked.select("key", "n", "g", F.explode(F.slice("g", F.lit(1), need)).alias("x"))
    a, b = (pre.select("x", F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("g").alias(f"g{c}")) for c in "ab")
    cand = a.join(b, "x").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).dropDuplicates(["a", "b"])
    both = F.size(F.array_intersect("ga", "gb"))
    return cand.select("a", "b", (both / (F.col("na") + F.col("nb") - both)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def _telling(labels: DataFrame) -> DataFrame:
    """Distinct labels of enough entropy to be compared."""
    return labels.select("text").where(F.col("text") != "").distinct().where(shannon_bits(F.col("text")) >= ENTROPY)


def similar_links(labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): links with the components of ``similar_labels``, not all its pairs where the labels are not too many."""
    items = scratch.save(_telling(labels).withColumn("at", F.monotonically_increasing_id()))
    if (got := L.classes(items, scratch, JACCARD, JW, SHORT)) is None:
        return similar_labels(labels).select("a", "b")
    texts = L.placed(items, *got, "text")
    first = texts.where("number = root").select(F.col("text").alias("b"), "root")
    return texts.where("number <> root").select(F.col("text").alias("a"), "root").join(first, "root").select("a", "b")


def similar_labels(labels: DataFrame, boosted: DataFrame | None = None) -> DataFrame:
    """(a, b, jw): pairs of distinct labels that count as one entity. ``labels``: column text, normal forms.

    ``boosted`` (text, community): where both labels have the same community and at least ``SHORT``
    characters, ``BOOST`` is added to the similarity before it is held against the threshold.
    """
    items = _telling(labels).select(F.col("text").alias("key"), "text")
    cand = jaccard_pairs(items).withColumn("jw", jaro_winkler_of(F.col("a"), F.col("b")))
    reached = F.col("jw")
    if boosted is not None:
        own = boosted.where("community is not null").groupBy("text").agg(F.min("community").alias("c"))
        for end in "ab":
            cand = cand.join(own.select(F.col("text").alias(end), F.col("c").alias(f"c{end}")), end, "left")
        near = (F.col("ca") == F.col("cb")) & (F.least(F.length("a"), F.length("b")) >= SHORT)
        reached = F.when(F.coalesce(near, F.lit(False)), F.col("jw") + BOOST).otherwise(F.col("jw"))
    cand = cand.where(reached >= JW)
    return cand.where(~variant_pair(F.col("a"), F.col("b")) & ~short_blocked(F.col("a"), F.col("b"), F.col("jw"))).select("a", "b", "jw")


def tie_break_pairs(labels: DataFrame, low: float = TIE, high: float = JW, batch: int = TIE_BATCH) -> DataFrame:
    """(batch, a, b, jw): pairs of distinct labels that are neither clearly one nor clearly two, in
    batches for a judge, in the order of the labels.

    Every label is a query against all others, in blocks: labels are dealt by hash to blocks of about
    ``BLOCK_LABELS``, and each pair of blocks is one group. A length bound that the threshold implies goes first.
    """
    distinct = labels.select("text").where(F.col("text") != "").distinct()
    blocks = max(1, -(-distinct.count() // BLOCK_LABELS))
    one = distinct.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int"))
    other = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: F.struct(F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi")))
    dealt = one.select("text", "block", F.explode(other).alias("pair"))

    def compare(pdf):
        import pandas as pd

        rows = sorted(zip(pdf["text"], pdf["block"], strict=True))
        lo, hi = int(pdf["lo"].iloc[0]), int(pdf["hi"].iloc[0])
        left = [t for t, b in rows if b == lo]
        right = [t for t, b in rows if b == hi]
        out = []
        for x in left:
            for y in right:
                if lo == hi and x >= y:
                    continue
                # matches are at most the shorter length: the Jaro part is at most (2 + short / long) / 3
                short, long = sorted((len(x), len(y)))
                top = (2 + short / long) / 3
                if top + 0.4 * (1 - top) < low:
                    continue
                s = jaro_winkler(x, y)
                if low <= s < high:
                    out.append((min(x, y), max(x, y), s))
        return pd.DataFrame(out, columns=["a", "b", "jw"])

    pairs = dealt.select("text", "block", "pair.lo", "pair.hi").groupBy("lo", "hi").applyInPandas(compare, "a string, b string, jw double")
    number = F.row_number().over(Window.partitionBy("head").orderBy("a", "b")) - 1
    # batches do not reach across first letters, so no task numbers all pairs
    return pairs.withColumn("head", F.substring("a", 1, 1)).withColumn("n", number).select(F.concat_ws("-", "head", F.floor(F.col("n") / batch).cast("string")).alias("batch"), "a",
        "b", "jw")


def survivors(members: DataFrame) -> DataFrame:
    """(component, winner): no chunk suffix first, then the shortest id, then the first."""
    key = F.struct(F.col("node").rlike(r"_c\d+$"), F.length("node"), F.col("node"))
    return members.groupBy("component").agg(F.min_by("node", key).alias("winner"))


def deduplicate(nodes: DataFrame, edges: DataFrame, norm: Column, scratch: Scratch | None = None, communities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after merging. Equal normal forms merge within one source file; of each form
    the first node goes on to the similarity join. Edges move to survivors; those that close on
    themselves go. Rows of one id: the least whole row stays. Nodes of more than one repository (column
    ``repo``) are refused; a table of one node or none comes back as it is. ``communities`` (id,
    community) turns the boost of pairs within a community on."""
    scratch = scratch or Scratch(nodes.sparkSession, "dedup")
    if "repo" in nodes.columns and len(repos := nodes.select("repo").where("repo is not null").distinct().limit(2).collect()) > 1:
        raise ValueError(f"nodes of several repositories ({repos[0][0]}, {repos[1][0]}, ...) cannot be merged")
    if nodes.limit(2).count() < 2:
        return nodes, edges
    n = scratch.save(least_rows(nodes, "id").withColumn("form", norm))
    if communities is None and (got := _by_classes(n, scratch)):
        kept, remap = got
        return kept, rewire(edges, remap)
    exact = n.where(F.coalesce("form", F.lit("")) != "").groupBy("form", "source_file").agg(F.min_by("id", F.struct(F.length("id"), F.col("id"))).alias("head"))
    links = n.join(exact, ["form", "source_file"]).where("id <> head").select(F.col("id").alias("src"), F.col("head").alias("dst"))
    heads = n.where(F.coalesce("form", F.lit("")) != "").groupBy("form").agg(F.min("id").alias("head"))
    boosted = None if communities is None else heads.join(communities.select(F.col("id").alias("head"), "community"), "head").select(F.col("form").alias("text"), "community")
    fuzzy = similar_labels(heads.select(F.col("form").alias("text")), boosted).join(heads.select(F.col("form").alias("a"), F.col("head").alias("src")), "a")
    fuzzy = fuzzy.join(heads.select(F.col("form").alias("b"), F.col("head").alias("dst")), "b").select("src", "dst")
    members = connected_components(links.union(fuzzy), scratch=scratch)
    remap = scratch.save(members.join(survivors(members), "component").select(F.col("node").alias("old"), F.col("winner").alias("new")))
    kept = n.drop("form").join(remap.where("old <> new").select(F.col("old").alias("id")), "id", "left_anti")
    return kept, rewire(edges, remap)


def _with_telling(forms: DataFrame) -> DataFrame:
    """Column ``telling``: the forms that ``_telling`` keeps, by arrays; those near the bound by its own expression."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(L.entropy_bits(batch.column(0)))], names=[*batch.schema.names, "bits"])

    bits = F.col("bits")
    telling = F.when(F.isnan(bits) | (F.abs(bits - ENTROPY) < 1e-6), shannon_bits(F.col("form")) >= ENTROPY).otherwise(bits >= ENTROPY)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in forms.schema)
    return forms.mapInArrow(run, f"{kinds}, bits double").withColumn("telling", telling).drop("bits")


def _by_classes(n: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame] | None:
    """(kept nodes, (old, new)) by groups of a form and a file; the one with a form's first node stands for the form in
    the similarity join, so a class is its groups and no component has to be looked for. None if the forms are too many."""
    # without a file a node is a group of its own
    group = F.coalesce(F.concat(F.lit("f"), F.col("source_file")), F.concat(F.lit("i"), F.col("id"))).alias("group")
    formed = (F.coalesce("form", F.lit("")) != "") & F.col("id").isNotNull()
    best = F.min(F.struct(F.col("id").rlike(r"_c\d+$").alias("cut"), F.length("id").alias("size"), F.col("id"))).alias("best")
    groups = scratch.save(n.where(formed).groupBy("form", group).agg(best, F.min("id").alias("least")))
    forms = groups.groupBy("form").agg(F.min("least").alias("least"), F.min_by("best", "least").alias("best"), F.count("*").alias("n"))
    forms = scratch.save(_with_telling(forms.select("form", "least", "best.*", "n")))
    items = scratch.save(forms.where("telling").select(F.col("form").alias("text"), "cut", "size", "id").withColumn("at", F.monotonically_increasing_id()))
    if (got := L.classes(items, scratch, JACCARD, JW, SHORT)) is None:
        return None
    several = forms.where("n > 1").select("form", F.col("least").alias("first"))
    rest = groups.join(several, "form").where("least <> first")
    won = scratch.save(L.placed(items, *got, "cut", "size", "id").groupBy("root").agg(F.min(F.struct("cut", "size", "id"))["id"].alias("new")))
    winners = won.select(F.col("new").alias("id")).union(forms.where("not telling").select("id")).union(rest.select("best.id"))
    kept = n.where(~formed).union(n.where(formed).join(winners, "id", "left_semi").select(*n.columns)).drop("form")
    # a form's own group goes with its class, another with itself
    to = L.placed(items, *got, "text").join(won, "root").select(F.col("text").alias("form"), "new").join(forms.select("form", F.col("least").alias("first")), "form", "right")
    to = groups.join(to, "form").select("form", "group", F.when(F.col("least") == F.col("first"), F.coalesce("new", "best.id")).otherwise(F.col("best.id")).alias("new"))
    remap = n.where(formed).select("id", "form", group).join(to, ["form", "group"]).select(F.col("id").alias("old"), "new")
    # a node that stays alone is not merged, so its own loops stay
    return kept, remap.join(remap.where("old <> new").select("new").distinct(), "new", "left_semi").select("old", "new")


def rewire(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Edges with their ends moved by (old, new); what becomes a self-loop by that goes."""
    own = edges.columns
    e = edges.join(remap.select(F.col("old").alias("src"), F.col("new").alias("s_")), "src", "left").join(remap.select(F.col("old").alias("dst"), F.col("new").alias("d_")), "dst",
        "left")
    e = e.withColumn("src", F.coalesce("s_", "src")).withColumn("dst", F.coalesce("d_", "dst"))
    return e.where((F.col("src") != F.col("dst")) | (F.col("s_").isNull() & F.col("d_").isNull())).select(*own)


def minhash(text: Column, perms: int = 128, k: int = 3) -> Column:
    """Signature of a label: per permutation the least hash of its character shingles, spaces left out. The hash is the
    MD5 of the permutation's number and the shingle, so other systems can make the same signature."""
    grams = shingles(F.replace(text, F.lit(" "), F.lit("")), k)
    return F.transform(F.sequence(F.lit(0), F.lit(perms - 1)),
        lambda i: F.array_min(F.transform(grams, lambda g: F.substring(F.md5(F.concat_ws(":", i.cast("string"), g)), 1, 16))))


def signature_bands(items: DataFrame, bands: int = 14, rows: int = 9) -> DataFrame:
    """(band, bucket, key): labels that agree in a whole band of their signatures share a bucket; the classic blocking
    beside the exact prefix filter. ``items``: (key, text)."""
    sig = items.select("key", minhash(F.col("text"), bands * rows).alias("s")).where(F.get("s", F.lit(0)).isNotNull())
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.md5(F.array_join(F.slice("s", b * rows + 1, rows), ",")).alias("bucket")))
    return sig.select("key", F.explode(cut).alias("c")).select("c.band", "c.bucket", "key")
