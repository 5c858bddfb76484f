"""Graph build: coercion, validation, repair, upsert, collapse, merge and pruning as joins and aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import id_of, suffix
from weftgraph.model import CONFIDENCES, FILE_TYPES

#: Other spellings of a node's file type.
FILE_TYPE_SYNONYMS = {
    "markdown": "document", "text": "document", "tool": "code", "library": "code", "pattern": "concept", "principle": "concept", "constraint": "concept", "tech": "concept",
    "technology": "concept",
    "data-source": "concept", "data_source": "concept", "gotcha": "concept", "framework": "concept",
}
#: Language families that may call each other, by suffix.
FAMILIES = {
    ".py": "py", ".pyi": "py", ".js": "js", ".mjs": "js", ".cjs": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".go": "go", ".rs": "rs", ".java": "jvm", ".kt": "jvm",
    ".scala": "jvm", ".groovy": "jvm",
    ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp", ".hpp": "cpp", ".rb": "rb", ".php": "php", ".cs": "cs", ".swift": "swift", ".lua": "lua",
}


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def first_present(df: DataFrame, names: list[str], kind: str = "string") -> Column:
    """The first of these columns that exists and is not null."""
    have = [F.col(f"`{n}`").cast(kind) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast(kind)


def coerce_nodes(raw: DataFrame) -> DataFrame:
    """Legacy node spellings to the schema: ``source`` for source_file, file-type synonyms, none: concept."""
    given = F.lower(first_present(raw, ["file_type", "type"]))
    kind = F.when(given.isin(*FILE_TYPES), given).otherwise(F.coalesce(F.try_element_at(literal_map(FILE_TYPE_SYNONYMS), given), F.lit("concept")))
    return raw.select(
        first_present(raw, ["id", "node_id", "key", "name"]).alias("id"), first_present(raw, ["label", "name", "title", "id"]).alias("label"), kind.alias("file_type"),
        first_present(raw, ["source_file", "source", "file", "path"]).alias("source_file"), first_present(raw, ["source_location", "location"]).alias("source_location"),
        first_present(raw, ["community"], "int").alias("community"), first_present(raw, ["ord"], "long").alias("ord"),
    )


def coerce_edges(raw: DataFrame) -> DataFrame:
    """Legacy edge spellings to the schema (``from``/``to``, ``source``/``target``)."""
    score = first_present(raw, ["confidence_score", "score"]).try_cast("double")
    return raw.select(
        first_present(raw, ["src", "source", "from"]).alias("src"), first_present(raw, ["dst", "target", "to"]).alias("dst"),
        first_present(raw, ["relation", "type", "label"]).alias("relation"),
        first_present(raw, ["confidence"]).alias("confidence"), score.alias("confidence_score"), first_present(raw, ["weight"]).try_cast("double").alias("weight"),
        first_present(raw, ["context"]).alias("context"),
        first_present(raw, ["source_file"]).alias("source_file"), first_present(raw, ["source_location"]).alias("source_location"),
        first_present(raw, ["ord"], "long").alias("ord"),
    )


def node_violations(nodes: DataFrame) -> DataFrame:
    """(id, code): a row for every rule that a node breaks."""
    codes = F.array_compact(F.array(
        *(F.when(F.col(c).isNull(), f"missing_{c}") for c in ("id", "label", "file_type", "source_file")),
        F.when(~F.col("file_type").isin(*FILE_TYPES), "invalid_file_type"),
    ))
    return nodes.select("id", F.explode(codes).alias("code"))


def edge_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, code): missing fields, unknown confidences and endpoints that no node has."""
    ids = nodes.select("id").where("id is not null").distinct()
    e = edges.join(ids.select(F.col("id").alias("s_id")), F.col("src") == F.col("s_id"), "left").join(ids.select(F.col("id").alias("d_id")), F.col("dst") == F.col("d_id"), "left")
    codes = F.array_compact(F.array(
        *(F.when(F.col(c).isNull(), f"missing_{c}") for c in ("src", "dst", "relation", "confidence", "source_file")),
        F.when(~F.col("confidence").isin(*CONFIDENCES), "invalid_confidence"),
        F.when(F.col("src").isNotNull() & F.col("s_id").isNull(), "dangling_src"), F.when(F.col("dst").isNotNull() & F.col("d_id").isNull(), "dangling_dst"),
    ))
    return e.select("src", "dst", F.explode(codes).alias("code"))


def upsert_nodes(nodes: DataFrame, order: list[str], conflict: str = "last") -> DataFrame:
    """One row per id. ``last``: per attribute the last value that is not null; ``first``: the first row whole."""
    rest = [c for c in nodes.columns if c != "id" and c not in order]
    key = F.struct(*order)
    if conflict == "first":
        got = nodes.groupBy("id").agg(F.min_by(F.struct(*rest), key).alias("r"))
        return got.select("id", *(F.col(f"r.{c}").alias(c) for c in rest))
    return nodes.groupBy("id").agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(c) for c in rest))


def least_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: the least whole row, columns in order of their names. Array and struct columns compare
    as they are, others by value."""
    rest = sorted(c for c in df.columns if c not in keys)
    if not rest:
        return df.distinct()
    got = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r_"))
    return got.select(*(F.col(c) if c in keys else F.col(f"r_.{c}").alias(c) for c in df.columns))


def normalize_path(path: Column, root: str = "") -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    root = root.rstrip("/") + "/"
    return F.when(p.startswith(root), F.substr(p, F.lit(len(root) + 1))).otherwise(p) if root != "/" else p


def repair_endpoints(edges: DataFrame, nodes: DataFrame, norm=id_of) -> DataFrame:
    """Endpoints that are no node's id take the node whose normal form they share; else the edge goes."""
    ids = nodes.select("id").where("id is not null").distinct()
    forms = ids.select(norm(F.col("id")).alias("form"), F.col("id").alias("fid")).groupBy("form").agg(F.max("fid").alias("fid"))
    out = edges
    for end in ("src", "dst"):
        exact = ids.select(F.col("id").alias("x_id"))
        hit = out.join(exact, F.col(end) == F.col("x_id"), "left")
        miss = hit.withColumn("form_", F.when(F.col("x_id").isNull(), norm(F.col(end))))
        hit = miss.join(forms, F.col("form_") == F.col("form"), "left").withColumn(end, F.coalesce("x_id", "fid"))
        out = hit.where(F.col(end).isNotNull()).select(*edges.columns)
    return out


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an endpoint that no node has."""
    ids = nodes.select(F.col("id").alias("nid")).distinct()
    held = edges.join(ids, F.col("src") == F.col("nid"), "left").withColumnRenamed("nid", "s_").join(ids, F.col("dst") == F.col("nid"), "left")
    return held.where("s_ is null or nid is null").select(*edges.columns)


def without_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("id").alias("nid")).distinct()
    return edges.join(ids, F.col("src") == F.col("nid"), "left_semi").join(ids, F.col("dst") == F.col("nid"), "left_semi")


def collapse_edges(edges: DataFrame, order: list, directed: bool = False) -> DataFrame:
    """The simple graph: one edge per pair, the last row's attributes and direction, and how many there were."""
    a, b = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    got = edges.groupBy(a.alias("u"), b.alias("v")).agg(F.count("*").alias("n_edges"), F.max_by(F.struct("src", "dst", *rest), F.struct(*order)).alias("r"))
    return got.select("u", "v", "n_edges", F.col("r.src").alias("src"), F.col("r.dst").alias("dst"), *(F.col(f"r.{c}").alias(c) for c in rest))


def drop_cross_family_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Inferred calls between files of different language families go. Two unknown suffixes are equal,
    an unknown and a known one differ; a file without a suffix belongs anywhere."""
    ext = nodes.select(F.col("id").alias("nid"), suffix(F.coalesce("source_file", F.lit(""))).alias("ext"))
    e = edges.join(ext.select(F.col("nid").alias("a_id"), F.col("ext").alias("a_x")), F.col("src") == F.col("a_id"),
        "left").join(ext.select(F.col("nid").alias("b_id"), F.col("ext").alias("b_x")), F.col("dst") == F.col("b_id"), "left")
    family = lambda c: F.try_element_at(literal_map(FAMILIES), F.col(c))
    both = (F.coalesce("a_x", F.lit("")) != "") & (F.coalesce("b_x", F.lit("")) != "")
    bad = F.coalesce((F.col("relation") == "calls") & (F.col("confidence") == "INFERRED"), F.lit(False)) & both & ~family("a_x").eqNullSafe(family("b_x"))
    return e.where(~bad).select(*edges.columns)


def prefix_repo(nodes: DataFrame, edges: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    """Ids under ``tag::``; nodes keep their local id and get their repo."""
    local = F.col("local_id") if "local_id" in nodes.columns else F.lit(None).cast("string")
    n = nodes.withColumn("local_id", F.coalesce(local, F.col("id"))).withColumn("repo", F.lit(tag)).withColumn("id", F.concat(F.lit(f"{tag}::"), "id"))
    e = edges.withColumn("src", F.concat(F.lit(f"{tag}::"), "src")).withColumn("dst", F.concat(F.lit(f"{tag}::"), "dst"))
    return n, e


def prune(nodes: DataFrame, edges: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes for which ``gone`` holds go, with every edge at them."""
    kept = nodes.where(~F.coalesce(gone, F.lit(False)))
    return kept, without_dangling(edges, kept)


def compose(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key; the right side's row wins, its nulls included."""
    rest = [c for c in left.columns if c not in keys]
    both = left.withColumn("p_", F.lit(0)).unionByName(right.withColumn("p_", F.lit(1)), allowMissingColumns=True)
    got = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "p_").alias("r"))
    return got.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def union_fragments(fragments: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), fragments)


def merge_first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """First writer wins by key."""
    rest = [c for c in rows.columns if c != key]
    got = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return got.select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def merge_incremental(base: DataFrame, fresh: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Rows of files that were extracted again or deleted leave the base; the fresh ones come in."""
    touched = fresh.select("source_file").distinct()
    if deleted is not None:
        touched = touched.union(deleted.select("source_file")).distinct()
    return base.join(touched, "source_file", "left_anti").unionByName(fresh, allowMissingColumns=True)


def shrinks(before: int, after: int, force: bool = False, deletions: bool = False) -> bool:
    """Whether a write is to be refused for losing nodes."""
    return after < before and not force and not deletions


def hyperedge_members(hyperedges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hyperedge, node) of members that are nodes."""
    m = hyperedges.select(F.col("id").alias("hyperedge"), F.explode("nodes").alias("node"))
    return m.join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("hyperedge", "node")


def attach_hyperedges(held: DataFrame, more: DataFrame) -> DataFrame:
    """Appends hyperedges whose id is not held yet, one per id."""
    new = more.where("id is not null").join(held.select("id"), "id", "left_anti")
    new = least_rows(new, "id")
    return held.unionByName(new, allowMissingColumns=True)


def sentence_like(label: Column) -> Column:
    """At least 80 characters or 8 words, and a sentence mark."""
    long = (F.length(label) >= 80) | (F.size(F.filter(F.split(label, r"\s+"), lambda w: w != "")) >= 8)
    return long & label.rlike("[.!?:]")


def sanitize_fragment(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rationale and concept nodes go. What a sentence-like one gives as a reason becomes ``rationale``
    text of its target; edges at dropped nodes go; hyperedges keep two or more living members."""
    drop = nodes.where(F.col("file_type").isin("rationale", "concept"))
    kept = nodes.where(~F.coalesce(F.col("file_type").isin("rationale", "concept"), F.lit(False)))
    why = (
        edges.where("relation = 'rationale_for'").join(drop.select(F.col("id").alias("src"), "label"), "src").where(sentence_like(F.col("label")))
        .groupBy(F.col("dst").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("label")), "\n\n").alias("why"))
    )
    old = F.col("rationale") if "rationale" in nodes.columns else F.lit(None).cast("string")
    out = kept.join(why, "id", "left").withColumn("rationale", F.when(F.col("why").isNull(), old).otherwise(F.concat_ws("\n\n", old, "why"))).drop("why")
    live = hyperedges.select("id", F.posexplode("nodes").alias("at", "node")).join(kept.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    members = live.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "node"))).alias("m")).where("size(m) >= 2").select("id",
        F.transform("m", lambda x: x["node"]).alias("nodes"))
    return out, without_dangling(edges, kept), hyperedges.drop("nodes").join(members, "id")


def fragment_violations(nodes: DataFrame, max_id: int = 256) -> DataFrame:
    """(id, code) for ids of an untrusted fragment: length, character set, path separators."""
    i = F.col("id")
    codes = F.array_compact(F.array(
        F.when(i.isNull() | (i == ""), "empty_id"), F.when(F.length(i) > max_id, "long_id"), F.when(i.rlike(r"[/\\]"), "path_separator"),
        F.when(~i.rlike(r"^[A-Za-z0-9_.:\-/\\]*$"), "bad_character"),
    ))
    return nodes.select("id", F.explode(codes).alias("code"))


