"""Degrees, hubs, audits, community metrics, surprises, diagnostics and reviews of change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import basename, suffix
from weftgraph.operators.build import literal_map
from weftgraph.sources.corpus import CODE, IMAGE, PAPER

#: Keys of JSON files that are no concepts.
JSON_NOISE = (
    "start", "end", "name", "id", "type", "properties", "value", "key", "data", "items", "title", "description", "version", "dependencies", "devdependencies", "peerdependencies",
    "optionaldependencies",
    "bundleddependencies", "bundledependencies",
)
#: Language families for surprises, by suffix.
LANGUAGES = {
    ".py": "python", ".pyw": "python", ".js": "js", ".jsx": "js", ".mjs": "js", ".ejs": "js", ".ts": "js", ".tsx": "js", ".vue": "js", ".svelte": "js", ".go": "go", ".rs": "rust",
    ".java": "jvm", ".kt": "jvm", ".kts": "jvm", ".scala": "jvm",
    ".c": "c", ".h": "c", ".cpp": "c", ".cc": "c", ".cxx": "c", ".hpp": "c", ".rb": "ruby", ".swift": "swift", ".cs": "dotnet", ".php": "php", ".r": "r",
}
#: Relations that only say how a program is built.
STRUCTURAL = ("imports", "imports_from", "contains", "method")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree); a self-loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    """Label is the file's name, or a method or function stub."""
    label = F.coalesce(label, F.lit(""))
    return (label != "") & ((label == basename(source_file)) | (label.startswith(".") & label.endswith("()")) | (label.endswith("()") & (degree <= 1)))


def is_concept_node(source_file: Column) -> Column:
    return F.coalesce(source_file, F.lit("")).eqNullSafe("") | ~basename(source_file).contains(".")


def is_json_key(label: Column, source_file: Column) -> Column:
    return F.coalesce(source_file.endswith(".json") & F.lower(label).isin(*JSON_NOISE), F.lit(False))


def god_nodes(nodes: DataFrame, edges: DataFrame, top_n: int = 10, order: str = "id") -> DataFrame:
    """The nodes of highest degree that are things, not files, stubs, bare concepts or manifest keys."""
    d = with_degree(nodes, edges)
    skip = is_file_node(F.col("label"), F.col("source_file"), F.col("degree")) | is_concept_node(F.col("source_file")) | is_json_key(F.col("label"), F.col("source_file"))
    return d.where(~skip).select("id", "label", "degree").orderBy(F.desc("degree"), order).limit(top_n)


def confidence_audit(edges: DataFrame) -> DataFrame:
    """Edges and half-even rounded percentage per confidence; none stored counts as EXTRACTED."""
    c = edges.groupBy(F.coalesce("confidence", F.lit("EXTRACTED")).alias("confidence")).agg(F.count("*").alias("n_edges"))
    share = F.bround(100.0 * F.col("n_edges") / F.sum("n_edges").over(Window.partitionBy(F.lit(1))), 0).cast("long")
    return c.withColumn("pct", share)


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n_nodes"), F.count_distinct("community").alias("n_communities"))
    e = edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("confidence") == "INFERRED").alias("n_inferred"),
        F.count_if(F.col("confidence") == "AMBIGUOUS").alias("n_ambiguous"))
    return n.join(F.broadcast(e))  # one row each


def inferred_score(edges: DataFrame) -> DataFrame:
    return edges.where("confidence = 'INFERRED'").agg(F.count("*").alias("n_edges"), F.round(F.avg(F.coalesce("confidence_score", F.lit(0.5))), 2).alias("avg_score"))


def with_communities(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    c = nodes.select("id", "community")
    return edges.join(c.select(F.col("id").alias("src"), F.col("community").alias("cu")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("cv")), "dst")


def community_meta_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Quotient graph: edges between two different communities."""
    return with_communities(edges, nodes).where("cu <> cv").groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.count("*").alias("n_edges"))


def cohesion(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Share of possible pairs that are edges, per community; 1 for one node. ``pairs``: a simple graph (u, v)."""
    size = nodes.groupBy("community").agg(F.count("*").alias("n"))
    inner = with_communities(pairs.select(F.col("u").alias("src"), F.col("v").alias("dst")),
        nodes).where("cu = cv").groupBy(F.col("cu").alias("community")).agg(F.count("*").alias("m"))
    return size.join(inner, "community", "left").select(
        "community", "n", F.coalesce("m", F.lit(0).cast("long")).alias("m"),
        F.when(F.col("n") <= 1, 1.0).otherwise(F.round(F.coalesce("m", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2.0), 9)).alias("cohesion"),
    )


def top_communities_of(edges: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """Per community its k most linked others, both directions counted."""
    both = with_communities(edges, nodes).where("cu <> cv")
    flat = both.select(F.col("cu").alias("community"), F.col("cv").alias("other")).union(both.select("cv", "cu")).groupBy("community", "other").agg(F.count("*").alias("links"))
    w = Window.partitionBy("community").orderBy(F.desc("links"), "other")
    return flat.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dominant_confidence(edges: DataFrame) -> DataFrame:
    """The most frequent confidence at each node, ties to the first name."""
    flat = edges.select(F.explode(F.array("src", "dst")).alias("id"), "confidence").groupBy("id", "confidence").agg(F.count("*").alias("n"))
    return flat.groupBy("id").agg(F.min_by("confidence", F.struct(-F.col("n"), F.col("confidence"))).alias("confidence"))


def community_reach(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct communities among a node's neighbours."""
    e = with_communities(edges, nodes)
    return e.select(F.col("src").alias("id"), F.col("cv").alias("c")).union(e.select("dst", "cu")).groupBy("id").agg(F.count_distinct("c").alias("reach"))


def neighbours(edges: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    """Out, then in neighbours of a node, by choice only relations that contain a string."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), "relation", "confidence")
    inn = edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("other"), "relation", "confidence")
    both = out.union(inn)
    return both.where(F.lower("relation").contains(relation.lower())) if relation else both


def neighbours_by_relation(edges: DataFrame, k: int = 20) -> DataFrame:
    """Per node and relation its first k distinct neighbours."""
    both = edges.select(F.col("src").alias("id"), "relation", F.col("dst").alias("other")).union(edges.select("dst", "relation", "src")).distinct()
    w = Window.partitionBy("id", "relation").orderBy("other")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knowledge_gaps(nodes: DataFrame, edges: DataFrame, thin: int = 3) -> DataFrame:
    """One row: nodes of degree at most one, communities under ``thin`` nodes, share of ambiguous edges and whether it is high."""
    iso = with_degree(nodes, edges).agg(F.count_if(F.col("degree") <= 1).alias("n_isolated"))
    thin_c = nodes.groupBy("community").count().agg(F.count_if(F.col("count") < thin).alias("n_thin"))
    amb = edges.agg(F.round(100.0 * F.count_if(F.col("confidence") == "AMBIGUOUS") / F.count("*"), 3).alias("pct_ambiguous"))
    return iso.join(F.broadcast(thin_c)).join(F.broadcast(amb)).withColumn("high_ambiguity", F.col("pct_ambiguous") > 20)


def top_level_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise(path)


def file_category(path: Column) -> Column:
    """code, paper, image or doc, by the last suffix."""
    ext = F.when(path.contains("."), F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))).otherwise("")
    return F.when(ext.isin(*sorted(CODE)), "code").when(ext.isin(*sorted(PAPER)), "paper").when(ext.isin(*sorted(IMAGE)), "image").otherwise("doc")


def cross_language(a: Column, b: Column) -> Column:
    """Both suffixes are of known families, and these differ."""
    fa, fb = (F.try_element_at(literal_map(LANGUAGES), suffix(c)) for c in (a, b))
    return F.coalesce(fa != fb, F.lit(False))


def scored_surprises(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between files with their surprise score: how uncertain, and how far apart the ends are."""
    d = with_degree(nodes, edges).select("id", "label", "source_file", "community", "degree")
    e = edges.where(~F.coalesce(F.col("relation").isin(*STRUCTURAL), F.lit(False)))
    e = e.join(d.select(*(F.col(c).alias(f"u_{c}") for c in d.columns)), F.col("src") == F.col("u_id")).join(d.select(*(F.col(c).alias(f"v_{c}") for c in d.columns)),
        F.col("dst") == F.col("v_id"))
    for p in ("u", "v"):
        e = e.where(~is_concept_node(F.col(f"{p}_source_file")) & ~is_file_node(F.col(f"{p}_label"), F.col(f"{p}_source_file"), F.col(f"{p}_degree")))
    e = e.where("u_source_file <> v_source_file")
    base = F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1)
    cu, cv = file_category(F.col("u_source_file")), file_category(F.col("v_source_file"))
    apart = cross_language(F.col("u_source_file"), F.col("v_source_file")) | F.array_sort(F.array(cu, cv)).eqNullSafe(F.array(F.lit("code"), F.lit("doc")))
    guessed = (F.col("confidence") == "INFERRED") & F.col("relation").isin("calls", "uses") & apart
    far = F.when(cu != cv, 2).otherwise(0) + F.when(top_level_dir(F.col("u_source_file")) != top_level_dir(F.col("v_source_file")),
        2).otherwise(0) + F.when(F.col("u_community") != F.col("v_community"), 1).otherwise(0)
    s = base + F.when(guessed, 0).otherwise(far)
    s = F.when(~guessed & (F.col("relation") == "semantically_similar_to"), F.floor(s * 1.5).cast("int")).otherwise(s)
    lo, hi = F.least("u_degree", "v_degree"), F.greatest("u_degree", "v_degree")
    return e.withColumn("surprise", (s + F.when((lo <= 2) & (hi >= 5), 1).otherwise(0)).cast("int"))


def confidence_rank(c: Column) -> Column:
    return F.when(c == "AMBIGUOUS", 0).when(c == "INFERRED", 1).when(c == "EXTRACTED", 2).otherwise(3)


def cross_community_surprises(edges: DataFrame, nodes: DataFrame, order: list) -> DataFrame:
    """The least certain edge of every pair of communities."""
    e = with_communities(edges.where(~F.coalesce(F.col("relation").isin(*STRUCTURAL), F.lit(False))), nodes).where("cu <> cv")
    rest = ["src", "dst", "relation", "confidence"]
    got = e.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.min_by(F.struct(*rest),
        F.struct(confidence_rank(F.col("confidence")), *order)).alias("r"))
    return got.select("a", "b", *(F.col(f"r.{c}").alias(c) for c in rest))


def graph_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(change, key columns): rows of one side only."""
    o, n = old.select(*keys).distinct(), new.select(*keys).distinct()
    return n.join(o, keys, "left_anti").select(F.lit("added").alias("change"), *keys).unionByName(o.join(n, keys, "left_anti").select(F.lit("removed").alias("change"), *keys))


def edge_key(edges: DataFrame) -> DataFrame:
    """Undirected identity of an edge: sorted ends and relation."""
    return edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "relation")


def diagnostics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of counts on how edges would collapse: missing and dangling ends, self-loops, exact repeats, pairs.

    Edges are read once: equal rows are counted first, then the rows of a directed pair, and the ends are
    looked up per pair; the totals and the undirected pairs come from these.
    """
    ids = nodes.select("id").where("id is not null").distinct()
    rows = edges.groupBy(*edges.columns).agg(F.count("*").alias("n"))
    differ = lambda c: (F.min(c) != F.max(c)).cast("int")
    pairs = rows.groupBy("src", "dst").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), differ("relation").alias("r"), differ("source_location").alias("l"))
    pairs = pairs.join(ids.select(F.col("id").alias("s_id")), F.col("src") == F.col("s_id"), "left").join(ids.select(F.col("id").alias("d_id")), F.col("dst") == F.col("d_id"),
        "left")
    missing = F.col("src").isNull() | F.col("dst").isNull()
    valid = F.col("s_id").isNotNull() & F.col("d_id").isNotNull()
    told = pairs.select("src", "dst", "n", "kinds", "r", "l", missing.alias("missing"), valid.alias("valid"), F.when(valid, F.least("src", "dst")).alias("a"),
        F.when(valid, F.greatest("src", "dst")).alias("b"))
    some = lambda cond, c="n": F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    ok = F.col("valid")
    per = told.groupBy("a", "b").agg(
        some(F.lit(True)).alias("n_raw"), some(F.col("missing")).alias("n_missing"), some(~F.col("missing") & ~ok).alias("n_dangling"), some(ok).alias("n_valid"),
        some(ok & (F.col("src") == F.col("dst"))).alias("n_self_loops"), F.coalesce(F.sum(F.when(ok, F.col("n") - F.col("kinds"))), F.lit(0)).alias("n_exact_repeats"),
        F.count_if(ok).alias("n_directed_pairs"), F.coalesce(F.sum(F.when(ok, F.col("n") - 1)), F.lit(0)).alias("n_collapsed"),
        F.count_if(ok & (F.col("n") > 1)).alias("n_same_pair_groups"),
        some(ok, "r").alias("n_relation_variants"), some(ok, "l").alias("n_location_variants"), F.max(ok.cast("int")).cast("long").alias("n_undirected_pairs"),
    )
    return per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per.columns if c not in ("a", "b")))


def tree_rollup(nodes: DataFrame) -> DataFrame:
    """(path, depth, total): nodes under every path prefix, the root being empty."""
    parts = F.split("source_file", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), i.alias("depth")))
    # pre-aggregated by file, so a hot file is one row before the explode
    files = nodes.where("source_file is not null").groupBy("source_file").agg(F.count("*").alias("n"))
    return files.select(F.explode(prefixes).alias("p"), "n").groupBy(F.col("p.path").alias("path"), F.col("p.depth").alias("depth")).agg(F.sum("n").alias("total"))


def section_summary(edges: DataFrame, sections: DataFrame) -> DataFrame:
    """Edges by class (intra, inter, orphan), pair of sections and relation. ``sections``: (id, section)."""
    s = sections.select("id", "section")
    e = edges.join(s.select(F.col("id").alias("src"), F.col("section").alias("a")), "src", "left").join(s.select(F.col("id").alias("dst"), F.col("section").alias("b")), "dst",
        "left")
    kind = F.when(F.col("a").isNull() | F.col("b").isNull(), "orphan").when(F.col("a") == F.col("b"), "intra").otherwise("inter")
    return e.groupBy(kind.alias("kind"), "a", "b", "relation").agg(F.count("*").alias("n_edges"))


def change_impact(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per change set the distinct communities and nodes of the files it touches.

    A path fits if it equals a node's file or either ends with ``/`` and the other: both sides explode
    into their suffixes, so the match is an equi-join. ``files``: (number, path).
    """
    def suffixes(c: str) -> Column:
        p = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, i, F.size(p)), "/"))

    f = files.select("number", "path").distinct()
    g = nodes.where("source_file is not null").groupBy("source_file", "community").agg(F.count("*").alias("n"))
    names = g.select("source_file").distinct()
    one = f.withColumn("k", F.explode(suffixes("path"))).join(names.withColumnRenamed("source_file", "k"), "k").select("number", F.col("k").alias("source_file"))
    two = names.withColumn("k", F.explode(suffixes("source_file"))).join(f.withColumnRenamed("path", "k"), "k").select("number", "source_file")
    hit = one.union(two).distinct().join(g, "source_file")
    return hit.groupBy("number").agg(F.count_distinct("community").alias("n_communities"), F.sum("n").alias("n_nodes"))


def change_conflicts(touched: DataFrame) -> DataFrame:
    """Communities that more than one change set touches. ``touched``: (number, community)."""
    return touched.distinct().groupBy("community").agg(F.count("*").alias("n_changes"), F.min("number").alias("first_change")).where("n_changes > 1")


def change_status(rows: DataFrame, now: Column, stale_days: int = 14) -> DataFrame:
    """Adds ``age_days`` and ``status``, the first that holds of WRONG-BASE, CI-FAIL, CHANGES-REQ, DRAFT, STALE, APPROVED, PENDING, READY."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp("updated_at")) / 86400)
    status = (
        F.when(F.col("base_branch") != F.col("expected_base"), "WRONG-BASE").when(F.col("ci_status") == "FAILURE", "CI-FAIL").when(F.col("review_decision") == "CHANGES_REQUESTED",
        "CHANGES-REQ")
        .when(F.col("is_draft"), "DRAFT").when(age >= stale_days, "STALE").when(F.col("review_decision") == "APPROVED", "APPROVED").when(F.col("ci_status") == "PENDING",
        "PENDING").otherwise("READY")
    )
    return rows.withColumn("age_days", age.cast("long")).withColumn("status", status)


def community_labels(nodes: DataFrame, top_n: int = 4, order: str = "id") -> DataFrame:
    w = Window.partitionBy("community").orderBy(order)
    first = nodes.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= top_n)
    return first.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_", "label"))), lambda x: x["label"]), ", ").alias("labels"))
