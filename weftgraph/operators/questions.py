"""Questions a graph suggests, details of a node, and views for rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators import analytics as A
from weftgraph.operators.centrality import node_betweenness

#: Words of node types that name a kind.
KINDS = {
    "klass": ("class", "klass", "struct", "interface", "enum", "trait", "model"), "module": ("module", "file", "package", "namespace"),
    "api": ("endpoint", "route", "api", "handler", "controller"), "test": ("test", "spec"), "ui": ("component", "hook", "view", "page"),
}
#: Suffixes of source files.
CODE_ENDS = (".py", ".ts", ".tsx", ".js", ".jsx", ".go", ".rs", ".java", ".kt", ".rb", ".php", ".cs", ".swift", ".vue", ".svelte")


def explain(nodes: DataFrame, edges: DataFrame, node: str, top: int = 20) -> DataFrame:
    """(direction, other, relation, confidence, degree): a node's connections by the other end's degree."""
    return A.neighbours(edges, node).join(A.degrees(edges).withColumnRenamed("id", "other"), "other").orderBy(F.desc("degree"), "direction", "other",
        "relation").limit(top).select("direction", "other", "relation", "confidence", "degree")


def suggest_questions(nodes: DataFrame, edges: DataFrame, top_n: int = 7, bridges: bool = True) -> DataFrame:
    """(kind, subject, question): at most ``top_n``, by family: ambiguous edges, nodes that bridge
    communities, hubs with inferred edges, isolated nodes, loose communities."""
    spark = nodes.sparkSession
    label = nodes.select("id", "label")
    a = edges.where("confidence = 'AMBIGUOUS'").join(label.withColumnRenamed("id", "src"), "src").withColumnRenamed("label", "sl").join(label.withColumnRenamed("id", "dst"), "dst")
    rows = [(0, "ambiguous_edge", r["sl"], f"What is the exact relation between {r['sl']} and {r['label']}?") for r in a.orderBy("src", "dst", "relation").limit(top_n).collect()]
    if len(rows) >= top_n:  # later families come after these: none of theirs can be among the rows
        return spark.createDataFrame([r[1:] for r in rows], "kind string, subject string, question string")
    if bridges:
        reach = A.community_reach(edges, nodes)
        b = node_betweenness(edges).where("betweenness > 0").join(reach.where("reach > 1"), "id").join(label, "id").orderBy(F.desc(F.round("betweenness", 9)), "id").limit(3)
        rows += [(1, "bridge_node", r["label"], f"Why does {r['label']} connect {r['reach']} communities?") for r in b.collect()]
    inferred = edges.where("confidence = 'INFERRED'").select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("n")).where("n >= 2")
    d = A.with_degree(nodes, edges)
    top = d.where(~A.is_file_node(F.col("label"), F.col("source_file"), F.col("degree"))).orderBy(F.desc("degree"), "id").limit(5)
    rows += [(2, "verify_inferred", r["label"], f"Are the {r['n']} inferred relations of {r['label']} correct?") for r in top.join(inferred, "id").orderBy(F.desc("degree"),
        "id").collect()]
    lone = d.where("degree <= 1").where(~A.is_file_node(F.col("label"), F.col("source_file"),
        F.col("degree")) & ~A.is_concept_node(F.col("source_file"))).orderBy("id").limit(3).collect()
    if lone:
        names = ", ".join(r["label"] for r in lone)
        rows.append((3, "isolated_nodes", names, f"What connects {names} to the rest?"))
    pairs = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    loose = A.cohesion(pairs, nodes).where("cohesion < 0.15 and n >= 5").orderBy("community").limit(top_n)
    rows += [(4, "low_cohesion", str(r["community"]), f"Should community {r['community']} be split?") for r in loose.collect()]
    if not rows:
        rows = [(5, "no_signal", "", "Not enough signal to suggest questions.")]
    kept = [r[1:] for r in sorted(rows, key=lambda r: r[0])][:top_n]
    return spark.createDataFrame(kept, "kind string, subject string, question string")


def node_kind(label: Column, source_file: Column, file_type: Column, node_type: Column) -> Column:
    """klass, module, api, test, ui, concept, entry, async or function; the first rule that fits."""
    low, src = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(source_file, F.lit("")))
    raw, ntype, ftype = F.coalesce(label, F.lit("")), F.lower(F.coalesce(node_type, F.lit(""))), F.lower(F.coalesce(file_type, F.lit("")))
    any_of = lambda words: F.coalesce(low.rlike("|".join(words)), F.lit(False))
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(ntype.isin(*KINDS[kind]), kind).otherwise(out)
    ends = F.lit(False)
    for e in CODE_ENDS:
        ends = ends | raw.endswith(e)
    rest = (
        F.when(ftype.isin("rationale", "document"), "concept").when(src.contains("test") | low.startswith("test_") | src.contains("spec"),
        "test").when(any_of(("endpoint", "router", "api", "route")), "api")
        .when(any_of(("cli", "command", "click", "typer")), "entry").when(any_of(("async", "await", "stream", "sse")), "async")
        .when(any_of(("component", "props", "hook", "store")) | raw.rlike("^use[A-Z_-]") | src.rlike(r"\.(tsx|jsx|vue|svelte)$"),
        "ui").when(raw.rlike(r"^\p{Lu}") & ~raw.endswith("()"), "klass").when(ends, "module").otherwise("function")
    )
    return F.coalesce(out, rest)


def canvas(nodes: DataFrame, width: int = 400, height: int = 200) -> DataFrame:
    """(id, x, y): a grid per community, ceil(sqrt(n)) wide, communities below each other in order.

    Positions within a community need its order: the window is per community."""
    n = nodes.groupBy("community").agg(F.count("*").alias("n"))
    side = n.withColumn("cols", F.ceil(F.sqrt("n")).cast("int")).withColumn("rows", F.ceil(F.col("n") / F.ceil(F.sqrt("n"))).cast("int"))
    # one row per community passes one task: a running sum needs it
    top = side.withColumn("top", F.coalesce(F.sum(F.col("rows") + 1).over(Window.orderBy("community").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    k = nodes.select("id", "community", (F.row_number().over(Window.partitionBy("community").orderBy("id")) - 1).alias("k")).join(top, "community")
    return k.select("id", (F.col("k") % F.col("cols") * width).cast("long").alias("x"), ((F.floor(F.col("k") / F.col("cols")) + F.col("top")) * height).cast("long").alias("y"))


def note_names(nodes: DataFrame) -> DataFrame:
    """(id, name): file names of notes; equal ones are numbered from 1 after the first."""
    base = F.trim(F.regexp_replace("label", r'[\\/*?:"<>|#^\[\]]', ""))
    w = Window.partitionBy(F.lower(base)).orderBy("id")
    return nodes.select("id", base.alias("b"), (F.row_number().over(w) - 1).alias("k")).select("id",
        F.when(F.col("k") == 0, F.col("b")).otherwise(F.concat_ws("_", "b", F.col("k").cast("string"))).alias("name"))


def sections(nodes: DataFrame, archetypes: dict[str, tuple[str, ...]], most: int = 12) -> DataFrame:
    """(community, section): the archetype whose words the labels of a community say most, at least
    twice; communities beyond the ``most`` largest and those without one are ``other``."""
    text = F.lower(F.concat_ws(" ", "label", "source_file"))
    hits = F.array(*(F.struct(F.lit(k).alias("k"), F.regexp_count(text, F.lit("|".join(words))).alias("n")) for k, words in archetypes.items()))
    flat = nodes.select("community", F.explode(hits).alias("h")).groupBy("community", F.col("h.k").alias("k")).agg(F.sum("h.n").alias("n")).where("n >= 2")
    best = flat.groupBy("community").agg(F.min_by("k", F.struct(-F.col("n"), F.col("k"))).alias("section"))
    size = nodes.groupBy("community").count().orderBy(F.desc("count"), "community").limit(most)
    return nodes.select("community").distinct().join(best.join(size, "community", "left_semi"), "community", "left").select("community",
        F.coalesce("section", F.lit("other")).alias("section"))
