"""Sinks: tables, node-link JSON, Cypher, GraphML, Markdown reports, wiki and trees.

Row-shaped outputs stay distributed (one line per row, written by Spark); only bounded reports are
put together on the driver."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import cypher_name, cypher_text, safe_label
from weftgraph.model import DEFAULT_SCORE
from weftgraph.operators import analytics as A


def with_scores(edges: DataFrame) -> DataFrame:
    """confidence_score filled by confidence where there is none."""
    default = F.lit(1.0)
    for c, v in DEFAULT_SCORE.items():
        default = F.when(F.col("confidence") == c, v).otherwise(default)
    held = F.col("confidence_score") if "confidence_score" in edges.columns else F.lit(None).cast("double")
    return edges.withColumn("confidence_score", F.coalesce(held, default))


def write_tables(nodes: DataFrame, edges: DataFrame, path: str, before: int | None = None, force: bool = False) -> int:
    """Parquet tables ``nodes`` and ``edges``; refuses to write fewer nodes than ``before``. Gives the number of nodes."""
    n = nodes.count()
    if before is not None and n < before and not force:
        raise ValueError(f"refusing to shrink the graph from {before} to {n} nodes")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    with_scores(edges).write.mode("overwrite").parquet(f"{path}/edges")
    return n


def node_link_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): a line per node and link in node-link form."""
    n = nodes.withColumn("norm_label", F.lower("label"))
    e = with_scores(edges).withColumnRenamed("src", "source").withColumnRenamed("dst", "target")
    return n.select(F.lit("node").alias("kind"), F.to_json(F.struct(*n.columns)).alias("json")).union(e.select(F.lit("link"), F.to_json(F.struct(*e.columns))))


def write_json(nodes: DataFrame, edges: DataFrame, path: str, limit: int = 500_000, directed: bool = False) -> None:
    """One node-link file, streamed through the driver; refuses graphs over ``limit`` rows, for which the tables are."""
    rows = node_link_rows(nodes, edges)
    if rows.limit(limit + 1).count() > limit:
        raise ValueError(f"a single JSON file is for at most {limit} rows; use write_tables")
    parts: dict[str, list[str]] = {"node": [], "link": []}
    for r in rows.toLocalIterator():
        parts[r["kind"]].append(r["json"])
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"directed": %s, "multigraph": false, "graph": {}, "nodes": [%s], "links": [%s]}' % (json.dumps(directed), ",".join(sorted(parts["node"])),
            ",".join(sorted(parts["link"]))))


def read_json(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link file; ``edges`` for ``links`` is understood, (source, target) become (src, dst)."""
    doc = spark.read.option("multiLine", True).json(path)
    key = "links" if "links" in doc.columns else "edges"
    n = doc.select(F.explode("nodes").alias("n")).select("n.*")
    e = doc.select(F.explode(key).alias("e")).select("e.*")
    return n, e.withColumnRenamed("source", "src").withColumnRenamed("target", "dst")


def cypher_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): a MERGE per node, then one per edge."""
    q = lambda c: F.concat(F.lit("'"), cypher_text(F.coalesce(F.col(c), F.lit(""))), F.lit("'"))
    kind = cypher_name(F.initcap("file_type"), "Entity")
    n = nodes.select(F.concat(F.lit("MERGE (n:"), kind, F.lit(" {id: "), q("id"), F.lit(", label: "), q("label"), F.lit("});")).alias("line"))
    rel = cypher_name(F.upper("relation"), "RELATES_TO")
    e = edges.select(F.concat(F.lit("MATCH (a {id: "), q("src"), F.lit("}), (b {id: "), q("dst"), F.lit("}) MERGE (a)-[:"), rel, F.lit(" {confidence: "), q("confidence"),
        F.lit("}]->(b);")).alias("line"))
    return n.union(e)


def xml_text(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): node and edge elements; a missing community is -1."""
    n = nodes.select(F.concat(F.lit('<node id="'), xml_text(F.col("id")), F.lit('"><data key="label">'), xml_text(F.col("label")), F.lit('</data><data key="community">'),
        F.coalesce("community", F.lit(-1)).cast("string"), F.lit("</data></node>")).alias("line"))
    e = edges.select(F.concat(F.lit('<edge source="'), xml_text(F.col("src")), F.lit('" target="'), xml_text(F.col("dst")), F.lit('"><data key="relation">'),
        xml_text(F.col("relation")), F.lit("</data></edge>")).alias("line"))
    return n.union(e)


def wiki_pages(nodes: DataFrame, edges: DataFrame, members: int = 25) -> DataFrame:
    """(page, text): a Markdown article per community with its first members by degree and its sources."""
    from pyspark.sql.window import Window

    d = A.with_degree(nodes, edges)
    w = Window.partitionBy("community").orderBy(F.desc("degree"), "id")
    top = d.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= members)
    line = F.concat(F.lit("- **"), safe_label(F.col("label")), F.lit("** ("), F.col("degree").cast("string"), F.lit(" links)"))
    lines = top.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    total = nodes.groupBy("community").count()
    return lines.join(total, "community").select(F.concat(F.lit("community_"), F.col("community").cast("string")).alias("page"),
        F.concat(F.lit("# Community "), F.col("community").cast("string"), F.lit("\n\n"), F.col("count").cast("string"), F.lit(" nodes\n\n"), "body").alias("text"))


def report(nodes: DataFrame, edges: DataFrame, top: int = 10) -> str:
    """A Markdown report from bounded frames: audit, hubs, surprises and gaps."""
    s = A.graph_stats(nodes, edges).first()
    out = ["# Graph report", "", f"{s['n_nodes']} nodes, {s['n_edges']} edges, {s['n_communities']} communities", "", "## Confidence", ""]
    out += [f"- {r['confidence']}: {r['n_edges']} ({r['pct']} %)" for r in A.confidence_audit(edges).orderBy("confidence").collect()]
    out += ["", "## Hubs", ""] + [f"- {r['label']} ({r['degree']})" for r in A.god_nodes(nodes, edges, top).collect()]
    best = A.scored_surprises(edges, nodes).select("u_label", "v_label", "relation", "surprise").orderBy(F.desc("surprise"), "u_label", "v_label").limit(top)
    out += ["", "## Surprising connections", ""] + [f"- {r['u_label']} {r['relation']} {r['v_label']} ({r['surprise']})" for r in best.collect()]
    g = A.knowledge_gaps(nodes, edges).first()
    out += ["", "## Gaps", "", f"- isolated nodes: {g['n_isolated']}", f"- thin communities: {g['n_thin']}", f"- ambiguous: {g['pct_ambiguous']} %"]
    return "\n".join(out) + "\n"


def write_lines(df: DataFrame, path: str) -> None:
    """A text file per partition."""
    df.select(df.columns[0]).write.mode("overwrite").text(path)
