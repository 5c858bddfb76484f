"""Graphs of several repositories in one, and symbol indexes as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.build import least_rows, prefix_repo, without_dangling


def global_add(nodes: DataFrame, edges: DataFrame, repo_nodes: DataFrame, repo_edges: DataFrame, tag: str, rewire: bool = False) -> tuple[DataFrame, DataFrame]:
    """The global graph with one repository's put in anew. Nodes without a source file that the global
    graph has under the same label are not added; their edges go, or with ``rewire`` move there."""
    kept = nodes.where((F.col("repo") != tag) | F.col("repo").isNull())
    held = without_dangling(edges, kept)
    n, e = prefix_repo(repo_nodes, repo_edges, tag)
    known = kept.where("coalesce(source_file, '') = ''").groupBy("label").agg(F.min("id").alias("old"))
    twin = n.where("coalesce(source_file, '') = ''").join(known, "label").select(F.col("id").alias("gone"), "old")
    fresh = n.join(twin.withColumnRenamed("gone", "id"), "id", "left_anti")
    if rewire:
        for end in ("src", "dst"):
            e = e.join(twin.select(F.col("gone").alias(end), F.col("old").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    out = kept.unionByName(fresh, allowMissingColumns=True)
    return out, held.unionByName(without_dangling(e, out), allowMissingColumns=True)


def global_remove(nodes: DataFrame, edges: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where((F.col("repo") != tag) | F.col("repo").isNull())
    return kept, without_dangling(edges, kept)


def global_list(nodes: DataFrame) -> DataFrame:
    return nodes.where("repo is not null").groupBy("repo").agg(F.count("*").alias("n_nodes"))


#: Relation of each true flag of a symbol relationship, the first that holds.
RELATIONS = (("is_implementation", "scip_impl"), ("is_type_definition", "scip_typed"), ("is_definition", "scip_def"), ("is_reference", "scip_ref"))


def symbol_index(symbols: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a symbol index. ``symbols``: (path, symbol, display_name, line);
    ``relationships``: (path, symbol, target, is_*). A target is the symbol of the same document, else
    the only one of that name, else a stub node without a source file."""
    node_id = lambda p, s: F.concat(F.lit("scip_"), F.substring(F.sha2(F.concat_ws("|", p, s), 256), 1, 16))
    s = least_rows(symbols.where("symbol is not null and symbol <> ''"), "path", "symbol").withColumn("id", node_id(F.col("path"), F.col("symbol")))
    r = relationships.where("target is not null and target <> ''")
    kind = F.lit(None).cast("string")
    for flag, relation in reversed(RELATIONS):
        kind = F.when(F.col(flag).eqNullSafe(True), relation).otherwise(kind)
    r = r.withColumn("relation", kind).where("relation is not null")
    same = s.select("path", F.col("symbol").alias("target"), F.col("id").alias("same_id"))
    only = s.groupBy(F.col("symbol").alias("target")).agg(F.count("*").alias("n"), F.min("id").alias("only_id")).where("n = 1").drop("n")
    e = r.join(same, ["path", "target"], "left").join(only, "target", "left").withColumn("stub", F.concat(F.lit("scip_stub_"), F.substring(F.sha2("target", 256), 1, 16)))
    e = e.withColumn("dst", F.coalesce("same_id", "only_id", "stub")).withColumn("src", node_id(F.col("path"), F.col("symbol"))).join(s.select(F.col("id").alias("src")), "src",
        "left_semi")
    stubs = e.where(F.col("dst") == F.col("stub")).select(F.col("dst").alias("id"), F.col("target").alias("label")).distinct()
    nodes = s.select("id", F.coalesce("display_name", "symbol").alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"),
        F.when(F.col("line").isNotNull(), F.concat(F.lit("L"), F.col("line").cast("string"))).alias("source_location"))
    nodes = nodes.unionByName(stubs.select("id", "label", F.lit("concept").alias("file_type"), F.lit("").alias("source_file"), F.lit(None).cast("string").alias("source_location")))
    return nodes, e.where("src <> dst").select("src", "dst", "relation", F.lit("EXTRACTED").alias("confidence"), F.col("path").alias("source_file")).distinct()
