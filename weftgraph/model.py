"""The property graph as DataFrames, and the star-schema entity graph of the driver tables.

nodes: id, label, file_type, source_file, and ``ord`` (insertion order, from data keys).
edges: src, dst, relation, confidence, confidence_score, context, source_file, source_location, ord.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Score of a confidence where none is stored.
DEFAULT_SCORE = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")


@dataclass
class PropertyGraph:
    nodes: DataFrame
    edges: DataFrame
    directed: bool = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def star_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Entities as nodes: ids ``table:key``; ``community`` is the nation, of parts the size class."""
    t = lambda n: table(spark, sf, n)

    def of(df, kind, key, label, community, file_type="concept", top="geo"):
        return df.select(
            F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("id"), label.alias("label"), F.lit(file_type).alias("file_type"),
            F.lit(f"{top}/{kind}.tbl").alias("source_file"), community.cast("int").alias("community"),
        )

    cust = t("customer")
    orders = t("orders").join(cust.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    parts = [
        of(t("region"), "region", "r_regionkey", F.col("r_name"), F.col("r_regionkey")),
        of(t("nation"), "nation", "n_nationkey", F.col("n_name"), F.col("n_nationkey")),
        of(cust, "customer", "c_custkey", F.col("c_name"), F.col("c_nationkey"), top="party"),
        of(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), F.col("s_nationkey"), top="party"),
        of(t("part"), "part", "p_partkey", F.col("p_name"), F.col("p_size") % 25, top="goods"),
        of(orders, "order", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.col("c_nationkey"), "document", top="trade"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Foreign keys as edges; a line item links its order to the part (contains) and the supplier (uses)."""
    t = lambda n: table(spark, sf, n)
    ref = lambda kind, col: F.concat(F.lit(f"{kind}:"), F.col(col).cast("string"))

    def of(df, src, dst, relation, conf, score, context, file, loc):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"), conf.alias("confidence"), score.alias("confidence_score"), context.alias("context"),
            F.lit(file).alias("source_file"), loc.alias("source_location"))

    ext, one, none = F.lit("EXTRACTED"), F.lit(1.0), F.lit(None).cast("string")
    li = t("lineitem")
    conf = F.when(F.col("l_returnflag") == "A", "INFERRED").when(F.col("l_returnflag") == "R", "AMBIGUOUS").otherwise("EXTRACTED")
    context = F.when(F.col("l_linestatus") == "F", "call").otherwise("import")
    score, loc = 1 - F.col("l_discount"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string"))
    parts = [
        of(t("nation"), ref("nation", "n_nationkey"), ref("region", "n_regionkey"), "part_of", ext, one, none, "geo/nation.tbl", none),
        of(t("customer"), ref("customer", "c_custkey"), ref("nation", "c_nationkey"), "located_in", ext, one, none, "party/customer.tbl", none),
        of(t("supplier"), ref("supplier", "s_suppkey"), ref("nation", "s_nationkey"), "located_in", ext, one, none, "party/supplier.tbl", none),
        of(t("orders"), ref("order", "o_orderkey"), ref("customer", "o_custkey"), "placed_by", ext, one, none, "trade/order.tbl", none),
        of(li, ref("order", "l_orderkey"), ref("part", "l_partkey"), "contains", conf, score, context, "trade/lineitem.tbl", loc),
        of(li, ref("order", "l_orderkey"), ref("supplier", "l_suppkey"), "uses", conf, score, context, "trade/lineitem.tbl", loc),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_graph(spark: SparkSession, sf: str) -> PropertyGraph:
    return PropertyGraph(star_nodes(spark, sf), star_edges(spark, sf))


#: The same graph for DuckDB, as common table expressions.
STAR_SQL = """
nodes AS (
  SELECT 'region:' || r_regionkey AS id, r_name AS label, 'concept' AS file_type, 'geo/region.tbl' AS source_file, CAST(r_regionkey AS INTEGER) AS community FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'concept', 'geo/nation.tbl', CAST(n_nationkey AS INTEGER) FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, c_name, 'concept', 'party/customer.tbl', CAST(c_nationkey AS INTEGER) FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, s_name, 'concept', 'party/supplier.tbl', CAST(s_nationkey AS INTEGER) FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, p_name, 'concept', 'goods/part.tbl', CAST(p_size % 25 AS INTEGER) FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'order ' || o_orderkey, 'document', 'trade/order.tbl', CAST(c_nationkey AS INTEGER) FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
li AS (
  SELECT *, CASE l_returnflag WHEN 'A' THEN 'INFERRED' WHEN 'R' THEN 'AMBIGUOUS' ELSE 'EXTRACTED' END AS conf,
    CASE WHEN l_linestatus = 'F' THEN 'call' ELSE 'import' END AS ctx FROM lineitem),
edges AS (
  SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'part_of' AS relation, 'EXTRACTED' AS confidence, CAST(1.0 AS DOUBLE) AS confidence_score, CAST(NULL AS VARCHAR) AS context, 'geo/nation.tbl' AS source_file, CAST(NULL AS VARCHAR) AS source_location FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located_in', 'EXTRACTED', 1.0, NULL, 'party/customer.tbl', NULL FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 'EXTRACTED', 1.0, NULL, 'party/supplier.tbl', NULL FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', 'EXTRACTED', 1.0, NULL, 'trade/order.tbl', NULL FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains', conf, 1 - l_discount, ctx, 'trade/lineitem.tbl', 'L' || l_linenumber FROM li
  UNION ALL SELECT 'order:' || l_orderkey, 'supplier:' || l_suppkey, 'uses', conf, 1 - l_discount, ctx, 'trade/lineitem.tbl', 'L' || l_linenumber FROM li)
"""
