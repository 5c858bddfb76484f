"""Queries over the star-schema entity graph, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.model import STAR_SQL, star_edges, star_nodes, table
from weftgraph.operators import analytics as A
from weftgraph.operators import build as B
from weftgraph.operators import dedup as D
from weftgraph.operators import search as S
from weftgraph.operators import traverse as V
from weftgraph.operators.components import connected_components as components

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
EDGE_ORDER = ["confidence_score", "source_location", "src", "dst", "relation", "confidence", "context"]
_ORD = "ROW(confidence_score, coalesce(source_location, ''), src, dst, relation, confidence, coalesce(context, ''))"


def query(sql: str | None = None, star: bool = True, recursive: bool = False):
    """Registers a query under its function's name, with SQL over the star graph's expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            if star:
                body = f"WITH {'RECURSIVE ' * recursive}{STAR_SQL}{', ' + body if not body.startswith('SELECT') else body}"
            ORACLE_SQL[f.__name__] = body
        return f

    return add


def _order() -> list:
    return [F.col("confidence_score"), F.coalesce("source_location", F.lit("")), F.col("src"), F.col("dst"), F.col("relation"), F.col("confidence"),
        F.coalesce("context", F.lit(""))]


_DEG = "d AS (SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"
_CC = "c AS (SELECT e.*, a.community AS cu, b.community AS cv FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst)"


@query(f"{_DEG} SELECT * FROM d")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return A.degrees(star_edges(spark, sf))


@query(f"{_DEG} SELECT id, label, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN d USING (id) ORDER BY degree DESC, id LIMIT 20")
def god_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return A.god_nodes(star_nodes(spark, sf), star_edges(spark, sf), 20)


@query("SELECT confidence, CAST(count(*) AS BIGINT) AS n_edges, CAST(round_even(100.0 * count(*) / sum(count(*)) OVER (), 0) AS BIGINT) AS pct FROM edges GROUP BY 1")
def confidence_audit(spark, sf):
    return A.confidence_audit(star_edges(spark, sf))


@query("SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT community) FROM nodes) AS n_communities, count(*) AS n_edges, count(*) FILTER (confidence = 'INFERRED') AS n_inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS n_ambiguous FROM edges")
def graph_stats(spark, sf):
    return A.graph_stats(star_nodes(spark, sf), star_edges(spark, sf))


@query("SELECT count(*) AS n_edges, round(avg(confidence_score), 2) AS avg_score FROM edges WHERE confidence = 'INFERRED'")
def inferred_avg_score(spark, sf):
    return A.inferred_score(star_edges(spark, sf))


@query(f"{_CC} SELECT least(cu, cv) AS a, greatest(cu, cv) AS b, count(*) AS n_edges FROM c WHERE cu <> cv GROUP BY 1, 2")
def community_meta_graph(spark, sf):
    return A.community_meta_graph(star_edges(spark, sf), star_nodes(spark, sf))


@query("""p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM edges),
i AS (SELECT a.community, count(*) AS m FROM p JOIN nodes a ON a.id = u JOIN nodes b ON b.id = v WHERE a.community = b.community GROUP BY 1)
SELECT n.community, n.n, coalesce(m, 0) AS m, CASE WHEN n.n <= 1 THEN 1.0 ELSE round(coalesce(m, 0) / (n.n * (n.n - 1) / 2.0), 9) END AS cohesion
FROM (SELECT community, count(*) AS n FROM nodes GROUP BY 1) n LEFT JOIN i USING (community)""")
def cohesion(spark, sf):
    e = star_edges(spark, sf)
    pairs = e.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    return A.cohesion(pairs, star_nodes(spark, sf))


@query(f"""{_CC}, f AS (SELECT cu AS community, cv AS other FROM c WHERE cu <> cv UNION ALL SELECT cv, cu FROM c WHERE cu <> cv),
g AS (SELECT community, other, count(*) AS links FROM f GROUP BY 1, 2)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY community ORDER BY links DESC, other) AS INTEGER) AS rank FROM g) WHERE rank <= 12""")
def cross_community_links(spark, sf):
    return A.top_communities_of(star_edges(spark, sf), star_nodes(spark, sf), 12)


@query("""f AS (SELECT src AS id, confidence FROM edges UNION ALL SELECT dst, confidence FROM edges), g AS (SELECT id, confidence, count(*) AS n FROM f GROUP BY 1, 2)
SELECT id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, confidence) AS k FROM g) WHERE k = 1""")
def dominant_confidence(spark, sf):
    return A.dominant_confidence(star_edges(spark, sf))


@query(f"{_CC} SELECT id, count(DISTINCT x) AS reach FROM (SELECT src AS id, cv AS x FROM c UNION ALL SELECT dst, cu FROM c) GROUP BY 1")
def community_reach(spark, sf):
    return A.community_reach(star_edges(spark, sf), star_nodes(spark, sf))


@query("""b AS (SELECT src AS id, relation, dst AS other FROM edges UNION SELECT dst, relation, src FROM edges)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id, relation ORDER BY other) AS INTEGER) AS rank FROM b) WHERE rank <= 20""")
def neighbors_by_relation_topk(spark, sf):
    return A.neighbours_by_relation(star_edges(spark, sf), 20)


@query("SELECT 'out' AS direction, dst AS other, relation, confidence FROM edges WHERE src = 'order:1' UNION ALL SELECT 'in', src, relation, confidence FROM edges WHERE dst = 'order:1'")
def get_neighbors(spark, sf):
    return A.neighbours(star_edges(spark, sf), "order:1")


@query(f"""{_DEG} SELECT (SELECT count(*) FROM nodes LEFT JOIN d USING (id) WHERE coalesce(degree, 0) <= 1) AS n_isolated,
(SELECT count(*) FROM (SELECT community FROM nodes GROUP BY 1 HAVING count(*) < 3)) AS n_thin, round(100.0 * count(*) FILTER (confidence = 'AMBIGUOUS') / count(*), 3) AS pct_ambiguous,
round(100.0 * count(*) FILTER (confidence = 'AMBIGUOUS') / count(*), 3) > 20 AS high_ambiguity FROM edges""")
def knowledge_gaps(spark, sf):
    return A.knowledge_gaps(star_nodes(spark, sf), star_edges(spark, sf))


def _even_parts(spark, sf):
    """Nodes without the odd parts, so that edges dangle."""
    return star_nodes(spark, sf).where("not (id like 'part:%' and cast(substring(id, 6) as bigint) % 2 = 1)")


_EVEN = "kept AS (SELECT * FROM nodes WHERE NOT (id LIKE 'part:%' AND coalesce(TRY_CAST(substr(id, 6) AS BIGINT) % 2 = 1, false)))"


@query(f"{_EVEN} SELECT relation, count(*) AS n FROM edges WHERE src NOT IN (SELECT id FROM kept) OR dst NOT IN (SELECT id FROM kept) GROUP BY 1")
def dangling_edges(spark, sf):
    return B.dangling_edges(star_edges(spark, sf), _even_parts(spark, sf)).groupBy("relation").agg(F.count("*").alias("n"))


@query(f"""{_EVEN}, m AS (SELECT CASE WHEN relation = 'placed_by' THEN upper(replace(src, ':', '-')) ELSE src END AS s0, dst, relation FROM edges),
f AS (SELECT lower(regexp_replace(id, '[^A-Za-z0-9]+', '_', 'g')) AS form, max(id) AS fid FROM kept GROUP BY 1)
SELECT coalesce(k.id, f.fid) AS src, m.dst, relation FROM m LEFT JOIN kept k ON k.id = s0 LEFT JOIN f ON f.form = lower(regexp_replace(s0, '[^A-Za-z0-9]+', '_', 'g')) JOIN kept k2 ON k2.id = m.dst WHERE coalesce(k.id, f.fid) IS NOT NULL""")
def endpoint_repair(spark, sf):
    e = star_edges(spark, sf).select(F.when(F.col("relation") == "placed_by", F.upper(F.replace("src", F.lit(":"), F.lit("-")))).otherwise(F.col("src")).alias("src"), "dst",
        "relation")
    norm = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"))  # noqa: E731  all ids here are ASCII
    return B.repair_endpoints(e, _even_parts(spark, sf), norm)


def _supplier_part(spark, sf):
    li = table(spark, sf, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"),
        F.col("l_quantity").alias("weight"), key.alias("ord"))


_COLLAPSE = """g AS (SELECT 'supplier:' || l_suppkey AS src, 'part:' || l_partkey AS dst, l_quantity AS weight, ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ord FROM lineitem),
r AS (SELECT *, count(*) OVER w0 AS n_edges, row_number() OVER (PARTITION BY {u}, {v} ORDER BY ord DESC) AS k FROM g WINDOW w0 AS (PARTITION BY {u}, {v}))
SELECT {u} AS u, {v} AS v, n_edges, src, dst, weight FROM r WHERE k = 1"""


@query(_COLLAPSE.format(u="least(src, dst)", v="greatest(src, dst)"))
def edge_collapse_undirected(spark, sf):
    return B.collapse_edges(_supplier_part(spark, sf), ["ord"]).drop("ord")


@query(_COLLAPSE.format(u="src", v="dst"))
def edge_collapse_directed(spark, sf):
    return B.collapse_edges(_supplier_part(spark, sf), ["ord"], directed=True).drop("ord")


@query("""SELECT 'supplier:' || l_suppkey AS id, max_by(l_shipdate, ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) AS seen,
max_by(l_tax, ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)) FILTER (l_returnflag = 'R') AS tax FROM lineitem GROUP BY 1""")
def node_upsert_last(spark, sf):
    li = table(spark, sf, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = li.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("id"), F.col("l_shipdate").alias("seen"),
        F.when(F.col("l_returnflag") == "R", F.col("l_tax")).alias("tax"), key.alias("ord"))
    return B.upsert_nodes(rows, ["ord"])


@query("""SELECT id, seen, tax FROM (SELECT 'supplier:' || l_suppkey AS id, l_shipdate AS seen, l_tax AS tax, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS k FROM lineitem) WHERE k = 1""")
def node_upsert_first(spark, sf):
    li = table(spark, sf, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = li.select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("id"), F.col("l_shipdate").alias("seen"), F.col("l_tax").alias("tax"), key.alias("ord"))
    return B.upsert_nodes(rows, ["ord"], "first")


@query("""SELECT 'missing_label' AS code, count(*) AS n FROM part WHERE p_size % 7 = 0 UNION ALL SELECT 'invalid_file_type', count(*) FROM part WHERE p_size % 5 = 0""")
def validate_nodes(spark, sf):
    raw = table(spark, sf, "part").select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("label"),
        F.when(F.col("p_size") % 5 == 0, "thing").otherwise("concept").alias("file_type"), F.lit("part.tbl").alias("source_file"),
    )
    return B.node_violations(raw).groupBy("code").agg(F.count("*").alias("n"))


@query(f"{_EVEN} SELECT 'dangling_dst' AS code, count(*) AS n FROM edges WHERE dst NOT IN (SELECT id FROM kept) UNION ALL SELECT 'missing_relation', count(*) FROM edges WHERE relation = 'uses'")
def validate_edges(spark, sf):
    e = star_edges(spark, sf).withColumn("relation", F.when(F.col("relation") != "uses", F.col("relation")))
    return B.edge_violations(e, _even_parts(spark, sf)).groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT 'acme::' || id AS id, label, id AS local_id, 'acme' AS repo FROM nodes")
def prefix_repo(spark, sf):
    return B.prefix_repo(star_nodes(spark, sf), star_edges(spark, sf), "acme")[0].select("id", "label", "local_id", "repo")


@query("SELECT relation, count(*) AS n FROM edges WHERE src NOT LIKE 'supplier:%' AND dst NOT LIKE 'supplier:%' GROUP BY 1")
def prune_source(spark, sf):
    _, e = B.prune(star_nodes(spark, sf), star_edges(spark, sf), F.col("source_file") == "party/supplier.tbl")
    return e.groupBy("relation").agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN id LIKE 'nation:%' THEN 'new ' || label ELSE label END AS label FROM nodes WHERE file_type = 'concept' UNION ALL SELECT 'extra:1', 'extra'")
def graph_compose(spark, sf):
    left = star_nodes(spark, sf).where("file_type = 'concept'").select("id", "label")
    right = left.where("id like 'nation:%'").select("id", F.concat(F.lit("new "), "label").alias("label"))
    return B.compose(left, right.union(spark.createDataFrame([("extra:1", "extra")], right.schema)), ["id"])


@query("SELECT 'order:' || l_orderkey AS hyperedge, 'part:' || l_partkey AS node FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 2 = 0)")
def hyperedge_members(spark, sf):
    li = table(spark, sf, "lineitem")
    h = li.groupBy(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")).alias("id")).agg(F.collect_set(F.concat(F.lit("part:"),
        F.col("l_partkey").cast("string"))).alias("nodes"))
    return B.hyperedge_members(h, _even_parts(spark, sf))


@query("""l AS (SELECT 'part:' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'src/a.py' WHEN p_size % 3 = 1 THEN 'src/b.ts' ELSE 'x/readme' END AS f FROM part),
s AS (SELECT id, CASE regexp_extract(f, '\\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'ts' THEN 'js' END AS fam FROM l)
SELECT confidence, count(*) AS n FROM (SELECT 'part:' || a.l_partkey AS src, 'part:' || b.l_partkey AS dst, a.conf AS confidence FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2) e
JOIN s x ON x.id = src JOIN s y ON y.id = dst WHERE NOT (confidence = 'INFERRED' AND x.fam IS NOT NULL AND y.fam IS NOT NULL AND x.fam <> y.fam) GROUP BY 1""")
def cross_family_filter(spark, sf):
    nodes = table(spark, sf, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_size") % 3 == 0, "src/a.py").when(F.col("p_size") % 3 == 1, "src/b.ts").otherwise("x/readme").alias("source_file"))
    li = table(spark, sf, "lineitem")
    conf = F.when(F.col("l_returnflag") == "A", "INFERRED").when(F.col("l_returnflag") == "R", "AMBIGUOUS").otherwise("EXTRACTED")
    a = li.where("l_linenumber = 1").select("l_orderkey", F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("src"), conf.alias("confidence"))
    b = li.where("l_linenumber = 2").select("l_orderkey", F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("dst"))
    e = a.join(b, "l_orderkey").withColumn("relation", F.lit("calls"))
    return B.drop_cross_family_calls(e, nodes).groupBy("confidence").agg(F.count("*").alias("n"))


@query(f"""{_EVEN}, v AS (SELECT e.*, src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept) AS ok FROM edges e), g AS (SELECT * FROM v WHERE ok),
p AS (SELECT src, dst, count(*) AS n, count(DISTINCT relation) AS r, count(DISTINCT source_location) AS l FROM g GROUP BY 1, 2),
w AS (SELECT count(*) AS n FROM g GROUP BY src, dst, relation, confidence, confidence_score, context, source_file, source_location)
SELECT (SELECT count(*) FROM v) AS n_raw, CAST(0 AS BIGINT) AS n_missing, (SELECT count(*) FROM v WHERE NOT ok) AS n_dangling, (SELECT count(*) FROM g) AS n_valid, (SELECT count(*) FROM g WHERE src = dst) AS n_self_loops,
(SELECT CAST(sum(n - 1) AS BIGINT) FROM w) AS n_exact_repeats, count(*) AS n_directed_pairs, CAST(sum(n - 1) AS BIGINT) AS n_collapsed, count(*) FILTER (n > 1) AS n_same_pair_groups, count(*) FILTER (r > 1) AS n_relation_variants,
count(*) FILTER (l > 1) AS n_location_variants, (SELECT count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM g)) AS n_undirected_pairs FROM p""")
def diagnostics_summary(spark, sf):
    return A.diagnostics(star_edges(spark, sf), _even_parts(spark, sf))


@query("""SELECT '' AS path, 0 AS depth, count(*) AS total FROM nodes UNION ALL SELECT split_part(source_file, '/', 1), 1, count(*) FROM nodes GROUP BY 1 UNION ALL SELECT source_file, 2, count(*) FROM nodes GROUP BY 1""")
def file_tree_rollup(spark, sf):
    return A.tree_rollup(star_nodes(spark, sf))


@query("""s AS (SELECT id, split_part(source_file, '/', 1) AS section FROM nodes WHERE source_file <> 'geo/region.tbl')
SELECT CASE WHEN a.section IS NULL OR b.section IS NULL THEN 'orphan' WHEN a.section = b.section THEN 'intra' ELSE 'inter' END AS kind, a.section AS a, b.section AS b, relation, count(*) AS n_edges
FROM edges LEFT JOIN s a ON a.id = src LEFT JOIN s b ON b.id = dst GROUP BY 1, 2, 3, 4""")
def section_edge_summary(spark, sf):
    n = star_nodes(spark, sf).where("source_file <> 'geo/region.tbl'")
    return A.section_summary(star_edges(spark, sf), n.select("id", A.top_level_dir(F.col("source_file")).alias("section")))


_PRS = "pr(number, path) AS (VALUES (1, 'party/customer.tbl'), (1, 'customer.tbl'), (2, 'repo/trade/order.tbl'), (2, 'geo/nation.tbl'), (3, 'xorder.tbl'), (3, 'nation.tbl'))"
_PR_ROWS = [(1, "party/customer.tbl"), (1, "customer.tbl"), (2, "repo/trade/order.tbl"), (2, "geo/nation.tbl"), (3, "xorder.tbl"), (3, "nation.tbl")]


@query(f"""{_PRS}, f AS (SELECT DISTINCT source_file FROM nodes), h AS (SELECT DISTINCT number, source_file FROM pr JOIN f ON path = source_file OR ends_with(path, '/' || source_file) OR ends_with(source_file, '/' || path))
SELECT number, count(DISTINCT community) AS n_communities, count(*) AS n_nodes FROM h JOIN nodes USING (source_file) GROUP BY 1""")
def pr_impact(spark, sf):
    return A.change_impact(spark.createDataFrame(_PR_ROWS, "number int, path string"), star_nodes(spark, sf))


@query("SELECT n_nationkey AS community, count(DISTINCT c_mktsegment) AS n_changes, min(c_mktsegment) AS first_change FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 9000 GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1", star=False)
def pr_conflicts(spark, sf):
    return A.change_conflicts(table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_mktsegment").alias("number"), F.col("c_nationkey").alias("community")))


@query("""SELECT status, count(*) AS n, CAST(sum(age_days) AS BIGINT) AS ages FROM (SELECT CAST(floor((epoch(TIMESTAMP '1999-01-01') - floor(epoch(o_orderdate))) / 86400) AS BIGINT) AS age_days,
CASE WHEN o_orderkey % 11 = 0 THEN 'WRONG-BASE' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'CI-FAIL' WHEN o_orderpriority LIKE '1%' THEN 'CHANGES-REQ' WHEN o_orderkey % 7 = 0 THEN 'DRAFT'
WHEN floor((epoch(TIMESTAMP '1999-01-01') - floor(epoch(o_orderdate))) / 86400) >= 14 THEN 'STALE' WHEN o_orderpriority LIKE '2%' THEN 'APPROVED' ELSE 'READY' END AS status FROM orders) GROUP BY 1""", star=False)
def pr_status(spark, sf):
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 11 == 0, "dev").otherwise("main").alias("base_branch"), F.lit("main").alias("expected_base"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0), "FAILURE").otherwise("SUCCESS").alias("ci_status"),
        F.when(F.col("o_orderpriority").startswith("1"), "CHANGES_REQUESTED").when(F.col("o_orderpriority").startswith("2"), "APPROVED").alias("review_decision"),
        (F.col("o_orderkey") % 7 == 0).alias("is_draft"), F.col("o_orderdate").alias("updated_at"),
    )
    return A.change_status(o, F.to_timestamp(F.lit("1999-01-01"))).groupBy("status").agg(F.count("*").alias("n"), F.sum("age_days").alias("ages"))


_TERMS = ["steel", "order", "blue"]


@query("n AS (SELECT count(*) AS n FROM nodes), t(term) AS (VALUES ('steel'), ('order'), ('blue')), f AS (SELECT term, (SELECT count(*) FROM nodes WHERE contains(lower(label), term)) AS df FROM t) SELECT term, df, round(ln(1 + n / (1 + df)), 9) AS idf FROM f, n")
def idf(spark, sf):
    return S.idf(star_nodes(spark, sf), _TERMS).select("term", "df", F.round("idf", 9).alias("idf"))


_SCORE = """n AS (SELECT count(*) AS n FROM nodes), t(term) AS (VALUES ('nation'), ('order'), ('1')), f AS (SELECT term, ln(1 + n / (1 + (SELECT count(*) FROM nodes WHERE contains(lower(label), term)))) AS w FROM t, n),
q AS (SELECT id, label, round(sum(w * (CASE WHEN lower(label) = term OR trim(regexp_replace(lower(label), '[()]+$', '')) = term THEN 1000 WHEN starts_with(lower(label), term) THEN 100 WHEN contains(lower(label), term) THEN 1 ELSE 0 END) + CASE WHEN contains(lower(source_file), term) THEN 0.5 * w ELSE 0 END), 6) AS score FROM nodes, f GROUP BY 1, 2)"""


@query(f"{_SCORE} SELECT id, label, score FROM q WHERE score > 0")
def score_nodes(spark, sf):
    return S.score_nodes(star_nodes(spark, sf), ["nation", "order", "1"])


@query(f"{_SCORE}, k AS (SELECT * FROM q WHERE score > 0 ORDER BY score DESC, id DESC LIMIT 3) SELECT id, label, score FROM k WHERE score >= 0.2 * (SELECT max(score) FROM k)")
def pick_seeds(spark, sf):
    return S.pick_seeds(S.score_nodes(star_nodes(spark, sf), ["nation", "order", "1"]))


@query("SELECT id, label, tier FROM (SELECT id, label, CASE WHEN lower(label) = 'order 1' OR lower(id) = 'order 1' THEN 0 WHEN starts_with(lower(label), 'order 1') THEN 1 WHEN contains(lower(label), 'order 1') THEN 2 END AS tier FROM nodes) WHERE tier IS NOT NULL ORDER BY tier, id LIMIT 20")
def find_node_tiers(spark, sf):
    return S.find_node(star_nodes(spark, sf), "Order 1")


@query("SELECT id, 1 AS tier FROM nodes WHERE lower(label) = 'order 2' AND (SELECT count(*) FROM nodes WHERE lower(label) = 'order 2') = 1 AND NOT EXISTS (SELECT 1 FROM nodes WHERE id = 'Order 2')")
def resolve_seed(spark, sf):
    return S.resolve_seed(star_nodes(spark, sf), "Order 2")


@query("""q AS (SELECT id || ' ' || label AS line FROM nodes ORDER BY line LIMIT 2000), r AS (SELECT line, sum(length(line) + 1) OVER (ORDER BY line ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT line, CAST(upto AS BIGINT) AS upto FROM r WHERE upto <= 2000""")
def render_budget(spark, sf):
    lines = star_nodes(spark, sf).select(F.concat_ws(" ", "id", "label").alias("line"))
    return S.render_budget(lines, ["line"], 2000)


_BFS = """b AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges),
reach(id, depth) AS (SELECT 'customer:1', 0 UNION SELECT v, depth + 1 FROM reach JOIN b ON u = id WHERE depth < {depth} {more})
SELECT id, min(depth) AS depth FROM reach GROUP BY 1"""


@query(_BFS.format(depth=2, more=""), recursive=True)
def bfs_depth2(spark, sf):
    return V.bfs(star_edges(spark, sf), spark.createDataFrame([("customer:1",)], "id string"), 2)


@query(_DEG + ", hub AS (SELECT id AS h FROM d WHERE degree >= 50), " + _BFS.format(depth=3, more="AND (depth = 0 OR id NOT IN (SELECT h FROM hub))"), recursive=True)
def bfs_hub_capped(spark, sf):
    return V.bfs(star_edges(spark, sf), spark.createDataFrame([("customer:1",)], "id string"), 3, hub=50)


@query("""r AS (SELECT dst AS u, src AS v, relation FROM edges WHERE relation = 'uses'), l1 AS (SELECT v AS id, min(relation) AS via FROM r WHERE u = 'supplier:1' GROUP BY 1) SELECT id, 1 AS depth, via FROM l1""")
def reverse_affected(spark, sf):
    return V.affected(star_edges(spark, sf), spark.createDataFrame([("supplier:1",)], "id string"), 2)


@query("""b AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges), reach(id, depth) AS (SELECT 'region:0', 0 UNION SELECT v, depth + 1 FROM reach JOIN b ON u = id WHERE depth < 6) SELECT min(depth) AS hops FROM reach WHERE id = 'order:1'""", recursive=True)
def shortest_path_len(spark, sf):
    return V.shortest_path(star_edges(spark, sf), "region:0", "order:1").agg(F.max("hop").alias("hops"))


@query("""b AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges), reach(id, depth) AS (SELECT 'customer:1', 0 UNION SELECT v, depth + 1 FROM reach JOIN b ON u = id WHERE depth < 4),
dist AS (SELECT id, min(depth) AS depth FROM reach GROUP BY 1),
h0 AS (SELECT id, depth AS hop FROM dist WHERE id = 'supplier:1'), h1 AS (SELECT min(b.u) AS id, any_value(h.hop) - 1 AS hop FROM b JOIN h0 h ON b.v = h.id JOIN dist d ON d.id = b.u AND d.depth = h.hop - 1), h2 AS (SELECT min(b.u) AS id, any_value(h.hop) - 1 AS hop FROM b JOIN h1 h ON b.v = h.id JOIN dist d ON d.id = b.u AND d.depth = h.hop - 1), h3 AS (SELECT min(b.u) AS id, any_value(h.hop) - 1 AS hop FROM b JOIN h2 h ON b.v = h.id JOIN dist d ON d.id = b.u AND d.depth = h.hop - 1), h4 AS (SELECT min(b.u) AS id, any_value(h.hop) - 1 AS hop FROM b JOIN h3 h ON b.v = h.id JOIN dist d ON d.id = b.u AND d.depth = h.hop - 1), h5 AS (SELECT min(b.u) AS id, any_value(h.hop) - 1 AS hop FROM b JOIN h4 h ON b.v = h.id JOIN dist d ON d.id = b.u AND d.depth = h.hop - 1), h6 AS (SELECT min(b.u) AS id, any_value(h.hop) - 1 AS hop FROM b JOIN h5 h ON b.v = h.id JOIN dist d ON d.id = b.u AND d.depth = h.hop - 1)
SELECT CAST(hop AS INTEGER) AS hop, id FROM h0 WHERE id IS NOT NULL UNION ALL SELECT CAST(hop AS INTEGER) AS hop, id FROM h1 WHERE id IS NOT NULL UNION ALL SELECT CAST(hop AS INTEGER) AS hop, id FROM h2 WHERE id IS NOT NULL UNION ALL SELECT CAST(hop AS INTEGER) AS hop, id FROM h3 WHERE id IS NOT NULL UNION ALL SELECT CAST(hop AS INTEGER) AS hop, id FROM h4 WHERE id IS NOT NULL UNION ALL SELECT CAST(hop AS INTEGER) AS hop, id FROM h5 WHERE id IS NOT NULL UNION ALL SELECT CAST(hop AS INTEGER) AS hop, id FROM h6 WHERE id IS NOT NULL""", recursive=True)
def shortest_path(spark, sf):
    return V.shortest_path(star_edges(spark, sf), "customer:1", "supplier:1")


@query()
def dfs_trace(spark, sf):
    return V.dfs(star_edges(spark, sf), ["customer:1"], 2)


@query("""k AS (SELECT 'region:' || n_regionkey AS r, n_nationkey AS k FROM nation), t AS (SELECT DISTINCT r, r AS node FROM k UNION ALL SELECT r, 'nation:' || k FROM k UNION ALL SELECT r, 'customer:' || c_custkey FROM customer JOIN k ON k = c_nationkey
UNION ALL SELECT r, 'supplier:' || s_suppkey FROM supplier JOIN k ON k = s_nationkey UNION ALL SELECT r, 'order:' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN k ON k = c_nationkey)
SELECT node, min(node) OVER (PARTITION BY r) AS component FROM t""")
def connected_components_geo(spark, sf):
    """Everything but line items: one component per region."""
    return components(star_edges(spark, sf).where(~F.col("relation").isin("contains", "uses")))


@query()
def connected_components(spark, sf):
    return components(star_edges(spark, sf))


@query("""b AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges), near AS (SELECT 'customer:1' AS id UNION SELECT v FROM b WHERE u = 'customer:1' UNION SELECT y.v FROM b x JOIN b y ON y.u = x.v WHERE x.u = 'customer:1')
SELECT DISTINCT src, dst, relation FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)""")
def ego_net(spark, sf):
    e = star_edges(spark, sf)
    near = V.bfs(e, spark.createDataFrame([("customer:1",)], "id string"), 2).select("id")
    inner = e.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return inner.select("src", "dst", "relation").distinct()


@query("SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS form, count(*) AS n, count(DISTINCT p_brand) AS n_sources FROM part GROUP BY 1", star=False)
def label_norm_groups(spark, sf):
    return table(spark, sf, "part").groupBy(T.ascii_label(F.col("p_name")).alias("form")).agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_sources"))


@query("SELECT DISTINCT p_name AS label, round(entropy(c), 9) AS bits FROM (SELECT p_name, unnest(string_split(p_name, '')) AS c FROM (SELECT DISTINCT p_name FROM part)) GROUP BY 1", star=False)
def label_entropy(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("label")).distinct().select("label", F.round(T.shannon_bits(F.col("label")), 9).alias("bits"))


@query("SELECT p_name AS label, list_sort(list_distinct(list_transform(range(1, greatest(2, length(p_name) - 1)), lambda i: substr(p_name, i, 3)))) AS grams FROM (SELECT DISTINCT p_name FROM part)", star=False)
def shingles(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("label")).distinct().select("label", F.array_sort(T.shingles(F.col("label"))).alias("grams"))


_JAC = """l AS (SELECT DISTINCT p_name AS t FROM part), s AS (SELECT t, list_distinct(list_transform(range(1, greatest(2, length(replace(t, ' ', '')) - 1)), lambda i: substr(replace(t, ' ', ''), i, 3))) AS g FROM l)"""


@query(f"WITH {_JAC} SELECT x.t AS a, y.t AS b, round(len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))), 9) AS jaccard FROM s x JOIN s y ON x.t < y.t WHERE jaccard >= 0.3", star=False)
def jaccard_pairs(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_name").alias("key"), F.col("p_name").alias("text")).distinct()
    return D.jaccard_pairs(items, 0.3).select("a", "b", F.round("jaccard", 9).alias("jaccard")).where("jaccard >= 0.3")


@query("SELECT x.t AS a, y.t AS b, round(jaro_winkler_similarity(x.t, y.t), 6) AS jw FROM (SELECT DISTINCT p_name AS t FROM part) x JOIN (SELECT DISTINCT p_name AS t FROM part) y ON x.t < y.t WHERE jaro_winkler_similarity(x.t, y.t) >= 0.8", star=False)
def jaro_winkler_all_pairs(spark, sf):
    p = D.tie_break_pairs(table(spark, sf, "part").select(F.col("p_name").alias("text")), 0.8, 2.0)
    return p.select("a", "b", F.round("jw", 6).alias("jw"))


@query("""m AS (SELECT p_name AS component, 'p' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '_c1' ELSE '' END AS node FROM part)
SELECT component, node AS winner FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY node LIKE '%\\_c1' ESCAPE '\\', length(node), node) AS k FROM m) WHERE k = 1""")
def dedup_survivors(spark, sf):
    m = table(spark, sf, "part").select(F.col("p_name").alias("component"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "_c1").otherwise("")).alias("node"))
    return D.survivors(m)


@query("""r AS (SELECT 'part:' || p_partkey AS old, 'part:' || min(p_partkey) OVER (PARTITION BY p_name) AS new FROM part)
SELECT relation, coalesce(b.new, dst) AS dst, count(*) AS n FROM edges LEFT JOIN r b ON b.old = dst GROUP BY 1, 2""")
def edge_rewire(spark, sf):
    p = table(spark, sf, "part")
    least = p.groupBy("p_name").agg(F.min("p_partkey").alias("m"))
    remap = p.join(least, "p_name").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("old"),
        F.concat(F.lit("part:"), F.col("m").cast("string")).alias("new"))
    return D.rewire(star_edges(spark, sf), remap).groupBy("relation", "dst").agg(F.count("*").alias("n"))


@query()
def entity_dedup(spark, sf):
    return D.deduplicate(star_nodes(spark, sf), star_edges(spark, sf), T.ascii_label(F.col("label")))[0]


_SURPRISE = f"""{_DEG}, e AS (SELECT e.*, a.community AS cu, b.community AS cv, da.degree AS du, db.degree AS dv, a.source_file AS fu, b.source_file AS fv FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst JOIN d da ON da.id = src JOIN d db ON db.id = dst WHERE relation NOT IN ('imports', 'imports_from', 'contains', 'method') AND a.source_file <> b.source_file),
s AS (SELECT *, CAST(CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN split_part(fu, '/', 1) <> split_part(fv, '/', 1) THEN 2 ELSE 0 END + CASE WHEN cu <> cv THEN 1 ELSE 0 END + CASE WHEN least(du, dv) <= 2 AND greatest(du, dv) >= 5 THEN 1 ELSE 0 END AS INTEGER) AS surprise FROM e)"""


@query(f"{_SURPRISE} SELECT relation, confidence, surprise, count(*) AS n FROM s GROUP BY 1, 2, 3")
def surprise_score(spark, sf):
    return A.scored_surprises(star_edges(spark, sf), star_nodes(spark, sf)).groupBy("relation", "confidence", "surprise").agg(F.count("*").alias("n"))


@query(f"{_SURPRISE} SELECT DISTINCT src, dst, relation, surprise FROM s ORDER BY surprise DESC, src, dst, relation LIMIT 20")
def cross_file_surprises(spark, sf):
    return A.scored_surprises(star_edges(spark, sf), star_nodes(spark, sf)).select("src", "dst", "relation", "surprise").distinct().orderBy(F.desc("surprise"), "src", "dst",
        "relation").limit(20)


@query(f"""{_CC}, k AS (SELECT *, row_number() OVER (PARTITION BY least(cu, cv), greatest(cu, cv) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, src, dst, relation) AS r FROM c WHERE cu <> cv AND relation NOT IN ('imports', 'imports_from', 'contains', 'method'))
SELECT least(cu, cv) AS a, greatest(cu, cv) AS b, src, dst, relation, confidence FROM k WHERE r = 1""")
def cross_community_surprises(spark, sf):
    return A.cross_community_surprises(star_edges(spark, sf), star_nodes(spark, sf), ["src", "dst", "relation"])


@query("SELECT 'removed' AS change, id FROM nodes WHERE id LIKE 'part:%' AND coalesce(TRY_CAST(substr(id, 6) AS BIGINT) % 2 = 1, false) UNION ALL SELECT 'added', 'extra:1'")
def graph_diff_nodes(spark, sf):
    new = _even_parts(spark, sf).select("id").union(spark.createDataFrame([("extra:1",)], "id string"))
    return A.graph_diff(star_nodes(spark, sf), new, ["id"])


@query("""o AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v, relation FROM edges), n AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v, CASE WHEN relation = 'part_of' THEN 'in' ELSE relation END AS relation FROM edges)
SELECT 'added' AS change, * FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT 'removed', * FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""")
def graph_diff_edges(spark, sf):
    e = star_edges(spark, sf)
    new = e.withColumn("relation", F.when(F.col("relation") == "part_of", "in").otherwise(F.col("relation")))
    return A.graph_diff(A.edge_key(e), A.edge_key(new), ["u", "v", "relation"])


@query("SELECT community, string_agg(label, ', ' ORDER BY k) AS labels FROM (SELECT community, label, row_number() OVER (PARTITION BY community ORDER BY id) AS k FROM nodes) WHERE k <= 4 GROUP BY 1")
def community_labels(spark, sf):
    return A.community_labels(star_nodes(spark, sf))


@query("SELECT a.community AS old, b.community AS new, count(*) AS overlap FROM nodes a JOIN (SELECT id, community % 10 AS community FROM nodes) b USING (id) GROUP BY 1, 2")
def community_overlap(spark, sf):
    from weftgraph.operators.community import overlap

    n = star_nodes(spark, sf).select(F.col("id").alias("node"), "community")
    return overlap(n, n.withColumn("community", F.col("community") % 10))


@query()
def louvain(spark, sf):
    from weftgraph.operators.community import communities

    return communities(star_nodes(spark, sf), star_edges(spark, sf))
