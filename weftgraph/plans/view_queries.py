"""Queries of details, suggestions, views and federated graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.model import STAR_SQL, star_edges, star_nodes, table
from weftgraph.operators import community as M
from weftgraph.operators import federation as G
from weftgraph.operators import questions as Q

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            sep = " " if sql.startswith("SELECT") else ", "
            ORACLE_SQL[f.__name__] = f"WITH {STAR_SQL}{sep}{sql}"
        return f

    return add


@query("""d AS (SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
n AS (SELECT 'out' AS direction, dst AS other, relation, confidence FROM edges WHERE src = 'supplier:3' UNION ALL SELECT 'in', src, relation, confidence FROM edges WHERE dst = 'supplier:3')
SELECT direction, other, relation, degree FROM n JOIN d ON d.id = other ORDER BY degree DESC, direction, other, relation LIMIT 20""")
def explain_node(spark, sf):
    return Q.explain(star_nodes(spark, sf), star_edges(spark, sf), "supplier:3").drop("confidence")


@query()
def suggest_questions(spark, sf):
    return Q.suggest_questions(star_nodes(spark, sf), star_edges(spark, sf))


@query(r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN file_type = 'document' THEN 'concept' WHEN regexp_matches(lower(label), 'endpoint|router|api|route') THEN 'api' WHEN regexp_matches(lower(label), 'cli|command|click|typer') THEN 'entry'
WHEN regexp_matches(lower(label), 'async|await|stream|sse') THEN 'async' WHEN regexp_matches(lower(label), 'component|props|hook|store') THEN 'ui' WHEN regexp_matches(label, '^\p{Lu}') THEN 'klass' ELSE 'function' END AS kind FROM nodes) GROUP BY 1""")
def node_kinds(spark, sf):
    k = Q.node_kind(F.col("label"), F.col("source_file"), F.col("file_type"), F.lit(None).cast("string"))
    return star_nodes(spark, sf).groupBy(k.alias("kind")).agg(F.count("*").alias("n"))


@query(r"""SELECT id, CASE WHEN k = 0 THEN b ELSE b || '_' || k END AS name FROM (SELECT id, b, row_number() OVER (PARTITION BY lower(b) ORDER BY id) - 1 AS k FROM (SELECT id, trim(regexp_replace(label, '[\\/*?:"<>|#^\[\]]', '', 'g')) AS b FROM nodes))""")
def note_names(spark, sf):
    return Q.note_names(star_nodes(spark, sf))


@query("""n AS (SELECT community, count(*) AS n FROM nodes GROUP BY 1), s AS (SELECT *, CAST(ceil(sqrt(n)) AS INTEGER) AS cols, CAST(ceil(n / ceil(sqrt(n))) AS INTEGER) AS rs FROM n),
t AS (SELECT *, coalesce(sum(rs + 1) OVER (ORDER BY community ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM s),
k AS (SELECT id, community, row_number() OVER (PARTITION BY community ORDER BY id) - 1 AS k FROM nodes)
SELECT id, CAST(k % cols * 400 AS BIGINT) AS x, CAST((k // cols + top) * 200 AS BIGINT) AS y FROM k JOIN t USING (community)""")
def canvas_grid(spark, sf):
    return Q.canvas(star_nodes(spark, sf))


@query("""h AS (SELECT community, 'parties' AS k, sum(len(regexp_extract_all(lower(label || ' ' || source_file), 'customer|supplier'))) AS n FROM nodes GROUP BY 1 UNION ALL SELECT community, 'goods', sum(len(regexp_extract_all(lower(label || ' ' || source_file), 'steel|blue|goods'))) FROM nodes GROUP BY 1),
b AS (SELECT community, k, row_number() OVER (PARTITION BY community ORDER BY n DESC, k) AS r FROM h WHERE n >= 2), z AS (SELECT community FROM nodes GROUP BY 1 ORDER BY count(*) DESC, community LIMIT 12)
SELECT c.community, coalesce(b.k, 'other') AS section FROM (SELECT DISTINCT community FROM nodes) c LEFT JOIN b ON b.community = c.community AND b.r = 1 AND b.community IN (SELECT community FROM z)""")
def derive_sections(spark, sf):
    return Q.sections(star_nodes(spark, sf), {"parties": ("customer", "supplier"), "goods": ("steel", "blue", "goods")})


@query("""d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id), a AS (SELECT coalesce(degree, 0) AS degree, row_number() OVER (ORDER BY coalesce(degree, 0)) - 1 AS k FROM nodes LEFT JOIN d USING (id)),
c AS (SELECT degree AS cut FROM a WHERE k = greatest(0, CAST(floor((SELECT count(*) FROM nodes) * 95 / 100.0) AS BIGINT) - 1)), h AS (SELECT id FROM d, c WHERE degree > cut),
v AS (SELECT src AS node, dst AS o FROM edges UNION ALL SELECT dst, src FROM edges), g AS (SELECT node, community, count(*) AS n FROM v JOIN nodes ON nodes.id = o WHERE node IN (SELECT id FROM h) GROUP BY 1, 2)
SELECT node, community FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, community) AS r FROM g) WHERE r = 1""")
def hub_reattach(spark, sf):
    n, e = star_nodes(spark, sf), star_edges(spark, sf)
    return M.reattach(M.hubs(n, e, 95), n.select(F.col("id").alias("node"), "community"), e)


@query("SELECT id AS node, community FROM nodes")
def remap_communities(spark, sf):
    old = star_nodes(spark, sf).select(F.col("id").alias("node"), "community")
    return M.remap_to_previous(old.withColumn("community", (F.col("community") * 7 + 3) % 25), old)


@query()
def split_oversized(spark, sf):
    return M.communities(star_nodes(spark, sf), star_edges(spark, sf), exclude_hubs=99)


@query("SELECT 'acme::' || id AS id, 'acme' AS repo FROM nodes WHERE id LIKE 'nation:%' UNION ALL SELECT id, 'base' FROM nodes WHERE id LIKE 'region:%'")
def global_add(spark, sf):
    n, e = star_nodes(spark, sf), star_edges(spark, sf).where("relation = 'part_of'")
    base = n.where("id like 'region:%'").withColumn("repo", F.lit("base")).withColumn("local_id", F.col("id"))
    return G.global_add(base, e.limit(0), n.where("id like 'nation:%'"), e, "acme")[0].select("id", "repo")


@query("SELECT DISTINCT 'scip_' || substr(sha256('r' || n_regionkey || '|' || n_name), 1, 16) AS src, 'scip_stub_' || substr(sha256('REGION' || n_regionkey), 1, 16) AS dst, 'scip_ref' AS relation, 'EXTRACTED' AS confidence, 'r' || n_regionkey AS source_file FROM nation")
def symbol_index(spark, sf):
    p = table(spark, sf, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("path"), F.col("n_name").alias("symbol"),
        F.col("n_name").alias("display_name"), F.col("n_nationkey").alias("line"))
    r = p.select("path", "symbol", F.concat(F.lit("REGION"), F.substring("path", 2, 1)).alias("target"), F.lit(True).alias("is_reference"), F.lit(False).alias("is_implementation"),
        F.lit(None).cast("boolean").alias("is_type_definition"), F.lit(False).alias("is_definition"))
    return G.symbol_index(p, r)[1]
