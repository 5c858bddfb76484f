"""Row-shaped sinks as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.model import STAR_SQL, star_edges, star_nodes
from weftgraph.sinks import writers as W


def cypher_lines(spark, sf):
    return W.cypher_lines(star_nodes(spark, sf), star_edges(spark, sf))


def graphml_rows(spark, sf):
    return W.graphml_lines(star_nodes(spark, sf), star_edges(spark, sf))


def wiki_pages(spark, sf):
    return W.wiki_pages(star_nodes(spark, sf), star_edges(spark, sf))


def report_sections(spark, sf):
    text = W.report(star_nodes(spark, sf), star_edges(spark, sf))
    rows = [(i, x) for i, x in enumerate(text.split("\n"))]
    return spark.createDataFrame(rows, "line_no int, line string").where(F.col("line") != "")


QUERIES = {f.__name__: f for f in (cypher_lines, graphml_rows, wiki_pages, report_sections)}
ORACLE_SQL = {
    "wiki_pages": f"""WITH {STAR_SQL}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
k AS (SELECT community, label, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS k, count(*) OVER (PARTITION BY community) AS n FROM nodes LEFT JOIN d USING (id))
SELECT 'community_' || community AS page, '# Community ' || community || chr(10) || chr(10) || any_value(n) || ' nodes' || chr(10) || chr(10) || string_agg('- **' || label || '** (' || degree || ' links)', chr(10) ORDER BY k) AS text FROM k WHERE k <= 25 GROUP BY community""",
    "cypher_lines": f"""WITH {STAR_SQL} SELECT 'MERGE (n:' || upper(substr(file_type, 1, 1)) || substr(file_type, 2) || ' {{id: ''' || id || ''', label: ''' || replace(label, '''', '\\''') || '''}});' AS line FROM nodes
UNION ALL SELECT 'MATCH (a {{id: ''' || src || '''}}), (b {{id: ''' || dst || '''}}) MERGE (a)-[:' || upper(relation) || ' {{confidence: ''' || confidence || '''}}]->(b);' FROM edges""",
    "graphml_rows": f"""WITH {STAR_SQL} SELECT '<node id="' || id || '"><data key="label">' || replace(replace(label, '&', '&amp;'), '<', '&lt;') || '</data><data key="community">' || coalesce(community, -1) || '</data></node>' AS line FROM nodes
UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"><data key="relation">' || relation || '</data></edge>' FROM edges""",
}
