import datetime as dt

from pyspark.sql import functions as F

from weftgraph.api import GraphService
from weftgraph.model import PropertyGraph

NODE = "id string, label string, file_type string, source_file string, community int"
EDGE = "src string, dst string, relation string, confidence string, context string"


def test_service(spark):
    n = spark.createDataFrame([("n1", "extract", "code", "extract.py", 0), ("n2", "cluster", "code", "cluster.py", 0), ("n3", "build", "code", "build.py", 1),
        ("n4", "report", "code", "report.py", 1), ("n5", "isolated", "code", "other.py", 2)], NODE)
    e = spark.createDataFrame([("n1", "n2", "calls", "INFERRED", "call"), ("n2", "n3", "imports", "EXTRACTED", "import"), ("n3", "n4", "uses", "EXTRACTED", None)], EDGE)
    g = GraphService(PropertyGraph(n, e))
    text = g.query_graph("what about extract", depth=1)
    assert text.splitlines()[0].startswith("NODE extract") and "EDGE n1 --calls [INFERRED]--> n2" in text and "n3" not in text
    assert "more lines" in g.query_graph("extract", token_budget=20) and g.query_graph("zzz") == "No matching nodes."
    assert "EDGE n2 --imports" in g.query_graph("extract", mode="dfs", depth=3)
    path, notes = g.shortest_path("extract", "report")
    assert [r.id for r in path.orderBy("hop").collect()] == ["n1", "n2", "n3", "n4"] and notes == []
    assert g.shortest_path("extract", "extract")[1] == ["both ends are the same node"]
    assert g.get_node("CLUST").first().id == "n2" and g.get_neighbors("cluster", "call").count() == 1 and g.explain("build").count() == 2
    assert {r.id for r in g.affected("build").collect()} == {"n2", "n1"} and g.get_community(1).count() == 2
    assert g.graph_stats().first().n_nodes == 5 and g.communities().first().n_nodes == 2 and g.god_nodes(2).count() == 2
    old = dt.datetime(2024, 1, 1)
    prs = spark.createDataFrame([(1, "main", "main", "SUCCESS", None, False, old), (2, "main", "main", "FAILURE", None, False, old),
        (3, "dev", "main", "SUCCESS", None, False, old)], "number int, base_branch string, expected_base string, ci_status string, review_decision string, is_draft boolean, updated_at timestamp")
    files = spark.createDataFrame([(1, "build.py"), (2, "x/extract.py")], "number int, path string")
    got = {r.number: (r.status, r.n_communities) for r in g.triage(prs, files, F.lit(old + dt.timedelta(days=3))).collect()}
    assert got == {1: ("READY", 1), 2: ("CI-FAIL", 1), 3: ("WRONG-BASE", None)}
