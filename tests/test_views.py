"""Views, files and state on small graphs."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from weftgraph.api import RESOURCES, GraphService, surprising
from weftgraph.model import PropertyGraph
from weftgraph.operators import changes, diagrams
from weftgraph.scratch import shared_dir
from weftgraph.sinks import pages
from weftgraph.streaming import state

NODE = "id string, label string, file_type string, source_file string, community int"
EDGE = "src string, dst string, relation string, confidence string, confidence_score double, context string"


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame([
        ("a", "main", "code", "src/a.py", 0), ("b", "Loader", "code", "src/a.py", 0), ("c", "<save>", "code", "lib/c.ts", 1), ("d", "notes", "document", "docs/d.md", 1),
        ("e", "lonely", "code", "lib/e.ts", 2)], NODE)
    e = spark.createDataFrame([
        ("a", "b", "calls", "EXTRACTED", 1.0, "call"), ("a", "c", "calls", "INFERRED", 0.9, "call"), ("b", "c", "uses", "AMBIGUOUS", 0.3, None),
        ("d", "c", "rationale_for", "INFERRED", 0.5, None), ("a", "b", "imports", "EXTRACTED", 1.0, "import")], EDGE)
    return n, e


def test_pages(graph):
    n, e = graph
    level, nodes, links = pages.page_graph(n, e)
    assert level == "nodes" and len(nodes) == 5 and [(x["u"], x["v"], x["n"]) for x in links] == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "d", 1)]
    level, nodes, links = pages.page_graph(n, e, most=4)
    assert level == "communities" and [x["id"] for x in nodes] == ["0", "1", "2"] and [(x["u"], x["v"], x["n"]) for x in links] == [("0", "1", 2)]
    with pytest.raises(ValueError, match="over 2 nodes"):
        pages.page_graph(n, e, most=2)
    html = pages.html_page(n, e, "A & B")
    assert "A &amp; B" in html and "\\u003csave\\u003e" in html and "<save>" not in html
    svg = pages.svg_page(n, e)
    assert svg.count("<circle") == 5 and svg.count("<line") == 4 and svg == pages.svg_page(n.repartition(4), e.repartition(3))
    tree = pages.tree_page(diagrams.tree_leaves(n))
    assert "src (2)" in tree and "&lt;save&gt;" in tree
    notes = {r.name: r.text for r in pages.vault_notes(n, e, links=1).collect()}
    assert "- and 1 more" in notes["Loader"] or "- and 2 more" in notes["Loader"]
    assert "[[" not in notes["lonely"]
    assert {r.name for r in pages.community_notes(n).collect()} == {f"_COMMUNITY_{i}" for i in range(3)}


def test_flow_and_diagram_nodes(spark, graph):
    n, e = graph
    s = spark.createDataFrame([("x", "y", 5), ("x", "z", 7), ("z", "y", 1), ("y", "x", 9), ("w", "q", 1)], "a string, b string, n_edges long")
    assert diagrams.flow_chain(s, ["x", "y", "z", "w"]) == ["w", "x", "z", "y"]
    assert diagrams.flow_chain(s, []) == [] and diagrams.flow_chain(s, ["x", "y", "z"], most=2) == ["y", "x"]
    kind = F.when(F.col("file_type") == "document", "concept").otherwise("function")
    assert diagrams.diagram_nodes(n, e, 3, kind)[0] == "a" and len(diagrams.diagram_nodes(n, e, 3, kind)) == 3
    assert set(diagrams.diagram_nodes(n, e, 50, kind)) == {"a", "b", "c", "d", "e"}
    ranked = n.withColumn("rank", F.lit("0.5"))
    assert ranked.select(diagrams.importance(ranked).alias("i")).first().i == 0.5 and n.select(diagrams.importance(n).alias("i")).first().i == 0.0
    over = diagrams.overview_lines(spark.createDataFrame([("inter", "x", "y", "calls", 2)], "kind string, a string, b string, relation string, n_edges long"),
        spark.createDataFrame([("x", 1), ("y", 2)], "section string, n long"))
    page = pages.flow_page(over, ["x", "y"])
    assert "s_x --&gt;|calls x2| s_y" in page and "x -&gt; y" in page


def test_service_resources_and_tools(spark, graph):
    n, e = graph
    g = GraphService(PropertyGraph(n, e))
    for name in RESOURCES:
        assert g.resource(name)
    with pytest.raises(ValueError, match="unknown resource"):
        g.resource("nothing")
    assert g.call("god_nodes", top_n=2).count() == 2
    with pytest.raises(ValueError, match="unknown tool"):
        g.call("drop_table")
    assert "Loader" in g.affected_text("<save>") and g.affected_text("nope").startswith("No unique")
    rows = [(7, "Fix", "ann", "main", "main", False, dt.datetime(2020, 1, 1), None, "SUCCESS"), (8, "Old", "bob", "dev", "main", False, dt.datetime(2020, 1, 1), None, "SUCCESS")]
    c = spark.createDataFrame(rows, "number long, title string, author string, base_branch string, expected_base string, is_draft boolean, updated_at timestamp, review_decision string, ci_status string")
    files = spark.createDataFrame([(7, "src/a.py")], "number long, path string")
    now = F.to_timestamp(F.lit("2020-01-03"))
    text = g.list_prs(c, now, "main", files)
    assert text.startswith("Open changes to main: 1 (1 on another base)") and "#7 [READY]" in text and "impact=1 communities, 2 nodes" in text
    assert [(r.n_communities, r.n_nodes) for r in g.get_pr_impact(files, 7).collect()] == [(1, 2)] and g.get_pr_impact(files, 8).count() == 0


def test_surprises_choose_their_ranking(spark, graph):
    n, e = graph
    assert surprising(n, e).count() > 0
    one = n.withColumn("source_file", F.lit("src/a.py"))
    assert [r.rank for r in surprising(one, e).collect()] == [1]  # a pair of communities is joined
    bare = one.withColumn("community", F.lit(None).cast("int"))
    assert surprising(bare, e).orderBy("rank").first().rank == 1 and surprising(bare, e).count() == 4


def test_work_trees_and_checks(spark):
    t = changes.work_trees(spark, "worktree /a\nHEAD 1\nbranch refs/heads/x\n\nworktree /b\nHEAD 2\ndetached\n\n")
    assert [(r.path, r.branch) for r in t.collect()] == [("/a", "x"), ("/b", None)]
    raw = spark.createDataFrame([("not json",), ('[{"number": 1, "statusCheckRollup": null}, {"title": "no number"}]',)], "text string")
    got = changes.read_changes(raw, F.lit("main")).collect()
    assert [(r.number, r.ci_status, r.title, r.is_draft) for r in got] == [(1, "NONE", "", False)]


def test_backup_and_loaders(tmp_path):
    d = str(tmp_path)
    day = dt.date(2020, 1, 2)
    assert pages.backup(d, day) is None
    (tmp_path / "graph.json").write_text("{}")
    assert pages.backup(d, day) is None
    (tmp_path / "labels.json").write_text(json.dumps({"0": "Community 0"}))
    assert pages.backup(d, day) is None
    (tmp_path / "labels.json").write_text(json.dumps({"0": "Parsers"}))
    assert pages.backup(d, day) == os.path.join(d, "2020-01-02") and (tmp_path / "2020-01-02" / "labels.json").exists()
    (tmp_path / "graph.json").write_text("{1}")
    pages.backup(d, day)
    assert (tmp_path / "2020-01-02" / "graph.json").read_text() == "{1}"
    assert pages.read_json_or(os.path.join(d, "graph.json"), 5) == 5 and pages.read_json_or(os.path.join(d, "none"), 5) == 5


class Store:
    def __init__(self, path):
        self.path = path

    def run(self, statement, rows):
        with open(os.path.join(self.path, f"{os.getpid()}-{len(os.listdir(self.path))}-{id(rows)}"), "w") as f:
            json.dump([statement, rows], f)

    def close(self):
        pass


def test_upsert_sends_scalars_in_batches(graph, tmp_path):
    n, e = graph
    where = str(tmp_path)
    pages.upsert(n.withColumn("tags", F.array(F.lit("x"))), e, lambda: Store(where), batch=2)
    sent = [json.load(open(tmp_path / f)) for f in os.listdir(where)]
    rows = [r for _, rs in sent for r in rs]
    assert len(rows) == 10 and not any("tags" in r for r in rows)
    assert any("MERGE (n:Document" in s for s, _ in sent) and any("[r:RATIONALE_FOR]" in s for s, _ in sent)


def test_lock_reload_and_scratch(spark, tmp_path):
    with state.RebuildLock(str(tmp_path)) as first:
        assert first and not state.RebuildLock(str(tmp_path)).acquire()
    assert os.listdir(tmp_path) == []
    (tmp_path / ".rebuild.lock").write_text("999999999")
    again = state.RebuildLock(str(tmp_path))
    assert again.acquire()
    again.release()
    path = tmp_path / "g.json"
    path.write_text("1")
    reads = []
    served = state.Reloading(spark, str(path), lambda p: reads.append(p) or open(p).read())
    assert served.get() == served.get() == "1" and len(reads) == 1
    path.write_text("22")
    assert served.get() == "22" and len(reads) == 2

    class Conf(dict):
        def get(self, k, d=None):
            return {"spark.master": "yarn"}.get(k, d)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="all machines"):
        shared_dir(Session())


def test_graph_files(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps({"directed": True, "nodes": [{"name": "x"}, {"name": "y"}], "links": [{"source": "x", "target": "y", "confidence_score": "high"}]}))
    n, e, directed = state.read_graph(spark, str(p))
    assert directed and sorted(r.label for r in n.collect()) == ["x", "y"] and [(r.src, r.dst, r.confidence_score) for r in e.collect()] == [("x", "y", None)]
    assert state.read_graph(spark, str(p), directed=False)[2] is False
    with pytest.raises(ValueError, match="bytes"):
        state.read_graph(spark, str(p), max_bytes=3)
    with pytest.raises(ValueError, match="json"):
        state.read_graph(spark, str(tmp_path / "g.txt"))
