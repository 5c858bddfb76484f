"""Operators on small literal graphs."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.operators import analytics as A
from weftgraph.operators import build as B
from weftgraph.operators import centrality, community, dedup
from weftgraph.operators import resolution as R
from weftgraph.operators import search as S
from weftgraph.operators import traverse as V
from weftgraph.operators.components import connected_components
from weftgraph.sinks import writers
from weftgraph.sources import corpus as C
from weftgraph.sources import extractors as X
from weftgraph.streaming import feeds

NODE = "id string, label string, file_type string, source_file string, community int"
EDGE = "src string, dst string, relation string, confidence string, context string"


@pytest.fixture(scope="module")
def chain(spark):
    n = spark.createDataFrame([("n1", "extract", "code", "extract.py", 0), ("n2", "cluster", "code", "cluster.py", 0), ("n3", "build", "code", "build.py", 1),
        ("n4", "report", "code", "report.py", 1), ("n5", "isolated", "code", "other.py", 2)], NODE)
    e = spark.createDataFrame([("n1", "n2", "calls", "INFERRED", "call"), ("n2", "n3", "imports", "EXTRACTED", "import"), ("n3", "n4", "uses", "EXTRACTED", None)], EDGE)
    return n, e


def test_bfs_and_contexts(spark, chain):
    n, e = chain
    seed = spark.createDataFrame([("n1",)], "id string")
    assert {(r.id, r.depth) for r in V.bfs(e, seed, 1).collect()} == {("n1", 0), ("n2", 1)}
    assert {r.id for r in V.bfs(e, seed, 5).collect()} == {"n1", "n2", "n3", "n4"}
    assert {r.id for r in V.bfs(S.in_contexts(e, ["call"]), seed, 5).collect()} == {"n1", "n2"}
    assert {r.id for r in V.bfs(e, seed, 3, hub=2).collect()} == {"n1", "n2"}
    assert V.hub_threshold(n, e) == V.HUB_FLOOR
    assert [(r.u, r.v) for r in V.tree_edges(e, V.bfs(e, seed, 2)).orderBy("depth").collect()] == [("n1", "n2"), ("n2", "n3")]


def test_shortest_path_and_dfs(spark, chain):
    _, e = chain
    assert [r.id for r in V.shortest_path(e, "n4", "n1").orderBy("hop").collect()] == ["n4", "n3", "n2", "n1"]
    assert V.shortest_path(e, "n1", "n5").count() == 0
    assert [r.id for r in V.shortest_path(e, "n1", "n1").collect()] == ["n1"]
    assert [r.id for r in V.dfs(e, ["n2"], 2).orderBy("ord").collect()] == ["n2", "n1", "n3", "n4"]


def test_impact(spark):
    e = spark.createDataFrame([("caller", "target", "calls"), ("barrel", "target", "re_exports"), ("consumer", "target", "imports"), ("far", "caller", "contains")],
        "src string, dst string, relation string")
    seed = spark.createDataFrame([("target",)], "id string")
    assert {(r.id, r.depth, r.via) for r in V.affected(e, seed).collect()} == {("caller", 1, "calls"), ("barrel", 1, "re_exports"), ("consumer", 1, "imports")}
    assert {r.id for r in V.affected(e, seed, relations=("calls",)).collect()} == {"caller"}


def test_terms_idf_score_seeds(spark):
    assert S.terms_of("How does Foo to é1 x") == ["how", "does", "foo", "é1"]
    rows = [(f"err{i}", f"error_handler_{i}", "code", f"err{i}.py", 0) for i in range(20)] + [("fbs", "FooBarService", "code", "service.py", 1),
        ("fbs_dep", "ServiceClient", "code", "client.py", 1)]
    n = spark.createDataFrame(rows, NODE)
    best = S.score_nodes(n, ["foobarservice", "error"]).orderBy(F.desc("score"), F.desc("id")).first()
    assert best.id == "fbs"
    w = {r.term: r.idf for r in S.idf(n, ["foobarservice", "error"]).collect()}
    assert w["foobarservice"] > 1 > w["error"] - 0.1
    scored = lambda rows: spark.createDataFrame(rows, "id string, score double")
    assert [r.id for r in S.pick_seeds(scored([("fbs", 1000.0), ("e1", 1.0), ("e2", 0.9)])).collect()] == ["fbs"]
    assert S.pick_seeds(scored([("a", 10.0), ("b", 9.0), ("c", 8.5)])).count() == 3
    assert S.pick_seeds(scored([])).count() == 0
    assert S.contexts_of("what calls this module") == ["call", "import"] and S.contexts_of("x", ["params", "Param"]) == ["parameter_type"]
    assert S.score_nodes(n, []).count() == 0


def test_diagnostics(spark):
    n = spark.createDataFrame([(x, x, "code", "a.py", 0) for x in "abc"], NODE)
    e = spark.createDataFrame([("a", "b", "calls", "E", "L1"), ("a", "b", "imports", "E", "L2"), ("a", "b", "calls", "I", "L3"), ("a", "b", "calls", "E", "L1"),
        ("a", "missing", "calls", "E", "L1"), ("a", None, "calls", "E", "L1"), ("c", "c", "calls", "E", "L1")],
        "src string, dst string, relation string, confidence string, source_location string")
    r = A.diagnostics(e, n).first()
    assert (r.n_raw, r.n_valid, r.n_missing, r.n_dangling, r.n_self_loops, r.n_exact_repeats, r.n_directed_pairs, r.n_collapsed, r.n_same_pair_groups, r.n_relation_variants,
        r.n_location_variants) == (7, 5, 1, 1, 1, 1, 2, 3, 1, 1, 1)


def test_coercion_repair_and_validation(spark):
    raw = spark.createDataFrame([("a", "A", None, "x.py"), ("b", None, "markdown", "y.md")], "id string, label string, type string, source string")
    n = B.coerce_nodes(raw)
    assert [(r.id, r.file_type, r.source_file) for r in n.orderBy("id").collect()] == [("a", "concept", "x.py"), ("b", "document", "y.md")]
    e = B.coerce_edges(spark.createDataFrame([("A", "b", "calls", "nope")], "from string, to string, relation string, score string"))
    assert [(r.src, r.dst, r.confidence_score) for r in e.collect()] == [("A", "b", None)]
    assert [(r.src, r.dst) for r in B.repair_endpoints(e, n).collect()] == [("a", "b")]
    assert {r.code for r in B.edge_violations(e, n).collect()} == {"missing_confidence", "missing_source_file", "dangling_src"}
    assert {r.code for r in B.node_violations(n.withColumn("label", F.lit(None).cast("string"))).collect()} == {"missing_label"}


def test_merge_sanitize_and_hyperedges(spark):
    n = spark.createDataFrame([("a", "A", "code", "x.py", 0), ("w", "Because it is the only way to keep every reader of it happy: really. " * 2, "rationale", "x.py", 0),
        ("b", "B", "code", "y.py", 0)], NODE)
    e = spark.createDataFrame([("w", "a", "rationale_for", "EXTRACTED", None), ("a", "b", "calls", "EXTRACTED", None)], EDGE)
    h = spark.createDataFrame([("h1", ["a", "w", "b"]), ("h2", ["a", "w"])], "id string, nodes array<string>")
    n2, e2, h2 = B.sanitize_fragment(n, e, h)
    got = {r.id: r.rationale for r in n2.collect()}
    assert set(got) == {"a", "b"} and got["a"].startswith("Because") and got["b"] is None
    assert e2.count() == 1 and [(r.id, r.nodes) for r in h2.collect()] == [("h1", ["a", "b"])]
    base = spark.createDataFrame([("x.py", 1), ("y.py", 2), ("z.py", 3)], "source_file string, v int")
    out = B.merge_incremental(base, spark.createDataFrame([("x.py", 9)], base.schema), spark.createDataFrame([("z.py",)], "source_file string"))
    assert {(r.source_file, r.v) for r in out.collect()} == {("x.py", 9), ("y.py", 2)}
    assert B.shrinks(5, 4) and not B.shrinks(5, 4, force=True)


@pytest.mark.parametrize("labels, left", [(["UserService", "userservice", "User Service"], 1), (["GraphExtractor", "Graph Extractor"], 1), (["UserService", "OrderService"], 2),
    (["AI", "ML"], 2), (["ASR1603", "ASR1605"], 2), (["M1", "M1 Pro"], 2)])
def test_dedup(spark, labels, left):
    rows = [(x.lower().replace(" ", "_") + ("" if i == 0 else f"_{i}") if len({y.lower().replace(" ", "_") for y in labels}) < len(labels) else x.lower().replace(" ", "_"), x,
        "code", "a.py", 0) for i, x in enumerate(labels)]
    n = spark.createDataFrame(rows, NODE)
    e = spark.createDataFrame([(rows[0][0], rows[-1][0], "calls", "EXTRACTED", None)], EDGE)
    kept, edges = dedup.deduplicate(n, e, T.norm_label(F.col("label")))
    assert kept.count() == left and edges.count() == (1 if left == len(rows) else 0)


def test_string_functions(spark):
    assert T.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert T.jaro_winkler("", "a") == 0 and T.jaro_winkler("same", "same") == 1
    assert T.one_edit_or_swap("abc", "acb") and not T.one_edit_or_swap("abc", "cba")
    assert T.id_form("Ünï  Code/x.py") == "ünï_code_x_py" and T.bare_form("é") == "e"
    r = spark.createDataFrame([("a/b/c.tar.gz", "O'Brien\\", "ab", None)], "p string, q string, s string, z string").select(
        T.suffix(F.col("p")).alias("x"), T.file_stem(F.col("p")).alias("y"), T.cypher_text(F.col("q")).alias("c"), T.shingles(F.col("s")).alias("g"),
        T.norm_label(F.col("z")).alias("n"), T.url_kind(F.lit("https://a.org/x.PDF?y")).alias("u")).first()
    assert (r.x, r.y, r.c, r.g, r.n, r.u) == (".gz", "b.c.tar", "O\\'Brien\\\\", ["ab"], None, "pdf")


def test_components_match_union_find(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_communities_cover_and_are_stable(spark):
    groups = [[f"{g}{i}" for i in range(6)] for g in "abc"]
    edges = [(x, y) for g in groups for i, x in enumerate(g) for y in g[:i]] + [("a0", "b0"), ("b1", "c1")]
    n = spark.createDataFrame([(x,) for g in groups for x in g] + [("lone",)], "id string")
    got = community.communities(n, spark.createDataFrame(edges, "src string, dst string"))
    by = {}
    for r in got.collect():
        by.setdefault(r.community, set()).add(r.node)
    assert sorted(map(len, by.values())) == [1, 6, 6, 6] and {frozenset(g) for g in groups} <= {frozenset(v) for v in by.values()}
    shifted = got.withColumn("community", (F.col("community") + 1) % 4)
    back = community.remap_to_previous(shifted, got)
    assert {(r.node, r.community) for r in back.collect()} == {(r.node, r.community) for r in got.collect()}
    hub = community.communities(n, spark.createDataFrame(edges, "src string, dst string"), exclude_hubs=90)
    assert hub.count() == 19


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    got = {r.id: round(r.betweenness, 6) for r in centrality.node_betweenness(e).collect()}
    assert got == {"a": 0, "b": pytest.approx(2 / 3, abs=1e-6), "c": pytest.approx(2 / 3, abs=1e-6), "d": 0}
    eb = {(r.u, r.v): round(r.betweenness, 6) for r in centrality.edge_betweenness(e).collect()}
    assert eb == {("a", "b"): 0.5, ("b", "c"): pytest.approx(4 / 6, abs=1e-6), ("c", "d"): 0.5}


def test_calls_stubs_and_ids(spark):
    n = spark.createDataFrame([("f", "foo()", "code", "a.py", 0), ("g", "bar()", "code", "b.py", 0), ("h", "bar()", "code", "c.py", 0), ("s", "Foo", "code", "", 0)], NODE)
    raw = spark.createDataFrame([("g", "foo", False, "b.py"), ("f", "bar", False, "a.py"), ("f", "foo", False, "a.py"), ("h", "foo", True, "c.py")],
        "caller string, callee string, is_member_call boolean, source_file string")
    none = spark.createDataFrame([], "src string, dst string, relation string")
    assert [(r.src, r.dst, r.confidence) for r in R.resolve_calls(raw, n.where("id <> 's'"), none).collect()] == [("g", "f", "INFERRED")]
    kept, e = R.rewire_stubs(n, spark.createDataFrame([("g", "s")], "src string, dst string"))
    assert kept.count() == 3 and [(r.src, r.dst) for r in e.collect()] == [("g", "f")]


def test_extractors(spark):
    py = '"""A module docstring that is long enough."""\nimport os\nfrom .m import N\nclass A(N):\n    def f(self, x: N) -> int:\n        return g(x)\n# WHY: because\ndef g(x):\n    return h(x)\n'
    sql = "CREATE TABLE organizations (id int);\nCREATE TABLE users (id int, org_id int REFERENCES organizations(id));\nCREATE VIEW active_users AS SELECT * FROM users;\nCREATE FUNCTION get_user() RETURNS int AS 'x';\n"
    md = "# One\n## Two\n```py\n# not\n```\n# Three\n"
    files = [("p/a.py", py), ("p/s.sql", sql), ("p/r.md", md), ("p/x.json", '{"extends": "base", "dependencies": {"lib": "1"}, "a": {"$ref": "#/b"}}'), ("p/bad.py", "def ("),
        ("p/n.py", None), ("p/t.ts", "import {a} from './b'\nexport class K {}\n"), ("p/none.xyz", "x")]
    out = X.extract(spark.createDataFrame(files, "path string, text string")).collect()
    rel = lambda p: sorted((r.relation for r in out if r.source_file == p and r.kind == "edge"))
    assert rel("p/s.sql") == ["contains"] * 4 + ["reads_from", "references"]
    assert set(rel("p/a.py")) >= {"imports", "imports_from", "inherits", "method", "calls", "contains", "references", "rationale_for"}
    assert [(r.dst, r.is_member_call) for r in out if r.kind == "raw_call"] == [("h", False)]
    assert rel("p/r.md") == ["contains"] * 4 and [r.source_file for r in out if r.kind == "error"] == ["p/bad.py"]
    assert {"extends", "imports", "references"} <= set(rel("p/x.json")) and "imports_from" in rel("p/t.ts")


def test_corpus_rules(spark):
    paths = [("a/.ssh/x", True), ("secrets", True), ("secret_store.txt", True), ("tokenizer.py", False), ("src/main.py", False), ("k.pem", True)]
    df = spark.createDataFrame(paths, "path string, want boolean")
    assert df.where(C.is_sensitive(F.col("path")) != F.col("want")).count() == 0
    ig = {r.path: r.ignored for r in C.ignored(spark.createDataFrame([("build/x.py",), ("src/build/y.py",), ("keep.log",), ("b.log",), ("doc/a/b.txt",)], "path string"),
        ["/build/", "*.log", "!keep.log", "doc/**/b.txt"]).collect()}
    assert ig == {"build/x.py": True, "src/build/y.py": False, "keep.log": False, "b.log": True, "doc/a/b.txt": True}
    k = spark.createDataFrame([("x.py", "code"), ("y.PDF", "paper"), ("v.blade.php", "code"), ("z", None), ("i.imageset/a.pdf", None)], "path string, want string")
    assert k.where(~C.classify(F.col("path")).eqNullSafe(F.col("want"))).count() == 0
    s = spark.createDataFrame([("#!/usr/bin/env -S A=1 python3 -u", "python3"), ("#!/bin/bash", "bash"), ("x", "")], "l string, want string")
    assert s.where(C.shebang_interpreter(F.col("l")) != F.col("want")).count() == 0
    packed = C.pack(spark.createDataFrame([("d", f"f{i}", t) for i, t in enumerate([60, 50, 40, 200, 10])], "dir string, path string, tokens long"), 100)
    assert [r.chunk for r in packed.orderBy("path").collect()] == [0, 1, 1, 2, 3]


def test_json_round_trip_and_guards(spark, chain, tmp_path):
    n, e = chain
    writers.write_json(n, e, str(tmp_path / "g.json"))
    doc = json.loads((tmp_path / "g.json").read_text())
    assert len(doc["nodes"]) == 5 and {x["confidence_score"] for x in doc["links"]} == {0.5, 1.0}
    n2, e2 = writers.read_json(spark, str(tmp_path / "g.json"))
    assert A.graph_diff(n, n2, ["id", "label"]).count() == 0 and A.graph_diff(A.edge_key(e), A.edge_key(e2), ["u", "v", "relation"]).count() == 0
    assert writers.write_tables(n, e, str(tmp_path / "t")) == 5
    with pytest.raises(ValueError, match="shrink"):
        writers.write_tables(n.limit(1), e, str(tmp_path / "t"), before=5)
    assert "## Hubs" in writers.report(n, e)
    assert feeds.fingerprint(n, ["id"]) == feeds.fingerprint(n.repartition(3), ["id"]) != feeds.fingerprint(n.limit(2), ["id"])


def test_streamed_bursts_equal_the_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", f"f{i}.py", t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 10, 11, 60])]
    df = spark.createDataFrame(rows, "root string, path string, ts timestamp")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    late = spark.createDataFrame([("r", "z.py", t0 + dt.timedelta(hours=2))], df.schema)
    late.coalesce(1).write.mode("append").parquet(src)
    stream = feeds.debounced(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src))
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.n_events, tuple(r.paths)) for r in feeds.debounced(df).collect()}
    assert len(want) == 3
    assert {(r.start, r.n_events, tuple(r.paths)) for r in spark.sql("select * from bursts").collect()} == want


def test_questions_views_and_names(spark, chain):
    from weftgraph.operators import questions as Q

    n, e = chain
    got = Q.suggest_questions(n, e.withColumn("confidence", F.lit("AMBIGUOUS")), top_n=5)
    assert got.count() == 5 and got.where("kind = 'ambiguous_edge'").count() == 3
    assert [r.kind for r in Q.suggest_questions(n.limit(0), e.limit(0)).collect()] == ["no_signal"]
    assert [(r.other, r.degree) for r in Q.explain(n, e, "n2").collect()] == [("n3", 2), ("n1", 1)]
    k = spark.createDataFrame([("useThing", "a.ts", "code", None, "ui"), ("Foo", "a.py", "code", None, "klass"), ("foo()", "tests/x.py", "code", None, "test"),
        ("x", "a.py", "code", "Enum", "klass"), (None, None, None, None, "function")], "l string, s string, f string, t string, want string")
    assert k.where(~Q.node_kind(F.col("l"), F.col("s"), F.col("f"), F.col("t")).eqNullSafe(F.col("want"))).count() == 0
    names = {r.id: r.name for r in Q.note_names(spark.createDataFrame([("1", "A/b"), ("2", "ab"), ("3", "ab")], "id string, label string")).collect()}
    assert names == {"1": "Ab", "2": "ab_1", "3": "ab_2"}
    assert {(r.x, r.y) for r in Q.canvas(n).collect()} == {(0, 0), (400, 0), (0, 400), (400, 400), (0, 800)}


def test_global_graph_and_symbol_index(spark):
    from weftgraph.operators import federation as G

    one = spark.createDataFrame([("a", "A", "a.py"), ("x", "os", "")], "id string, label string, source_file string")
    e1 = spark.createDataFrame([("a", "x")], "src string, dst string")
    empty_n, empty_e = spark.createDataFrame([], "id string, label string, source_file string, repo string, local_id string"), spark.createDataFrame([], "src string, dst string")
    n, e = G.global_add(empty_n, empty_e, one, e1, "r1")
    n2, e2 = G.global_add(n, e, one, e1, "r2")
    assert {r.id for r in n2.collect()} == {"r1::a", "r1::x", "r2::a"} and e2.count() == 1
    _, moved = G.global_add(n, e, one, e1, "r2", rewire=True)
    assert {(r.src, r.dst) for r in moved.collect()} == {("r1::a", "r1::x"), ("r2::a", "r1::x")}
    again, _ = G.global_add(n2, e2, one, e1, "r2")
    assert again.count() == 3 and {r.repo: r.n_nodes for r in G.global_list(again).collect()} == {"r1": 2, "r2": 1}
    assert G.global_remove(n2, e2, "r1")[0].count() == 1
    s = spark.createDataFrame([("p", "f", "F", 3), ("q", "g", None, None), ("q", "f", "F2", 1)], "path string, symbol string, display_name string, line int")
    r = spark.createDataFrame([("p", "f", "g", True), ("q", "g", "f", True), ("p", "f", "zzz", True), ("p", "f", "g", None)],
        "path string, symbol string, target string, is_reference boolean")
    for flag in ("is_implementation", "is_type_definition", "is_definition"):
        r = r.withColumn(flag, F.lit(False))
    nodes, edges = G.symbol_index(s, r)
    assert nodes.where("source_file = ''").count() == 1 and edges.count() == 3 and edges.where("relation <> 'scip_ref'").count() == 0
