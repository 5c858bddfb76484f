"""Queries over the whole star graph, on small tables of several components."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.model import star_edges, star_nodes
from weftgraph.operators import centrality, community, numbered
from weftgraph.operators import questions as Q
from weftgraph.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """Four worlds of one region each that share nothing: keys of a world are equal modulo 4."""
    rng, at = random.Random(3), str(tmp_path_factory.mktemp("tiny"))
    of = lambda w, n: w + 4 * rng.randrange(n)
    rows = {
        "region": ("r_regionkey long, r_name string", [(i, f"REGION {i}") for i in range(4)]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(i, f"NATION {i}", i % 4) for i in range(8)]),
        "customer": ("c_custkey long, c_name string, c_nationkey long", [(i, f"Customer#{i:09}", of(i % 4, 2)) for i in range(12)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(i, f"Supplier#{i:09}", of(i % 4, 2)) for i in range(8)]),
        "part": ("p_partkey long, p_name string, p_size int", [(i, f"part {i % 5}", i % 7) for i in range(16)]),
        "orders": ("o_orderkey long, o_custkey long", [(i, of(i % 4, 3)) for i in range(24)]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double",
            [(i, of(i % 4, 4), of(i % 4, 2), k, "ARN"[i % 3], "FO"[k], 0.25) for i in range(24) for k in range(2)],
        ),
    }
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def test_connected_components_of_all_edges(spark, tiny):
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in star_edges(spark, tiny).collect():
        a, b = sorted((find(r.src), find(r.dst)))
        root[b] = a
    want = {x: find(x) for x in root}
    assert len(set(want.values())) == 4
    assert {r.node: r.component for r in QUERIES["connected_components"](spark, tiny).collect()} == want


@pytest.mark.parametrize("name", ["louvain", "split_oversized", "remap_communities"])
def test_communities_take_every_node(spark, tiny, name):
    got = [r.node for r in QUERIES[name](spark, tiny).collect()]
    assert sorted(got) == sorted(r.id for r in star_nodes(spark, tiny).collect())


def test_dedup_takes_nodes_of_every_kind(spark, tiny):
    left = {r.id for r in QUERIES["entity_dedup"](spark, tiny).collect()}
    assert {f"order:{i}" for i in range(24)} <= left
    assert {x.split(":")[0] for x in left} == {"region", "nation", "customer", "supplier", "part", "order"}
    assert sum(x.startswith("part:") for x in left) == 5


def test_dfs_walks_line_items(spark, tiny):
    edges = star_edges(spark, tiny).collect()
    near = {"customer:1"}
    for _ in range(2):
        near |= {b for e in edges for a, b in ((e.src, e.dst), (e.dst, e.src)) if a in near}
    got = QUERIES["dfs_trace"](spark, tiny).collect()
    assert {r.id for r in got} <= near and any(r.id.startswith("part:") for r in got)


def test_jaro_winkler_pairs_of_different_starts(spark, tmp_path):
    spark.createDataFrame([("xarble tile",), ("marble tile",), ("amrble tile",), ("zinc",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.a, r.b) for r in QUERIES["jaro_winkler_all_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("amrble tile", "marble tile"), ("amrble tile", "xarble tile"), ("marble tile", "xarble tile")}


def test_large_graphs_keep_bridges(spark, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f"), ("f", "g"), ("c", "c"), ("c", "d"), ("x", "y")]
    e = spark.createDataFrame(pairs, "src string, dst string").withColumns({"relation": F.lit("uses"), "confidence": F.lit("EXTRACTED")}).coalesce(1)
    n = spark.createDataFrame([(i, i, "code", f"{i}.py", int(i > "c")) for i in "abcdefgxy"],
        "id string, label string, file_type string, source_file string, community int").coalesce(1)
    want = {r.id: pytest.approx(r.betweenness) for r in centrality.node_betweenness(e).collect() if r.betweenness}
    monkeypatch.setattr(centrality, "MAX_EDGES", 3)
    monkeypatch.setattr(Q, "MAX_EDGES", 3, raising=False)
    assert {r.id: r.betweenness for r in centrality.node_betweenness(e).collect() if r.betweenness} == want
    assert [r.subject for r in Q.suggest_questions(n, e).where("kind = 'bridge_node'").collect()] == ["d", "c"]  # 9 and 8 pairs pass them


def _brandes(pairs):
    """(nodes, edges): sums over all ordered pairs, by counting shortest paths."""
    adj: dict = {}
    for a, b in pairs:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)
    nodes, edges = dict.fromkeys(adj, 0.0), {}
    for s in adj:
        order, dist, paths, delta = [s], {s: 0}, {s: 1.0}, dict.fromkeys(adj, 0.0)
        for v in order:
            for w in adj[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        for w in reversed(order):
            for v in adj[w]:
                if dist[v] + 1 == dist[w]:
                    c = paths[v] / paths[w] * (1 + delta[w])
                    delta[v] += c
                    edges[min(v, w), max(v, w)] = edges.get((min(v, w), max(v, w)), 0.0) + c
            if w != s:
                nodes[w] += delta[w]
    return nodes, edges


def test_betweenness_with_trees_folded(spark):
    rng = random.Random(5)
    pairs = [(f"a{i}", f"a{rng.randrange(i)}") for i in range(1, 40)] + [(f"a{rng.randrange(9)}", f"a{rng.randrange(9)}") for _ in range(9)]  # cycles with hanging trees
    pairs += [(f"b{i}", f"b{rng.randrange(i)}") for i in range(1, 12)] + [("c0", "c1"), ("d0", "d1"), ("d1", "d2"), ("d2", "d0"), ("e", "e")]
    e = spark.createDataFrame(pairs + pairs[:5], "src string, dst string")
    nodes, edges = _brandes(pairs)
    n = len(nodes)
    got = {r.id: r.betweenness for r in centrality.node_betweenness(e).collect()}
    assert got == {k: pytest.approx(x / (n - 1) / (n - 2)) for k, x in nodes.items()}
    got = {(r.u, r.v): r.betweenness for r in centrality.edge_betweenness(e).collect()}
    assert got == {k: pytest.approx(x / n / (n - 1)) for k, x in edges.items()}


def test_betweenness_of_a_large_tree(spark):
    """A star of stars of 50,000 nodes: a walk from each would take hours."""
    e = spark.range(50_000).selectExpr("concat('leaf', id) AS src", "concat('hub', id % 5) AS dst").unionAll(spark.range(5).selectExpr("concat('hub', id)", "'top'"))
    n = 50_006
    got = {r.id: r.betweenness for r in centrality.node_betweenness(e, None).where("id not like 'leaf%'").collect()}
    hub = (n - 1) ** 2 - 10_000 - (n - 10_001) ** 2
    assert got == {"top": pytest.approx((5 * 10_001) ** 2 / ((n - 1) * (n - 2)) * 0.8), **{f"hub{i}": pytest.approx(hub / ((n - 1) * (n - 2))) for i in range(5)}}
    b = [r.betweenness for r in centrality.edge_betweenness(e).where("u = 'hub1' and v = 'top'").collect()]
    assert b == [pytest.approx(2 * 10_001 * (n - 10_001) / n / (n - 1))]


def test_sampled_betweenness_is_that_of_its_sources(spark, monkeypatch):
    rng = random.Random(7)
    pairs = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(90)]
    e = spark.createDataFrame(pairs, "src string, dst string")
    monkeypatch.setattr(centrality, "EXACT_NODES", 10)
    some = {r.id: r.betweenness for r in centrality.node_betweenness(e, 20).collect() if r.betweenness}
    monkeypatch.setattr(centrality, "MAX_EDGES", 3)
    assert some == {r.id: pytest.approx(r.betweenness) for r in centrality.node_betweenness(e, 20).collect() if r.betweenness}


def test_hashes_of_nodes_and_rounds(spark):
    import numpy as np

    rows = spark.range(50).selectExpr("concat('n', id) AS x").selectExpr("xxhash64(x) AS h", *(f"xxhash64(x, {r}) % 2 <> 0 AS r{r}" for r in (0, 1, 23))).collect()
    for r in (0, 1, 23):
        assert list(community._odd(np.array([x.h for x in rows]), r)) == [x[f"r{r}"] for x in rows]


@pytest.mark.parametrize("hubs", [None, 90])
def test_communities_by_arrays_are_those_by_joins(spark, monkeypatch, hubs):
    rng = random.Random(11)
    at = [rng.randrange(20) for _ in range(180)]
    pairs = [(f"n{i}", f"n{j}") for _ in range(700) for i, j in [(rng.randrange(180), rng.randrange(180))] if at[i] == at[j] or rng.random() < 0.03]
    pairs += [("h1", "h2"), ("h1", "h1"), ("n3", "gone"), *(("h1", f"x{i}") for i in range(60)), *((f"x{i}", f"x{i + 1}") for i in range(60))]
    e = spark.createDataFrame(pairs, "src string, dst string").coalesce(2)
    n = spark.createDataFrame([(x,) for x in sorted({x for p in pairs for x in p} - {"gone"}) + ["lone"]], "id string").coalesce(1)
    monkeypatch.setattr(numbered, "BLOCK", 100)
    got = {r.node: r.community for r in community.communities(n, e, hubs).collect()}
    monkeypatch.setattr(numbered, "MAX_NODES", 0)
    assert got == {r.node: r.community for r in community.communities(n, e, hubs).collect()}


def test_links_of_labels_by_arrays_are_those_of_all_pairs(spark, tmp_path):
    from weftgraph.functions.text import jaro_winkler
    from weftgraph.operators import alike, dedup
    from weftgraph.operators.components import connected_components
    from weftgraph.scratch import Scratch

    rng = random.Random(2)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(3, 9))) for _ in range(12)]
    texts = {" ".join(rng.choice(words) for _ in range(rng.randrange(1, 4))) for _ in range(150)}
    texts |= {f"order {rng.randrange(90_000, 120_000)}" for _ in range(150)} | {f"customer {i:09}" for i in range(0, 300, 2)} | {"ab", "gpt4x", "gpt5x", "naïve café", "naive café ☃"}
    texts |= {t[:i] + t[i + 1:i + 2] + t[i:i + 1] + t[i + 2:] for t in sorted(texts)[::3] for i in [rng.randrange(len(t))]}
    labels = spark.createDataFrame([(t,) for t in sorted(texts)], "text string").coalesce(1)
    of = lambda links: {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    want, some = of(dedup.similar_labels(labels).select("a", "b")), pytest.MonkeyPatch()
    with some.context() as m:
        m.setattr(alike, "KEYS", 500)
        assert of(dedup.similar_links(labels, Scratch(spark, "links"))) == want and len(set(want.values())) > 10
        m.setattr(alike, "MAX_LABELS", 0)
        assert of(dedup.similar_links(labels, Scratch(spark, "links"))) == want
    pairs = [(x, y) for x in sorted(texts)[:60] for y in sorted(texts)[200:260] if x != y]
    for x, y in pairs:
        assert alike.jaro_winkler_rows(alike._chars([x], len(x)), alike._chars([y], len(y)))[0] == jaro_winkler(x, y)


def test_package_imports_send_no_row_of_a_star_on(spark, monkeypatch):
    from weftgraph.operators import resolution

    classes = [("p", f"C{i}", f"c{i}") for i in range(9)] + [("q", "C1", "c1"), ("q", "D", "d"), ("p", "C0", "c0"), (None, "N", "n"), ("q", "E", None), ("r", "F", "f1")]
    imports = [("f1", "p.*"), ("f1", "p.C1"), ("f1", "q.*"), ("f2", "q.C1"), ("f2", "p.C1"), ("f2", "p.C2"), ("f2", "p.C2"), ("f3", "p.*"), ("f3", "p.*"), ("f1", "r.*"), ("f4", "r.F"),
        ("f4", "x.C1"), (None, "p.*")]
    c, i = spark.createDataFrame(classes, "package string, label string, id string"), spark.createDataFrame(imports, "file_id string, name string")
    want = set()
    for f, name in imports:
        package, label = name.rsplit(".", 1)
        want |= {(f, k) for p, x, k in classes if f and k and p == package and label in ("*", x) and f != k}
    monkeypatch.setattr(resolution, "CHUNK", 2)
    got = resolution.package_imports(i, c)
    rows = [(r.src, r.dst) for r in got.collect()]
    assert sorted(rows) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("Union")  # no pass over all rows after the stars are opened


def test_stars_are_opened_by_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    from weftgraph.operators import resolution

    monkeypatch.setattr(resolution, "FEW_ROWS", 100, raising=False)
    monkeypatch.setattr(resolution, "STAR_ROWS", 400, raising=False)
    c = spark.createDataFrame([(f"p{i % 2}", f"C{i}", f"c{i}") for i in range(60)], "package string, label string, id string")
    got = resolution.package_imports(spark.createDataFrame([(f"f{i % 200}", f"p{i % 2}.*") for i in range(400)], "file_id string, name string"), c)
    by = [len(part) for part in got.rdd.glom().collect() if part]
    assert sum(by) == 6000 and len(by) >= 20 and max(by) <= 1200


def test_full_lists_of_questions_look_for_no_more(spark, tiny, monkeypatch):
    want = [tuple(r) for r in Q.suggest_questions(star_nodes(spark, tiny), star_edges(spark, tiny), 40).collect()][:3]
    assert {r[0] for r in want} == {"ambiguous_edge"}

    def never(*_):
        raise AssertionError("bridges cannot be among the rows")

    monkeypatch.setattr(Q, "node_betweenness", never)
    assert [tuple(r) for r in Q.suggest_questions(star_nodes(spark, tiny), star_edges(spark, tiny), 3).collect()] == want


def test_communities_without_hubs_write_little(spark, tiny, monkeypatch):
    from weftgraph.scratch import Scratch

    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df: saved.append(df.columns) or save(self, df))
    assert QUERIES["split_oversized"](spark, tiny).count() == star_nodes(spark, tiny).count()
    assert saved == [["id"], ["h"], ["u", "n", "v"]]  # no table of edges or of a round


@pytest.mark.parametrize("regions", [1, 3])
def test_rounds_send_two_numbers_a_node(spark, tmp_path, monkeypatch, regions):
    """What a round sends lies on the disk of each machine: the community of each node, its weight, and a bit."""
    import numpy as np

    from weftgraph.scratch import Scratch

    rng = random.Random(9)
    pairs = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(1500)]
    e, scratch = spark.createDataFrame(pairs, "src string, dst string").coalesce(1), Scratch(spark, "rounds")
    order = numbered.order_of(e.selectExpr("explode(array(src, dst)) AS id").distinct(), scratch)
    blocks, sent, whole = numbered.adjacency(e, order, scratch), [], community.per_block

    def kept(blocks, f, *shared):
        sent.append((f.__name__, sum(x.nbytes for x in shared if isinstance(x, np.ndarray))))
        return whole(blocks, f, *shared)

    monkeypatch.setattr(community, "per_block", kept)
    got = community._partition(blocks, order, np.arange(len(order), dtype=np.int32) % regions)
    rounds = [x for name, x in sent if name == "_moves"]
    assert len(rounds) > 2 and max(rounds) <= 8.2 * len(order)
    assert all(a % regions == b % regions for a, b in enumerate(got) if b >= 0)
    assert not spark.conf.get(numbered._CLEAN, "false") == "true"


def test_dedup_by_classes_is_that_of_pairs_and_looks_for_no_component(spark, monkeypatch):
    """Forms in several files, in none, too plain to be compared, and nodes without a form or an id; edges follow."""
    from weftgraph.operators import dedup

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 9))) for _ in range(8)]
    labels = [f"order {rng.randrange(99_900, 100_300)}" for _ in range(120)] + [" ".join(rng.choice(words) for _ in range(2)) for _ in range(80)] + ["aaa", "", None, "zażółć gęślą", "zażółć gęśla"] * 3
    rows = [(f"n{i}" + "_c1" * (i % 11 == 0), t, rng.choice(["f", "g", None])) for i, t in enumerate(labels)] + [(None, labels[0], "f")]
    n = spark.createDataFrame(rows, "id string, label string, source_file string").coalesce(2)
    e = spark.createDataFrame([(rng.choice(rows)[0], rng.choice(rows)[0]) for _ in range(200)], "src string, dst string").coalesce(2)
    of = lambda got: [sorted(map(str, x.collect())) for x in got]
    with monkeypatch.context() as m:
        m.setattr(dedup.L, "MAX_LABELS", 0)
        want = of(dedup.deduplicate(n, e, F.col("label")))

    def never(*_, **__):
        raise AssertionError("classes are the components")

    monkeypatch.setattr(dedup, "connected_components", never)
    monkeypatch.setattr(dedup, "similar_labels", never)
    assert of(dedup.deduplicate(n, e, F.col("label"))) == want and 20 < len(want[0]) < 150


def test_labels_are_not_gathered_on_the_driver(spark, monkeypatch):
    """Links of labels that share a hot shingle, a combination of very many, and characters beyond 16 bits."""
    import numpy as np
    import pyarrow as pa

    from weftgraph.functions.text import shannon_bits
    from weftgraph.operators import alike

    rng = random.Random(6)
    texts = sorted({f"part {rng.randrange(9_000):05} of {rng.choice('xyz') * 3} \U0001f600" for _ in range(250)} | {f"node {i:09}" for i in range(200)} | {" ", "ab", "a", "\U0001f600\U0001f601"})
    counts = np.full(1 << alike.BUCKETS, 9, np.int32)
    every = pa.array(texts)
    want = alike.linked(every, counts, 0, 1, 0.7, 0.92, 12)
    for keys, most in ((8, 60), (200_000, 1)):
        monkeypatch.setattr(alike, "KEYS", keys)
        monkeypatch.setattr(alike, "COMBINATIONS", most)
        root = np.arange(len(texts), dtype=np.int32)
        rows, codes = alike.token_rows(every, counts)
        by = alike.Shares(codes, counts, 7, 0.7)
        dealt = []
        for n, (at, r) in rows.items():
            i, to = by.rows(r, max(n - o for o in (alike.least_overlap(n, m, 0.7) for m in rows) if o))
            dealt.append((at[i], to))
        for share in range(7):
            own = np.concatenate([at[to == share] for at, to in dealt]).astype(np.int32)
            got = alike.linked(every.take(pa.array(own)), counts, share, 7, 0.7, 0.92, 12)
            alike.joined(root, own, own[got])
        assert (root == want).all()
    df = spark.createDataFrame([(t,) for t in texts if t.strip()], "t string").withColumn("b", shannon_bits(F.col("t"))).toPandas()
    bits = alike.entropy_bits(pa.array(df["t"].tolist()))
    assert all(np.isnan(x) == (max(t) > "￿") and (np.isnan(x) or abs(x - y) < 1e-9) for x, t, y in zip(bits, df["t"], df["b"], strict=True))
