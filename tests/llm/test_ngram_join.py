import random
import re
from collections import defaultdict

import numpy as np
import pytest

from weftgraph.llm import ngram_join as N

SCHEMA = "doc_id long, text string"


def sets(rows, k=4):
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def brute(rows, k=4, num=85):
    s = sets(rows, k)
    parent = list(range(len(s)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            a, b = s[i][1], s[j][1]
            if a and b and 100 * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(s):
        groups[root(i)].append(d)
    least = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((d, len(x), least[root(i)]) for i, (d, x) in enumerate(s)), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randrange(40))
    passage = [word() for _ in range(30)]
    rows, d = [], 0
    for _ in range(n):
        base = [word() for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 120, 300]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = word()
            rows.append((d, " ".join(w).title() if rng.random() < 0.2 else "\n".join(w)))
            d += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = N.jaccard_components(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_five_words_and_four_fifths(spark):
    rows = corpus(6)
    got = N.jaccard_components(spark.createDataFrame(rows, SCHEMA), k=5, num=80)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows, 5, 80)
    with pytest.raises(ValueError, match="2/3"):
        N.jaccard_components(spark.createDataFrame(rows, SCHEMA), num=50)


def test_columns_with_and_without_keys(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "A b c d e"), (3, None)], SCHEMA)
    plain, full = N.jaccard_components(df), N.jaccard_components(df, keys=True)
    assert plain.columns == ["doc_id", "n_shingles", "class_id", "component_id"]
    assert full.columns == [*plain.columns, "group_id", "text_key"]
    by = {r.doc_id: r for r in full.collect()}
    assert by[1].class_id == by[2].class_id and by[1].group_id == by[2].group_id and by[1].text_key != by[2].text_key
    assert by[3].class_id is None and by[3].group_id is None and by[3].component_id == 3


def test_classes_of_many_copies_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT_LEAST", 3)
    rows = corpus(8, 20) + [(5000 + i, "one text with many copies of itself here") for i in range(40)] + [(None, None), (6000, "")]
    got = N.jaccard_components(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_large_components_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 8)
    rows = corpus(4, 30)
    base = [f"w{i}" for i in range(90)]
    rng = random.Random(5)
    for d in range(1000, 1060):
        w = list(base)
        for i in rng.sample(range(90), rng.randrange(0, 4)):
            w[i] = f"z{rng.randrange(10**6)}"
        rows.append((d, " ".join(w)))
    got = N.jaccard_components(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_common_columns_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "SAMPLE_SHARE", 1)
    monkeypatch.setattr(N, "SAMPLE_LEAST", 2)
    rows = corpus(6)
    got = N.jaccard_components(spark.createDataFrame(rows, SCHEMA))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_signatures_meet_at_the_bound():
    rng = np.random.default_rng(0)
    for n in [1, 2, 5, 6, 7, 11, 12, 13, 27, 40, 100, 333, 1000]:
        for _ in range(20):
            pool = np.unique(rng.integers(0, 2**63, 3 * n + 40, dtype=np.uint64))
            rng.shuffle(pool)
            x = pool[:n]
            lose = rng.integers(0, n // 6 + 1)
            y = np.concatenate([x[: n - lose], pool[n : n + rng.integers(0, n // 6 + 1)]])
            both = len(np.intersect1d(x, y))
            if len(y) and 185 * both >= 85 * (len(x) + len(y)):
                assert len(np.intersect1d(N.signatures(np.sort(x)), N.signatures(np.sort(y)))), n


def test_nulls_empty_repeats_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "one", "x"), (9, "ONE", "x"), (9, "ONE", "x"), (None, "one", "x"), (None, "lonely words here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(docs).collect()], key=str)
    assert got == brute([r[:2] for r in rows])
    kept = N.one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, None), (2, ""), (3, " \n"), (4, "one"), (None, "lonely words here")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert N.jaccard_components(docs).count() == 0
    assert N.one_per_group(docs).count() == 0


def test_rows_of_the_matrix_are_shuffled_once(spark, monkeypatch):
    """Places are joined to the texts: no row of the matrix is dealt by its class before it goes to its task."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(5)]
    rows = [(i, " ".join(b[:j] + ["x"] + b[j + 1:])) for i, (b, j) in enumerate((b, rng.randrange(60)) for b in base for _ in range(8))]
    d = spark.createDataFrame(rows + rows[:6], SCHEMA)
    plans, linked = [], N.connected_components

    def kept(links, a, b, scratch):
        plans.append(links._jdf.queryExecution().executedPlan().toString())
        return linked(links, a, b, scratch)

    monkeypatch.setattr(N, "connected_components", kept)
    monkeypatch.setattr(N, "BLOCK_ROWS", 4)  # classes in several places
    held = spark.conf.get(key := "spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(d).collect()), key=str)
    spark.conf.set(key, held)
    assert got == brute(rows + rows[:6])
    assert "FlatMapGroupsInPandas" in plans[1] and plans[1].count("hashpartitioning(task") == 1 and "hashpartitioning(uid" not in plans[1]
