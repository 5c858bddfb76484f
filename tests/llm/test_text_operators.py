"""Decontamination, BPE, sharding and language identification against plain twins."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from weftgraph.llm import byte_bpe, decontaminate, langid, sharding

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_decontamination_equals_window_search(spark):
    rng = random.Random(1)
    vocab = [f"W{i}" for i in range(30)] + ["é", "ß9", "naïve"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([20, 13, 14, 40, 5, 1, 3, 12, 0, 30])] + [(98, None), (None, "w1 w2 w3"), (3, "w0 w0 w0 w0")]
    docs = []
    for d in range(200):
        w = [rng.choice(vocab[:12]) if rng.random() < 0.7 else f"q{rng.randrange(99)}" for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            src = rng.choice(items[:10])[1].split()
            a = rng.randrange(len(src) + 1)
            w[3:3] = src[a : a + rng.randrange(1, 40)]
        docs.append((d, rng.choice([" ", ", ", "\n", "--"]).join(w), "clash"))
    docs += [(900, None, "c"), (901, "", "c"), (900, None, "c"), (None, docs[3][1], "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_hit string")
    known = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df, known).collect()
    plain = [(str(i), t) for i, t in items if i is not None]
    assert len(got) == len(docs)
    for r in got:
        n, hit, found = decontaminate.brute_hits(r.text, plain)
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found)
        assert sum(s.end - s.start for s in r.spans) == hit
        if r.text is not None:
            assert decontaminate.brute_hits(r.clean_text, [])[0] == n - hit
    none = decontaminate.decontaminate(df, known.limit(0))
    assert none.agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.decontaminate(df.limit(0), known).count() == 0
    # several automata: every item in a group of its own, and the longest cut into pieces
    cut = decontaminate.decontaminate(df, known, max_item_words=26)
    assert cut.columns == decontaminate.decontaminate(df, known).columns
    assert len(list(decontaminate.groups_of(plain, max_words=26))) > 4
    assert Counter(map(repr, cut.collect())) == Counter(map(repr, got))
    wide = df.withColumn("row", F.lit(1)).withColumn("g_spans", F.lit("x"))
    assert Counter((r.row, r.g_spans, r.n_hit) for r in decontaminate.decontaminate(wide, known, max_item_words=26).collect()) == Counter((1, "x", r.n_hit) for r in got)
    assert decontaminate.decontaminate(df.limit(0), known, max_item_words=26).count() == 0


def test_groups_of_items_keep_every_window():
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(n))) for i, n in enumerate([0, 1, 12, 13, 26, 27, 100, 333])] + [(None, "a"), (9, None)]
    whole = next(decontaminate.groups_of(items))
    groups = list(decontaminate.groups_of(items, max_words=40))
    assert all(sum(len(w) for _, w in g) <= 40 for g in groups) and len(groups) > 5
    wins = lambda gs: {(i, w[a : a + 13].tobytes()) for g in gs for i, w in g if len(w) >= 13 for a in range(len(w) - 12)}
    assert wins([whole]) == wins(groups)
    assert {(i, w.tobytes()) for i, w in whole if 0 < len(w) < 13} == {(i, w.tobytes()) for g in groups for i, w in g if 0 < len(w) < 13}
    assert list(decontaminate.groups_of([])) == [[]]


def texts():
    rng = random.Random(2)
    out = ["", "hello world", "  \n\t x", "1234567 89", "it's we'LL they're", "a" * 3000, "ab" * 900, "éèüß ñandú 你好世界 🙂👍🏽", "\x1c\x1d\x85  end", "<|endoftext|>", "\r\n\r\n  a"]
    out += ["".join(rng.choice("abc \n'é9!-🙂 ") for _ in range(rng.randrange(1, 200))) for _ in range(150)]
    return out


def test_bpe_equals_library_and_round_trips(spark):
    ranks = byte_bpe.load_ranks(PATH)
    own = byte_bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for t in texts():
        ids = own.encode(t)
        assert ids == lib.encode_ordinary(t), t[:60]
        assert own.decode(ids) == t.encode()
    rows = [(i, t, 5) for i, t in enumerate(texts())] + [(None, None, 5), (1, "hello world", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = byte_bpe.encode_documents(df, PATH, public_tokenizers.PATTERN, digests=True)
    for r in byte_bpe.decode_documents(out, PATH).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.token_ids == lib.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        own.decode([10**6])


def test_rank_queue_pops_least_rank_leftmost_first():
    rng = random.Random(3)
    q, plain = byte_bpe.RankQueue(50_256), []
    for _ in range(2000):
        if rng.random() < 0.6:
            x = (rng.randrange(50256), rng.randrange(1000))
            q.push(*x)
            plain.append(x)
        else:
            plain.sort()
            assert q.pop() == (plain.pop(0) if plain else None)


def check_shards(rows, out, n=8):
    import zlib

    assert sorted((str(d), t is None) for d, t in rows) is not None and len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted(((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows))
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == want
    sizes = [sum(r["size"] for r in out if r.shard == s) for s in range(n)]
    return sizes


def test_sharding_is_near_equal_and_keeps_groups(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randrange(0, 400) + str(i)) for i in range(4000)] + [(10_000 + i, f"copy {i % 50}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = sharding.shard_by_bytes(df, 8).collect()
    sizes = check_shards(rows, out)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8
    text = dict(rows)
    homes = {}
    for r in out:
        homes.setdefault(text[r.doc_id], set()).add(r.shard)
    assert all(len(v) == 1 for v in homes.values())


def test_sharding_splits_a_hot_group_and_repeated_rows(spark):
    rows = [(i, "hot text " * 20) for i in range(3000)] + [(7, "same row" * 10)] * 1500 + [(i, f"t{i}" * 9) for i in range(3000)] + [(None, None)] * 5
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8).collect()
    sizes = check_shards(rows, out)
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8
    assert sharding.shard_by_bytes(spark.createDataFrame([], "doc_id long, text string"), 8).count() == 0
    few = sharding.shard_by_bytes(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), 8).collect()
    check_shards([(1, "a"), (2, None)], few)


def test_language_id_held_out_and_code_switching(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.train(langid.training_sample(docs.where(fold != 1), "text", "lang"), max_words=60_000)
    out = langid.identify(docs, model).where(fold == 1).collect()
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    by = {r.lang: r.text for r in docs.where("length(text) > 600").collect()}
    mixed = " ".join(by["de"].split()[:60] + by["es"].split()[:60])
    odd = [(1, mixed, "x"), (2, None, "x"), (3, "123 -- 45", "x"), (4, "", "x"), (None, "¿?", "x"), (5, by["fr"], "x"), (5, by["fr"], "x")]
    got = {(r.doc_id, i): r for i, r in enumerate(langid.identify(spark.createDataFrame(odd, "doc_id long, text string, score string").coalesce(1), model).collect())}
    rows = list(got.values())
    assert [r.lang_pred for r in rows[1:5]] == ["und"] * 4 and all(r.score == 0 for r in rows[1:5])
    assert rows[5].lang_pred == rows[6].lang_pred == "fr" and 0.5 < rows[5].score <= 1
    words = [x.lang for x in rows[0].lang_runs for _ in range(x.first, x.last + 1)]
    assert sum(w == "de" for w in words[:55]) > 45 and sum(w == "es" for w in words[-55:]) > 45
    assert langid.identify(spark.createDataFrame(odd, "doc_id long, text string, s string"), langid.train([])).where("lang_pred <> 'und'").count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    n, length, k = 3, 5, 3
    emit = rng.uniform(0.1, 2, (n, length, k))
    moves = rng.normal(0, 1, (k, k))
    used = np.ones((n, length), bool)
    used[1, 3:] = used[2, 1:] = False
    post, pairs = langid.forward_backward(emit, used, moves)
    want_pairs = np.zeros((k, k))
    for c in range(n):
        m = int(used[c].sum())
        want, z, two = np.zeros((m, k)), 0.0, np.zeros((k, k))
        for path in itertools.product(range(k), repeat=m):
            weight = np.prod([emit[c, t, y] for t, y in enumerate(path)]) * np.exp(sum(moves[a, b] for a, b in itertools.pairwise(path)))
            z += weight
            for t, y in enumerate(path):
                want[t, y] += weight
            for a, b in itertools.pairwise(path):
                two[a, b] += weight
        assert np.allclose(post[c, :m], want / z)
        want_pairs += two / z
    assert np.allclose(pairs, want_pairs)


def test_language_model_without_words_or_with_one_label(spark):
    docs = spark.createDataFrame([(1, "ein Wort"), (2, None)], "doc_id long, text string")
    for pairs in ([("123", "en"), ("456", "de")], [], [("one two", "en")]):
        out = langid.identify(docs, langid.train(pairs)).collect()
        assert len(out) == 2 and all(0 <= r.score <= 1 for r in out)


def test_first_texts_of_a_label_are_those_of_the_least_hashes(spark):
    rows = [(f"text {i}", "en" if i % 3 else "de") for i in range(400)] * 2 + [(None, "en"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = langid.training_sample(df, "text", "lang", 50)
    hashed = df.where("text is not null and lang is not null").distinct().select("text", "lang", F.xxhash64("text", F.lit(11)).alias("h")).collect()
    want = {lang: {r.text for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: r.h)[:50]} for lang in ("de", "en")}
    assert {lang: {t for t, x in got if x == lang} for lang in ("de", "en")} == want and len(got) == 100
