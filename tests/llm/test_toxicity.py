import random

import numpy as np
import pytest
import zstandard as zstd

from weftgraph.llm import toxicity as X


def corpus(n, seed):
    rng = random.Random(seed)
    parts = ["an", "er", "th", "on", "in", "re", "ti", "es", "ha", "ou", "st", "nd"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(rng.randrange(30, 200))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "dimwit", "vermin", "buffoon"]))
        out.append((" ".join(w), y))
    return out


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_texts(spark):
    model = X.train(corpus(700, 1))
    held = corpus(300, 2)
    df = spark.createDataFrame([(i, t, y, "c") for i, (t, y) in enumerate(held)] + [(None, None, 0, "c"), (None, "", 0, "c")], "doc_id long, text string, y int, score string")
    out = X.score_documents(df, model).collect()
    assert len(out) == 302 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= X.CUT) for r in out)
    got = {r.doc_id: r.score for r in out if r.doc_id is not None}
    assert auc(np.array([got[i] for i in range(300)]), np.array([y for _, y in held])) > 0.95
    assert len({r.score for r in out if r.doc_id is None}) == 1
    assert X.score_documents(df.limit(0), model).count() == 0


@pytest.mark.parametrize("texts", [[], [("only one class", 0)], [("a b", 1), (None, 0)]])
def test_degenerate_training(texts):
    scores = X.Scorer(X.train(texts)).score(["some text", None, ""])
    assert len(scores) == 3 and ((0 <= scores) & (scores <= 1)).all()


def test_codes_are_the_compressed_lengths():
    model = X.train(corpus(60, 3))
    scorer = X.Scorer(model)
    for w in X.windows_of(b"blockhead") + X.windows_of(b"x") + X.windows_of(b"averyverylongwordindeed"):
        want = len(w)
        for d in (model.toxic, model.ordinary):
            f = X._Length(d, model.preamble)
            want = want * X._SPAN + max(0, min(X._SPAN - 1, f(w) - f(b"")))
        word = w.strip(b" ")
        if X.windows_of(word) == [w]:
            assert scorer.cells(word.decode()).tolist() == [want]
    assert zstd.__version__


def test_sample_is_bounded_and_repeats_count_once(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(30)] + [(3, "t3"), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    got = X.training_sample(docs, labels, toxic=5, ordinary=7)
    assert sorted(y for _, y in got) == [0] * 7 + [1] * 5
