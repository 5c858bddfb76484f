"""Language identification of words by a linear-chain conditional random field.

Every word has hashed features: the word itself (lexicon), its prefixes and suffixes of two and
three bytes, and its byte trigrams. Their weights per language give emissions, learned transitions
tie neighbours, and forward-backward gives every word its posterior. Chains are runs of ``CHAIN``
words of one text, so all chains of a batch move in step. A text's language is the one with the
largest sum of posteriors over all its words.

Training texts carry one label each; chains for training are put together from runs of different
texts, so that the transitions see switches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from weftgraph.llm import kernels as K
from weftgraph.llm.batches import bounded

CHAIN = 64
BUCKETS = 1 << 17
#: Bounds of the training sample: texts per language (by the order of a hash) and words in all.
TEXTS_PER_LANG, TRAIN_WORDS = 250, 250_000
#: A label is dealt to so many parts before its first texts are taken.
SALTS = 32
EPOCHS, BATCH, RATE, L2, RUN_MEAN = 4, 128, 0.3, 1e-5, 20
UNKNOWN = "und"


def letter_mask() -> np.ndarray:
    """Word bytes: A-Z, a-z and all bytes of characters beyond ASCII."""
    word = np.ones(256, bool)
    word[:128] = False
    word[65:91] = word[97:123] = True
    return word


def features(c: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature buckets, first feature of each word with the total last), words in order."""
    data, starts, ends = c.data, c.starts, c.ends
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    n = len(starts)
    size = ends - starts
    tri = np.maximum(size - 2, 0)
    count = tri + 5
    at = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=at[1:])
    out = np.empty(int(at[-1]), np.uint64)
    two = np.zeros(len(low) + 1, np.uint64)
    two[:-2] = low[:-1] * np.uint64(257) + low[1:]
    three = two.copy()
    three[:-3] = two[:-3] * np.uint64(257) + low[2:]
    first = at[:-1]
    out[first] = c.hashes
    out[first + 1] = two[starts] + np.uint64(1 << 40)
    out[first + 2] = three[starts] * np.uint64(2) + (size > 2).astype(np.uint64) + np.uint64(2 << 40)
    out[first + 3] = two[np.maximum(ends - 2, 0)] + np.uint64(3 << 40)
    out[first + 4] = three[np.maximum(ends - 3, 0)] * np.uint64(2) + (size > 2).astype(np.uint64) + np.uint64(4 << 40)
    where = np.repeat(first + 5 - np.concatenate([[0], np.cumsum(tri)[:-1]]), tri) + np.arange(int(tri.sum()))
    source = np.repeat(starts - np.concatenate([[0], np.cumsum(tri)[:-1]]), tri) + np.arange(int(tri.sum()))
    out[where] = three[source] + np.uint64(5 << 40)
    return (K.mix(out) & np.uint64(BUCKETS - 1)).astype(np.int32), at


class Crf:
    """Weights by feature bucket and label, transitions and the order of labels."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((BUCKETS, len(labels)), np.float32)
        self.moves = np.eye(len(labels), dtype=np.float64) * 2.0

    def emissions(self, c: K.Words) -> np.ndarray:
        idx, at = features(c)
        return np.add.reduceat(self.weights[idx], at[:-1], axis=0) if len(at) > 1 else np.zeros((0, len(self.labels)), np.float32)


def _layout(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every word in the padded chains, is the slot used) for texts of these lengths."""
    chains = -(-lengths // CHAIN)
    base = np.concatenate([[0], np.cumsum(chains)[:-1]]) * CHAIN
    total = int(lengths.sum())
    inside = np.arange(total) - np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    slot = np.repeat(base, lengths) + inside
    used = np.zeros(int(chains.sum()) * CHAIN, bool)
    used[slot] = True
    return slot, used


def forward_backward(emit: np.ndarray, used: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors [chains, CHAIN, labels] and the sum of those of all transitions.

    ``emit`` is exp of the emissions up to a factor per word; unused slots come last in a chain.
    """
    n, length, k = emit.shape
    step = np.exp(moves)
    alpha = np.empty_like(emit)
    a = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
    alpha[:, 0] = a
    for t in range(1, length):
        nxt = (a @ step) * emit[:, t]
        nxt /= nxt.sum(1, keepdims=True)
        a = np.where(used[:, t, None], nxt, a)
        alpha[:, t] = a
    post = np.empty_like(emit)
    b = np.ones((n, k))
    post[:, -1] = alpha[:, -1]
    pairs = np.zeros((k, k))
    for t in range(length - 2, -1, -1):
        eb = emit[:, t + 1] * b
        back = eb @ step.T
        on = used[:, t + 1, None]
        joint_norm = (alpha[:, t] * back).sum(1, keepdims=True)
        pairs += (np.where(on, alpha[:, t] / joint_norm, 0.0).T @ eb) * step
        back /= back.sum(1, keepdims=True)
        b = np.where(on, back, 1.0)
        p = alpha[:, t] * b
        post[:, t] = p / p.sum(1, keepdims=True)
    return post, pairs


def _scaled(e: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(e - e.max(1, keepdims=True), -60, 0)).astype(np.float64)


def train(texts: list[tuple[str, str]], seed: int = 7, max_words: int = TRAIN_WORDS) -> Crf:
    """Fits a model on (text, label) pairs by AdaGrad on the conditional likelihood."""
    labels = sorted({label for _, label in texts})
    model = Crf(labels)
    if len(labels) < 2:
        return model
    rng = np.random.default_rng(seed)
    idx_all, at_all, runs = [], [np.zeros(1, np.int64)], [[] for _ in labels]
    done = total = 0
    for i in rng.permutation(len(texts)):
        text, label = texts[i]
        for c in K.chunks(pa.array([text], pa.large_string()), letter_mask()):
            idx, at = features(c)
            n = len(at) - 1
            if not n:
                continue
            idx_all.append(idx)
            at_all.append(at[1:] + done)
            done += len(idx)
            cut = 0
            while cut < n:
                size = 1 + int(rng.geometric(1 / RUN_MEAN))
                runs[labels.index(label)].append((total + cut, min(n, cut + size) + total))
                cut += size
            total += n
        if total >= max_words:
            break
    if not idx_all:  # no text has a word with a letter
        return model
    idx, at = np.concatenate(idx_all), np.concatenate(at_all)
    order = [(k, r) for k, rs in enumerate(runs) for r in rs]
    slots = rng.permutation(len(order))
    words = np.concatenate([np.arange(*order[i][1]) for i in slots])
    gold = np.concatenate([np.full(order[i][1][1] - order[i][1][0], order[i][0]) for i in slots])
    keep = len(words) // CHAIN * CHAIN
    if not keep:
        return model
    words, gold = words[:keep].reshape(-1, CHAIN), gold[:keep].reshape(-1, CHAIN)
    k = len(labels)
    square, move_square = np.full((BUCKETS, k), 1e-6, np.float32), np.full((k, k), 1e-6)
    for _ in range(EPOCHS):
        for pick in np.array_split(rng.permutation(len(words)), max(1, len(words) // BATCH)):
            w, g = words[pick].ravel(), gold[pick]
            first, count = at[w], at[w + 1] - at[w]
            flat = idx[np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))]
            emit = np.add.reduceat(model.weights[flat], np.concatenate([[0], np.cumsum(count)[:-1]]), axis=0)
            post, pairs = forward_backward(_scaled(emit).reshape(len(pick), CHAIN, k), np.ones((len(pick), CHAIN), bool), model.moves)
            miss = post.reshape(-1, k)
            miss[np.arange(len(w)), g.ravel()] -= 1
            grad = np.stack([np.bincount(flat, np.repeat(miss[:, j], count), BUCKETS) for j in range(k)], 1).astype(np.float32) / len(pick)
            grad += L2 * model.weights
            square += grad * grad
            model.weights -= RATE * grad / np.sqrt(square)
            np.add.at(pairs, (g[:, :-1].ravel(), g[:, 1:].ravel()), -1)
            pairs /= len(pick)
            move_square += pairs * pairs
            model.moves -= RATE * pairs / np.sqrt(move_square)
    return model


def training_sample(docs: DataFrame, text_col: str, label_col: str, per_label: int = TEXTS_PER_LANG) -> list[tuple[str, str]]:
    """At most ``per_label`` distinct texts of every label, in the order of a hash of the text.

    The first of a label are the first among the first of its ``SALTS`` parts, so no task orders all of a
    label that holds much of the table.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("text is not null and label is not null").withColumn("key",
        F.xxhash64("text", F.lit(11)))
    # the order is taken over hashes alone; only the texts that are picked travel
    leading = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("n") <= per_label).drop("n")
    parts = rows.select("label", "key", F.pmod("key", F.lit(SALTS)).alias("salt")).distinct()
    first = leading(leading(parts, "label", "salt"), "label").select("label", "key")
    got = rows.join(F.broadcast(first), ["label", "key"])  # at most per_label rows a label
    return [(r["text"], r["label"]) for r in got.groupBy("label", "key").agg(F.min("text").alias("text")).orderBy("label", "key").collect()]


def identify(docs: DataFrame, model: Crf, text_col: str = "text", runs: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` plus lang_pred, score double and, by choice, lang_runs: the
    maximal runs of words of one language as array<struct<first:int,last:int,lang:string>> (word
    positions, last inclusive).

    ``und`` with score 0 if the text is null or has no letter, or if the model knows no label.
    Repeated rows are kept; clashing columns of ``docs`` are replaced.
    """
    bounded(docs.sparkSession)
    new = ["lang_pred", "score", *["lang_runs"] * runs]
    own = [c for c in docs.columns if c not in new]
    moved = docs.select(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(own)), F.when(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.col(f"`{text_col}`")).alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        k = len(crf.labels)
        names = np.array([*crf.labels, UNKNOWN], object)
        for batch in batches:
            n = batch.num_rows
            pred, score = np.full(n, k), np.zeros(n)
            found: list[list] = [[] for _ in range(n)]
            for c in K.chunks(batch.column(len(own)), letter_mask()) if k else ():
                lengths = np.diff(c.bounds)
                some = np.flatnonzero(lengths)
                if not len(some):
                    continue
                slot, used = _layout(lengths[some])
                emit = np.ones((len(used), k))
                emit[slot] = _scaled(crf.emissions(c))
                post, _ = forward_backward(emit.reshape(-1, CHAIN, k), used.reshape(-1, CHAIN), crf.moves)
                post = post.reshape(-1, k)[slot]
                sums = np.add.reduceat(post, c.bounds[:-1][some], axis=0)
                best = sums.argmax(1)
                pred[c.first + some] = best
                score[c.first + some] = np.clip(sums[np.arange(len(some)), best] / lengths[some], 0, 1)
                if runs:
                    tags = post.argmax(1)
                    for i in some.tolist():
                        mine = tags[c.bounds[i] : c.bounds[i + 1]]
                        cut = np.flatnonzero(mine[1:] != mine[:-1]) + 1
                        edges = [0, *cut.tolist(), len(mine)]
                        found[c.first + i] = [{"first": a, "last": b - 1, "lang": crf.labels[mine[a]]} for a, b in zip(edges, edges[1:], strict=False)]
            arrays = [*(batch.column(i) for i in range(len(own))), pa.array(names[pred].tolist(), pa.string()), pa.array(score)]
            if runs:
                arrays.append(pa.array(found, run_type))
            yield pa.RecordBatch.from_arrays(arrays, names=[*(f"o{i}" for i in range(len(own))), *new])

    added = "lang_pred string, score double" + ", lang_runs array<struct<first:int,last:int,lang:string>>" * runs
    schema = StructType([*moved.drop("t").schema.fields, *StructType.fromDDL(added).fields])
    out = moved.mapInArrow(run, schema)
    return out.select(*(F.col(f"o{i}").alias(c) for i, c in enumerate(own)), *new)
