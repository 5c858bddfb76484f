"""Toxicity by compression distance.

A zstandard dictionary is trained on windows of toxic texts and another on those of ordinary texts.
Every window of a text (a word with its borders, long words in overlapping pieces) is compressed
with both behind a fixed preamble, which keeps short windows from being stored raw. The window's
length and its two compressed lengths name a cell; how much more often toxic texts fall into a cell
than ordinary ones, on texts that the dictionaries have not seen, is its weight of evidence. How
many windows of a text reach each of a row of thresholds of it, as shares and as counts, is
calibrated by logistic regression on yet other texts.

Lengths depend on the window alone, so workers keep them in bounded tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.batches import bounded

#: Bounds of the training sample, in texts of either class (in the order of a hash of the id).
TOXIC_TEXTS, ORDINARY_TEXTS = 1200, 2400
DICT_SIZE = 65_536
SAMPLES_PER_BYTE = 5
WHOLE, PIECE, STEP = 12, 8, 4
THRESHOLDS = (0.25, 0.5, 1.0, 1.5, 2.0, 3.0)
CUT = 0.3
#: A window is typical of toxic texts if so many of these hold it, and so many times the share of ordinary ones.
TYPICAL_LEAST, TYPICAL_RATIO = 3, 2.0
_SPAN = 24  # compressed lengths beyond the preamble's are clipped to 0..23
_CELLS = (WHOLE + 1) * _SPAN * _SPAN
SMOOTH = 3.0
WORDS_KEPT, WINDOWS_KEPT = 300_000, 500_000
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8").lower())


def windows_of(word: bytes) -> list[bytes]:
    """The word with its borders; a long one in pieces that overlap by half and end with it."""
    w = b" " + word + b" "
    if len(w) <= WHOLE:
        return [w]
    return [*(w[i : i + PIECE] for i in range(0, len(w) - PIECE, STEP)), w[-PIECE:]]


def _dictionary(windows: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too little text for that, the text itself."""
    try:
        return zstd.train_dictionary(size, windows).as_bytes()
    except zstd.ZstdError:
        return b"".join(windows)[-size:] or b" " * 8


class _Length:
    """Compressed length of preamble and window with one dictionary."""

    def __init__(self, data: bytes, preamble: bytes):
        base = dict(window_log=17, search_log=4, min_match=3, target_length=16, strategy=zstd.STRATEGY_BTOPT)
        known = zstd.ZstdCompressionDict(data)
        known.precompute_compress(compression_params=zstd.ZstdCompressionParameters(chain_log=17, hash_log=17, **base))
        params = zstd.ZstdCompressionParameters(chain_log=10, hash_log=10, write_content_size=False, write_dict_id=False, format=zstd.FORMAT_ZSTD1_MAGICLESS, **base)
        self.compress = zstd.ZstdCompressor(dict_data=known, compression_params=params).compress
        self.preamble = preamble

    def __call__(self, window: bytes) -> int:
        return len(self.compress(self.preamble + window))


class Model:
    """Dictionaries, preamble, evidence of the cells and weights; picklable."""

    def __init__(self, toxic: bytes, ordinary: bytes, preamble: bytes):
        self.toxic, self.ordinary, self.preamble = toxic, ordinary, preamble
        self.evidence: np.ndarray | None = None
        self.weights: np.ndarray | None = None


class _Codes(dict):
    """Per word the packed cells of its windows, both tables bounded: a full one starts anew."""

    def __init__(self, model: Model):
        super().__init__()
        self.pair = [_Length(d, model.preamble) for d in (model.toxic, model.ordinary)]
        self.bare = [f(b"") for f in self.pair]
        self.windows: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        out = b""
        for w in windows_of(word):
            code = self.windows.get(w)
            if code is None:
                cell = len(w)
                for f, bare in zip(self.pair, self.bare, strict=True):
                    cell = cell * _SPAN + max(0, min(_SPAN - 1, f(w) - bare))
                code = cell.to_bytes(2, "little")
                if len(self.windows) >= WINDOWS_KEPT:
                    self.windows.clear()
                self.windows[w] = code
            out += code
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = out
        return out


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.codes = _Codes(model) if model.toxic else None

    def cells(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.codes.__getitem__, words_of(text))), "<u2")

    def features(self, text: str | None) -> np.ndarray:
        found = self.model.evidence[self.cells(text)]
        n = max(1, len(found))
        over = [int((found >= t).sum()) for t in THRESHOLDS]
        top = np.sort(found)[-3:] if len(found) else np.zeros(1)
        return np.array([*(x / n for x in over), *(np.log1p(x) for x in over), found.sum() / n, np.clip(found, 0, None).sum() / n, top.max(), top.mean()])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.model.weights is None or not texts:
            return np.zeros(len(texts))
        return _probability(np.stack([self.features(t) for t in texts]), self.model.weights)


def _probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    mean, scale, beta = w
    return 1 / (1 + np.exp(-np.clip(beta[0] + ((x - mean[1:]) / scale[1:]) @ beta[1:], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps: rows of (mean, scale, weight), the constant first."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    beta = np.zeros(z.shape[1])
    ridge = np.full(len(beta), max(1.0, 1e-3 * len(y)))
    ridge[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * beta)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.stack([np.r_[0, mean], np.r_[1, scale], beta])


def train(texts: list[tuple[str | None, int]], seed: int = 5) -> Model:
    """Dictionaries from half of the texts, evidence from a quarter, weights from the last. One class
    alone: no weights, score 0. Too few texts for parts of their own share one part."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    cut = [[i for i in order if texts[i][1] == y] for y in (0, 1)]
    if not cut[0] or not cut[1]:
        return Model(b"", b"", b"")
    few = min(map(len, cut)) < 8
    part = lambda a, b: [c if few else c[int(len(c) * a) : int(len(c) * b)] for c in cut]
    by_text = [[[w for word in words_of(texts[i][0]) for w in windows_of(word)] for i in c] for c in part(0, 0.5)]
    windows = [[w for text in c for w in text] for c in by_text]
    # What toxic texts say as ordinary ones do teaches nothing: their dictionary learns the windows
    # that toxic texts hold clearly more often (all of them if there are none such).
    held = [Counter(w for text in c for w in set(text)) for c in by_text]
    share = max(1, len(by_text[1])) / max(1, len(by_text[0]))
    typical = {w for w, n in held[1].items() if n >= TYPICAL_LEAST and n + 0.5 >= TYPICAL_RATIO * share * (held[0][w] + 0.5)}
    windows[1] = [w for w in windows[1] if w in typical] or windows[1]
    common = b"".join(w for w, _ in sorted(Counter(windows[0]).items(), key=lambda kv: (-kv[1], kv[0]))[:12])[:40]
    drawn = [[w[i] for i in rng.permutation(len(w))[: DICT_SIZE * SAMPLES_PER_BYTE]] for w in windows]
    model = Model(_dictionary(drawn[1], DICT_SIZE), _dictionary(drawn[0], DICT_SIZE), common)
    scorer = Scorer(model)
    seen = [np.zeros(_CELLS), np.zeros(_CELLS)]
    for y, c in enumerate(part(0.5, 0.75)):
        for i in c:
            seen[y] += np.bincount(scorer.cells(texts[i][0]), minlength=_CELLS)
    rate = [(x + SMOOTH * (seen[0] + seen[1] + 1e-9) / (seen[0].sum() + seen[1].sum() + 1) + 1e-3) / (x.sum() + 1) for x in seen]
    known = (seen[0] + seen[1]) / (seen[0] + seen[1] + SMOOTH)
    model.evidence = np.log(rate[1] / rate[0]) * known
    last = [i for c in part(0.75, 1) for i in c]
    y = np.array([texts[i][1] for i in last], float)
    if 0 < y.sum() < len(y):
        model.weights = _logistic(np.stack([scorer.features(texts[i][0]) for i in last]), y)
    return model


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC_TEXTS,
    ordinary: int = ORDINARY_TEXTS) -> list[tuple[str | None, int]]:
    """At most ``toxic`` and ``ordinary`` labelled texts, picked by a hash of the id. An id labelled
    both ways counts as toxic; null ids and labels are left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    pick = None
    for y, most in ((1, toxic), (0, ordinary)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("l_id", F.lit(17)), "l_id").limit(most)
        pick = part if pick is None else pick.union(part)
    # at most toxic + ordinary ids
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).join(F.broadcast(pick), F.col("d_id") == F.col("l_id"))
    return [(r["text"], r["y"]) for r in rows.dropDuplicates(["d_id"]).orderBy("d_id").select("text", "y").collect()]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """One row per row of ``docs``: (id, score double from 0 to 1, predicted int: 1 from ``cut`` on).

    Null and empty texts have no windows and get the score of that. Null ids and repeated rows pass
    through. Other columns of ``docs`` are ignored.
    """
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for pdf in batches:
            out = pdf[["id"]].copy()
            out["score"] = scorer.score(pdf["text"].tolist())
            yield out

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
