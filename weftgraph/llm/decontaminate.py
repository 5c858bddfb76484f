"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton is over word ids and knows every substring of every item. Training words stream
through it; at each word the state stands for the longest suffix that some item contains, and a
match of at least the window's length marks the last ``window`` words as hit. Items shorter than
the window count as one window each. A first look at the word hashes of a chunk finds the runs
of item words that are long enough to hold any window; only those runs are walked, which loses
nothing, for a window consists of item words alone.

One automaton holds a bounded number of item words, for it is broadcast. More items are cut into
groups of that size, each with an automaton of its own: every group streams the documents once and
saves the few that it hits, and a last pass unites the hits by row.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from weftgraph.llm import kernels as K
from weftgraph.llm.batches import bounded, trimmed
from weftgraph.scratch import Scratch

WINDOW = 13
#: Words of one automaton, which is broadcast: at about 400 bytes a word this bounds it to some 400 MB.
MAX_ITEM_WORDS = 1_000_000
_ADDED = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, clean_text string"


class SuffixAutomaton:
    """Generalised suffix automaton of word-id sequences, with the items of every window."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        finals = []
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
            finals.append(last)
        owners: dict[int, set[str]] = {}
        shorts: dict[int, list[tuple[int, str]]] = {}
        for (item, words), final in zip(items, finals, strict=True):
            if len(words) < window:
                if words:
                    shorts.setdefault(self._at_length(final, len(words)), []).append((len(words), item))
                continue
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= window:
                    owners.setdefault(self._at_length(state, window), set()).add(item)
        self.owners = {s: tuple(sorted(v)) for s, v in owners.items()}
        self.anchor = [self._at_length(s, window) if n >= window else -1 for s, n in enumerate(self.length)]
        self.shorts: dict[int, tuple[tuple[int, str], ...]] = {}
        for s in sorted(range(len(self.length)), key=self.length.__getitem__):
            up = self.link[s]
            found = [*shorts.get(s, ()), *(self.shorts.get(up, ()) if up >= 0 else ())]
            if found:
                self.shorts[s] = tuple(sorted(set(found), reverse=True))
        self.least = min([window, *(n for v in shorts.values() for n, _ in v)])

    def _at_length(self, state: int, n: int) -> int:
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(nxt)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def walk(self, words: list[int], base: int, spans: list[tuple[int, int]], items: set[str]) -> None:
        """Adds the hit intervals (end exclusive, shifted by base) and the items of a run of words."""
        state = matched = 0
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for i, w in enumerate(words):
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            longest = 0
            if matched >= window:
                items.update(self.owners.get(self.anchor[state], ()))
                longest = window
            for n, item in self.shorts.get(state, ()):
                if n <= matched:
                    items.add(item)
                    longest = max(longest, n)
            if longest:
                at = base + i + 1
                if spans and spans[-1][1] >= at - longest:
                    start = min(spans.pop()[0], at - longest)
                    while spans and spans[-1][1] >= start:
                        start = min(spans.pop()[0], start)
                    spans.append((start, at))
                else:
                    spans.append((at - longest, at))


def groups_of(items: Iterable[tuple[str | None, str | None]], window: int = WINDOW, max_words: int = MAX_ITEM_WORDS) -> Iterator[list[tuple[str, np.ndarray]]]:
    """(item id, word hashes) in groups of at most ``max_words`` words; null ids and texts are left out.

    An item longer than a group is cut into pieces that share ``window`` - 1 words, so each of its
    windows lies in one piece. At least one group comes, if an empty one.
    """
    most = max(max_words, 2 * window)
    group: list[tuple[str, np.ndarray]] = []
    held, any_yet = 0, False
    for item, text in items:
        if item is None or text is None:
            continue
        parts = [c.hashes for c in K.chunks(pa.array([text], pa.large_string()), K.alnum_mask())]
        words = np.concatenate([np.empty(0, np.uint64), *parts])
        step = most - window + 1
        for at in range(0, max(1, len(words) - window + 1), step):
            piece = words[at : at + most]
            if held and held + len(piece) > most:
                yield group
                group, held, any_yet = [], 0, True
            group.append((str(item), piece))
            held += len(piece)
    if group or not any_yet:
        yield group


def build(group: list[tuple[str, np.ndarray]], window: int = WINDOW) -> tuple[np.ndarray, SuffixAutomaton]:
    """(sorted word hashes, automaton over their ranks) of a group."""
    vocab = np.unique(np.concatenate([np.empty(0, np.uint64), *(s for _, s in group)]))
    return vocab, SuffixAutomaton([(i, np.searchsorted(vocab, s).tolist()) for i, s in group], window)


def _runs(ids: np.ndarray, known: np.ndarray, bounds: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of item words of at least ``least`` words that stay in one text."""
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    inner = bounds[:-1][bounds[:-1] < len(ids)]
    begin[inner] = known[inner]
    stop = known.copy()
    stop[:-1] &= ~known[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    stop[last] = known[last]
    a, b = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    long = b - a >= least
    return zip(a[long].tolist(), b[long].tolist(), strict=True)


Span = tuple[int, int]


def _hits(column: pa.Array, vocab: np.ndarray, auto: SuffixAutomaton) -> Iterator[tuple[int, list[Span], set[str]]]:
    """(index, hit word spans in order, items) of every text of the column that is hit."""
    for c in K.chunks(column, K.alnum_mask()):
        if not len(c.hashes) or not len(vocab):
            continue
        ids = np.minimum(np.searchsorted(vocab, c.hashes), len(vocab) - 1)
        known = vocab[ids] == c.hashes
        found: dict[int, tuple[list, set]] = {}
        for a, b in _runs(ids, known, c.bounds, auto.least):
            doc = int(np.searchsorted(c.bounds, a, "right")) - 1
            sp, it = found.setdefault(doc, ([], set()))
            auto.walk(ids[a:b].tolist(), a - int(c.bounds[doc]), sp, it)
        yield from ((c.first + doc, sp, it) for doc, (sp, it) in found.items() if sp)


def _united(spans: Iterable[Span]) -> list[Span]:
    """The same words in spans that neither overlap nor touch, in order."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without(column: pa.Array, spans: dict[int, list[Span]]) -> dict[int, str]:
    """The hit texts without the characters from the first to the last word of each span."""
    texts: dict[int, str] = {}
    for c in K.chunks(column, K.alnum_mask()):
        for doc in range(len(c.bounds) - 1):
            cuts = spans.get(c.first + doc)
            if not cuts:
                continue
            base, at = int(c.bounds[doc]), int(c.text_offsets[doc])
            parts = []
            for a, b in cuts:
                parts.append(c.data[at : int(c.starts[base + a])].tobytes())
                at = int(c.ends[base + b - 1])
            parts.append(c.data[at : int(c.text_offsets[doc + 1])].tobytes())
            texts[c.first + doc] = b"".join(parts).decode("utf-8", "replace")
    return texts


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _told(column: pa.Array, hits: dict[int, tuple[list[Span], list[str]]], clean: bool) -> list[pa.Array]:
    """The new columns: words, hit words, items, spans and the text without them."""
    n = len(column)
    words = np.zeros(n, np.int64)
    for c in K.chunks(column, K.alnum_mask()):
        words[c.first : c.first + len(c.bounds) - 1] = np.diff(c.bounds)
    hit = np.zeros(n, np.int64)
    items: list[list[str]] = [[] for _ in range(n)]
    spans: list[list[dict[str, int]]] = [[] for _ in range(n)]
    for i, (sp, it) in hits.items():
        hit[i], items[i], spans[i] = sum(b - a for a, b in sp), it, [{"start": a, "end": b} for a, b in sp]
    cleaned = column if clean else pa.nulls(n, column.type)
    texts = _without(column, {i: sp for i, (sp, _) in hits.items()}) if clean else {}
    if texts:
        at, sub = np.arange(n), np.full(n, -1)
        sub[list(texts)] = range(len(texts))
        cleaned = pa.concat_arrays([column, pa.array(list(texts.values()), column.type)]).take(pa.array(np.where(sub >= 0, n + sub, at)))
    return [pa.array(words), pa.array(hit), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS), cleaned]


def _group_mapper(shared, row: str | None, keep: list[str], names: list[str], text_col: str, clean: bool):
    """Documents -> all of them with the new columns; or, with ``row``, (row, spans, items) of those hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, auto = pickle.loads(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col) if row else keep.index(text_col))
            hits = {i: (sp, sorted(it)) for i, sp, it in _hits(column, vocab, auto)}
            if row is None:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *_told(column, hits, clean)], names=[*keep, *names])
            elif hits:
                at = batch.column(batch.schema.get_field_index(row)).take(pa.array(list(hits)))
                spans = pa.array([[{"start": a, "end": b} for a, b in sp] for sp, _ in hits.values()], _SPANS)
                yield pa.RecordBatch.from_arrays([at, spans, pa.array([it for _, it in hits.values()], pa.list_(pa.string()))], names=[row, "g_spans", "g_items"])

    return run


def _union_mapper(keep: list[str], names: list[str], text_col: str, clean: bool):
    """Documents with the hits of all groups -> documents with the new columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(keep.index(text_col))
            spans, items = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            hits = {i: (_united((s["start"], s["end"]) for s in sp), sorted(set(it))) for i, (sp, it) in enumerate(zip(spans, items, strict=True)) if sp}
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *_told(column, hits, clean)], names=[*keep, *names])

    return run


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_item_words: int = MAX_ITEM_WORDS,
    prefix: str = "", clean: bool = True, scratch: Scratch | None = None,
) -> DataFrame:
    """All rows and columns of ``docs`` plus n_words, n_hit, items, spans (word positions, end
    exclusive) and clean_text (the text without its hit spans), each name led by ``prefix``.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. Null and empty texts
    have no words and no hits (clean_text stays as the text is). Items without words, with null text
    or null id are left out; items of the same id count once. Columns of ``docs`` that clash with the
    new names are replaced. Repeated rows are kept. An empty item table hits nothing.
    ``clean=False`` leaves clean_text null. ``max_item_words`` bounds one automaton, not the items: more
    of them take several, with the same result.
    """
    spark = docs.sparkSession
    bounded(spark)
    names = [prefix + x for x in ("n_words", "n_hit", "items", "spans", "clean_text")]
    keep = [f for f in docs.schema.fields if f.name not in names]
    kept = [f.name for f in keep]
    schema = StructType([*keep, *(StructField(prefix + f.name, f.dataType) for f in StructType.fromDDL(_ADDED).fields)])
    known = items.select(F.col(item_id).cast("string"), F.col(item_text))
    # one group of items at a time is in the driver's memory
    groups = groups_of(((r[0], r[1]) for r in known.toLocalIterator()), window, max_item_words)
    group, following = next(groups), next(groups, None)
    share = lambda g: spark.sparkContext.broadcast(pickle.dumps(build(g, window)))
    own = docs.select(*(F.col(f"`{c}`") for c in kept))
    if following is None:
        return own.mapInArrow(trimmed(_group_mapper(share(group), None, kept, names, text_col, clean)), schema)
    scratch = scratch or Scratch(spark, "decontamination")
    row = "row"
    while row in kept:
        row += "_"
    rows = scratch.save(own.withColumn(row, F.monotonically_increasing_id()))
    found = []
    while group is not None:
        shared = share(group)
        mapper = _group_mapper(shared, row, kept, names, text_col, clean)
        found.append(scratch.save(rows.select(F.col(f"`{row}`"), F.col(f"`{text_col}`")).mapInArrow(mapper,
            f"`{row}` long, g_spans array<struct<start:int,end:int>>, g_items array<string>")))
        shared.destroy()
        group, following = following, next(groups, None) if following is not None else None
    hits = functools.reduce(DataFrame.unionByName, found).groupBy(f"`{row}`").agg(F.flatten(F.collect_list("g_spans")).alias("g_spans"),
        F.flatten(F.collect_list("g_items")).alias("g_items"))
    joined = rows.alias("d").join(hits.alias("h"), F.col(f"d.`{row}`") == F.col(f"h.`{row}`"), "left")
    moved = joined.select(*(F.col(f"d.`{c}`").alias(f"o{i}") for i, c in enumerate(kept)), "h.g_spans", "h.g_items")  # by position from here
    return moved.mapInArrow(_union_mapper(kept, names, text_col, clean), schema)


def contaminated(n_hit, n_words, num: int = 20):
    """The rule on a document: hit words are at least a ``num``-th of all."""
    return (n_hit > 0) & (num * n_hit >= n_words)


def items_sha256(items) -> object:
    """Lowercase hex of the sorted, comma-joined item ids."""
    return F.sha2(F.array_join(items, ","), 256)


def brute_hits(text: str | None, items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """Plain window-by-window twin for tests: (n_words, n_hit, sorted items)."""
    import re

    def split(t):
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    doc, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        size = min(window, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if size else set()
        for i in range(len(doc) - size + 1 if size else 0):
            if tuple(doc[i : i + size]) in wins:
                hit.update(range(i, i + size))
                found.add(item)
    return len(doc), len(hit), sorted(found)


__all__ = ["SuffixAutomaton", "brute_hits", "build", "contaminated", "decontaminate", "groups_of", "items_sha256"]
