"""Classes of labels that are alike, without all pairs of them. Two shingle sets that reach the threshold share some of
the rarest-first shingles of their sizes' prefixes in one combination at least, so combinations are looked up instead of
single shingles: exact, and numbered names no longer meet by every digit. A label is sent, packed, to the shares of its
first shingles that can be the rarest common one; a share links what is alike in it, and the driver holds no more than a
number for each label."""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.numbered import file_cleanup, ints
from weftgraph.scratch import Scratch

#: Labels that numbers are held for; labels of a share, and that a task packs at once; pairs at once; most combinations
#: of a label to begin with; buckets of shingle counts; links that the driver takes in at once.
MAX_LABELS, KEYS, FLUSH, PAIRS, COMBINATIONS, BUCKETS, LINKS = 50_000_000, 200_000, 500_000, 200_000, 60, 18, 4_000_000
_PAD = 0x1FFFFF
_VARIANT = re.compile("^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$")


def _chars(texts: list[str], width: int) -> np.ndarray:
    """Code points, 0 beyond the end."""
    return np.array(texts, dtype=f"U{max(1, width)}").view(np.uint32).reshape(len(texts), max(1, width))


def char_rows(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length: (places, code points) of the texts."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if not len(texts):
        return []
    if raw[off[0]:off[-1]].max(initial=0) < 128:
        size, every = np.diff(off), None
    else:
        every = texts.to_pylist()
        size = np.array([len(t) for t in every])
    out = []
    for w in np.unique(size):
        at = np.flatnonzero(size == w)
        out.append((at, raw[off[at][:, None] + np.arange(w)].astype(np.uint32) if every is None else _chars([every[i] for i in at], w)[:, :w]))
    return out


def entropy_bits(texts: pa.Array) -> np.ndarray:
    """Shannon entropy of the characters, in bits each; NaN where a character takes two units of UTF-16."""
    out = np.zeros(len(texts))
    for at, c in char_rows(texts):
        if w := c.shape[1]:
            start = np.flatnonzero(_first(np.sort(c, axis=1)))
            part = np.diff(np.r_[start, c.size]) / w
            out[at] = np.where((c > 0xFFFF).any(axis=1), np.nan, -np.bincount(start // w, part * np.log2(part), minlength=len(c)))
    return out


def _grams(c: np.ndarray) -> np.ndarray:
    """Codes of the 3-character shingles of rows of characters, each row in order; a shorter text is its own."""
    c = c.astype(np.int64)
    if c.shape[1] < 3:
        c = np.concatenate([c, np.full((len(c), 3 - c.shape[1]), _PAD)], axis=1)
    return np.sort(c[:, :-2] << 42 | c[:, 1:-1] << 21 | c[:, 2:], axis=1)


def _first(g: np.ndarray) -> np.ndarray:
    return np.c_[np.ones(len(g), bool), g[:, 1:] != g[:, :-1]]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _bucket(codes: np.ndarray) -> np.ndarray:
    return (_mixed(codes) >> np.uint64(64 - BUCKETS)).astype(np.int64)


def token_rows(texts: pa.Array, counts: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """By set size: (places of the texts, their shingles by rank, rarest first); and the shingles by rank. ``counts``,
    by bucket, orders them; shingles of one count go by their codes."""
    parts = [(at, _grams(c)) for at, c in char_rows(pc.replace_substring(texts, " ", ""))]
    codes = np.unique(np.concatenate([np.unique(g) for _, g in parts])) if parts else np.zeros(0, np.int64)
    by = np.lexsort((codes, counts[_bucket(codes)]))
    rank = np.empty(len(codes), np.int32)
    rank[by] = np.arange(len(codes), dtype=np.int32)
    out: dict = {}
    for at, g in parts:
        new = _first(g)
        r = np.sort(np.where(new, rank[np.searchsorted(codes, g)], np.iinfo(np.int32).max), axis=1)
        size = new.sum(axis=1)
        for n in np.unique(size):
            rows = size == n
            out.setdefault(int(n), []).append((at[rows], r[rows, :n]))
    return {n: tuple(np.concatenate(x) for x in zip(*got, strict=True)) for n, got in out.items()}, codes[by]


def least_overlap(n: int, m: int, threshold: float) -> int | None:
    """Fewest shingles that sets of these sizes share at the threshold."""
    return next((o for o in range(1, min(n, m) + 1) if o / (n + m - o) >= threshold), None)


class Shares:
    """Which share a common rarest shingle falls to; one of very many labels, with the next common one."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, shares: int, threshold: float):
        self.value, self.shares = _mixed(codes), shares
        self.own = (self.value % np.uint64(shares)).astype(np.int32)
        # over one half, sets of two or more have two shingles in common
        self.hot = (counts[_bucket(codes)] > KEYS) & (threshold > 0.5)

    def of(self, rows: np.ndarray, p: int, q: int | None) -> np.ndarray:
        """Share of each row, if its ``p``-th and ``q``-th are the first common ones."""
        out, e = self.own[rows[:, p]], rows[:, p]
        if q is not None and len(hot := np.flatnonzero(self.hot[e])):
            out[hot] = _mixed(self.value[e[hot]] * np.uint64(3) + self.value[rows[hot, q]]) % np.uint64(self.shares)
        return out

    def rows(self, rows: np.ndarray, spare: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, share), each once, where up to ``spare`` shingles are not common."""
        n, got = rows.shape[1], []
        for p in range(spare + 1):
            for q in range(p + 1, min(n, spare + 2)) if n > 1 else [None]:
                got.append(np.arange(len(rows), dtype=np.int64) * self.shares + self.of(rows, p, q))
                if q is not None and not self.hot[rows[:, p]].any():
                    break
        key = np.unique(np.concatenate(got))
        return key // self.shares, key % self.shares


def _keys(rows: np.ndarray, overlap: int, together: int, mine, value: np.ndarray, sieve: np.ndarray | None = None):
    """(keys, rows) of the combinations of ``together`` shingles whose first fall to this share."""
    n = rows.shape[1]
    keys, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for p in range(n - overlap + 1):
        for q in range(p + 1, n - overlap + 2) if together > 1 else [None]:
            if not len(own := mine(p, q if n > 1 else None)):
                continue
            v = value[rows[own].T]
            for rest in combinations(range(q + 1, n - overlap + together), together - 2) if q is not None else [()]:
                k = v[p].copy() if q is None else v[p] + v[q]
                for j in rest:
                    k += v[j]
                k = _mixed(k)
                if sieve is None:
                    keys.append(k)
                    at.append(own)
                else:
                    met = np.flatnonzero(sieve[k >> np.uint64(42)])
                    keys.append(k[met])
                    at.append(own[met])
    return np.concatenate(keys), np.concatenate(at)


class _Met:
    """Rows that share a combination, by groups: places ``x`` in the rows of the smaller size, then those of the larger."""

    def __init__(self, lo, hi, count: int, rows: int):
        same = hi is None
        bits = np.uint64(rows.bit_length())
        k, x = lo if same else tuple(np.concatenate(z) for z in zip(lo, (hi[0], hi[1] + count), strict=True))
        # the upper bits of a key and the row in one number: those meet by chance are held apart by the comparison
        s = np.sort(k >> bits << bits | x.astype(np.uint64))
        key, x = s >> bits, (s & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
        if len(x):
            new = np.r_[True, key[1:] != key[:-1]]
            repeat = np.r_[False, (s[1:] == s[:-1])]
            x, new = x[~repeat], new[~repeat]
        start = np.flatnonzero(new) if len(x) else np.zeros(0, np.int64)
        end = np.r_[start[1:], len(x)] if len(x) else start
        self.x, self.same, self.count = x, same, count
        self.start, self.end = start, end
        self.mid = end if same or not len(x) else start + np.add.reduceat((x < count).astype(np.int64), start)
        self._take((end - start > 1) if same else (self.mid > start) & (self.mid < end))

    def _take(self, groups: np.ndarray) -> None:
        self.start, self.mid, self.end = (y[groups] for y in (self.start, self.mid, self.end))

    def _spread(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def chain(self):
        """Pairs, as many as rows, that link each group if all its rows are alike."""
        for lo in range(0, len(self.start), PAIRS // 4):
            start, mid, end = (y[lo:lo + PAIRS // 4] for y in (self.start, self.mid, self.end))
            if self.same:
                i = self._spread(start, end - start - 1)
                yield self.x[i], self.x[i + 1]
            else:
                yield self.x[self._spread(start, mid - start)], self.x[np.repeat(mid, mid - start)] - self.count
                yield self.x[np.repeat(start, end - mid)], self.x[self._spread(mid, end - mid)] - self.count

    def split(self, root: np.ndarray) -> None:
        """Only groups of more than one class stay. ``root`` by the numbers of ``x``."""
        if not len(self.start):
            return
        i = self._spread(self.start, self.end - self.start)
        n = self.end - self.start
        at = np.cumsum(n) - n
        r = root[self.x[i]]
        self._take(np.minimum.reduceat(r, at) != np.maximum.reduceat(r, at))

    def pairs(self) -> int:
        n = self.end - self.start
        return int((n * (n - 1) // 2 if self.same else (self.mid - self.start) * (self.end - self.mid)).sum())

    def all(self):
        """All pairs of the groups, some at a time."""
        i = self._spread(self.start, self.mid - self.start)
        n = self.mid - self.start
        until = np.repeat(self.end, n)
        begin = i + 1 if self.same else np.repeat(self.mid, n)
        many = until - begin
        total = np.cumsum(many)
        a = 0
        while a < len(i):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 5 * PAIRS, "right")))
            x, y = np.repeat(i[a:b], many[a:b]), self._spread(begin[a:b], many[a:b])
            if len(x):
                yield self.x[x], self.x[y] - (0 if self.same else self.count)
            a = b


def jaro_winkler_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``functions.text.jaro_winkler`` of rows of characters, all of one length on each side and not equal."""
    (p, la), lb = a.shape, b.shape[1]
    reach = max(0, max(la, lb) // 2 - 1)
    used, hit = np.zeros((p, lb), bool), np.zeros((p, la), bool)
    for i in range(la):
        for j in range(max(0, i - reach), min(lb, i + reach + 1)):
            now = ~hit[:, i] & ~used[:, j] & (a[:, i] == b[:, j])
            used[:, j] |= now
            hit[:, i] |= now
    m, w = hit.sum(axis=1), min(la, lb)
    x, y = (np.take_along_axis(c, np.argsort(~f, axis=1, kind="stable"), axis=1)[:, :w] for c, f in ((a, hit), (b, used)))
    half = ((x != y) & (np.arange(w) < m[:, None])).sum(axis=1) // 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / la + m / lb + (m - half) / some) / 3, 0.0)
    prefix = np.cumprod(a[:, :min(4, w)] == b[:, :min(4, w)], axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """At most one character differs, or two neighbours are swapped; rows of one length."""
    off = a != b
    n, at = off.sum(axis=1), off.argmax(axis=1)
    rows, nxt = np.arange(len(a)), np.minimum(at + 1, a.shape[1] - 1)
    return (n < 2) | ((n == 2) & off[rows, nxt] & (a[rows, at] == b[rows, nxt]) & (a[rows, nxt] == b[rows, at]))


def _variants(x: str, y: str) -> bool:
    p, q = _VARIANT.match(x), _VARIANT.match(y)
    return bool(p and q and p[1] == q[1] and p[2] != q[2])


def _is_one(texts: pa.Array, a: np.ndarray, b: np.ndarray, reached: float, short: int) -> np.ndarray:
    """Whether the labels at ``a`` and ``b`` count as one entity, once their shingles are near."""
    ta, tb = texts.take(pa.array(a)), texts.take(pa.array(b))
    ra, rb = char_rows(ta), char_rows(tb)
    kind, row = np.zeros((2, len(a)), np.int64), np.zeros((2, len(a)), np.int64)
    for side, rows in enumerate((ra, rb)):
        for k, (at, _) in enumerate(rows):
            kind[side, at], row[side, at] = k, np.arange(len(at))
    out = np.zeros(len(a), bool)
    both = kind[0] << 32 | kind[1]
    for k in np.unique(both):
        at = np.flatnonzero(both == k)
        ca, cb = ra[int(k) >> 32][1][row[0, at]], rb[int(k) & 0xFFFFFFFF][1][row[1, at]]
        na, nb = ca.shape[1], cb.shape[1]
        jw = jaro_winkler_rows(ca, cb)
        ok = jw >= reached
        if max(na, nb) < short:
            ok &= (jw >= 0.97) & (_one_edit(ca, cb) if na == nb else False)
            for i in np.flatnonzero(ok):
                ok[i] = not _variants(ta[int(at[i])].as_py(), tb[int(at[i])].as_py())
        out[at] = ok
    return out


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Links into ``root``, which has the least place of its class for each place, in place."""
    while len(a):
        x, y = root[a], root[b]
        new = x != y
        a, b, x, y = a[new], b[new], x[new], y[new]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def linked(texts: pa.Array, counts: np.ndarray, share: int, shares: int, threshold: float, reached: float, short: int) -> np.ndarray:
    """Place of the first text of each one's class, by the links whose rarest common shingle falls to this share."""
    rows, codes = token_rows(texts, counts)
    by, root, held = Shares(codes, counts, shares, threshold), np.arange(len(texts), dtype=np.int32), {}

    def mine(n):
        def at(p, q):
            if (n, p, q) not in held:
                held[n, p, q] = np.flatnonzero(by.of(rows[n][1], p, q) == share)
            return held[n, p, q]

        return at

    def settle(x, y, n, m, overlap):
        (pa_, lo), (pb, hi) = rows[n], rows[m]
        apart = root[pa_[x]] != root[pb[y]]
        key = np.unique(x[apart].astype(np.int64) << 32 | y[apart])
        x, y = key >> 32, key & 0x7FFFFFFF
        both, gx, gy = np.zeros(len(x), np.int16), np.ascontiguousarray(lo[x].T), np.ascontiguousarray(hi[y].T)
        for p in gx:
            for q in gy:
                both += p == q
        near = both >= overlap
        a, b = pa_[x[near]], pb[y[near]]
        if len(a):
            one = _is_one(texts, a, b, reached, short)
            joined(root, a[one], b[one])

    # sets of one size first, the most common ones before others: what is linked already is not compared again
    sizes = sorted(rows, key=lambda n: -len(rows[n][0]))
    for n, m in sorted(((n, m) for n in sizes for m in sizes if n <= m), key=lambda k: k[1] - k[0]):
        if not (overlap := least_overlap(n, m, threshold)):
            continue
        (pa_, lo), (pb, hi) = rows[n], rows[m]
        together = max(t for t in range(1, overlap + 1) if t <= min(3, overlap) or max(comb(k - overlap + t, t) for k in (n, m)) <= COMBINATIONS)
        while True:
            if n == m:
                met = _Met(_keys(lo, overlap, together, mine(n), by.value), None, len(lo), len(lo))
            else:
                few, more = ((n, lo), (m, hi)) if len(lo) <= len(hi) else ((m, hi), (n, lo))
                one = _keys(few[1], overlap, together, mine(few[0]), by.value)
                if not len(one[0]):
                    break
                sieve = np.zeros(1 << 22, bool)
                sieve[one[0] >> np.uint64(42)] = True
                other = _keys(more[1], overlap, together, mine(more[0]), by.value, sieve)
                met = _Met(*((one, other) if few[0] == n else (other, one)), len(lo), len(lo) + len(hi))
            for x, y in met.chain():
                settle(x, y, n, m, overlap)
            met.split(root[pa_ if n == m else np.concatenate([pa_, pb])])
            # a combination of too many labels takes further shingles in
            if together == overlap or met.pairs() <= 20 * max(len(met.x), 100_000):
                for x, y in met.all():
                    settle(x, y, n, m, overlap)
                break
            together = min(overlap, together + 2)
    return root


def number(starts: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Number of each label by its ``monotonically_increasing_id``."""
    parts, first = starts
    return (first[np.searchsorted(parts, at >> 33)] + (at & (1 << 33) - 1)).astype(np.int32)


def classes(items: DataFrame, scratch: Scratch, threshold: float, reached: float, short: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray] | None:
    """(starts of ``number``, number of the first label of each one's class) of distinct labels; None if they are too many.
    ``items``, written: (text, at), ``at`` the ``monotonically_increasing_id`` of the table as it was written."""
    spark = items.sparkSession
    sc = spark.sparkContext
    parts = sorted(tuple(r) for r in items.groupBy(F.shiftright("at", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    many = np.array([n for _, n in parts], np.int64)
    if many.sum() > MAX_LABELS:
        return None
    starts, root = (np.array([p for p, _ in parts], np.int64), np.cumsum(many) - many), np.arange(many.sum(), dtype=np.int32)
    if len(root) < 2:
        return starts, root

    def count(batches):
        counts, sizes = np.zeros(1 << BUCKETS, np.int64), {}
        for batch in batches:
            for _, c in char_rows(pc.replace_substring(batch.column(0), " ", "")):
                g = _grams(c)
                new = _first(g)
                counts += np.bincount(_bucket(g[new]), minlength=len(counts))
                for n, k in zip(*np.unique(new.sum(axis=1), return_counts=True), strict=True):
                    sizes[int(n)] = sizes.get(int(n), 0) + int(k)
        yield pa.RecordBatch.from_arrays([pa.array([counts.astype(np.int32).tobytes()]), pa.array([np.array(sorted(sizes.items()), np.int32).tobytes()])], names=["c", "s"])

    counts, sizes = np.zeros(1 << BUCKETS, np.int64), {}
    for r in items.select("text").mapInArrow(count, "c binary, s binary").collect():
        counts += ints(r["c"])
        for n, k in ints(r["s"]).reshape(-1, 2).tolist():
            sizes[n] = sizes.get(n, 0) + k
    counts = np.minimum(counts, np.iinfo(np.int32).max).astype(np.int32)
    spare = {n: max(n - o for m in sizes if (o := least_overlap(n, m, threshold))) for n in sizes}
    shares = max(2 * sc.defaultParallelism, -(-sum(k * (spare[n] + 1) for n, k in sizes.items()) // KEYS))
    shared = sc.broadcast((starts, counts))

    def sent(texts, at):
        starts, counts = shared.value
        texts = pa.concat_arrays(texts)
        no = number(starts, np.concatenate(at))
        rows, codes = token_rows(texts, counts)
        by, i, to = Shares(codes, counts, shares, threshold), [], []
        for n, (place, r) in rows.items():
            x, share = by.rows(r, spare[n])
            i.append(place[x])
            to.append(share)
        i, to = np.concatenate(i), np.concatenate(to)
        order = np.argsort(to, kind="stable")
        i, to = i[order], to[order]
        cuts = np.searchsorted(to, np.arange(shares + 1))
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
            own = i[cuts[s]:cuts[s + 1]]
            _, offsets, data = pa.concat_arrays([texts.take(pa.array(own))]).buffers()
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in (no[own].tobytes(), offsets.to_pybytes()[:4 * len(own) + 4], data.to_pybytes() if data is not None else b""))],
                names=["share", "n", "o", "t"])

    def send(batches):
        texts, at, n = [], [], 0
        for batch in batches:
            texts.append(batch.column(0))
            at.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= FLUSH:
                yield from sent(texts, at)
                texts, at, n = [], [], 0
        if n:
            yield from sent(texts, at)

    def find(batches):
        held: dict = {}
        for batch in batches:
            for s, n, o, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(s, []).append((n, o, t))
        for s in sorted(held):
            got = held.pop(s)
            no = np.concatenate([ints(n) for n, _, _ in got])
            texts = pa.concat_arrays([pa.StringArray.from_buffers(len(n) // 4, pa.py_buffer(o), pa.py_buffer(t)) for n, o, t in got])
            root = linked(texts, shared.value[1], s, shares, threshold, reached, short)
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array([no[x].tobytes()], pa.binary()) for x in (moved, root[moved])], names=["a", "b"])

    with file_cleanup(spark):
        links = scratch.save(items.select("text", "at").mapInArrow(send, "share int, n binary, o binary, t binary").repartition(shares, "share").mapInArrow(find, "a binary, b binary"))
    shared.destroy()
    a, b, n = [], [], 0
    for r in links.toLocalIterator():
        a.append(ints(r["a"]))
        b.append(ints(r["b"]))
        n += len(a[-1])
        if n >= LINKS:
            joined(root, np.concatenate(a), np.concatenate(b))
            a, b, n = [], [], 0
    if a:
        joined(root, np.concatenate(a), np.concatenate(b))
    scratch.drop(links)
    return starts, root


def placed(items: DataFrame, starts: tuple[np.ndarray, np.ndarray], root: np.ndarray, *keep: str) -> DataFrame:
    """The columns ``keep`` of the labels with ``number`` and the number of the class, ``root``."""
    shared = items.sparkSession.sparkContext.broadcast((starts, root))

    def run(batches):
        starts, root = shared.value
        for batch in batches:
            no = number(starts, batch.column(len(keep)).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(no), pa.array(root[no])], names=[*keep, "number", "root"])

    kind = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in keep)
    return items.select(*keep, "at").mapInArrow(run, f"{kind}, number int, root int")
