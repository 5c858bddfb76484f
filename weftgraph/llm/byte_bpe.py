"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of tokens. Every adjacent pair that has a merge rank waits in
the bucket of that rank, as its position in the list. Which ranks have a waiting bucket is a bitmap
of three levels of 64-bit words; find-first-set on each level gives the least rank in three steps.
Entries whose pair has changed since are stale and are skipped. So a pre-token of n bytes takes
about n log n steps, however long it is.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from weftgraph.llm.batches import bounded

#: Encoded pre-tokens kept per worker: at most so many in each of two generations, of so many characters.
CACHE_ENTRIES, CACHE_CHARS = 180_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64(token) rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Positions by rank below ``ranks``; ``pop`` gives the leftmost position of the least rank.

    A bucket is a position, or a heap of them once it has two. A drained queue is as new.
    """

    __slots__ = ("buckets", "low", "mid", "top")

    def __init__(self, ranks: int):
        self.buckets: list[int | list[int] | None] = [None] * ranks
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets[rank]
        if bucket is None:
            self.buckets[rank] = at
            word = rank >> 6
            bits = self.low[word]
            self.low[word] = bits | 1 << (rank & 63)
            if not bits:
                block = rank >> 12
                self.mid[block] |= 1 << (word & 63)
                self.top |= 1 << block
        elif type(bucket) is int:
            self.buckets[rank] = [bucket, at] if bucket < at else [at, bucket]
        else:
            heapq.heappush(bucket, at)

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        block = (top & -top).bit_length() - 1
        words = self.mid[block]
        word = block << 6 | (words & -words).bit_length() - 1
        bits = self.low[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        at = self.buckets[rank]
        if type(at) is not int:
            heap, at = at, heapq.heappop(at)
            if heap:
                return rank, at
        self.buckets[rank] = None
        bits &= bits - 1
        self.low[word] = bits
        if not bits:
            words &= words - 1
            self.mid[block] = words
            if not words:
                self.top = top & (top - 1)
        return rank, at


class ByteBPE:
    """Encoder and decoder for one rank table; ``pattern`` cuts a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.split = regex.compile(pattern).findall
        self.packed = _Packed(self)
        self.queue = RankQueue(len(self.tokens))
        self.four = [i.to_bytes(4, "little") for i in range(len(self.tokens))]
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        get = self.ranks.get
        n = len(piece)
        parts = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pending = [get(piece[i : i + 2], -1) for i in range(n - 1)]
        pending.append(-1)
        queue = self.queue
        push, pop = queue.push, queue.pop
        for i, rank in enumerate(pending):
            if rank >= 0:
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if pending[i] != rank:
                continue  # stale: the pair at i has changed or is gone
            j = after[i]
            merged = parts[i] = parts[i] + parts[j]
            pending[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = pending[i] = get(merged + parts[k], -1)
                if rank >= 0:
                    push(rank, i)
            else:
                pending[i] = -1
            h = before[i]
            if h >= 0:
                rank = pending[h] = get(parts[h] + merged, -1)
                if rank >= 0:
                    push(rank, h)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[parts[i]])
            i = after[i]
        return out

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers; of a null: none."""
        return b"".join(map(self.packed.__getitem__, self.split(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Bytes of the ids; an id that the table lacks raises."""
        at = np.asarray(ids, np.int64)
        if not len(at):
            return b""
        if at.min() < 0 or at.max() >= len(self.tokens) or not (size := self.sizes[at]).all():
            raise ValueError("unknown token id")
        shift = np.repeat(self.starts[at] - (np.cumsum(size) - size), size)
        return self.bytes[shift + np.arange(len(shift))].tobytes()


class _Packed(dict):
    """Packed ids by pre-token, bounded: a full table becomes the old one, from which what is used returns."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        out = self.old.get(piece)
        if out is None:
            four = self.bpe.four
            out = b"".join([four[i] for i in self.bpe.encode_piece(piece.encode("utf-8"))])
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[piece] = out
        return out


@functools.lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(load_ranks(path), pattern)


def _ship(df: DataFrame, path: str) -> str:
    """Sends the rank file to every executor with Spark's own file transport; its name there."""
    bounded(df.sparkSession)
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` plus n_tokens long and, by choice, token_ids array<int>,
    ids_sha256 and decoded_sha256 (of the ids decoded again).

    Whole texts, no special tokens; null and empty texts have no tokens. Repeated rows are kept.
    Columns of ``docs`` that clash with the new names are replaced. Ids stay below 2**31.
    """
    name = _ship(docs, ranks_path)
    new = ["n_tokens", *["token_ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests]
    kept = [c for c in docs.columns if c not in new]
    source = docs.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(SparkFiles.get(name), pattern)
        for batch in batches:
            column = batch.column(kept.index(text_col))
            for start in range(0, batch.num_rows, 256):
                counts, packed, sums = [], [], []
                for text in column.slice(start, 256).to_pylist():
                    raw = bpe.encode_packed(text)
                    counts.append(len(raw) // 4)
                    if ids:
                        packed.append(raw)
                    if digests:
                        back = bpe.decode(np.frombuffer(raw, "<u4"))
                        sums.append((hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
                part = batch.slice(start, 256)
                arrays = [*(part.column(i) for i in range(len(kept))), pa.array(counts, pa.int64())]
                if ids:
                    flat = np.frombuffer(b"".join(packed), "<i4")
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int32())))
                if digests:
                    arrays += [pa.array([x[0] for x in sums], pa.string()), pa.array([x[1] for x in sums], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *new])

    added = ", ".join(f"{c} " + {"n_tokens": "long", "token_ids": "array<int>"}.get(c, "string") for c in new)
    schema = StructType([*source.schema.fields, *StructType.fromDDL(added).fields])
    return source.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, ranks_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """All rows and columns plus ``out_col`` binary: the bytes of the ids (null ids: null; none: empty)."""
    name = _ship(docs, ranks_path)
    kept = [c for c in docs.columns if c != out_col]
    source = docs.select(*(F.col(f"`{c}`") for c in kept))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _coder(SparkFiles.get(name), "")
        for batch in batches:
            got = [None if x is None else bpe.decode(x) for x in batch.column(kept.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(got, pa.binary())], names=[*kept, out_col])

    return source.mapInArrow(run, StructType([*source.schema.fields, StructField(out_col, BinaryType())]))
