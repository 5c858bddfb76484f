"""Graphs by number. Nodes are numbered by the order of the 64-bit hashes of their ids; an adjacency is a table of
packed blocks, each with all steps out of its nodes, so a round over a graph is one pass without a shuffle. What is
held per node is an array on the driver, broadcast to the passes."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.scratch import Scratch

#: Nodes that arrays are held for; steps of a block, and rows that a task packs at once.
MAX_NODES, BLOCK, FLUSH = 20_000_000, 1_000_000, 4_000_000
_PACKED = "part int, u binary, v binary"
#: Shuffle files of a write go as soon as it ends, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BLOCKS = "u binary, n binary, v binary"


def ints(raw) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.int32)


@contextmanager
def file_cleanup(spark: SparkSession):
    """Shuffle files of the writes in it go as soon as each ends."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def order_of(ids: DataFrame, scratch: Scratch) -> np.ndarray | None:
    """Sorted hashes of the ids (column id, distinct); None beyond ``MAX_NODES``, or if two ids share a hash."""
    saved = scratch.save(ids.select(F.xxhash64("id").alias("h")))
    if saved.count() > MAX_NODES:
        return None
    order = np.sort(saved.toArrow().column("h").to_numpy())
    scratch.drop(saved)
    return None if (order[1:] == order[:-1]).any() else order


def numbers(order: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Number of each hash, -1 for those of no node."""
    if not len(order):
        return np.full(len(hashes), -1, np.int32)
    # ascending probes stay in the cache
    by = np.argsort(hashes)
    at = np.empty(len(hashes), np.int32)
    at[by] = np.searchsorted(order, hashes[by])
    at[at == len(order)] = 0
    return np.where(order[at] == hashes, at, -1).astype(np.int32)


def adjacency(edges: DataFrame, order: np.ndarray, scratch: Scratch) -> DataFrame:
    """Blocks (u, n, v): nodes, how many steps each has, and the steps' ends in order. Both ways, repeated edges
    repeated, self-loops twice; edges with an end that is no node are left out. Columns src and dst."""
    shared = edges.sparkSession.sparkContext.broadcast(order)
    parts = max(1, min(1 << 14, -(-2 * edges.count() // BLOCK)))
    span = max(1, -(-len(order) // parts))

    def packed(a, b):
        a, b = numbers(shared.value, np.concatenate(a)), numbers(shared.value, np.concatenate(b))
        known = (a >= 0) & (b >= 0)
        a, b = a[known], b[known]
        u, v = np.concatenate([a, b]), np.concatenate([b, a])
        by = np.argsort(u, kind="stable")
        u, v = u[by], v[by]
        cuts = np.searchsorted(u, np.arange(parts + 1, dtype=np.int64) * span)
        some = [p for p in range(parts) if cuts[p] < cuts[p + 1]]
        # the nodes of a part as steps from one to the next, which take less room than their numbers
        at = [np.diff(u[cuts[p]:cuts[p + 1]], prepend=np.int32(p * span)) for p in some]
        small = [x.astype(np.uint8) if x.max() < 256 else x for x in at]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([x.tobytes() for x in small], pa.binary()),
            pa.array([v[cuts[p]:cuts[p + 1]].tobytes() for p in some], pa.binary())], names=["part", "u", "v"])

    def opened(p, u, v):
        v = ints(v)
        return np.cumsum(np.frombuffer(u, np.uint8 if len(u) == len(v) else np.int32), dtype=np.int64).astype(np.int32) + np.int32(p * span), v

    def pack(batches):
        a, b, n = [], [], 0
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
            n += batch.num_rows
            if n >= FLUSH:
                yield packed(a, b)
                a, b, n = [], [], 0
        if n:
            yield packed(a, b)

    def merge(batches):
        held: dict = {}
        for batch in batches:
            for p, u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(p, []).append((u, v))
        for p in sorted(held):
            got = [opened(p, *x) for x in held.pop(p)]
            u, v = (np.concatenate([x[i] for x in got]) for i in (0, 1))
            key = np.sort(u.astype(np.int64) << 32 | v)
            u, v = (key >> 32).astype(np.int32), (key & 0x7FFFFFFF).astype(np.int32)
            nodes, n = np.unique(u, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (nodes, n.astype(np.int32), v)], names=["u", "n", "v"])

    ends = edges.where("src is not null and dst is not null").select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b"))
    with file_cleanup(edges.sparkSession):
        out = scratch.save(ends.mapInArrow(pack, _PACKED).repartition(parts, "part").mapInArrow(merge, BLOCKS))
    shared.destroy()
    return out


def per_block(blocks: DataFrame, f, *shared) -> list:
    """``f(u, n, v, *shared)`` of each block, which returns arrays or None; the arrays of all blocks joined.
    ``shared`` are broadcast for this pass."""
    held = blocks.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        import pickle

        for batch in batches:
            for u, n, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = f(ints(u), ints(n), ints(v), *held.value)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], names=["got"])

    import pickle

    rows = [pickle.loads(r) for r in blocks.mapInArrow(run, "got binary").toArrow().column("got").to_pylist()]
    held.destroy()
    return [np.concatenate(x) for x in zip(*rows, strict=True)]


def valued(ids: DataFrame, order: np.ndarray, values: np.ndarray, name: str) -> DataFrame:
    """(id, ``name``) of the ids, by their numbers."""
    shared = ids.sparkSession.sparkContext.broadcast((order, values))

    def run(batches):
        for batch in batches:
            order, values = shared.value
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values[numbers(order, batch.column(1).to_numpy())])], names=["id", name])

    kind = "double" if values.dtype == np.float64 else "int"
    return ids.select("id", F.xxhash64("id").alias("h")).mapInArrow(run, f"id {ids.schema['id'].dataType.simpleString()}, {name} {kind}")
