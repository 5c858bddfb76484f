"""Betweenness by Brandes' algorithm, parallel over sources. Where all nodes are sources, hanging trees are folded first
into weights of the nodes they hang on, which gives their nodes and edges exact values at once; only what has cycles
is walked. Up to ``MAX_EDGES`` edges the adjacency is broadcast; beyond that that of nodes goes by frontier joins, and
that of edges refuses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.numbered import adjacency, numbers, order_of, per_block, valued
from weftgraph.operators.traverse import both_ways
from weftgraph.scratch import Scratch

MAX_EDGES, EXACT_NODES, PIVOTS = 20_000_000, 1000, 100


def _pivots(n: int, pivots: int | None) -> int:
    return n if pivots is None or n <= EXACT_NODES else min(pivots, n)


def _steps(u, n, v):
    """Distinct steps of a block, without self-loops."""
    at = np.repeat(u, n)
    new = np.r_[True, (at[1:] != at[:-1]) | (v[1:] != v[:-1])] & (at != v)
    return at[new], v[new]


def _sums(at: np.ndarray, x: np.ndarray, out: np.ndarray) -> None:
    """``out[at] += x``, repeated places summed."""
    if len(at) * 8 > len(out):
        out += np.bincount(at, x, minlength=len(out))
    else:
        np.add.at(out, at, x)


def _walk(start: np.ndarray, to: np.ndarray, weight: np.ndarray, s: int, nodes: np.ndarray, steps: np.ndarray | None) -> None:
    """Adds the dependencies of source ``s``: of other nodes to ``nodes``, of steps to ``steps``. Each node stands
    for ``weight`` of them."""
    m = len(start) - 1
    dist, paths, delta = np.full(m, -1, np.int32), np.zeros(m), np.zeros(m)
    dist[s], paths[s], frontier, d, back = 0, 1.0, np.array([s]), 0, []
    while len(frontier):
        n = start[frontier + 1] - start[frontier]
        a = np.repeat(frontier, n)
        place = np.repeat(start[frontier] - (np.cumsum(n) - n), n) + np.arange(len(a))
        b = to[place]
        new = dist[b] < 0
        a, b, place = a[new], b[new], place[new]
        d += 1
        dist[b] = d
        _sums(b, paths[a], paths)
        back.append((a, b, place if steps is not None else None))
        frontier = np.flatnonzero(dist == d) if len(b) * 8 > m else np.unique(b)
    for a, b, place in reversed(back):
        c = paths[a] / paths[b] * (weight[b] + delta[b])
        _sums(a, c, delta)
        if steps is not None:
            steps[place] += c * weight[s]
    delta[s] = 0
    nodes += delta * weight[s]


def _walked(spark, start, to, weight, sources: np.ndarray, of_nodes: bool) -> np.ndarray:
    """Dependencies of nodes, or of steps, summed over the sources."""
    size, k = (len(start) - 1 if of_nodes else len(to)), len(sources)
    if not k:
        return np.zeros(size)
    shared = spark.sparkContext.broadcast((start, to, weight, sources))

    def run(batches):
        start, to, weight, sources = shared.value
        nodes, steps = np.zeros(len(start) - 1), None if of_nodes else np.zeros(len(to))
        for batch in batches:
            for i in batch.column(0).to_numpy():
                _walk(start, to, weight, sources[i], nodes, steps)
        out = nodes if of_nodes else steps
        at = np.flatnonzero(out)
        for lo in range(0, len(at), 1 << 20):
            some = at[lo:lo + (1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["i", "x"])

    parts = max(1, min(64, k // 8 + 1))
    got = spark.range(0, k, 1, parts).mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("x").to_numpy()
    shared.destroy()
    return out


def _fold(u: np.ndarray, v: np.ndarray, n: int):
    """Hanging trees taken off leaf by leaf: (parent or -1, size, sum of squared sizes of what hangs below, rounds)."""
    deg, near = np.bincount(u, minlength=n), np.zeros(n, np.int64)
    first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]]) if len(u) else np.zeros(0, np.int64)
    if len(u):
        near[u[first]] = np.bitwise_xor.reduceat(v.astype(np.int64), first)  # of one neighbour: that one
    parent, size, square, rounds = np.full(n, -1), np.ones(n), np.zeros(n), []
    leaves = np.flatnonzero(deg == 1)
    while len(leaves):
        up = near[leaves]
        go = (deg[up] > 1) | (up > leaves)  # of two that are left, one goes
        leaves, up = leaves[go], up[go]
        parent[leaves], deg[leaves] = up, 0
        np.add.at(size, up, size[leaves])
        np.add.at(square, up, size[leaves] ** 2)
        np.subtract.at(deg, up, 1)
        np.bitwise_xor.at(near, up, leaves)
        rounds.append((leaves, up))
        leaves = np.unique(up[deg[up] == 1])
    return parent, size, square, rounds


def _totals(start: np.ndarray, to: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weight of each node's component."""
    out, seen = np.zeros(len(weight)), np.zeros(len(weight), bool)
    for s in range(len(weight)):
        if seen[s]:
            continue
        seen[s], frontier, found = True, np.array([s]), [np.array([s])]
        while len(frontier):
            n = start[frontier + 1] - start[frontier]
            b = to[np.repeat(start[frontier] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            frontier = np.unique(b[~seen[b]])
            seen[frontier] = True
            found.append(frontier)
        at = np.concatenate(found)
        out[at] = weight[at].sum()
    return out


def _rows(u: np.ndarray, v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, to) of steps in order."""
    return np.r_[0, np.cumsum(np.bincount(u, minlength=n))], v


class _Graph:
    """The distinct undirected edges by number; ``order`` is None where they are too many."""

    def __init__(self, edges: DataFrame):
        self.spark, scratch = edges.sparkSession, Scratch(edges.sparkSession, "betweenness")
        self.pairs = scratch.save(edges.select("src", "dst").where("src <> dst"))
        self.order = None
        if self.pairs.count() > MAX_EDGES:
            return
        self.ids = scratch.save(self.pairs.select(F.col("src").alias("id")).union(self.pairs.select("dst")).distinct())
        self.order = order_of(self.ids, scratch)
        if self.order is None:
            return
        got = per_block(adjacency(self.pairs, self.order, scratch), _steps)
        self.n = len(self.order)
        u, v = got or (np.zeros(0, np.int32),) * 2
        by = np.argsort(u, kind="stable")
        self.u, self.v = u[by], v[by]

    def sampled(self, k: int) -> np.ndarray:
        """Dependencies of nodes on the ``k`` first sources in the order of the hash."""
        start, to = _rows(self.u, self.v, self.n)
        return _walked(self.spark, start, to, np.ones(self.n), np.arange(k), True)

    def exact(self, of_nodes: bool):
        """Of all sources: values of the nodes, or what ``_of_edges`` needs."""
        parent, size, square, rounds = _fold(self.u, self.v, self.n)
        inner = np.flatnonzero((parent < 0) & (np.bincount(self.u, minlength=self.n) > 0))
        place = np.full(self.n, -1)
        keep = (parent[self.u] < 0) & (parent[self.v] < 0)
        core = np.unique(self.u[keep])
        place[core] = np.arange(len(core))
        u, v = place[self.u[keep]], place[self.v[keep]]
        start, to = _rows(u, v, len(core))
        total = np.zeros(self.n)
        total[inner] = size[inner]  # roots of trees
        total[core] = _totals(start, to, size[core])
        for leaves, up in reversed(rounds):
            total[leaves] = total[up]
        x = _walked(self.spark, start, to, size[core], np.arange(len(core)), of_nodes)
        if of_nodes:
            rest = total - size  # one more branch of a node in a tree
            out = (total - 1) ** 2 - square - rest**2
            below = size[core] - 1
            out[core] = below**2 - square[core] + 2 * below * rest[core] + x
            return out
        return parent, size, total, place, u.astype(np.int64) << 32 | v, x


def _of_edges(folded: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Values of the edges between the numbers ``a`` and ``b``, of what ``_Graph.exact`` gives for steps."""
    parent, size, total, place, keys, x = folded
    low = np.where(parent[a] == b, a, b)
    out = 2 * size[low] * (total[low] - size[low])
    flat = (parent[a] != b) & (parent[b] != a)
    p, q = place[a[flat]], place[b[flat]]
    if len(p):
        out[flat] = x[np.searchsorted(keys, p << 32 | q)] + x[np.searchsorted(keys, q << 32 | p)]
    return out


def _by_frontiers(edges: DataFrame, pivots: int | None) -> tuple[DataFrame, int, int]:
    """All pivots level by level: numbers of shortest paths on the way out, then
    dependencies on the way back. Neighbours of a level lie in it, the one before or the one after."""
    scratch = Scratch(edges.sparkSession, "betweenness")
    steps = scratch.save(both_ways(edges).where("u <> v"))
    starts = scratch.save(steps.select(F.col("u").alias("s")).distinct())
    n = starts.count()
    k = _pivots(n, pivots)
    if k < n:
        starts = starts.orderBy(F.xxhash64("s"), "s").limit(k)
    levels = [scratch.save(starts.select("s", F.col("s").alias("u"), F.lit(1.0).alias("paths")))]
    while True:
        nxt = levels[-1].join(steps, "u").groupBy("s", F.col("v").alias("u")).agg(F.sum("paths").alias("paths"))
        for last in levels[-2:]:
            nxt = nxt.join(last.select("s", "u"), ["s", "u"], "left_anti")
        nxt = scratch.save(nxt)
        if not nxt.limit(1).count():
            break
        levels.append(nxt)
    got = starts.select("s", F.col("s").alias("u"), F.lit(0.0).alias("delta")).limit(0)
    total = got.select("u", "delta")
    for at in range(len(levels) - 1, 0, -1):
        own = scratch.save(levels[at].join(got, ["s", "u"], "left").select("s", "u", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        total = total.union(own.select("u", "delta"))
        back = own.join(steps, "u").select("s", F.col("v").alias("u"), ((1 + F.col("delta")) / F.col("paths")).alias("share"))
        got = back.join(levels[at - 1], ["s", "u"]).groupBy("s", "u").agg(F.sum(F.col("paths") * F.col("share")).alias("delta"))
    return total.groupBy("u").agg(F.sum("delta").alias("x")), n, k


def node_betweenness(edges: DataFrame, pivots: int | None = PIVOTS) -> DataFrame:
    """(id, betweenness), normalised; exact up to 1000 nodes, else from pivots in the order of a hash."""
    g = _Graph(edges)
    if g.order is None:
        got, n, k = _by_frontiers(g.pairs, pivots)
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        return got.select(F.col("u").alias("id"), (F.col("x") * scale * n / max(1, k)).alias("betweenness"))
    k = _pivots(g.n, pivots)
    x = g.exact(True) if k == g.n else g.sampled(k)
    scale = 1 / ((g.n - 1) * (g.n - 2)) if g.n > 2 else 1.0
    return valued(g.ids, g.order, x * scale * g.n / max(1, k), "betweenness")


def edge_betweenness(edges: DataFrame) -> DataFrame:
    """(u, v, betweenness) of undirected edges, normalised, exact."""
    g = _Graph(edges)
    if g.order is None:
        raise ValueError(f"betweenness of edges is for at most {MAX_EDGES} edges")
    n, shared = g.n, g.spark.sparkContext.broadcast((g.order, g.exact(False)))

    def run(batches):
        for batch in batches:
            order, folded = shared.value
            x = _of_edges(folded, *(numbers(order, batch.column(i).to_numpy()) for i in (2, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x / (n * (n - 1)) if n > 1 else x)], names=["u", "v", "betweenness"])

    pairs = g.pairs.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    kind = pairs.schema["u"].dataType.simpleString()
    return pairs.select("u", "v", F.xxhash64("u").alias("a"), F.xxhash64("v").alias("b")).mapInArrow(run, f"u {kind}, v {kind}, betweenness double")
