"""Communities by synchronous Louvain moves on DataFrames, and what is done with them after.

A move round: every node looks at the weight towards each neighbouring community (one join and one
aggregation) and takes the best gain; only nodes of one parity of a hash move in a round, so two
nodes do not swap for ever. Results are deterministic; they are not those of another library.

Where the state of all nodes fits into arrays (``numbered.MAX_NODES``) a round is one pass over the packed adjacency,
without a shuffle; beyond that it is joins. Both give the same communities.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.operators.analytics import degrees
from weftgraph.operators.numbered import adjacency, order_of, per_block, valued
from weftgraph.scratch import Scratch

MAX_SHARE, MIN_SPLIT, COHESION_SPLIT, COHESION_LEAST = 0.25, 10, 50, 0.05


def partition(edges: DataFrame, rounds: int = 24, resolution: float = 1.0, scratch: Scratch | None = None) -> DataFrame:
    """(node, community): local moves from singletons, at most ``rounds`` of them. ``edges``: (src, dst)."""
    scratch = scratch or Scratch(edges.sparkSession, "louvain")
    half = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").cast("double").alias("w"))
    half = scratch.save(half)
    adj = scratch.save(half.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").union(half.select("b", "a", "w")))
    k = scratch.save(adj.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")))
    total = k.agg(F.sum("k")).first()[0] or 1.0  # twice the weight of all edges
    state = scratch.save(k.select("node", F.col("node").alias("community"), "k"))
    for r in range(rounds):
        size = state.groupBy("community").agg(F.sum("k").alias("tot"))
        to = adj.join(state.select(F.col("node").alias("v"), "community"), "v").groupBy(F.col("u").alias("node"), "community").agg(F.sum("w").alias("w"))
        own = state.select("node", F.col("community").alias("old"), "k")
        cand = to.join(own, "node").join(size, "community")
        tot = F.when(F.col("community") == F.col("old"), F.col("tot") - F.col("k")).otherwise(F.col("tot"))
        gain = F.col("w") - resolution * F.col("k") * tot / total
        best = cand.groupBy("node", "old", "k").agg(
            F.max_by(F.struct("community", gain.alias("gain")), F.struct(F.round(gain, 9), F.negate(F.xxhash64("community")))).alias("b"),
            F.max(F.when(F.col("community") == F.col("old"), gain)).alias("stay"),
        )
        stay = F.coalesce("stay", F.lit(0.0))
        wants = F.col("b.gain") > stay + 1e-9
        moves = wants & (F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0)
        nxt = scratch.save(best.select("node", F.when(moves, F.col("b.community")).otherwise(F.col("old")).alias("community"), "k", wants.alias("wants")))
        scratch.drop(state)
        state = nxt
        if not state.where("wants").limit(1).count():
            break
    return state.select("node", "community")


def _odd(order: np.ndarray, r: int) -> np.ndarray:
    """Whether the hash of a node and a round, ``xxhash64(node, r)``, is odd, from the hash of the node."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        h = order.astype(np.int64).view(np.uint64) + p5 + np.uint64(4)
        h ^= np.uint64(r) * p1
        h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        return ((h ^ h >> np.uint64(32)) & np.uint64(1)).astype(bool)


def _inner(u, n, v, region, one=False):
    """Steps of a block between two nodes of one region, as (place of the node in the block, end). ``one``: all that
    are not negative are one region."""
    own = np.repeat(np.arange(len(u)), n)
    keep = (one | (region[u][own] == region[v])) & (region[u][own] >= 0) & (region[v] >= 0) & (u[own] != v)
    return own[keep], v[keep]


def _counted(own, to):
    """(own, to, times) of the distinct pairs, in order."""
    key = np.sort(own.astype(np.int64) << 32 | to)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first] >> 32, key[first] & 0x7FFFFFFF, np.diff(np.r_[first, len(key)])


def _best(at, score):
    """Of each run of ``at`` the place of the first best score."""
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    top = np.flatnonzero(score == np.repeat(np.maximum.reduceat(score, start), np.diff(np.r_[start, len(at)])))
    return top[np.r_[True, at[top[1:]] != at[top[:-1]]]]


def _weights(u, n, v, region):
    own, v = _inner(u, n, v, region)
    k = np.bincount(own, minlength=len(u))
    return u[k > 0], k[k > 0]


def _moves(u, n, v, region, community, tot, odd, total, resolution):
    """(node, community) of the nodes of a block that move now, the first -1 if there are only others that want to.
    ``region`` None: all nodes that have a community."""
    own, v = _inner(u, n, v, community if region is None else region.value, region is None)
    if not len(own):
        return None
    odd = np.unpackbits(odd, count=len(community)).view(bool)[u]
    k, old = np.bincount(own, minlength=len(u)).astype(float), community[u]
    at, c, w = _counted(own, community[v])
    stays = c == old[at]
    gain = w - resolution * k[at] * (tot[c] - np.where(stays, k[at], 0.0)) / total
    stay = np.zeros(len(u))
    stay[at[stays]] = gain[stays]
    best = _best(at, np.round(gain, 9))  # ties: the least hash, as numbers go by hashes
    best = best[gain[best] > stay[at[best]] + 1e-9]
    if not len(best):
        return None
    now = best[~odd[at[best]]]
    if not len(now):
        return np.array([-1], np.int32), np.array([-1], np.int32)
    return u[at[now]].astype(np.int32), c[now].astype(np.int32)


def _links(u, n, v, community):
    """(community, distinct undirected pairs within it) of the steps of a block."""
    own = np.repeat(u, n)
    keep = (own <= v) & (community[own] == community[v]) & (community[v] >= 0)
    a, _, _ = _counted(own[keep], v[keep]) if keep.any() else (own[:0], None, None)
    return np.unique(community[a], return_counts=True)


def _votes(u, n, v, hub, community):
    """(hub, community) of most of its neighbours, ties to the least one."""
    own = np.repeat(np.arange(len(u)), n)
    keep = hub[u][own] & (community[v] >= 0)
    if not keep.any():
        return None
    at, c, w = _counted(own[keep], community[v[keep]])
    best = _best(at, w)
    return u[at[best]], c[best]


def _partition(blocks: DataFrame, order: np.ndarray, region: np.ndarray, rounds: int = 24, resolution: float = 1.0) -> np.ndarray:
    """As ``partition``, of the steps within regions: a community, named by one of its nodes, of each node, -1 without a step."""
    n = len(order)
    k = np.zeros(n)
    if got := per_block(blocks, _weights, region):
        k[got[0]] = got[1]
    some = k > 0
    community = np.where(some, np.arange(n), -1).astype(np.int32)
    # what a pass is sent lies on the disk of each machine, and more than once: the regions are sent once, and not at all
    # where there is one, for then the nodes in it that have a step have a community
    whole = not len(region) or region.max() <= 0
    shared = None if whole else blocks.sparkSession.sparkContext.broadcast(region)
    total = k.sum() or 1.0
    for r in range(rounds):
        tot = np.bincount(community[some], k[some], minlength=n).astype(np.int32 if total < 1 << 31 else np.float64)
        got = per_block(blocks, _moves, shared, community, tot, np.packbits(_odd(order, r)), total, resolution)
        if not got:
            break
        node, to = got
        to, node = to[node >= 0], node[node >= 0]
        community[node] = to
    if shared is not None:
        shared.destroy()
    return community


def _by_arrays(nodes: DataFrame, edges: DataFrame, exclude_hubs: float | None, scratch: Scratch) -> DataFrame | None:
    """As ``communities``; None where the nodes cannot be numbered."""
    ids = scratch.save(nodes.select("id").distinct())
    order = order_of(ids, scratch)
    if order is None:
        return None
    n, blocks = len(order), adjacency(edges.select("src", "dst"), order, scratch)
    region, hub = np.zeros(n, np.int32), np.zeros(n, bool)
    if exclude_hubs is not None and n:
        degree = np.zeros(n, np.int64)
        if got := per_block(blocks, lambda u, n, v: (u, n)):
            degree[got[0]] = got[1]
        rows = nodes.count()
        at = max(0, int(rows * exclude_hubs / 100) - 1) - (rows - n)
        hub = degree > (np.partition(degree, at)[at] if at >= 0 else 0)
        region[hub] = -1
    got = _partition(blocks, order, region)
    for attempt in ("size", "cohesion"):
        size = np.bincount(got[got >= 0], minlength=n)
        if attempt == "size":
            big = size > max(MIN_SPLIT, int(n * MAX_SHARE))
        else:
            big = size >= COHESION_SPLIT
            if big.any():
                m = np.zeros(n)
                for c, x in zip(*(per_block(blocks, _links, got) or ((), ())), strict=True):
                    m[c] += x
                big &= m / np.maximum(size * (size - 1.0) / 2, 1) < COHESION_LEAST
        if big.any():
            finer = _partition(blocks, order, np.where((got >= 0) & big[got], got, -1).astype(np.int32))
            got = np.where(finer >= 0, finer, got)
    got = np.where((got < 0) & ~hub, np.arange(n), got).astype(np.int32)
    named = _numbers_of(valued(ids, order, got, "community").where("community >= 0").withColumnRenamed("id", "node")).select("community", "id").toArrow()
    number = np.full(n, -1, np.int32)
    number[named.column(0).to_numpy()] = named.column(1).to_numpy()
    final = np.where(got >= 0, number[got], -1).astype(np.int32)
    if hub.any() and (back := per_block(blocks, _votes, hub, final)):
        final[back[0]] = back[1]
    out = valued(ids, order, final, "community").withColumnRenamed("id", "node")
    if (final >= 0).all():
        return out
    rest = out.where("community < 0").select("node", (F.row_number().over(Window.orderBy("node")) + int(number.max())).cast("int").alias("community"))
    return out.where("community >= 0").unionByName(rest)


def _numbers_of(assigned: DataFrame) -> DataFrame:
    size = assigned.groupBy("community").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    # one row per community passes one task: a running number needs it
    return size.withColumn("id", (F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).cast("int"))


def reindex(assigned: DataFrame) -> DataFrame:
    """Communities numbered from 0 by size, then by their least node."""
    return assigned.join(_numbers_of(assigned).select("community", "id"), "community").select("node", F.col("id").alias("community"))


def hubs(nodes: DataFrame, edges: DataFrame, percentile: float) -> DataFrame:
    """Nodes whose degree is over that at index max(0, int(n p / 100) - 1) of the ascending degrees."""
    n = nodes.count()
    hist = degrees(edges).groupBy("degree").agg(F.count("*").alias("n")).orderBy("degree").collect()  # a row per distinct degree
    at, seen, cut = max(0, int(n * percentile / 100) - 1), n - sum(r["n"] for r in hist), 0
    for r in hist:
        if seen > at:
            break
        seen, cut = seen + r["n"], r["degree"]
    return degrees(edges).where(F.col("degree") > cut).select(F.col("id").alias("node"))


def reattach(hub_nodes: DataFrame, assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """Hubs to the community of most of their neighbours, ties to the least one."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("o")).union(edges.select("dst", "src"))
    votes = both.join(hub_nodes, "node", "left_semi").join(assigned.select(F.col("node").alias("o"), "community"), "o").groupBy("node", "community").agg(F.count("*").alias("n"))
    return votes.groupBy("node").agg(F.max_by("community", F.struct(F.col("n"), -F.col("community"))).alias("community"))


def communities(nodes: DataFrame, edges: DataFrame, exclude_hubs: float | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(node, community int) for every node: partition, split of what is too large or too loose, numbering.

    Nodes without an edge are communities of their own. Edges count undirected; ends that are no
    nodes do not count.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "communities")
    if (found := _by_arrays(nodes, edges, exclude_hubs, scratch)) is not None:
        return found
    ids = nodes.select("id").distinct()
    e = scratch.save(edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    inner, hub = e, None
    if exclude_hubs is not None:
        hub = scratch.save(hubs(nodes, e, exclude_hubs))
        inner = e.join(hub.withColumnRenamed("node", "src"), "src", "left_anti").join(hub.withColumnRenamed("node", "dst"), "dst", "left_anti")
    got = partition(inner, scratch=scratch)
    total = ids.count()
    for attempt in ("size", "cohesion"):
        size = got.groupBy("community").agg(F.count("*").alias("n"))
        m = inner.join(got.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(got.select(F.col("node").alias("dst"), F.col("community").alias("b")),
            "dst").where("a = b")
        if attempt == "size":
            big = size.where(F.col("n") > max(MIN_SPLIT, int(total * MAX_SHARE)))
        else:
            links = m.select("a", F.least("src", "dst").alias("u"),
                F.greatest("src", "dst").alias("v")).distinct().groupBy(F.col("a").alias("community")).agg(F.count("*").alias("m"))
            big = size.join(links, "community", "left").where((F.col("n") >= COHESION_SPLIT) & (F.coalesce("m", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2) < COHESION_LEAST))
        big = scratch.save(big.select("community"))
        if not big.limit(1).count():
            continue
        within = m.join(big.withColumnRenamed("community", "a"), "a", "left_semi").select("src", "dst")
        finer = partition(within, scratch=scratch).withColumnRenamed("community", "sub")
        got = scratch.save(got.join(finer, "node", "left").select("node", F.coalesce("sub", "community").alias("community")))
    lone = ids.withColumnRenamed("id", "node").join(got, "node", "left_anti")
    if hub is not None:
        lone = lone.join(hub, "node", "left_anti")
    named = reindex(got.unionByName(lone.select("node", F.col("node").alias("community"))))
    if hub is None:
        return named
    named = scratch.save(named)
    back = reattach(hub, named, e)
    top = named.agg(F.coalesce(F.max("community"), F.lit(-1)).alias("top"))
    rest = hub.join(back, "node", "left_anti").withColumn("r", F.row_number().over(Window.orderBy("node"))).join(F.broadcast(top)).select("node",
        (F.col("top") + F.col("r")).cast("int").alias("community"))
    return named.unionByName(back).unionByName(rest)


def overlap(new: DataFrame, old: DataFrame) -> DataFrame:
    """(old, new, overlap) node counts. Both: (node, community)."""
    return new.select("node", F.col("community").alias("old")).join(old.select("node", F.col("community").alias("new")), "node").groupBy("old",
        "new").agg(F.count("*").alias("overlap"))


def remap_to_previous(new: DataFrame, previous: DataFrame) -> DataFrame:
    """New communities under previous ids where they overlap most, one to one; fresh ids by size.

    The overlap table, bounded by communities that share a node, is matched on the driver.
    """
    spark = new.sparkSession
    pairs = previous.select("node", F.col("community").alias("old")).join(new.select("node", F.col("community").alias("new")), "node").groupBy("old", "new").count()
    rows = sorted(((r["count"], r["old"], r["new"]) for r in pairs.collect()), key=lambda r: (-r[0], r[1], r[2]))
    used, name = set(), {}
    for _, o, n in rows:
        if o not in used and n not in name:
            used.add(o)
            name[n] = o
    sizes = sorted(((-r["count"], r["least"], r["community"]) for r in new.groupBy("community").agg(F.count("*").alias("count"), F.min("node").alias("least")).collect()))
    fresh = max([*used, -1]) + 1
    for _, _, c in sizes:
        if c not in name:
            name[c], fresh = fresh, fresh + 1
    table = spark.createDataFrame([(int(a), int(b)) for a, b in name.items()], "community int, to int")
    return new.join(table, "community").select("node", F.col("to").alias("community"))
