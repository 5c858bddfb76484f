"""Connected components by contraction: every round hooks each vertex to its least
neighbour, jumps pointers to the root and relabels the edges, which shrink until none
is left. All rounds are aggregations and equi-joins; no vertex's neighbours are ever
gathered in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.scratch import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for every endpoint of ``edges``; component is the least node of it.

    Null endpoints are ignored, self-loops keep their node as a component of one, repeated
    edges and an empty table are fine. Node type: any orderable type.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "components")
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    cur = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    levels: list[DataFrame] = []
    while True:
        both = cur.select(F.col("a").alias("v"), F.col("b").alias("u")).union(cur.select("b", "a"))
        hook = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("p"))
        hook = scratch.save(hook)
        while True:
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.save(hook.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            moved = jumped.where("moved").limit(1).count()
            scratch.drop(hook)
            hook = jumped
            if not moved:
                break
        hook = hook.select("v", "p")
        levels.append(hook)
        ha = hook.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        hb = hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        nxt = (
            cur.join(ha, "a").join(hb, "b").where("pa != pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        nxt = scratch.save(nxt)
        scratch.drop(cur)
        cur = nxt
        if not cur.limit(1).count():
            break
    out = levels[0].select(F.col("v").alias("node"), F.col("p").alias("component"))
    for level in levels[1:]:
        step = level.select(F.col("v").alias("component"), F.col("p").alias("nxt"))
        out = out.join(step, "component", "left").select("node", F.coalesce("nxt", "component").alias("component"))
    return scratch.save(out) if len(levels) > 1 else out
