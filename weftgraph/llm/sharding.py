"""Size-balanced sharding by sampled splitters.

Records are ordered by the hash of their text, so equal texts are neighbours. A bottom-k sample
under exponential ranks draws keys with a chance that follows their size; a bound on the ranks, from
the total size, lets about twice the sample through to the one task that orders it, however many
partitions there are. The sample's quantiles cut the key space into many more ranges than shards.
Ranges that turn out too full are sampled again and cut further, down to single records where one text
fills several ranges. Splitters reach the plan as one literal that the optimiser folds.
Windows run within a range only; range totals, a bounded table, give every record its place in
the whole, and the place gives the shard: shards are runs of nearly equal bytes.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.scratch import Scratch

RANGES, SAMPLE = 512, 8192
#: A range over so many times its share is cut again; at most so many times in all, then it stays whole,
#: which costs its task memory and time but changes no promise but the evenness of shards.
OVERFULL, ROUNDS = 2.0, 12
_STEP = 32


def _sample(rows: DataFrame, n: int, seed: int, total: int, count: int) -> list[tuple]:
    """At most n keys, drawn with a chance that follows the size (exponential ranks, smallest n).

    A rank lies below r with a chance of about size * r, so about 2n of the ranks of ``total`` bytes lie
    below 2n / total; the bound rises until n do. ``count`` rows that are no more than n all stay.
    """
    unit = (F.pmod(F.xxhash64("key", "tie", "row", F.lit(seed)), F.lit(1 << 52)) + 1) / float(1 << 52)
    ranked = rows.select("key", "tie", "row", (-F.log(unit) / F.col("size")).alias("rank"))
    most = 2.0 * n / max(1, total) if count > n else 100.0
    while True:
        got = ranked.where(F.col("rank") < most).orderBy("rank").limit(n).collect()
        if len(got) == n or most > 64:  # the greatest rank is 52 log 2
            return sorted(((r["key"], r["tie"], r["row"]) for r in got), key=_order)
        most *= 16


def _order(k: tuple) -> tuple:
    return (k[0], k[1] is not None, k[1] or 0, k[2] is not None, k[2] or 0)


def _quantiles(sample: list[tuple], n: int) -> list[tuple]:
    return [sample[i * len(sample) // n] for i in range(1, n)] if len(sample) >= n else sample


def _splitters(cuts: list[tuple]) -> list[tuple]:
    """Sorted distinct splitters; one that is alone at its key moves before the whole group."""
    cuts = sorted(set(cuts), key=_order)
    many = {a[0] for a, b in zip(cuts, cuts[1:], strict=False) if a[0] == b[0]}
    return sorted({c if c[0] in many else (c[0], None, None) for c in cuts}, key=_order)


def _literal(value: list, kind: str) -> Column:
    """A foldable column of nested lists and dicts of integers."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _range_of(splitters: list[tuple]) -> Column:
    """Number of splitters at or before the record's key, found in two steps."""
    kind = "struct<key:bigint,tie:bigint,row:bigint>"
    me = F.struct("key", "tie", "row")
    runs = [[dict(zip(("key", "tie", "row"), c, strict=True)) for c in splitters[i : i + _STEP]] for i in range(0, len(splitters), _STEP)]
    if not runs:
        return F.lit(0)
    coarse = F.size(F.filter(_literal([r[0] for r in runs], f"array<{kind}>"), lambda s: s <= me))
    fine = F.get(_literal(runs, f"array<array<{kind}>>"), coarse - 1)
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * _STEP + F.size(F.filter(fine, lambda s: s <= me)))


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES, sample: int = SAMPLE,
    scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: (id, size, text_crc32, shard, slot).

    size is the UTF-8 length of the text (null: 0) plus 1, text_crc32 the unsigned CRC-32 (null: of
    nothing, 0). Law: shards are near equal in bytes, each within about one range of its share, a
    range being 1/``ranges`` of all bytes or one text. Equal texts share a shard unless together
    they fill more than a range or so; such a group is split like any other run. slot counts
    a shard's records from 0 without a gap. Should a range still be overfull after ``ROUNDS`` cuts, the
    law's bound holds with that range's bytes in place of 1/``ranges``. Ids may be null or repeat; repeated rows count
    each. An empty table gives none. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "sharding")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = scratch.save(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
        F.xxhash64(text).alias("key"), F.xxhash64(id_col).alias("tie"), F.monotonically_increasing_id().alias("row"),
    ))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    splitters = _splitters(_quantiles(_sample(rows, sample, 1, total, count), ranges)) if count else []
    for attempt in range(ROUNDS):
        at = rows.withColumn("rng", _range_of(splitters))
        totals = {r["rng"]: (r["b"], r["n"]) for r in at.groupBy("rng").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
        full = [r for r, (b, n) in totals.items() if n > 1 and b > OVERFULL * total / ranges]
        if not full or attempt == ROUNDS - 1:
            break
        held = sum(totals[r][0] for r in full)
        crowded = at.where(F.array_contains(_literal(full, "array<int>"), F.col("rng")))
        extra = _sample(crowded, sample, attempt + 2, held, sum(totals[r][1] for r in full))
        wanted = min(len(extra), int(held / (total / ranges)) + 1)
        more = _splitters(splitters + _quantiles(extra, max(2, wanted)))
        if more == splitters:
            break
        splitters = more
    offsets, before = {}, 0
    for r in sorted(totals):
        offsets[r] = before
        before += totals[r][0]
    hot = sorted({a[0] for a, b in zip(splitters, splitters[1:], strict=False) if a[0] == b[0]})
    base = F.get(_literal([offsets.get(r, 0) for r in range(max(totals, default=0) + 1)], "array<bigint>"), F.col("rng"))
    ordered = Window.partitionBy("rng").orderBy("key", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("rng", "key")
    placed = at.withColumn("upto", F.sum("size").over(ordered)).withColumn("g_upto",
        F.sum("size").over(group.orderBy("tie", "row").rowsBetween(Window.unboundedPreceding, 0))).withColumn("g_size", F.sum("size").over(group))
    whole = ~F.array_contains(_literal(hot, "array<bigint>"), F.col("key"))
    middle = base + F.when(whole, F.col("upto") - F.col("g_upto") + F.col("g_size") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    shard = F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(max(1, total)))).cast("int")
    placed = scratch.save(placed.select("id", "size", "crc", "key", "tie", "row", "rng", shard.alias("shard")))
    counts = sorted((r["shard"], r["rng"], r["count"]) for r in placed.groupBy("shard", "rng").count().collect())
    first, seen, last = [], 0, None
    for s, r, n in counts:
        seen = 0 if s != last else seen
        first.append((s, r, seen))
        seen, last = seen + n, s
    firsts = spark.createDataFrame(first, "shard int, rng int, first long")  # a row per range and shard in it
    number = F.row_number().over(Window.partitionBy("rng", "shard").orderBy("key", "tie", "row"))
    out = placed.withColumn("n", number).join(F.broadcast(firsts), ["shard", "rng"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("n") - 1).cast("long").alias("slot"))
