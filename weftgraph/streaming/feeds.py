"""Change feeds: debounced batches of file events, and incremental graph maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATE = "10 minutes"


def wanted(events: DataFrame, suffixes: list[str], out_dir: str = "out") -> DataFrame:
    """Events of files with one of the suffixes, outside dot directories and the output directory."""
    parts = F.split("path", "/")
    return events.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes) & ~F.exists(parts, lambda p: p.startswith(".") | (p == out_dir)))


def debounced(events: DataFrame, gap: str = "3 seconds", key: str = "root", late: str | None = LATE) -> DataFrame:
    """One row per key and burst: events closer than ``gap`` are one. (key, start, end, n_events, paths).

    On a stream, events later than ``late`` are dropped and bursts come out when they are closed.
    """
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(key, F.session_window("ts", gap).alias("w"))
    out = g.agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set("path")).alias("paths"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", "paths")


def dedup_events(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first of repeated events within the watermark; of a table, one of each."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def graph_updates(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "3 seconds") -> StreamingQuery:
    """Hands each micro-batch of changed files to ``apply``, exactly once per batch id if that is idempotent."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def fingerprint(df: DataFrame, columns: list[str]) -> tuple[int, int]:
    """(rows, order-free hash): equal tables have equal ones."""
    # 64-bit hashes are summed as decimals, which cannot overflow
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], int(r["h"])
