"""Texts travel to Python workers in batches of few rows: one row can be a very long text, and a batch
is held several times over (by the JVM, by the socket and by the worker)."""

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(spark: SparkSession, rows: int = ROWS) -> None:
    """Lowers the session's rows per Arrow batch to ``rows``; a lower setting stays."""
    held = int(spark.conf.get(_KEY))
    if held <= 0 or held > rows:
        spark.conf.set(_KEY, rows)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker gives freed memory back: it may wait idle beside later stages, and would hold it."""

    def told(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return told
