"""Materialised intermediate tables in the folder that driver and executors share.

Loops and multi-consumer plans cut their lineage here. The folder is the one the
cluster names in ``spark.checkpoint.dir``; only in local mode (tests, a laptop) a
folder is made where that is unset. Written tables survive the loss of executors, and because
they are Parquet their size is known to the planner.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir``, else in local mode an own temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        found = tempfile.mkdtemp(prefix="weftgraph-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator run. ``save`` writes and rereads; ``drop`` frees the files.

    What the returned DataFrame still reads stays until the process ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/t{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weft_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_weft_path", None)
            if path:
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone at exit
            pass
