"""State between runs: what needs an update, when a served graph is read again, one rebuild at a time, and
graphs compared whatever the order of their rows."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources import corpus as C
from weftgraph.streaming.feeds import fingerprint

#: Columns that say what a graph is, in a fixed order; places in a file may move without changing it.
NODE_TOPOLOGY, EDGE_TOPOLOGY = ("id", "label", "file_type", "source_file"), ("src", "dst", "relation", "confidence")


def needs_update(changes: DataFrame) -> DataFrame:
    """(root, n_code, n_other, rebuild, needs_update): code changes rebuild at once, other files only raise a flag, for
    a model has to read them. ``changes``: (root, path)."""
    kind = C.classify(F.col("path"))
    g = changes.select("root", "path").distinct().groupBy("root").agg(F.count_if(kind == "code").alias("n_code"), F.count_if(kind.isNotNull() & (kind != "code")).alias("n_other"))
    return g.withColumn("rebuild", F.col("n_code") > 0).withColumn("needs_update", F.col("n_other") > 0)


def same_topology(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> bool:
    """Whether two graphs have the same nodes and edges, rows in any order."""
    own = lambda df, cols: [c for c in cols if c in df.columns]
    return all(
        own(x, cols) == own(y, cols) and fingerprint(x, own(x, cols)) == fingerprint(y, own(y, cols)) for x, y, cols in ((a[0], b[0], NODE_TOPOLOGY), (a[1], b[1], EDGE_TOPOLOGY))
    )


def canonical_rows(df: DataFrame) -> DataFrame:
    """(json): every row as JSON with its columns in order of their names, the rows in order."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json")).orderBy("json")


class Reloading:
    """A value that is read again when the (modification time, size) of its path changes. ``stat`` tells these two;
    the default asks the file system that Spark uses for the path."""

    def __init__(self, spark, path: str, read: Callable[[str], object], stat: Callable[[str], tuple[int, int]] | None = None):
        self.spark, self.path, self.read, self.stat = spark, path, read, stat or self._stat
        self._seen: tuple[int, int] | None = None
        self._value: object = None

    def _stat(self, path: str) -> tuple[int, int]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        s = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).getFileStatus(p)
        return s.getModificationTime(), s.getLen()

    def get(self) -> object:
        now = self.stat(self.path)
        if now != self._seen:
            self._value, self._seen = self.read(self.path), now
        return self._value


class RebuildLock:
    """One rebuild of a folder at a time on the driver's machine: a file that holds the process id. A lock whose
    process is gone is taken over. As a context manager it tells whether it was got."""

    def __init__(self, folder: str, name: str = ".rebuild.lock"):
        self.path, self.held = os.path.join(folder, name), False

    def acquire(self) -> bool:
        for _ in range(2):
            try:
                fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                if self._alive():
                    return False
                try:
                    os.unlink(self.path)
                except FileNotFoundError:
                    pass
                continue
            with os.fdopen(fd, "w") as f:
                f.write(str(os.getpid()))
            self.held = True
            return True
        return False

    def _alive(self) -> bool:
        try:
            with open(self.path) as f:
                pid = int(f.read().strip() or 0)
            os.kill(pid, 0)
            return pid > 0
        except PermissionError:
            return True
        except (OSError, ValueError):
            return False

    def release(self) -> None:
        if self.held:
            self.held = False
            os.unlink(self.path)

    def __enter__(self) -> bool:
        return self.acquire()

    def __exit__(self, *_) -> None:
        self.release()


def read_graph(spark, path: str, directed: bool | None = None, max_bytes: int = 512 << 20) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, directed) of a node-link file. ``directed`` overrides the flag that the file holds; a path
    that is no ``.json`` or a file over ``max_bytes`` is refused before it is read. Edges may be called links, edges or
    relationships; ends source and target, from and to, src and dst; nodes may be called vertices or lie under ``graph``."""
    if not path.endswith(".json"):
        raise ValueError("a graph file ends in .json")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    size = p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getLen()
    if size > max_bytes:
        raise ValueError(f"{path} has {size} bytes, over {max_bytes}")
    doc = spark.read.option("multiLine", True).json(path)
    inner = doc.select("graph.*") if "graph" in doc.columns and dict(doc.dtypes)["graph"].startswith("struct") else None

    def first(names: tuple[str, ...]) -> DataFrame:
        for d in (doc, inner):
            for n in names:
                if d is not None and n in d.columns and dict(d.dtypes)[n].startswith("array<struct"):
                    return d.select(F.explode(n).alias("x")).select("x.*")
        raise ValueError(f"{path} has none of {', '.join(names)}")

    def renamed(df: DataFrame, to: str, names: tuple[str, ...]) -> DataFrame:
        held = [n for n in (to, *names) if n in df.columns]
        if not held:
            raise ValueError(f"no column of {to}, {', '.join(names)}")
        return df.withColumn(to, F.coalesce(*(F.col(n).cast("string") for n in held))).drop(*(n for n in held if n != to))

    nodes = renamed(first(("nodes", "vertices")), "id", ("key", "name"))
    edges = renamed(renamed(first(("links", "edges", "relationships")), "src", ("source", "from")), "dst", ("target", "to"))
    if "label" not in nodes.columns:
        nodes = nodes.withColumn("label", F.col("id"))
    if "confidence_score" in edges.columns:
        edges = edges.withColumn("confidence_score", F.col("confidence_score").try_cast("double"))
    flag = bool(doc.select("directed").first()[0]) if "directed" in doc.columns else False
    return nodes, edges, flag if directed is None else directed
