"""N-gram Jaccard join as a blocked sparse matrix product.

Rows are the distinct shingle sets (classes) of the documents, columns the shingles.
The column space is cut into K blocks. A pair of sizes a and b whose Jaccard index is at
least t differs in at most (a + b)(1 - t)/(1 + t) columns, so with K larger than that bound
the two rows agree in at least one whole column block. K follows from the size interval of
the rows (intervals grow by half; a row takes part in the family of its own interval and, if
its size allows a partner there, in those towards its neighbours). Rows that agree in a whole
column block form row blocks; within these the product of the incidence matrix with its
transpose accumulates the overlap counts, and pairs below the bound of their sizes go.
Every pair that reaches t meets in some row block: the join is exact up to 64-bit hashes of shingles
and 128-bit hashes of classes (of which the candidate search uses one half; a clash of halves only
adds candidates).

What bounds memory and work: copies collapse to one class first; agreeing rows of one batch
are linked to their least row before anything is shuffled, so a block of n rows costs n rows
and not n * n; a component of candidates that is too large for one task is cut into sub-blocks
by size interval and hash, and every compatible pair of sub-blocks is one task that returns a
spanning forest.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import kernels as K
from weftgraph.llm.batches import bounded, trimmed
from weftgraph.operators.components import connected_components
from weftgraph.scratch import Scratch

NUM, DEN = 85, 100
SHINGLE = 4
BLOCK_ROWS, BLOCK_CELLS = 1024, 500_000
BROADCAST_ROWS = 400_000
#: Classes that hold more than one row in so many (and no fewer than HOT_LEAST) are joined by broadcast.
HOT_CLASSES, HOT_LEAST = 10_000, 64
#: Entries of a mapper that are combined before they leave it.
COMBINE = 1 << 20
#: One text in SAMPLE_SHARE is counted; a column in SAMPLE_LEAST of these is common. Both only steer the work.
SAMPLE_SHARE, SAMPLE_LEAST, COMMON_MOST = 16, 4, 4_000_000


@functools.cache
def _intervals() -> np.ndarray:
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, -(-3 * bounds[-1] // 2)))
    return np.array(bounds, np.int64)


@functools.cache
def _families(n: int, num: int, den: int) -> tuple[tuple[int, int, int], ...]:
    """(family, most columns that a pair may differ in, number of column blocks) for a row of n."""
    b = _intervals()
    k = int(np.searchsorted(b, n, "right")) - 1
    top = int(b[k + 1]) - 1

    def family(f: int, total: int) -> tuple[int, int, int]:
        differ = total * (den - num) // (den + num)
        spare = 0 if differ == 0 else 2 + -(-differ * 8 // 100)
        return f, differ, differ + 1 + spare

    out = [family(2 * k, 2 * top)]
    nxt = int(b[k + 1])
    if den * n >= num * nxt:
        out.append(family(2 * k + 1, top + min(int(b[k + 2]) - 1, den * top // num)))
    if k:
        low = int(b[k]) - 1
        if num * n <= den * low:
            out.append(family(2 * k - 1, low + min(top, den * low // num)))
    return tuple(out)


@functools.lru_cache(maxsize=4096)
def _cuts(blocks: int) -> np.ndarray:
    step = (1 << 64) // blocks
    return np.array([i * step for i in range(1, blocks)], np.uint64)


def _common_mask(row: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = (row >> np.uint64(7)) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(at >> np.uint64(3)).view(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _column_blocks(row: np.ndarray, blocks: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, is it non-empty) of every column block of a sorted row."""
    sums = np.zeros(len(row) + 1, np.uint64)
    np.cumsum(K.mix(row + np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    at = np.empty(blocks + 1, np.int64)
    at[0], at[-1] = 0, len(row)
    at[1:-1] = np.searchsorted(row, _cuts(blocks))
    size = at[1:] - at[:-1]
    return K.mix(sums[at[1:]] - sums[at[:-1]] + np.uint64(salt * 0xDA942042E4DD58B5 & 0xFFFFFFFFFFFFFFFF) + (np.arange(blocks) * 64 + np.minimum(size,
        63)).astype(np.uint64)), size > 0


def signatures(row: np.ndarray, num: int = NUM, den: int = DEN, bitmap: np.ndarray | None = None) -> np.ndarray:
    """Signatures of the column blocks of a row (sorted distinct shingle hashes).

    Columns in ``bitmap`` (common ones) are left out first: a pair that differs in few columns
    differs in no more of the others, so it still agrees in a block of them, and if the row has
    fewer empty blocks than must agree, in one that is not empty. A row for which empty blocks
    could be all that agrees says its blocks over all columns too.
    """
    rare = row if bitmap is None else row[~_common_mask(row, bitmap)]
    out = []
    for f, differ, blocks in _families(len(row), num, den):
        must = blocks - differ
        sig, full = _column_blocks(rare, blocks, 2 * f)
        out.append(sig[full])
        if blocks - int(full.sum()) >= must:
            sig, full = _column_blocks(row, blocks, 2 * f + 1)
            out.append(sig if blocks - int(full.sum()) >= must else sig[full])
    return np.concatenate(out)


def _rows(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of every text of the batch."""
    for c in K.chunks(batch.column("text"), K.space_mask()):
        b = c.bounds
        for i in range(len(b) - 1):
            s = K.shingle_hashes(c.hashes[b[i] : b[i + 1]], k)
            s.sort()
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            yield c.first + i, s


def _class_id(row: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of shingles, in two halves."""
    mixed = K.mix(row ^ np.uint64(0xF1357AEA2E62A9C5))
    size = np.uint64(len(row))
    halves = np.array([mixed.sum(dtype=np.uint64) + size, K.mix(mixed + np.uint64(0x9FB21C651E98DF25)).sum(dtype=np.uint64) ^ size], np.uint64)
    uid, chk = K.mix(halves).view(np.int64).tolist()
    return uid, chk


def _combined(sig: np.ndarray, uid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One entry per signature; the other rows of it hang on the least by a star of its own."""
    order = np.lexsort((uid, sig))
    sig, uid = sig[order], uid[order]
    first = np.empty(len(sig), bool)
    first[0] = True
    np.not_equal(sig[1:], sig[:-1], out=first[1:])
    lead = uid[np.flatnonzero(first)][np.cumsum(first) - 1]
    other = uid != lead
    if not other.any():
        return sig[first], uid[first]
    pair = np.unique(np.stack([lead[other], uid[other]]), axis=1)
    salt = K.mix(np.array([sig[0] ^ sig[-1]], np.uint64))[0]
    star = K.mix(pair[0].view(np.uint64) ^ salt)
    heads, at = np.unique(pair[0], return_index=True)
    return np.concatenate([sig[first], star, star[at]]), np.concatenate([uid[first], pair[1], heads])


def _common_columns(texts: DataFrame, k: int) -> np.ndarray:
    """Bitmap of the shingles that many classes hold, from a sample of the texts.

    A fixed share of the distinct texts is counted, so the sample grows with the corpus. The bitmap
    only steers which columns candidates are looked for in; whatever it holds, no pair is lost. That
    lets it be bounded: the least count rises until at most COMMON_MOST columns are left.
    """
    picked = texts.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(SAMPLE_SHARE)) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row in _rows(batch, k):
                yield pa.RecordBatch.from_pydict({"col": row.view(np.int64)})

    counts = picked.mapInArrow(run, "col long").groupBy("col").count().where(F.col("count") >= SAMPLE_LEAST).persist()
    steps = counts.groupBy(F.least("count", F.lit(10_000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()
    least, held = 10_001, 0
    for r in steps:
        if held + r["n"] > COMMON_MOST:
            break
        least, held = r["c"], held + r["n"]
    bits = 1 << 16
    while bits < 32 * held:
        bits *= 2
    bitmap = np.zeros(bits // 8, np.uint8)
    slot = F.shiftrightunsigned("col", 7).bitwiseAND(F.lit(bits - 1))
    for (at,) in counts.where(F.col("count") >= least).select(slot).toLocalIterator():
        bitmap[at >> 3] |= np.uint8(1 << (at & 7))
    counts.unpersist()
    return bitmap


def _entry_mapper(k: int, num: int, den: int, common):
    """Texts -> signature entries of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = common.value
        seen: set[tuple[int, int]] = set()
        sigs: list[np.ndarray] = []
        uids: list[np.ndarray] = []
        held = 0

        def flush():
            nonlocal held
            s, u = _combined(np.concatenate(sigs), np.concatenate(uids))
            sigs.clear()
            uids.clear()
            seen.clear()
            held = 0
            return pa.RecordBatch.from_pydict({"sig": s.view(np.int64), "uid": u})

        for batch in batches:
            for _, row in _rows(batch, k):
                if not len(row):
                    continue
                cls = _class_id(row)
                if cls in seen:
                    continue
                seen.add(cls)
                s = signatures(row, num, den, bitmap)
                sigs.append(s)
                uids.append(np.full(len(s), cls[0], np.int64))
                held += len(s)
                if held >= COMBINE:
                    yield flush()
        if held:
            yield flush()

    return run


def _fact_mapper(k: int):
    """Texts -> (position key of the text, both halves of the class, set size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            cls, size = np.zeros((n, 2), np.int64), np.zeros(n, np.int64)
            for i, row in _rows(batch, k):
                size[i] = len(row)
                if len(row):
                    cls[i] = _class_id(row)
            keep = [c for c in batch.schema.names if c != "text"]
            halves = [pa.array(cls[:, j].copy(), mask=size == 0) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *halves, pa.array(size)], names=[*keep, "uid", "chk", "n_shingles"])

    return run


def _row_mapper(k: int):
    """Texts of candidates, with the places of their classes -> one row of the incidence matrix per place and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            places, out = batch.column("places"), []
            for i, row in _rows(batch, k):
                cls = _class_id(row)
                if cls in seen:
                    continue
                # the hash of a text may be that of another class
                mine = [p for p in places[i].as_py() if (p["uid"], p["chk"]) == cls]
                if mine:
                    seen.add(cls)
                    cells = row.tobytes()
                    out += [(f"{cls[0]}:{cls[1]}", cells, p["task"], p["part"]) for p in mine]
            names = ("cls", "cells", "task", "part")
            kinds = (pa.string(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], names=list(names))

    return run


def forest(uid: list, rows: list[np.ndarray], num: int = NUM, den: int = DEN) -> list[tuple]:
    """Spanning forest of the pairs whose Jaccard index is at least num/den.

    One row of the product at a time: its overlap with all later rows accumulates over the
    columns, and a pair below the bound of its sizes is dropped.
    """
    n = len(rows)
    size = np.array([len(r) for r in rows], np.int64)
    if n == 2:
        both = len(np.intersect1d(rows[0], rows[1], assume_unique=True))
        return [(uid[0], uid[1])] if (num + den) * both >= num * int(size.sum()) else []
    cols = np.concatenate(rows)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(cols, kind="stable")
    ranked = cols[order]
    new = np.empty(len(ranked), bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    starts = np.append(np.flatnonzero(new), len(ranked))
    post = owner[order]
    rank = np.empty(len(cols), np.int64)
    rank[order] = np.cumsum(new) - 1
    ends, begins = starts[1:], starts[:-1]
    at = np.concatenate([[0], np.cumsum(size)])
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for i in range(n - 1):
        mine = rank[at[i] : at[i + 1]]
        lo, count = begins[mine], ends[mine] - begins[mine]
        shared = count > 1
        lo, count = lo[shared], count[shared]
        if not len(lo):
            continue
        offset = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        overlap = np.bincount(post[offset + np.arange(int(count.sum()))], minlength=n)
        hit = np.flatnonzero((num + den) * overlap >= num * (size + size[i]))
        for j in hit[hit > i].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((uid[i], uid[j]))
    return links


def _product(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, str]] = []
        for _, block in pdf.drop_duplicates(["part", "cls"]).groupby("part", sort=False):
            if len(block) > 1:
                block = block.sort_values("cls")
                out += forest(block["cls"].tolist(), [np.frombuffer(x, np.uint64) for x in block["cells"]], num, den)
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN, scratch: Scratch | None = None, keys: bool = False
) -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles long, class_id string, component_id) and, with
    ``keys``, group_id (of linked documents) and text_key (xxhash64 of the text).

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; sets are the distinct k-word
    shingles (fewer words: the sequence as one). Rows link when den*|x & y| >= num*|x | y|;
    component_id is the least id reachable, itself included. Null or wordless texts have an
    empty set, class_id null, and their own id as component. A null id stays null unless a linked
    row has one; repeated rows are kept and share a class. Other columns of ``docs`` are ignored.
    Empty tables give empty results. Thresholds under 2/3 are refused: sizes of partners would lie
    further apart than neighbouring size intervals.
    """
    if 3 * num < 2 * den:
        raise ValueError(f"the threshold {num}/{den} is below 2/3")
    spark = docs.sparkSession
    bounded(spark)
    scratch = scratch or Scratch(spark, "ngram-join")
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = dict(source.dtypes)["id"]
    facts = scratch.save(
        source.select("id", F.xxhash64("text").alias("tk"), "text").mapInArrow(trimmed(_fact_mapper(k)), f"id {id_type}, tk long, uid long, chk long, n_shingles long")
    )
    texts = source.select("text").where("text is not null")
    common = spark.sparkContext.broadcast(_common_columns(texts, k))
    entries = texts.mapInArrow(trimmed(_entry_mapper(k, num, den, common)), "sig long, uid long")
    led = entries.selectExpr("uid", "min(uid) over (partition by sig) as lead").where("uid != lead").distinct()
    members = connected_components(led, "uid", "lead", scratch)

    cls = F.concat_ws(":", "uid", "chk").alias("cls")
    classes = scratch.save(
        facts.where("uid is not null").groupBy("uid", "chk").agg(F.min("id").alias("first_id"), F.min("tk").alias("tk"), F.max("n_shingles").alias("n"),
        F.count("*").alias("copies"))
    )
    blocks = scratch.save(_row_blocks(members.withColumnRenamed("node", "uid").join(classes.select("uid", "chk", "tk", "n"), "uid"), scratch))
    # the places travel with the hash of the text, so rows of the matrix are shuffled once, to their tasks
    wanted = blocks.groupBy("tk").agg(F.collect_list(F.struct("uid", "chk", "task", "part")).alias("places"))
    if blocks.count() <= BROADCAST_ROWS:  # else a shuffled join on the text's hash
        wanted = F.broadcast(wanted)
    cells = source.select(F.xxhash64("text").alias("tk"), "text").where("text is not null").join(wanted, "tk").select("text", "places").mapInArrow(trimmed(_row_mapper(k)),
        "cls string, cells binary, task string, part string")
    links = cells.groupBy("task").applyInPandas(_product(num, den), "a string, b string")
    linked = connected_components(links, "a", "b", scratch).withColumnRenamed("node", "cls")
    labelled = scratch.save(classes.select("uid", "chk", cls, "first_id").join(linked, "cls").drop("cls"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    final = labelled.join(least, "component").select("uid", "chk", F.col("component").alias("group_id"), "component_id")
    every = scratch.save(
        classes.select("uid", "chk", "first_id", "copies").join(final, ["uid", "chk"], "left")
        .select("uid", "chk", "copies", "group_id", F.coalesce("component_id", "first_id").alias("component_id"))
    )
    # A class of many copies would meet in one task of the closing join. At most HOT_CLASSES can hold
    # this many rows each, so those are broadcast and only the rest is dealt by class.
    many = F.col("copies") >= max(HOT_LEAST, facts.count() // HOT_CLASSES)
    every = every if keys else every.drop("group_id")
    hot, rest = F.broadcast(every.where(many).drop("copies")), every.where(~many).drop("copies")
    told = facts.join(hot, ["uid", "chk"]).unionByName(facts.join(hot.select("uid", "chk"), ["uid", "chk"], "left_anti").join(rest, ["uid", "chk"], "left"))
    none = F.col("uid").isNull()
    own = F.when(~none, F.concat_ws(":", "uid", "chk"))
    return told.select(
        F.col("id").alias(id_col), "n_shingles", own.alias("class_id"), F.when(none, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        *([F.coalesce("group_id", own).alias("group_id"), F.col("tk").alias("text_key")] if keys else []),
    )


def _row_blocks(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, chk, tk, part, task): the row blocks whose product is taken, and the task that takes it.

    A component that fits is one part, and parts are dealt to tasks by hash, about a block's rows and
    cells each. A larger one is cut by size interval and hash; each compatible pair of its sub-blocks
    is a part and a task of its own.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.5)) + 1e-9).cast("int")
    rows = scratch.save(members.select("uid", "chk", "tk", "n", "component", level.alias("level")))
    per_level = scratch.save(rows.groupBy("component", "level").agg(F.count("*").alias("rows"), F.sum("n").alias("cells")))
    totals = per_level.groupBy("component").agg(F.sum("rows").alias("all_rows"), F.sum("cells").alias("all_cells"))
    fits = (F.col("all_rows") <= BLOCK_ROWS) & (F.col("all_cells") <= BLOCK_CELLS)
    n_rows, n_cells = totals.where(fits).agg(F.coalesce(F.sum("all_rows"), F.lit(0)), F.coalesce(F.sum("all_cells"), F.lit(0))).first()
    tasks = max(1, -(-int(n_rows) // BLOCK_ROWS), -(-int(n_cells) // BLOCK_CELLS))
    # A partner's size is within den/num <= 1.5 of n, so it is in the same or the next interval.
    plan = per_level.join(totals.where(~fits).select("component"), "component").select(
        "component", "level", F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("cells") / BLOCK_CELLS)).cast("int").alias("subs")
    )
    near = plan.select("component", (F.col("level") + 1).alias("level"), F.col("subs").alias("below"))
    far = plan.select("component", (F.col("level") - 1).alias("level"), F.col("subs").alias("above"))
    plan = scratch.save(plan.join(near, ["component", "level"], "left").join(far, ["component", "level"], "left"))
    # Components that do not fit are few, a row in BLOCK_ROWS at most or a cell in BLOCK_CELLS, and hold the hot keys.
    few = F.broadcast if plan.count() <= BROADCAST_ROWS else lambda df: df
    small = rows.join(few(plan.select("component").distinct()), "component", "left_anti")
    small = small.select("uid", "chk", "tk", F.concat_ws(":", "component").alias("part"), F.pmod(F.xxhash64("component"), F.lit(tasks)).cast("string").alias("task"))
    sub = F.pmod(F.xxhash64("uid", "chk", F.lit(7)), F.col("subs")).cast("int")
    large = rows.join(few(plan), ["component", "level"]).withColumn("sub", sub)
    same = F.transform(F.sequence(F.lit(0), F.col("subs") - 1),
        lambda j: F.concat_ws(":", "component", "level", F.least(j, F.col("sub")).cast("string"), F.lit("="), F.greatest(j, F.col("sub")).cast("string")))
    up = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1),
        lambda j: F.concat_ws(":", "component", "level", F.col("sub").cast("string"), F.lit("<"), j.cast("string"))))
    down = F.when(F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1),
        lambda j: F.concat_ws(":", "component", (F.col("level") - 1).cast("string"), j.cast("string"), F.lit("<"), F.col("sub").cast("string"))))
    empty = F.array().cast("array<string>")
    large = large.select("uid", "chk", "tk", F.explode(F.concat(same, F.coalesce(up, empty), F.coalesce(down, empty))).alias("part"))
    return small.unionByName(large.withColumn("task", F.col("part")))


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of ``docs`` with, of every group of linked documents, only the one of the least id
    (null ids last, then the least text hash); its repeated rows stay once. Rows with an empty set
    are groups of their own. Columns are those of ``docs``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "one-per-group")
    groups = scratch.save(jaccard_components(docs, id_col, text_col, k, num, den, keys=True, scratch=scratch))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_key").alias("tk"))
    first = groups.where("group_id is not null").groupBy("group_id").agg(F.min(order).alias("pick")).select("pick.id", "pick.tk")
    lone = groups.where("group_id is null").select(F.col(id_col).alias("id"), F.col("text_key").alias("tk")).distinct()
    times = groups.groupBy(F.col(id_col).alias("id"), F.col("text_key").alias("tk")).agg((F.count("*") > 1).alias("repeated"))
    keep = scratch.save(
        first.unionByName(lone).alias("k").join(times.alias("t"), F.col("k.id").eqNullSafe(F.col("t.id")) & (F.col("k.tk") == F.col("t.tk"))).select("k.id", "k.tk", "t.repeated")
    )
    if keep.count() <= BROADCAST_ROWS:  # else a shuffled join
        keep = F.broadcast(keep)
    own = docs.columns
    moved = docs.select(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(own)), F.col(f"`{id_col}`").alias("d_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("d_tk"))
    held = moved.join(keep, F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_tk") == F.col("tk")))
    once = held.where("not repeated").unionByName(held.where("repeated").dropDuplicates(["d_id", "d_tk"]))
    return once.select(*(F.col(f"o{i}").alias(c) for i, c in enumerate(own)))
