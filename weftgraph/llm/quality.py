"""Quality rules with adaptive thresholds, in built-in functions only.

Fixed base rules reject outright. On top, every metric has an upper fence per language and source:
the third quartile plus ``SPREADS`` times the distance of the quartiles. Quartiles come from KLL
sketches, which merge: a source with few documents uses the merged sketch of its language, a
language with few that of all. No fence has a fixed floor or cutoff. Where the quartiles of a group
coincide, its sketch knows no scale for that metric and the next wider sketch decides; a metric
without a scale anywhere judges nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.scratch import Scratch

_WS = " \t\n\x0b\x0c\r"
_WS_RE = r"[\x20\x09-\x0D]+"
#: The metrics under a fence: share of marks among the characters of words, length of words, share of repeated lines.
FENCES = ("mark_share", "chars_per_word", "dup_line_share")
SPREADS = 6.0
SKETCH_K = 400
#: A group with fewer documents takes the thresholds of the next wider one.
LEAST_GROUP = 50
#: Groups whose fences are broadcast at most, some 100 bytes each; more are joined by a shuffle.
BROADCAST_GROUPS = 400_000
MIN_WORDS, REPEAT_NUM, REPEAT_DEN = 20, 30, 100
WINDOW = 8


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(_WS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _WS_RE, -1))


def _cheap(docs: DataFrame, text_col: str) -> DataFrame:
    """The metrics that the fences need."""
    out = docs.withColumn("w_text", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumn("w_words", _words(F.col("w_text")))
    out = out.withColumn("w_lines", F.filter(F.split("w_text", "\n", -1), lambda x: F.btrim(x, F.lit(_WS)) != ""))
    return (
        out.withColumn("n_words", F.size("w_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("w_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count("w_text", F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("n_lines", F.size("w_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("w_lines") - F.size(F.array_distinct("w_lines"))).cast("long"))
        .withColumn("w_marks", F.length(F.regexp_replace("w_text", r"[\p{L}\p{M}\p{N}\s]++", "")))
        .withColumn("mark_share", F.when(F.col("word_chars") > 0, F.col("w_marks") / F.col("word_chars")).otherwise(F.lit(0.0)))
        .withColumn("chars_per_word", F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(F.lit(0.0)))
        .withColumn("dup_line_share", F.when(F.col("n_lines") > 0, F.col("n_dup_lines") / F.col("n_lines")).otherwise(F.lit(0.0)))
    )


def _repeats(df: DataFrame) -> DataFrame:
    """n_repeat_words: words in windows of ``WINDOW`` words that occur twice or more in the text.

    Hashes of the windows are compared first; only texts with two equal ones sort them. Windows
    that recur are then in order of position, and each adds the words that the next leaves over.
    """
    n = F.size("w_words")
    df = df.withColumn("w_hash", F.transform("w_words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(F.col("w_hash"), i + k) for k in range(WINDOW))))
    df = df.withColumn("w_win", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    twice = F.size(F.array_distinct("w_win")) < F.size("w_win")
    kind = "array<struct<h:bigint,i:int>>"
    df = df.withColumn("w_sorted", F.when(twice, F.array_sort(F.transform("w_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast(kind)))
    s = F.col("w_sorted")
    same = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
    marks = F.transform(s, lambda e, j: F.when(F.when(j > 0, same(e, j - 1)).otherwise(F.lit(False)) | same(e, j + 1), e["i"]).otherwise(F.lit(-1)))
    df = df.withColumn("w_at", F.sort_array(F.filter(marks, lambda x: x >= 0)))
    gaps = F.transform("w_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("w_at"), j + 1) - p, F.lit(WINDOW))))
    return df.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long"))


def fences(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spreads: float = SPREADS, k: int = SKETCH_K, least: int = LEAST_GROUP,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(f_lang, f_source, one upper fence per metric) for every language and source of ``docs``.

    Texts of fewer than ``MIN_WORDS`` words, which the base rules reject, are not sketched; a group of
    only these has no row. Null languages and sources are groups of their own. A fence is null where no
    sketch, however wide, has quartiles apart.
    """
    scratch = scratch or Scratch(docs.sparkSession, "fences")
    m = _cheap(docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "text").where(F.col("n_words") >= MIN_WORDS)
    groups = scratch.save(m.groupBy("lang", "source").agg(F.count("*").alias("rows"), *(F.kll_sketch_agg_double(c, F.lit(k)).alias(c) for c in FENCES)))
    langs = scratch.save(groups.groupBy("lang").agg(F.sum("rows").alias("lang_rows"), *(F.kll_merge_agg_double(c, F.lit(k)).alias(f"l_{c}") for c in FENCES)))
    every = langs.agg(*(F.kll_merge_agg_double(f"l_{c}", F.lit(k)).alias(f"a_{c}") for c in FENCES))
    wide = langs.join(F.broadcast(every))  # one row of a fixed size
    g = groups.alias("g").join(wide.alias("w"), F.col("g.lang").eqNullSafe(F.col("w.lang")))

    def fence(sketch: Column, enough: Column) -> Column:
        lo, hi = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        return F.when(enough & (hi > lo), hi + spreads * (hi - lo))

    return g.select(F.col("g.lang").alias("f_lang"), F.col("g.source").alias("f_source"), *(
        F.coalesce(
            fence(F.col(f"g.{c}"), F.col("rows") >= least), fence(F.col(f"w.l_{c}"), F.col("lang_rows") >= least), fence(F.col(f"w.a_{c}"), F.lit(True))
        ).alias(f"fence_{c}") for c in FENCES
    ))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limits: DataFrame | None = None) -> DataFrame:
    """All rows and columns of ``docs`` plus n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), base_failed and kept (boolean).

    ``limits`` defaults to ``fences(docs)``; a group without limits is judged by the base rules
    alone. Null and empty texts have no words and fail the base rules. Repeated rows are kept;
    columns of ``docs`` that clash with the new names are replaced.
    """
    limits = fences(docs, text_col, lang_col, source_col) if limits is None else limits
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    own = [c for c in docs.columns if c not in new]
    # own columns travel under positions, so none can clash with the helper columns
    moved = docs.select(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(own)), F.col(f"`{text_col}`").alias("t"), F.col(f"`{lang_col}`").alias("k_lang"),
        F.col(f"`{source_col}`").alias("k_source"))
    m = _repeats(_cheap(moved, "t"))
    # A generator is a barrier: a later filter on the verdict is not pushed below it, where it would
    # compute the metrics again once for every mention.
    m = m.select(*(f"o{i}" for i in range(len(own))), "k_lang", "k_source", F.inline(F.array(F.struct(*new[:-2], *FENCES))))
    m = m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (REPEAT_DEN * F.col("n_repeat_words") > REPEAT_NUM * F.col("n_words")))
    # known to be small, the fences go to the texts, not the texts to the fences
    near = F.broadcast(limits) if limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else limits
    j = m.join(near, F.col("k_lang").eqNullSafe(F.col("f_lang")) & F.col("k_source").eqNullSafe(F.col("f_source")), "left")
    over = F.lit(False)
    for c in FENCES:
        over = over | F.coalesce(F.col(c) > F.col(f"fence_{c}"), F.lit(False))
    return j.select(*(F.col(f"o{i}").alias(c) for i, c in enumerate(own)), *new[:-1], (~F.col("base_failed") & ~over).alias("kept"))
