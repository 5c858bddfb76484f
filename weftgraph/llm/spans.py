"""Match positions with built-in functions only.

``regexp_extract_all`` gives the matches and ``split`` the pieces between them; running sums of
their lengths are the positions, in code points, end exclusive. The sums are taken in runs of a
fixed length, so many matches in one text cost little more than their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = 256
SPAN = "array<struct<start:int,end:int,hit:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; the body of a lambda would compute it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none_found() -> Column:
    return F.array().cast(SPAN)


def _running(values: Column) -> Column:
    """Exclusive running sums of an int array, with the total last."""
    return F.aggregate(
        values, F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("out")),
        lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"] + v)).alias("out")),
    )["out"]


def _starts(steps: Column) -> Column:
    """``_running`` in runs: the sums of the runs first, then those within each run. ``steps``: a let variable."""
    count = F.floor((F.size(steps) - 1) / _RUN).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), count)), lambda r: F.slice(steps, r * _RUN + 1, _RUN))

    def spread(v: Column) -> Column:
        return F.flatten(F.transform(v["runs"], lambda run, i: F.transform(F.slice(_running(run), 1, F.size(run)), lambda x: x + F.get(v["bases"], i))))

    totals = lambda r: _running(F.transform(r, lambda run: F.aggregate(run, F.lit(0), lambda s, v: s + v)))
    return let(runs, lambda r: let(F.struct(r.alias("runs"), totals(r).alias("bases")), spread))


def find_spans(text: Column, pattern: str, maybe: Column) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as ``SPAN``; none where ``maybe`` is not true.

    ``maybe`` is a cheap test that every text with a match passes. Null text: none.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("pieces"))

    def place(v: Column) -> Column:
        gaps = F.transform(v["hits"], lambda h, i: F.length(F.get(v["pieces"], i)))
        return let(F.struct(v["hits"].alias("hits"), gaps.alias("gaps")), lambda u: let(
            F.struct(u["hits"].alias("hits"), u["gaps"].alias("gaps"), let(F.transform(u["hits"], lambda h, i: F.get(u["gaps"], i) + F.length(h)), _starts).alias("starts")),
            lambda w: F.transform(w["hits"], lambda h, i: F.struct((F.get(w["starts"], i) + F.get(w["gaps"], i)).alias("start"),
            (F.get(w["starts"], i) + F.get(w["gaps"], i) + F.length(h)).alias("end"), h.alias("hit"))),
        ))

    return F.when(text.isNotNull() & maybe, let(found, place)).otherwise(none_found())


def kept(spans: Column, test: Callable[[Column], Column]) -> Column:
    """The spans whose matched string passes."""
    return F.filter(spans, lambda s: test(s["hit"]))


def tagged(spans: Column, rank: int, kind: str) -> Column:
    """array<struct<start,rank,end,kind>>: sorts by start, then as the kinds are listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of sorted tagged spans, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def in_runs(spans: Column) -> Column:
    """The spans by start, in runs of a fixed length with the reach of each run: what ``met`` looks at."""
    one = lambda run: F.struct(
        F.get(run, F.lit(0))["start"].alias("lo"), F.array_max(F.transform(run, lambda t: t["end"])).alias("hi"),
        F.transform(run, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))).alias("run"),
    )
    ordered = F.array_sort(F.transform(spans, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _RUN).cast("int")), lambda r: let(F.slice(v, r * _RUN + 1, _RUN), one))
    none = F.array().cast("array<struct<lo:int,hi:int,run:array<struct<start:int,end:int>>>>")
    return let(ordered, lambda v: F.when(F.size(v) > 0, cut(v)).otherwise(none))


def met(runs: Column, lo: Column, hi: Column) -> Column:
    """Whether [lo, hi) shares a place with a span of ``runs``; runs out of reach are passed over."""
    return F.exists(runs, lambda r: (r["lo"] < hi) & (lo < r["hi"]) & F.exists(r["run"], lambda t: (t["start"] < hi) & (lo < t["end"])))


def outside(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of ``taken``."""
    return let(in_runs(taken), lambda known: F.filter(spans, lambda s: ~met(known, s["start"], s["end"])))
