"""Secret scan with multipart credential linking, in built-in functions only.

Three base kinds stand by themselves. A weak candidate (a long mixed token) proves nothing alone;
it is reported as ``linked`` when a complementary part, an access identifier (key id, user name, mail
address) or an endpoint (URL, IP address), lies within its scope: ``SCOPE`` code points of the same
text. One scan finds all kinds; the few texts that hold both a weak candidate and a part are saved.
Parts and candidates meet in an interval join: identifiers and endpoints are dealt to every cell their
scope touches, candidates to the cells of their start and their end, equal cells join, and the true
distance decides. No candidate overlaps a part, so its start (of a part before it) or its end (of one
after it) lies in the scope, however long it is. Spans of a kind do not overlap, so a cell holds a
bounded number of either side however many a text has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.spans import find_spans, kept, listed, outside, tagged
from weftgraph.scratch import Scratch

#: The base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?:\G|(?<![0-9a-f]))[0-9a-f]{24,}+"

ENDPOINT = r"[a-z][a-z0-9+]{1,9}://[^\x20\x09-\x0D\"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"
IDENTITY = r"""(?i:user(?:name)?|login|client_id|account|access_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}\.[A-Za-z0-9.-]{1,190}"""
WEAK = r"(?:\G|(?<![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{20,}+"
SCOPE = 200


def _mixed(token: Column) -> Column:
    """A weak candidate mixes digits with letters of either case."""
    return token.rlike("[0-9]") & token.rlike("[a-z]") & token.rlike("[A-Z]")


def _base(text: Column) -> dict[str, Column]:
    return {
        "assign": kept(find_spans(text, ASSIGN, text.rlike(r"(?i:passw|secret|token|api_?key)")), lambda h: F.length(F.regexp_extract(h, ASSIGN_VALUE, 1)) >= 6),
        "access": find_spans(text, ACCESS, text.contains("AKIA")),
        "hex": find_spans(text, HEX, text.rlike(HEX)),
    }


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: (id, n_assign, n_access, n_hex long, base array, linked array).

    Both arrays hold struct<start,rank,end,kind>, start and end in code points, end exclusive; base has
    the kinds assign, access and hex, linked the weak candidates with a complementary part in scope.
    Null and empty texts have no spans. A null id and repeated rows are fine: rows of equal id and text
    get equal results. Other columns of ``docs`` are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "secrets")
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    # a cheap look: the text holds a weak candidate and something that could complement it
    could = text.rlike(WEAK) & (text.contains("://") | text.contains("AKIA") | text.rlike(IDENTITY) | text.rlike(r"[0-9]\.[0-9]{1,3}\."))
    found = rows.select("id", "tk", "text", *(c.alias(k) for k, c in _base(text).items()), F.coalesce(could, F.lit(False)).alias("could"))
    mine = F.when(F.col("could"), text)
    found = found.select(
        "id", "tk", "assign", "access", "hex", kept(find_spans(mine, WEAK, F.col("could")), _mixed).alias("weak"),
        find_spans(mine, IDENTITY, F.col("could")).alias("identity"), find_spans(mine, ENDPOINT, F.col("could")).alias("endpoint"),
    )
    base = F.concat(tagged(F.col("assign"), 0, "assign"), tagged(F.col("access"), 1, "access"), tagged(F.col("hex"), 2, "hex"))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    parts = F.concat(*(bare(F.col(k)) for k in ("access", "identity", "endpoint")))
    both = (F.size("weak") > 0) & (F.size("access") + F.size("identity") + F.size("endpoint") > 0)
    known = F.concat("assign", "access", "hex", "endpoint", "identity")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    found = scratch.save(found.select(
        "id", "tk", *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")), base.alias("base"),
        F.when(both, bare(outside(F.col("weak"), known))).otherwise(empty).alias("weak"), F.when(both, parts).otherwise(empty).alias("parts"),
    ))
    held = found.where((F.size("weak") > 0) & (F.size("parts") > 0))
    cell = lambda at: F.floor(at / scope).cast("int")
    parts = held.select("id", "tk", F.explode("parts").alias("p")).select(
        "id", "tk", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"),
        F.explode(F.sequence(cell(F.greatest(F.lit(0), F.col("p.start") - scope)), cell(F.col("p.end") + scope))).alias("cell"),
    ).dropDuplicates(["id", "tk", "cell", "p_start", "p_end"])
    weak = held.select("id", "tk", F.explode("weak").alias("w")).select(
        "id", "tk", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.explode(F.array_distinct(F.array(cell(F.col("w.start")), cell(F.col("w.end"))))).alias("cell"),
    ).distinct()
    meet = weak.alias("w").join(
        parts.alias("p"),
        F.col("w.id").eqNullSafe(F.col("p.id")) & (F.col("w.tk") == F.col("p.tk")) & (F.col("w.cell") == F.col("p.cell"))
        & (F.col("w.start") <= F.col("p.p_end") + scope) & (F.col("w.end") >= F.col("p.p_start") - scope),
        "left_semi",
    )
    linked = meet.groupBy(F.col("id").alias("l_id"), F.col("tk").alias("l_tk")).agg(F.collect_set(F.struct(F.col("start"), F.lit(3).alias("rank"), F.col("end"),
        F.lit("linked").alias("kind"))).alias("linked"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    out = lambda df, spans: df.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base", spans.alias("linked"))
    # texts with nothing to link need no join
    joined = held.join(linked, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("tk") == F.col("l_tk")), "left")
    return out(found.where(~((F.size("weak") > 0) & (F.size("parts") > 0))), none).unionByName(out(joined, F.coalesce("linked", none)))


def digests(found: DataFrame, id_col: str, counts: list[str], added: str) -> DataFrame:
    """The contract's columns of a span scan: counts, base_sha256 and the list of all spans."""
    return found.select(id_col, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", added)).alias("spans"))


__all__ = ["digests", "scan_secrets"]
