"""URL rules by hashed expressions, in built-in functions only.

Every distinct URL expands into the host suffixes and path prefixes that a rule could name (only
label counts and path lengths that occur among the rules). Expressions meet the rules in an
equi-join on the first bytes of their digest; full digests confirm; the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rules of the contract as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per row of ``pages``: (id, host, path, rule, verdict).

    ``rules`` has (verdict, host, path); a rule fits its host and all subdomains where the URL's path
    starts with the rule's. Of several the longest (host and path), then the longer host, then
    ``block``, then the first in order wins. No rule: rule null and the default verdict. Null URLs
    and those without :// have an empty host and path, which no rule fits. Null ids, repeated rows
    and repeated rules are fine; other columns of ``pages`` are ignored.
    """
    rules = rules.where("host is not null and path is not null and host <> ''").select("verdict", F.translate("host", _UPPER, _LOWER).alias("host"), "path").distinct()
    shape = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("n"))
    # bounded: one number per label count and per path length that occurs
    sizes = shape.agg(F.collect_set("labels").alias("labels"), F.collect_set("n").alias("n")).first()
    full = lambda h, p: F.sha2(F.concat(h, F.lit("|"), p), 256)
    keyed = rules.select(
        F.col("verdict").alias("r_verdict"), F.concat("host", "path").alias("r_rule"), full(F.col("host"), F.col("path")).alias("r_digest"),
        F.length("host").alias("r_host_n"), (F.length("host") + F.length("path")).alias("r_n"),
    ).withColumn("key", F.substr("r_digest", F.lit(1), F.lit(PREFIX_HEX)))
    urls = pages.select(F.col(url_col).alias("url")).where("url is not null").distinct().select("url", host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path")).where("host <> ''")
    labels = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*(F.when(F.size(labels) >= k, F.concat_ws(".", F.slice(labels, -k, k))) for k in sorted(sizes["labels"]))))
    prefixes = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substr("path", F.lit(1), F.lit(n))) for n in sorted(sizes["n"]))))
    if not sizes["labels"]:
        best = urls.limit(0).select("url", F.lit(None).cast("struct<n:int,host_n:int,block:boolean,neg:string,rule:string,verdict:string>").alias("best"))
    else:
        expressions = urls.select("url", F.explode(suffixes).alias("h"), prefixes.alias("ps")).select("url", "h", F.explode("ps").alias("p")).select("url",
            full(F.col("h"), F.col("p")).alias("digest"))
        expressions = expressions.withColumn("key", F.substr("digest", F.lit(1), F.lit(PREFIX_HEX)))
        hit = expressions.join(keyed, "key").where("digest = r_digest")
        order = F.struct(F.col("r_n").alias("n"), F.col("r_host_n").alias("host_n"), (F.col("r_verdict") == "block").alias("block"), F.col("r_rule").alias("rule"),
            F.col("r_verdict").alias("verdict"))
        best = hit.groupBy("url").agg(F.max(order).alias("best"))
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).join(best, "url", "left")
    return out.select(
        F.col("id").alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
