"""The thin contract queries of the language-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(doc_id: str, n: int):
    """Remainder of the CRC-32 of the id as text; null ids have none."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.sharding import shard_by_bytes

    out = shard_by_bytes(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.toxicity import score_documents, train, training_sample

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False))
    labels = _table(spark, sf_dir, "labels").where(~held_out)
    model = train(training_sample(docs, labels))
    return score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.decontaminate import contaminated, decontaminate, items_sha256

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, _table(spark, sf_dir, "benchmark"), clean=False)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_sha256(F.col("items")).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.secrets import digests, scan_secrets

    return digests(scan_secrets(_table(spark, sf_dir, "documents")), "doc_id", ["n_assign", "n_access", "n_hex"], "linked")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.url_filter import RULES, filter_urls

    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return filter_urls(_table(spark, sf_dir, "pages"), rules)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.langid import identify, train, training_sample

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_fold("doc_id", 3) == 1, F.lit(False))
    model = train(training_sample(docs.where(~held_out), "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model, runs=False)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.pii import find_pii
    from weftgraph.llm.secrets import digests

    found = find_pii(_table(spark, sf_dir, "documents"))
    return digests(found, "doc_id", ["n_email", "n_ip", "n_card", "n_phone"], "added")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.quality import judge

    out = judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.llm.byte_bpe import encode_documents

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(docs, path, public_tokenizers.PATTERN, ids=False, digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_secret_scan": op5_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op7_language_id": op7_language_id,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS sh
  FROM w),
g AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS ov
  FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM o WHERE 100 * ov >= 85 * (na + nb - ov)
  UNION ALL SELECT b, a FROM o WHERE 100 * ov >= 85 * (na + nb - ov)),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
""",
    "op4_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[p : p + least(13, len(ws)) - 1], ' ') AS win
  FROM i, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS t(p) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, array_to_string(ws[p : p + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, greatest(0, len(ws) - n + 1) + 1)) AS t(p)),
hit AS (SELECT DISTINCT doc_id, item_id, dw.n, p FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS t(q) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_url_filter": r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT u.*, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
""",
}
