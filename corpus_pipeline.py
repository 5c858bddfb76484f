"""Training-data pipeline over ``documents``: what stays, what is masked, and its tokens.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.byte_bpe import encode_documents
from weftgraph.llm.decontaminate import contaminated, decontaminate
from weftgraph.llm.ngram_join import one_per_group
from weftgraph.llm.pii import find_pii, redact
from weftgraph.llm.quality import judge
from weftgraph.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or an adaptive fence reject go."""
    return judge(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents (five words, similarity 0.8 or more) the one with the least doc_id stays."""
    return one_per_group(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose hit words reach the coverage limit go; from others the hit spans are cut."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate(docs, items, prefix="dc_", clean=True).where(~contaminated(F.col("dc_n_hit"), F.col("dc_n_words")))
    hit = F.col("dc_n_hit") > 0
    cut = {"text": F.when(hit, F.col("dc_clean_text")).otherwise(F.col("text")), "n_chars": F.when(hit, F.length("dc_clean_text").cast("long")).otherwise(F.col("n_chars"))}
    return out.select(*(cut[c].alias(c) if c in cut else F.col(c) for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; n_chars follows."""
    own = [c for c in docs.columns if c not in ("text", "n_chars")]
    found = find_pii(docs, keep=True)
    out = found.select(*own, redact(F.col("text"), F.concat("base", "added")).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN).select("doc_id", "lang", "source", "n_tokens", "token_ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared scratch folder and reread."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot say the sketches, the span classifier or the tokens.
ORACLE_SQL = None
