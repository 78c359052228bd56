"""Corpus pipeline: raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents, the
last one token ids. Rows are matched to decisions by doc_id and a hash of the text, so rows without a doc_id, rows that
share one, and further columns of any name pass through. A null text is an empty one: the base rule rejects it. An empty
table stays empty at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelark.llm import bpe, common, exact, mixing, near, quality


def _only(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, rk) is decided; packed, so that no name can clash."""
    packed = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("long").alias("_id"), common.row_key().alias("_rk"))
    d = decided.select(F.col("doc_id").alias("_d"), F.col("rk").alias("_k"))
    return packed.join(d, F.col("_rk").eqNullSafe(F.col("_k")) & F.col("_id").eqNullSafe(F.col("_d")), "left_semi").select("_row.*")


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.accepted(docs)


def exact_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays; rows that are the same in doc_id and text become one."""
    stay = common.written(exact.exact_dedup(docs).where("kept").select("doc_id", "rk", "text_sha256"), "kept")
    one = stay.groupBy("doc_id", "text_sha256").agg(F.min("rk").alias("rk"), F.count("*").alias("n"))
    out = _only(docs, one)
    if one.where("n > 1").limit(1).count():
        packed = out.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), common.row_key().alias("key"))
        out = packed.groupBy("id", "key").agg(F.first("row").alias("row")).select("row.*")
    return out


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return _only(docs, near.near_duplicates(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by probabilities raked to source, language and topic targets."""
    return mixing.sampled(docs)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    return bpe.encode(docs, bpe.rank_file())


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mix_sources), ("byte-level BPE", encode)]

#: Not expressible in SQL (byte-level BPE); tests hold it against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
