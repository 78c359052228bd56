"""Totals and texts for reports: one-row aggregates, packs as Markdown or JSON, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GENERATED = r"(^|/)(dist|build|out|generated|gen|__generated__|coverage|vendor)/|\.(min|bundle|generated|g|pb)\.[A-Za-z]+\z|_pb2\.py\z"
TEST_DIR = r"(^|/)(__tests__|tests?|specs?|fixtures?)(/|\z)"


def is_generated(path: Column) -> Column:
    return path.rlike(GENERATED)


def in_test_dir(path: Column) -> Column:
    return path.rlike(TEST_DIR)


def view_totals(scopes: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: scopes by state and the number of violations."""
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    one = scopes.agg(F.count("*").alias("scopes"), n("fresh"), n("cosmetic_stale"), n("semantic_stale"), n("missing"), F.count_if(F.col("state").isNull()).alias("unknown"))
    return one.crossJoin(F.broadcast(violations.agg(F.count("*").alias("violations"))))


def generation_metrics(summaries: DataFrame) -> DataFrame:
    """(source, n, share in per cent) of where summaries came from."""
    total = summaries.agg(F.count("*").alias("total"))
    return summaries.groupBy("source").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("source", "n", (F.floor(F.col("n") * 1000 / F.col("total") + 0.5) / 10).alias("share"))


def child_states(dirs: DataFrame, states: DataFrame) -> DataFrame:
    """(dir, name, state) of each directory's children."""
    s = states.select(F.col("scope").alias("_s"), "state")
    return dirs.where("parent IS NOT NULL").join(s, F.col("dir") == F.col("_s"), "left").select(F.col("parent").alias("dir"), F.element_at(F.split("dir", "/"), -1).alias("name"), F.coalesce("state", F.lit("missing")).alias("state"))


def pack_markdown(pack: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: the pack's scopes in order, as one text. A pack is bounded by its budget."""
    rows = pack.join(texts.select("scope", "text"), "scope")
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), "\n\n").alias("markdown"))


def pack_json(pack: DataFrame) -> DataFrame:
    return pack.agg(F.to_json(F.struct(F.max("used").alias("used"), F.transform(F.array_sort(F.collect_list(F.struct("position", "scope"))), lambda x: x["scope"]).alias("scopes"))).alias("json"))


def provenance(spark, **facts: str) -> DataFrame:
    """One row of what a result was made from."""
    return spark.range(1).select(F.current_timestamp().alias("made_at"), *(F.lit(v).alias(k) for k, v in sorted(facts.items())))
