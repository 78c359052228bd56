"""Tokens, coverage, freshness and quality of a project's scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as k
from ..functions import text as t


def dir_tokens(files: DataFrame) -> DataFrame:
    """(dir, files, bytes, tokens)."""
    return files.groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.ceil(F.sum("size") / k.BYTES_PER_TOKEN).alias("tokens"))


def extension_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy(t.extension(F.col("file")).alias("ext")).agg(F.count("*").alias("files"))


def min_token_filter(dirs: DataFrame, threshold: int = k.MIN_TOKENS) -> DataFrame:
    """Directories to keep of dirs(dir, tokens): the root, those at the threshold, and all their ancestors; 0 keeps all."""
    if threshold <= 0:
        return dirs
    up = dirs.where(F.col("tokens") >= threshold).select(F.explode(t.ancestors(F.col("dir"))).alias("dir")).distinct()
    return dirs.join(up, "dir", "left_semi").unionByName(dirs.where("dir = '.'").join(up, "dir", "left_anti"))


def token_economics(scopes: DataFrame) -> DataFrame:
    """One row of scopes(source_tokens, context_tokens or null): totals, tracked totals, saved, reduction in per cent, ratio."""
    tracked = F.col("context_tokens").isNotNull()
    src, ctx = F.coalesce(F.sum(F.when(tracked, F.col("source_tokens"))), F.lit(0)), F.coalesce(F.sum("context_tokens"), F.lit(0))
    return scopes.agg(
        F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("total_tokens"), src.alias("tracked_tokens"), ctx.alias("context_tokens"), (src - ctx).alias("saved_tokens"),
        F.when(src == 0, 0.0).otherwise(t.round_half_up((src - ctx) * 100 / src)).alias("reduction_pct"), F.when(ctx == 0, 0.0).otherwise(t.round_half_up(src / ctx)).alias("ratio"),
    )


def reduction_percentiles(scopes: DataFrame) -> DataFrame:
    """Nearest-rank p50 and p95 of the reduction by scope; null with fewer than two."""
    r = scopes.where("source_tokens > 0 AND context_tokens IS NOT NULL").select(((F.col("source_tokens") - F.col("context_tokens")) * 100 / F.col("source_tokens")).alias("r"))
    return r.agg(*(F.when(F.count("*") >= 2, t.round_half_up(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY r)"))).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))))


def freshness_summary(scopes: DataFrame) -> DataFrame:
    """One row of scopes(state, tokens): counts by state, the fresh rate to 4 decimals, tokens saved by fresh ones, and the
    tokens that stale ones cost."""
    n = lambda s: F.count_if(F.col("state") == s)
    stale = F.col("state").isin("cosmetic_stale", "semantic_stale")
    return scopes.agg(
        F.count("*").alias("total"), F.count_if(F.col("state") != "missing").alias("tracked"), n("fresh").alias("fresh"), F.count_if(stale).alias("stale"), n("missing").alias("missing"),
        t.round_half_up(t.share(n("fresh"), F.count("*")) * 1000).alias("fresh_permille"), F.coalesce(F.sum(F.when(F.col("state") == "fresh", F.col("tokens"))), F.lit(0)).alias("fresh_tokens"),
        F.coalesce(F.sum(F.when(stale, F.col("tokens"))), F.lit(0)).alias("stale_tokens"),
    )


def signal_score(*facts: Column) -> Column:
    """How many of the facts hold, 0 to 5."""
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in facts[1:]), F.coalesce(facts[0], F.lit(False)).cast("int"))


def quality(scopes: DataFrame, facts: dict[str, Column]) -> DataFrame:
    """Rates in per cent of each fact over scopes, and the average signal."""
    n = F.count("*")
    rates = [t.round_half_up(t.share(F.count_if(f), n) * 100).alias(f"{name}_pct") for name, f in facts.items()]
    return scopes.agg(n.alias("scopes"), *rates, t.round_half_up(F.coalesce(F.avg(signal_score(*facts.values())), F.lit(0.0))).alias("signal"))


def context_lag(scopes: DataFrame) -> DataFrame:
    """Of scopes(last_updated, newest): how many lag, and the nearest-rank median of the hours, to one decimal."""
    hours = F.timestamp_diff("SECOND", F.col("last_updated"), F.col("newest")) / 3600
    late = scopes.select(hours.alias("h")).where("h > 0")
    return late.agg(F.count("*").alias("lagging"), t.round_half_up(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY h)")).alias("median_hours"))


def scope_rows(dirs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Per scope: source and context tokens, what is saved, and whether it is tracked."""
    c = contexts.select(F.col("scope").alias("dir"), t.estimate_tokens(F.col("context_chars")).alias("context_tokens"))
    return dirs.join(c, "dir", "left").select("dir", F.col("tokens").alias("source_tokens"), "context_tokens", F.when(F.col("context_tokens").isNotNull(), F.greatest(F.col("tokens") - F.col("context_tokens"), F.lit(0))).otherwise(0).alias("saved"), F.col("context_tokens").isNotNull().alias("tracked"))
