"""Revisions: differences of snapshots, churn, logs, set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOLATILE = ("last_updated", "fingerprint")


def fields_of(docs: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, field, value as JSON) of the fields that are set; volatile ones are left out."""
    some = [f for f in fields if f not in VOLATILE]
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.when(F.col(f).isNotNull(), F.to_json(F.struct(F.col(f).alias("v")))).alias("value")) for f in some)))
    return docs.select(*key, each.alias("x")).select(*key, "x.field", "x.value").where("value IS NOT NULL")


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, field, kind, before, after): added, removed or modified, by a full join on (key, field)."""
    on = [*key, "field"]
    j = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), on, "full")
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").otherwise("modified")
    return j.where(~F.col("before").eqNullSafe(F.col("after"))).select(*on, kind.alias("kind"), "before", "after")


def classify(prior: DataFrame, now: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged of two tables (key, mark)."""
    p, n = prior.select(key, F.col(mark).alias("p"), F.lit(True).alias("was")), now.select(key, F.col(mark).alias("n"), F.lit(True).alias("is"))
    j = p.join(n, key, "full")
    return j.select(key, F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("p").eqNullSafe(F.col("n")), "unchanged").otherwise("changed").alias("change"))


def paths_of(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def compare_sets(declared: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """(key, finding): phantom where only declared, unlisted where only actual."""
    d, a = declared.select(*key).distinct().withColumn("d", F.lit(True)), actual.select(*key).distinct().withColumn("a", F.lit(True))
    return d.join(a, key, "full").where("d IS NULL OR a IS NULL").select(*key, F.when(F.col("a").isNull(), "phantom").otherwise("unlisted").alias("finding"))


def transitions(commits: DataFrame, key: str = "scope") -> DataFrame:
    """(key, transitions): how often a non-null fingerprint differs from the non-null one before, oldest first."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    walked = commits.where("fingerprint IS NOT NULL").withColumn("before", F.lag("fingerprint").over(w))
    return walked.groupBy(key).agg(F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("fingerprint"))).alias("transitions"))


def hotspots(commits: DataFrame, by_transitions: bool = False, limit: int = 20, key: str = "scope") -> DataFrame:
    """The scopes with the most commits (or transitions), each with its last commit."""
    per = commits.groupBy(key).agg(F.count("*").alias("commits"), F.max_by("sha", F.struct("ts", "seq")).alias("last_sha"), F.max("ts").alias("last_ts"))
    metric = "commits"
    if by_transitions:
        per, metric = per.join(transitions(commits, key), key, "left").na.fill(0, ["transitions"]), "transitions"
    return per.orderBy(F.desc(metric), key).limit(limit)


def timeline(commits: DataFrame, scope, limit: int = 50) -> DataFrame:
    """The newest commits of a scope."""
    return commits.where(F.col("scope") == scope).orderBy(F.desc("ts"), F.desc("seq")).limit(limit)


def fix_commits(commits: DataFrame, low: int = 1, high: int = 5, limit: int = 20, words: str = r"(?i)\b(fix|bug)") -> DataFrame:
    """Commits(message, files array) whose message has the words and which touch few files."""
    return commits.where(F.col("message").rlike(words) & F.size("files").between(low, high)).orderBy(F.desc("ts"), "sha").limit(limit)


def last_of(rows: DataFrame, key: list[str], value: str, order: Column) -> DataFrame:
    return rows.groupBy(*key).agg(F.max_by(value, order).alias(value))
