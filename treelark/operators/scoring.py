"""Scores of answers, their aggregates by arm and category, samples, and comparisons of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from .graph import kept

ABSTAIN = r"(?i)\b(?:unable to answer|not sure|no information|insufficient information|i don'?t know|don'?t have enough|cannot (?:answer|determine))\b"
PATH = r"(?:[\w.-]+/)+[\w.-]+|[\w-]+\.(?:" + "|".join(sorted("yml yaml tsx ts toml rs rb py md jsx json js java go cfg".split(), key=lambda x: (-len(x), x))) + ")"


def abstained(response: Column) -> Column:
    return response.rlike(ABSTAIN)


def list_coverage(response: Column, expected: Column) -> Column:
    """The share of expected strings in the response, whatever their case; 1 for none expected. Also top-k recall."""
    low = F.lower(response)
    hits = F.size(F.filter(expected, lambda e: F.contains(low, F.lower(e))))
    return F.when(F.size(expected) == 0, 1.0).otherwise(hits / F.size(expected))


def target_hit(response: Column, expected: Column) -> Column:
    low = F.lower(response)
    return F.exists(expected, lambda e: F.contains(low, F.lower(e))).cast("double")


def paths_in(response: Column) -> Column:
    return F.transform(F.regexp_extract_all(response, F.lit(PATH), F.lit(0)), F.lower)


def mrr(predicted: Column, expected: Column) -> Column:
    """1 over the rank of the first predicted string that is expected; 1 for none expected."""
    low = F.transform(expected, F.lower)
    ranks = F.filter(F.transform(predicted, lambda p, i: F.when(F.array_contains(low, F.lower(p)), i + 1)), lambda r: r.isNotNull())
    return F.when(F.size(expected) == 0, 1.0).otherwise(F.coalesce(1 / F.array_min(ranks), F.lit(0.0)))


def file_set_f1(predicted: Column, expected: Column) -> Column:
    """F1 of distinct predictions against the expected strings."""
    p, e = F.array_distinct(F.transform(predicted, F.lower)), F.array_distinct(F.transform(expected, F.lower))
    hit = F.size(F.array_intersect(p, e))
    precision, recall = hit / F.size(p), hit / F.size(expected)
    return F.when(F.size(expected) == 0, 1.0).when((F.size(p) == 0) | (hit == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))


def judged(text: Column) -> Column:
    """A judge's leading digit 0 to 3 as a third of it."""
    return F.coalesce(F.regexp_extract(F.trim(text), "^([0-3])", 1).try_cast("int") / 3, F.lit(0.0))


def _measures() -> list[Column]:
    tokens = F.col("input_tokens")
    right = F.count_if(F.col("score") >= 0.7)
    return [
        F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.avg(F.col("abstained").cast("double")).alias("abstention"),
        F.avg("latency_ms").alias("latency"), F.sum(tokens).alias("tokens"), F.when(right == 0, F.lit(float("inf"))).otherwise(F.sum(tokens) / right).alias("cost_per_correct"),
    ]


def arm_summary(results: DataFrame) -> DataFrame:
    """By arm of results(arm, category, score, abstained, latency_ms, input_tokens)."""
    return results.groupBy("arm").agg(*_measures())


def arm_matrix(results: DataFrame) -> DataFrame:
    """By arm and category, and by arm (category null), in one pass over the rows."""
    return results.groupingSets([["arm", "category"], ["arm"]], "arm", "category").agg(*_measures())


def arm_deltas(summary: DataFrame, reference: str = "context") -> DataFrame:
    """Each arm against the reference arm: score, tokens, cost (null unless both are finite). The reference is one row."""
    ref = summary.where(F.col("arm") == reference).select(F.col("mean").alias("m0"), F.col("tokens").alias("t0"), F.col("cost_per_correct").alias("c0"))
    finite = (F.col("cost_per_correct") != float("inf")) & (F.col("c0") != float("inf"))
    return summary.where(F.col("arm") != reference).crossJoin(F.broadcast(ref)).select("arm", (F.col("mean") - F.col("m0")).alias("score_delta"), (F.col("tokens") - F.col("t0")).alias("token_delta"), F.when(finite, F.col("cost_per_correct") - F.col("c0")).alias("cost_delta"))


def mean_of_means(results: DataFrame, repo: str = "repo") -> DataFrame:
    """(category, mean): means by repository first, then their mean."""
    return results.groupBy("category", repo).agg(F.avg("score").alias("m")).groupBy("category").agg(F.avg("m").alias("mean"), F.count("*").alias("repos"))


def precision_recall(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """One row from multisets (key, n): matched, expected, actual, precision and recall."""
    j = expected.groupBy(*key).agg(F.sum("n").alias("e")).join(actual.groupBy(*key).agg(F.sum("n").alias("a")), key, "full")
    e, a = F.coalesce("e", F.lit(0)), F.coalesce("a", F.lit(0))
    s = j.agg(F.coalesce(F.sum(F.least(e, a)), F.lit(0)).alias("matched"), F.coalesce(F.sum(e), F.lit(0)).alias("expected"), F.coalesce(F.sum(a), F.lit(0)).alias("actual"))
    return s.withColumns({"precision": F.when(F.col("actual") == 0, 1.0).otherwise(F.col("matched") / F.col("actual")), "recall": F.when(F.col("expected") == 0, 1.0).otherwise(F.col("matched") / F.col("expected"))})


def regressions(before: DataFrame, after: DataFrame, key: list[str], tolerance: float = 0.02) -> DataFrame:
    """Rows whose score fell by more than the tolerance, or that are gone."""
    a = after.select(*key, F.col("score").alias("after"))
    return before.select(*key, F.col("score").alias("before")).join(a, key, "left").where(F.col("after").isNull() | (F.col("before") - F.col("after") > tolerance))


PROFILES = {"anthropic": (3.7, 12), "google": (4.2, 8), "ollama": (3.8, 10), "openai": (3.9, 10)}
MODELS = ((r"claude|haiku|sonnet|opus", 3.6), (r"gpt|o\d|o1|o3|o4", 3.9), (r"gemini", 4.2), (r"llama|mistral|qwen|deepseek", 3.7))


def input_tokens(provider: Column, model: Column, system: Column, user: Column, message: int = 4) -> Column:
    """Estimated input tokens by provider and model."""
    p, m = F.lower(F.trim(provider)), F.lower(F.trim(model))
    chars, overhead = F.lit(4.0), F.lit(10)
    for name, (c, o) in PROFILES.items():
        chars, overhead = F.when(p == name, c).otherwise(chars), F.when(p == name, o).otherwise(overhead)
    for regex, c in reversed(MODELS):
        chars = F.when(m.rlike(regex), c).otherwise(chars)
    return F.ceil(F.length(system) / chars) + F.ceil(F.length(user) / chars) + overhead + 2 * message


def _draws(seed: int):
    state = seed
    while True:
        state = (state * 1664525 + 1013904223) & 0x7FFFFFFF
        yield state / 0x7FFFFFFF


def sample_positions(size: int, n: int, seed: int) -> list[int]:
    """Positions of a partial shuffle by a linear congruential generator: the last n of the shuffled list."""
    if size <= n:
        return list(range(size))
    moved: dict[int, int] = {}
    draw = _draws(seed)
    for i in range(size - 1, max(size - 1 - n, 0), -1):
        j = int(next(draw) * (i + 1))
        moved[i], moved[j] = moved.get(j, j), moved.get(i, i)
    return [moved.get(i, i) for i in range(size - n, size)]


def _numbered(rows: DataFrame, order: str, key: list[str]) -> DataFrame:
    """rows with _at, their position by order within key. The range partitions are written once, so that no later plan cuts
    them otherwise, and no single task orders all rows."""
    from pyspark.sql import Window

    spread = kept(rows.repartitionByRange(*key, order).sortWithinPartitions(*key, order).withColumn("_part", F.spark_partition_id()))
    sizes = spread.groupBy("_part", *key).agg(F.count("*").alias("c"))
    base = sizes.withColumn("_base", F.sum("c").over(Window.partitionBy(*key).orderBy("_part")) - F.col("c")).select("_part", *key, "_base")
    at = F.row_number().over(Window.partitionBy("_part", *key).orderBy(order)) - 1 + F.col("_base")
    return spread.join(base, ["_part", *key]).withColumn("_at", at).drop("_part", "_base")


def seeded_sample(rows: DataFrame, order: str, n: int, seed: int) -> DataFrame:
    """n rows by the seeded shuffle of all rows in order. Only the count and n positions are made on the driver."""
    picked = rows.sparkSession.createDataFrame([(p, i) for i, p in enumerate(sample_positions(rows.count(), n, seed))], T.StructType([T.StructField("_at", T.LongType()), T.StructField("position", T.IntegerType())]))
    return _numbered(rows, order, []).join(F.broadcast(picked), "_at").drop("_at")  # n rows


def stratified_limits(sizes: dict[str, int], limit: int) -> dict[str, int]:
    """Rows per category in proportion to its size, one at least, no more than there are."""
    total = sum(sizes.values())
    return {c: min(n, max(1, int(limit * n / total))) for c, n in sizes.items()} if total else {}


def stratified_sample(rows: DataFrame, category: str, order: str, limit: int, seed: int) -> DataFrame:
    """A seeded sample per category, all in one plan, topped up from the rest by the next seed."""
    sizes = {r[0]: r[1] for r in rows.groupBy(category).count().collect()}
    limits = stratified_limits(sizes, limit)
    schema = T.StructType([T.StructField(category, rows.schema[category].dataType), T.StructField("_at", T.LongType()), T.StructField("position", T.IntegerType())])
    picked = rows.sparkSession.createDataFrame([(c, p, i) for c, n in limits.items() for i, p in enumerate(sample_positions(sizes[c], n, seed))], schema)
    out = _numbered(rows, order, [category]).join(F.broadcast(picked), [category, "_at"]).drop("_at").select(*rows.columns, "position")  # limit rows, and one for each category at most
    short = min(limit, sum(sizes.values())) - sum(limits.values())
    if short > 0:
        out = kept(out)
        out = out.unionByName(seeded_sample(rows.join(out.select(order), order, "left_anti"), order, short, seed + 1).select(*rows.columns, "position"))
    return out


def tasks(symbols: DataFrame, callers: DataFrame, dirs: DataFrame) -> DataFrame:
    """Synthetic tasks (category, subject, expected): where a unique symbol is defined, who uses it, how many files a directory holds."""
    where_ = symbols.select(F.lit("definition").alias("category"), F.col("name").alias("subject"), F.array("file").alias("expected"))
    use = callers.select(F.lit("callers").alias("category"), F.col("symbol_id").cast("string").alias("subject"), F.array(F.col("callers").cast("string")).alias("expected"))
    size = dirs.select(F.lit("directory").alias("category"), F.col("dir").alias("subject"), F.array(F.col("files").cast("string")).alias("expected"))
    return where_.unionByName(use).unionByName(size)


def plan_runs(tasks_: DataFrame, arms: list[str], iterations: int) -> DataFrame:
    """Every task under every arm, iterations times."""
    return tasks_.withColumn("arm", F.explode(F.array(*map(F.lit, arms)))).withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison across engines."""
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))

