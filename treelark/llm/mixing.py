"""Operator 2, mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Tokens (words) are summed per cell of source x language x topic. Raking scales the cells in turn to the three target
marginals until all hold, which gives each cell its share of the mixture. A common scale turns shares into sampling
probabilities, none above 1, such that the expected tokens are the wanted part of all; a document stays if a hash of its
doc_id, uniform in [0, 1), lies under its cell's probability. All documents are counted and judged: sampling is the feature.

The cell table follows the number of distinct sources, not of documents. Up to CELLS cells are raked on the driver; a
larger table is raked by DataFrame aggregates over the cells, by the same steps. Cells meet documents by a join, which
broadcasts only under Spark's size threshold. A hot source is only a hot join key, spread by AQE.

Nulls: a null source or language is the category '(null)', a null text has no tokens and the topic 'empty'. A target for
a category without tokens can't be met and is left out before targets are scaled to 1. Documents without tokens are kept
with the probability of their cell (1 where the cell holds no tokens at all). Repeated rows share their doc_id's draw.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

AXES = ("source_c", "lang_c", "topic_c")
CELLS = 200_000
#: Exponent that flattens the natural shares into default targets, part of all tokens to keep, and when raking ends.
FLATTEN, KEEP, ROUNDS, CLOSE = 0.8, 0.8, 200, 1e-9


def topic() -> Column:
    """A topic from the text's form: a replaceable default for tables without a topic column."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (
        F.when(F.trim(text) == "", "empty")
        .when(text.contains("Licensed under") | text.contains("Copyright"), "licence")
        .when(text.rlike(r"(?i)[\w.]+@[\w.]+\.\w|https?://"), "contact")
        .when(text.rlike(r"[{};<>#=|]{2}|\w+ = "), "markup")
        .when(text.rlike(r"\d{5}"), "numeric")
        .otherwise("prose")
    )


def axes(topics: Column | None = None) -> list[Column]:
    """The three categories of a row."""
    blank = F.lit("(null)")
    named = (F.col("source"), F.col("lang"), topic() if topics is None else topics)
    return [F.coalesce(x.cast("string"), blank).alias(a) for x, a in zip(named, AXES)]


def cells_of(docs: DataFrame, topics: Column | None = None) -> DataFrame:
    """doc_id, the three categories and tokens of each row of docs(doc_id, text, source, lang)."""
    count = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(c.WORD)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *axes(topics), count.alias("n_tokens"))


def targets(natural: dict, wanted: dict | None) -> dict:
    """Wanted shares of the categories that have tokens, scaled to 1; by default the natural shares, flattened."""
    shares = {k: (v**FLATTEN if wanted is None else float(wanted.get(k, 0))) for k, v in natural.items() if v > 0}
    total = sum(shares.values())
    return {k: v / total for k, v in shares.items()} if total else {}


def rake(tokens: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray]) -> np.ndarray:
    """Shares of cells that start in proportion to tokens and meet the goals of every axis, as far as they can."""
    share = tokens / tokens.sum()
    for _ in range(ROUNDS):
        worst = 0.0
        for code, goal in zip(codes, goals):
            now = np.bincount(code, share, len(goal))
            worst = max(worst, float(np.abs(now - goal).max()))
            share = share * np.divide(goal, now, out=np.zeros(len(goal)), where=now > 0)[code]
        if worst < CLOSE:
            break
    return share / share.sum()


def scale(tokens: np.ndarray, share: np.ndarray, part: float) -> np.ndarray:
    """Probabilities min(1, s * share / tokens) whose expected tokens are part of all (or as near as shares allow)."""
    ratio = share / tokens
    goal, some = part * tokens.sum(), share > 0
    goal = min(goal, tokens[some].sum())
    order = np.argsort(-ratio[some], kind="stable")
    t, x = tokens[some][order], share[some][order]
    full = np.concatenate([[0.0], np.cumsum(t)])
    rest = np.concatenate([np.cumsum(x[::-1])[::-1], [0.0]])
    for k in range(len(t) + 1):  # the k cells with the largest ratio are taken whole
        s = (goal - full[k]) / rest[k] if rest[k] > 0 else np.inf
        if k == len(t) or s * x[k] / t[k] <= 1:
            break
    with np.errstate(invalid="ignore"):
        return np.where(some, np.minimum(1.0, s * ratio if np.isfinite(s) else 1.0), 0.0)


def _rake_far(cells: DataFrame, wanted: dict[str, dict | None], part: float) -> DataFrame:
    """rake() and scale() by aggregates, for more cells than the driver should hold."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0]
    now = cells.withColumn("share", F.col("tokens") / F.lit(float(total)))
    goals = {}
    for axis in AXES:
        natural = cells.groupBy(axis).agg(F.sum("tokens").alias("t"))
        if wanted.get(axis) is None:
            weight = F.pow("t", F.lit(FLATTEN))
        else:
            weight = F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in wanted[axis].items() for y in kv]), F.col(axis)), F.lit(0.0)) if wanted[axis] else F.lit(0.0)
        natural = natural.withColumn("w", weight)
        whole = natural.agg(F.sum("w")).first()[0] or 1.0
        goals[axis] = c.written(natural.select(axis, (F.col("w") / whole).alias("goal")), "goal")
    for turn in range(ROUNDS):
        for axis in AXES:
            marginal = now.groupBy(axis).agg(F.sum("share").alias("now")).join(goals[axis], axis)
            now = now.join(marginal, axis).withColumn("share", F.when(F.col("now") > 0, F.col("share") * F.col("goal") / F.col("now")).otherwise(0.0)).drop("now", "goal")
        now = c.written(now, "rake")
        gap = max(now.groupBy(a).agg(F.sum("share").alias("now")).join(goals[a], a).agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0 for a in AXES)
        if gap < CLOSE:
            break
    low, high, goal = 0.0, float(total) * 1e6, part * total
    for _ in range(100):
        s = (low + high) / 2
        got = now.agg(F.sum(F.least(F.col("tokens").cast("double"), s * F.col("share")))).first()[0]
        low, high = (s, high) if got < goal else (low, s)
    return now.withColumn("p", F.least(F.lit(1.0), high * F.col("share") / F.col("tokens"))).select(*AXES, "share", "p")


def fit(rows: DataFrame, source: dict | None = None, lang: dict | None = None, topic_: dict | None = None, part: float = KEEP, cells_limit: int = CELLS) -> DataFrame:
    """Share and probability p of each cell with tokens of rows(*AXES, n_tokens)."""
    spark = rows.sparkSession
    wanted = dict(zip(AXES, (source, lang, topic_)))
    cells = c.written(rows.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "cells")
    many = cells.count()
    schema = ", ".join(f"{a} string" for a in AXES) + ", share double, p double"
    if many > cells_limit:
        return c.written(_rake_far(cells, wanted, part), "fitted")
    if not many:
        return spark.createDataFrame([], schema)
    table = cells.toPandas().sort_values(list(AXES), ignore_index=True)
    tokens = table["tokens"].to_numpy(float)
    codes, goals = [], []
    for axis in AXES:
        names, code = np.unique(table[axis].to_numpy(str), return_inverse=True)
        goal = targets(dict(zip(names.tolist(), np.bincount(code, tokens).tolist())), wanted[axis])
        codes.append(code)
        goals.append(np.array([goal.get(x, 0.0) for x in names.tolist()]))
    share = rake(tokens, codes, goals)
    table["share"], table["p"] = share, scale(tokens, share, part)
    return spark.createDataFrame(table[[*AXES, "share", "p"]], schema)


def chosen(p: Column, seed: int = 42) -> Column:
    """Whether a doc_id's draw, the same at every size and time, lies under p (1 for cells without tokens)."""
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return draw < F.coalesce(p, F.lit(1.0))


def mix(docs: DataFrame, source: dict | None = None, lang: dict | None = None, topic_: dict | None = None, part: float = KEEP, topics: Column | None = None, seed: int = 42, cells_limit: int = CELLS) -> DataFrame:
    """doc_id, source_c, lang_c, topic_c, n_tokens, share (of its cell), p and kept of each row of docs.

    source, lang, topic_: target shares by category; None takes the natural ones, flattened.
    """
    rows = c.written(cells_of(docs, topics), "mix")
    fitted = fit(rows, source, lang, topic_, part, cells_limit)
    return rows.join(fitted, list(AXES), "left").select("doc_id", *AXES, "n_tokens", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("p", F.lit(1.0)).alias("p"), chosen(F.col("p"), seed).alias("kept"))


def sampled(docs: DataFrame, part: float = KEEP, topics: Column | None = None, seed: int = 42) -> DataFrame:
    """The rows of docs that mix() keeps, with all their columns: only cells are joined, texts stay where they are."""
    rows = c.written(cells_of(docs, topics), "mix")
    fitted = fit(rows, part=part)
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", *axes(topics))
    return packed.join(fitted, list(AXES), "left").where(chosen(F.col("p"), seed)).select("_row.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(c.documents(spark, sf_dir))
