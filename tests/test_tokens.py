"""Counting tokens by patterns gives what making them gives, also for accents in two characters."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treelark.functions import terms
from treelark.functions import text as t
from treelark.operators import retrieval

from .test_operators import _moved

TEXTS = ["a I i A it", "camelCase the_thing HTTPServer x1 a1 b", "The THE of_the parse2XML __init__ a_ _b", "cafe\u0301 q\u0301x cafe\u0301s na\u00efve", "", None, "ABc aBC A_B abc123def 42 4"]
TERMS = ["camel", "thing", "cafe", "caf", "abc", "init"]


def test_token_counts(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS], "x string")
    c = t.composed(F.coalesce("x", F.lit("")))
    for keep in (False, True):
        parts = t.token_parts(c, keep)
        hits = t.token_hits(c, parts, TERMS)
        for r in df.select("x", t.tokens(F.col("x"), keep).alias("a"), t.token_bag(F.col("x"), keep).alias("b"), t.token_count(c, parts, keep).alias("n"), hits.alias("h")).collect():
            assert sorted(r.a) == sorted(r.b) == sorted(t.plain_tokens(r.x or "", keep)) and len(r.a) == r.n
            assert all(r.a.count(w) == r.h.count(w) for w in TERMS)


def _counts(rows, zones, joined):
    """By plain tokens: (term, zone) to its number and its documents."""
    found = {}
    for row in rows:
        each = [(z, t.plain_tokens(row[z] or "", z == "symbols")) for z in zones]
        for z, words in [("", [w for _, x in each for w in x])] if joined else each:
            for w, n in Counter(words).items():
                x = found.setdefault((w, z), [0, 0])
                x[0] += n
                x[1] += row["scope"] is not None
    return found


@pytest.mark.parametrize("joined", [False, True])
@pytest.mark.parametrize("size", [1, 40, 4_000_000])
def test_terms_counted_over_batches(monkeypatch, joined, size):
    monkeypatch.setattr(terms, "SLICE", size)
    r, odd = random.Random(2), [*TEXTS, "x", "_", "9a", "aB", "AB", "ABc", "\u00e9ab\u00e9", "\u0391\u0301b\u0301ab", "ab\u0300\U0001f600cd", " " * 50, "ab\u0130cd"]
    some = lambda: r.choice([None, "", "ab", *odd, "".join(r.choice("aAbBZ09_ -\n\u00e9\u0301") for _ in range(r.randrange(30)))])
    rows = [{"scope": r.choice([None, str(i), str(i)]), "summary": some(), "symbols": some()} for i in range(400)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in rows[0]]))
    got = {}
    for b in terms.counter(["summary", "symbols"], joined)(iter([batch.slice(0, 0), batch.slice(0, 7), batch.slice(7)])):
        for w, z, n, docs in zip(*(c.to_pylist() for c in b.columns)):
            x = got.setdefault((w, z), [0, 0])
            x[0], x[1] = x[0] + n, x[1] + docs
    assert got == _counts(rows, ["summary", "symbols"], joined)


def test_terms_are_counted_before_the_shuffle(spark):
    docs = spark.range(3000, numPartitions=4).select(F.col("id").cast("string").alias("scope"), F.lit("some plain words").alias("summary"), F.lit("plain cases here").alias("path"))
    got = {}
    moved = _moved(spark, lambda: got.update(((x.term, x.zone), (x.n, x.docs)) for x in retrieval.term_counts(docs, ["summary", "path"]).collect()))
    assert got == {(w, z): (3000, 3000) for z, words in (("summary", "some plain words"), ("path", "plain cases here")) for w in words.split()}
    assert moved < 3200  # the scopes, and a row per term and task


@pytest.mark.parametrize("scopes", [["1", "2", None, None], ["1", "1", "2", None]])
def test_scopes_count_once_and_null_ones_never(spark, scopes):
    docs = spark.createDataFrame([(s, "alpha beta alpha", "gamma" if i else "alpha") for i, s in enumerate(scopes)], "scope string, summary string, path string")
    named = len(set(scopes) - {None})
    assert {(x.term, x.zone): (x.n, x.docs) for x in retrieval.term_counts(docs, ["summary", "path"]).collect()} == {("alpha", "summary"): (8, named), ("beta", "summary"): (4, named), ("alpha", "path"): (1, 1), ("gamma", "path"): (3, len(set(scopes[1:]) - {None}))}
    assert {x.term: x.df for x in retrieval.document_frequency(docs, ["summary", "path"]).collect()} == {"alpha": named, "beta": named, "gamma": len(set(scopes[1:]) - {None})}
