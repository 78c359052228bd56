"""The pipeline's stages against brute force, and the queries against their SQL."""

import collections
import hashlib
import os
import re

import pytest

import corpus_pipeline
from treelark.llm import bpe, mixing, near, quality, queries

from ..oracle import same

ROOT = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")


@here
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    same(queries.QUERIES[name](spark, ROOT), queries.SQL[name], ROOT)


def test_stages_keep_columns_and_decide(spark, docs, rows):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now
        now = corpus_pipeline.common.written(stage(spark, now, ""), "t")
        assert now.columns == docs.columns, name
        full = collections.Counter(tuple(r) for r in before.collect())
        assert not collections.Counter(tuple(r) for r in now.collect()) - full
    last = corpus_pipeline.STAGES[-1][1](spark, now, "")
    assert collections.Counter(r.doc_id for r in last.collect()) == collections.Counter(r.doc_id for r in now.collect())


def test_exact_stage_leaves_one_row_of_each_text(spark, docs, rows):
    out = corpus_pipeline.exact_dedup(spark, docs, "").collect()
    norm = lambda x: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", x or "").encode()).digest()
    assert sorted(norm(r.text) for r in out) == sorted({norm(r[1]) for r in rows})


def test_near_stage_leaves_one_document_of_each_component(spark, docs):
    found = near.near_duplicates(docs).collect()
    out = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert {r.component_id for r in found if r.doc_id is not None} == {x for x in out if x is not None}


@here
def test_run_against_its_operators(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    good = {r.doc_id for r in quality.quality_rules(docs).where("kept").collect()}
    got = corpus_pipeline.run(spark, ROOT).collect()
    assert got and {r.doc_id for r in got} <= good
    texts = {r.doc_id: r.text for r in docs.collect()}
    v = bpe.ranks(bpe.rank_file())
    assert all(v.decode(__import__("numpy").array(r.ids)).tobytes().decode() == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in got[:50])


def test_empty_pipeline(spark, nothing):
    now = nothing
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
    assert now.count() == 0
    assert mixing.fit(mixing.cells_of(nothing)).count() == 0
