"""doc_ids near the ends of a long, and columns with names that operators use inside."""

import pytest

import corpus_pipeline
from treelark.llm import common, exact, near, recompress, suffixes

MOST = (1 << 63) - 1


@pytest.fixture(scope="module")
def far(spark):
    text = " ".join(f"word{i % 97} and{i}" for i in range(120))
    rows = [(-MOST - 1, text, "a"), (MOST, text, "b"), (MOST - 1, "something else that stands alone here", "c"), (0, text + " more", "d"), (MOST, text, "b")]
    return spark.createDataFrame([(*r, "s", 1, 2, 3, 4) for r in rows], "doc_id long, text string, lang string, source string, _key int, _row int, rk int, _id int")


def test_exact_and_near(far):
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact.exact_dedup(far).collect()}
    assert got == {(-MOST - 1, -MOST - 1, 3), (MOST, -MOST - 1, 3), (MOST - 1, MOST - 1, 1), (0, 0, 1)}
    assert {r.doc_id: r.component_id for r in near.near_duplicates(far).collect()} == {-MOST - 1: -MOST - 1, MOST: -MOST - 1, 0: -MOST - 1, MOST - 1: MOST - 1}


def test_repeats(far):
    assert {r.doc_id: r.n_removed for r in recompress.op3_digests(far.dropDuplicates(["doc_id"])).collect()} == {-MOST - 1: 0, MOST: 240, MOST - 1: 0, 0: 240}
    assert all((r.n_removed > 400) == (r.doc_id != MOST - 1) for r in suffixes.op10_digests(far).collect())


def test_pipeline_keeps_columns(spark, far):
    docs = far
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == far.columns
    rows = corpus_pipeline.exact_dedup(spark, far, "").collect()
    assert sorted(r.doc_id for r in rows) == [-MOST - 1, 0, MOST - 1]
    twice = corpus_pipeline.exact_dedup(spark, far.where(f"doc_id = {MOST}"), "").collect()
    assert len(twice) == 1 and twice[0]._key == 1 and twice[0].rk == 3


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        common.shared_dir(Session())
