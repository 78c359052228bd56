import os

import pytest

import __spark_entry__
from treelark.plans import catalogue, relations

from .oracle import same

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, name):
    same(catalogue.QUERIES[name](spark, ROOT), catalogue.SQL[name], ROOT)


def test_samples_have_their_size_and_repeat(spark):
    a = sorted(r[0] for r in catalogue.QUERIES["seeded_sample"](spark, ROOT).collect())
    b = sorted(r[0] for r in catalogue.QUERIES["seeded_sample"](spark, ROOT).collect())
    assert len(a) == 50 and a == b
    assert catalogue.QUERIES["stratified_limit"](spark, ROOT).count() == 60


def test_entry_gives_twenty_documents(spark):
    assert __spark_entry__.entry(spark).columns == ["scope", "score"]


def test_every_sql_has_its_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _reached(symbols, references, imports, seeds, depth=3):
    """Breadth-first search over plain tuples: hops by file, from whole files."""
    home = {i: f for i, f, exported in symbols if exported}
    users, importers = {}, {}
    for i, f in references:
        if i in home:
            users.setdefault(home[i], set()).add(f)
    for f, to in imports:
        if to is not None:
            importers.setdefault(to, set()).add(f)
    hops, frontier = {}, set(seeds)
    seen = set(seeds)
    for h in range(depth):
        step = set().union(*(users.get(f, set()) | (importers.get(f, set()) if not h or f not in set(home.values()) else set()) for f in frontier)) - seen
        hops |= dict.fromkeys(step, h)
        seen |= step
        frontier = step
    return hops


@pytest.mark.parametrize("name", ["impact_scopes", "import_edges"])
def test_joins_of_line_items_are_spread_by_their_number(spark, monkeypatch, name):
    monkeypatch.setattr(relations, "TASK_ROWS", 500)
    x = relations.Tables(spark, ROOT)
    plan = x.imports()._jdf.queryExecution().optimizedPlan().toString()
    parts = -(-x.table("lineitem").count() // 500)
    assert parts > 4 and plan.count(f", {parts}\n") == 3  # orders, and line items twice
    same(catalogue.QUERIES[name](spark, ROOT), catalogue.SQL[name], ROOT)
