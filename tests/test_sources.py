import subprocess

import pytest
from pyspark.sql import functions as F

from treelark.project import Project
from treelark.sources import git, index_store, scopes
from treelark.streaming import watch

GOOD = {"version": 1, "last_updated": "2026-01-01", "fingerprint": "abcd1234", "scope": ".", "summary": "Fresh cache of things.", "maintenance": "by hand"}
FULL = GOOD | {"scope": "src", "exports": ["run"], "decisions": [{"what": "w", "why": "y"}], "rules": [{"kind": "max_file_lines", "value": 2}], "evidence": {"test_status": "passing", "coverage_percent": 80.5}, "semantic_fingerprint": "0123456789ab"}


@pytest.mark.parametrize("record", [GOOD, FULL, GOOD | {"rules": []}, GOOD | {"dependencies": {"internal": ["a"]}}])
def test_valid_records(record):
    assert scopes.findings(record) == []


@pytest.mark.parametrize(
    "record",
    [{k: v for k, v in GOOD.items() if k != n} for n in GOOD]
    + [GOOD | x for x in ({"version": "1"}, {"version": 2}, {"extra": 1}, {"files": "a"}, {"files": [{"name": "a"}]}, {"interfaces": [{"name": "a", "description": 3}]}, {"decisions": [{"what": "w"}]}, {"evidence": {"test_status": "maybe"}}, {"evidence": {"coverage_percent": 101}}, {"evidence": {"x": 1}}, {"rules": [{"kind": "none"}]}, {"rules": [{"kind": "max_file_lines", "value": 0}]}, {"semantic_fingerprint": "0123"}, {"semantic_fingerprint": "0123456789AB"}, {"internals": [{"name": "a", "kind": "thing", "file": "f"}]})]
    + ["text", None],
)
def test_invalid_records(record):
    assert scopes.findings(record)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    (root / "src").mkdir()
    (root / "node_modules").mkdir()
    (root / "node_modules/x.js").write_text("export function no() {}\n")
    (root / "src/a.ts").write_text("export function run() {}\n// two\n// three\n")
    (root / "src/b.ts").write_text("import { run } from './a'\nrun()\n")
    scopes.write(GOOD, str(root / scopes.NAME))
    scopes.write(FULL, str(root / "src" / scopes.NAME))
    return root


def test_records_are_read_and_searched(spark, tree):
    p = Project(spark, str(tree))
    assert [r.scope for r in p.list_contexts().collect()] == [".", "src"]
    assert {r.file for r in p.files().collect()} == {"src/a.ts", "src/b.ts"}
    assert [r.scope for r in p.search_context("cache").collect()] == [".", "src"]
    assert p.build_context_pack("cache").first().scope == "src"
    assert p.validate().count() == 0 and p.query_context("src", ["exports", "nope"]).columns == ["version", "last_updated", "fingerprint", "scope", "exports"]
    assert p.aggregate_evidence().first().passing == 1
    assert {r.file for r in p.check_policies().collect()} >= {"src/a.ts"}
    assert {r.state for r in p.check_freshness().where("scope = 'src'").collect()} == {"semantic_stale"}
    assert [r.file for r in p.find_references("run").collect()] == ["src/b.ts"]
    out, how = p.impact("src/a.ts#run")
    assert [(r.file, r.hops) for r in out.collect()] == [("src/b.ts", 0)] and how["stopped"] == ["natural"]
    assert {r.check: r.status for r in p.doctor().collect()}["root record"] == "pass"


def test_later_versions_raise_when_asked(spark, tmp_path):
    (tmp_path / scopes.NAME).write_text("version: 2\nscope: .\n")
    assert scopes.read(spark, str(tmp_path)).count() == 0
    with pytest.raises(scopes.UnsupportedVersion):
        scopes.read(spark, str(tmp_path), strict=True)


def test_index_store(spark, tree, tmp_path):
    index = Project(spark, str(tree)).index()
    at = str(tmp_path / "index")
    assert index_store.state(at, "p") == "missing"
    index_store.write(index, at, "p")
    assert index_store.state(at, "other") == "stale"
    with pytest.raises(index_store.IndexUnavailable):
        index_store.read(spark, at, "other")
    back = index_store.read(spark, at, "p")
    assert back["symbols"].count() == index["symbols"].count() == 1
    assert [r.name for r in index_store.of_file(back["symbols"], "src/a.ts").collect()] == ["run"]
    now = spark.createDataFrame([("src/b.ts", "1")], "file string, content_hash string")
    prior = spark.createDataFrame([("src/a.ts", "0"), ("src/b.ts", "1")], "file string, content_hash string")
    assert index_store.refresh(index, prior, now, index)["symbols"].count() == 0


def test_git_log(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q")
    for i in range(3):
        (tmp_path / "f.txt").write_text(str(i))
        run("add", ".")
        run("commit", "-qm", f"fix {i}")
    rows = git.read_log(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.subject for r in rows] == ["fix 2", "fix 1", "fix 0"] and rows[0].files == ["f.txt"]
    assert git.show(str(tmp_path), "HEAD", "f.txt") == "2" and git.tree(str(tmp_path), "HEAD") == ["f.txt"] and git.changed(str(tmp_path), "HEAD~2") == ["f.txt"]


CHANGES = [("a", "2024-01-01 00:00:00", "fresh", 1), ("a", "2024-01-01 00:00:01", "fresh", 2), ("a", "2024-01-01 00:05:00", "stale", 3), ("b", "2024-01-01 00:00:00", "stale", 4), ("a", "2024-01-01 00:09:00", "stale", 5), ("z", "2024-01-02 00:00:00", "end", 6)]


def _stream(spark, tmp_path, make):
    spark.createDataFrame(CHANGES, "dir string, t string, state string, seq long").select("dir", F.to_timestamp("t").alias("ts"), "state", "seq").coalesce(1).write.parquet(str(tmp_path / "log"))
    batch = spark.read.parquet(str(tmp_path / "log"))
    stream = make(watch.changes_from(spark, str(tmp_path / "log"), "dir string, ts timestamp, state string, seq long"))
    q = stream.writeStream.format("memory").queryName("t" + tmp_path.name.replace("-", "_")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return batch, spark.table("t" + tmp_path.name.replace("-", "_"))


def test_debounce_stream_equals_its_batch_twin(spark, tmp_path):
    batch, got = _stream(spark, tmp_path, lambda s: watch.debounced_stream(s, "30 seconds", "1 second"))
    want = {tuple(r) for r in watch.debounced(batch, "30 seconds").collect()}
    assert {tuple(r) for r in got.collect()} == {r for r in want if r[0] != "z"}  # the last session is still open


def test_transition_stream_equals_its_batch_twin(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        batch, got = _stream(spark, tmp_path, watch.transition_stream)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in watch.transitions_of(batch).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
