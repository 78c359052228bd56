from pyspark.sql import functions as F

from treelark.operators import evidence, extract, freshness, policy, reports, retrieval, scan, scoring, stats
from treelark.sources import config
from treelark.streaming import watch


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_overlap_of_violations_and_scopes(spark):
    v = spark.createDataFrame([("r", "a", "a/x/f.ts"), ("r", "b/c", None), ("r", "z", None)], "rule string, scope string, file string")
    s = lambda *x: spark.createDataFrame([(i,) for i in x], "scope string")
    assert [r.scope for r in policy.overlapping(v, s("a/x")).collect()] == ["a"]
    assert sorted(r.scope for r in policy.overlapping(v, s("b")).collect()) == ["b/c"]
    assert [r.scope for r in policy.overlapping(v, s("b/c/d")).collect()] == ["b/c"]
    assert policy.overlapping(v, s("q")).count() == 0


def test_seeds_and_texts(spark):
    docs = spark.createDataFrame([(".", "root", ["boot"]), ("src", "code", ["runFast", "walk"])], "scope string, summary string, exports array<string>")
    assert [r.must for r in retrieval.seeds_of(docs, query="q", file="src/a").collect()] == [False]
    assert [r.scope for r in retrieval.seeds_of(docs, file="src/a.ts").collect()] == ["src"]
    assert [r.scope for r in retrieval.seeds_of(docs, symbol="run").collect()] == ["src"]
    assert retrieval.seeds_of(docs).count() == 0
    text = "First one. Second one! Third one?"
    one = spark.range(1).select(retrieval.truncate_sentences(F.lit(text), 5).alias("a"), retrieval.truncate_sentences(F.lit(text), 500).alias("b")).first()
    assert one.a == "First one. Second one!" and one.b == text
    e = F.array().cast("array<string>")
    assert spark.range(1).select(retrieval.render(F.lit("s"), F.lit("sum"), F.array(*map(F.lit, "abcdefghij")), e, e, e)).first()[0] == "# s\nsum\nexports: a, b, c, d, e, f, g, h and 2 more"


def test_facts_of_a_tree(spark):
    files = spark.createDataFrame(
        [
            ("package.json", '{"dependencies": {"react": "1"}, "devDependencies": {"vitest": "2"}}'), ("requirements.txt", "numpy\n"), ("tsconfig.json", '{"strict": true}'),
            ("py/requirements.txt", "# c\nnumpy==1\npandas\n"), ("api/a.test.ts", "x"), ("api/b.ts", "y"), ("api/c.ts", "z"), (".nvmrc", "22\n"), ("w/index.ts", "/** Entry of w\n */"),
        ],
        "file string, text string",
    )
    assert rows(extract.requirements(files)) == [(".", "package.json", ["react", "vitest"]), ("py", "requirements.txt", ["numpy", "pandas"])]
    assert spark.range(1).select(extract.framework(F.array(F.lit("vue"), F.lit("react")))).first()[0] == "Vue"
    assert {r.fact for r in extract.config_facts(files).where("dir = '.'").collect()} == {"TypeScript", "TypeScript strict", "node 22"}
    assert {r.fact for r in extract.testing_facts(files).collect()} == {"framework vitest", "name.test files"}
    got = {r.dir: (r.summary, r.source) for r in extract.summaries(files).collect()}
    assert got["w"] == ("Entry of w", "docstring") and got["api"] == ("API endpoints", "name")
    assert rows(reports.generation_metrics(extract.summaries(files).where("source = 'name'"))) == [("name", 1, 100.0)]


def test_assembly_keeps_what_a_person_wrote(spark):
    fresh = spark.createDataFrame([("a", "made", ["x"]), ("b", "made", ["y"])], "scope string, summary string, exports array<string>")
    own = spark.createDataFrame([("a", "written")], "scope string, summary string")
    got = {r.scope: (r.summary, r.exports, r.derived_fields) for r in extract.assemble(fresh, own, ["summary", "exports"]).collect()}
    assert got == {"a": ("written", ["x"], ["exports"]), "b": ("made", ["y"], ["summary", "exports"])}
    llm = spark.createDataFrame([("a", "said", ["z"])], "scope string, summary string, exports array<string>")
    assert rows(extract.overlay(fresh, llm, ["exports"]).where("scope = 'a'")) == [("a", "said", ["x"])]


def test_commands_artifacts_and_cache(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("max_depth: 3\nmin_tokens: many\nverify:\n  .: {test: make}\n  a/b: {test: {command: go test}}\n")
    c = config.load(str(tmp_path / "c.yaml"))
    assert (c.max_depth, c.min_tokens) == (3, 4096) and config.load(str(tmp_path / "none")) is None
    commands = spark.createDataFrame([(s, x) for s, _, x in config.commands(c)], "scope string, command string")
    s = spark.createDataFrame([("a",), ("a/b/c",)], "scope string")
    assert rows(evidence.command_for(s, commands)) == [("a", "make"), ("a/b/c", "go test")]
    m = spark.createDataFrame([("s", "clean", 5, "errors", 3, 4)], "scope string, typecheck string, typecheck_mtime int, lint_status string, lint_status_mtime int, newest_source int")
    assert evidence.by_artifact(m).select("typecheck", "lint_status").first() == ("clean", None)
    key = spark.range(1).select(freshness.cache_key({"b": F.lit(1), "a": F.lit("x")}), freshness.cache_key({"a": F.lit("x"), "b": F.lit(1)})).first()
    assert key[0] == key[1] and len(key[0]) == 64
    cache = spark.createDataFrame([("k", "answer")], "key string, response string")
    assert rows(freshness.cache_lookup(spark.createDataFrame([("k",), ("n",)], "key string"), cache)) == [("k", "answer"), ("n", None)]
    assert freshness.cache_stats(cache).first() == (1, 6)


def test_reports(spark):
    s = spark.createDataFrame([("a", "fresh"), ("b", None)], "scope string, state string")
    assert reports.view_totals(s, s.limit(0)).first() == (2, 1, 0, 0, 0, 1, 0)
    pack = spark.createDataFrame([(1, "b", 9), (0, "a", 9)], "position int, scope string, used int")
    assert reports.pack_json(pack).first()[0] == '{"used":9,"scopes":["a","b"]}'
    assert reports.pack_markdown(pack, spark.createDataFrame([("a", "A"), ("b", "B")], "scope string, text string")).first()[0] == "A\n\nB"
    d = spark.createDataFrame([("a", "."), ("a/b", "a")], "dir string, parent string")
    assert rows(reports.child_states(d, s)) == [(".", "a", "fresh"), ("a", "b", "missing")]
    p = spark.createDataFrame([("dist/a.js", True), ("src/a.pb.go", True), ("src/a.ts", False)], "p string, want boolean")
    assert p.where(reports.is_generated(F.col("p")) != F.col("want")).count() == 0
    assert reports.provenance(spark, commit="x").columns == ["made_at", "commit"]


def test_runs_and_regressions(spark):
    t = spark.createDataFrame([("t1",)], "task string")
    assert scoring.plan_runs(t, ["a", "b"], 3).count() == 6
    assert scoring.stratified_limits({"a": 90, "b": 10, "c": 1}, 20) == {"a": 17, "b": 1, "c": 1}
    before, after = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.9)], "k string, score double"), spark.createDataFrame([("a", 0.89), ("b", 0.5)], "k string, score double")
    assert sorted(r.k for r in scoring.regressions(before, after, ["k"]).collect()) == ["b", "c"]


def test_rates_of_nothing(spark):
    none = spark.createDataFrame([], "source_tokens long, context_tokens long, state string, tokens long")
    assert stats.token_economics(none).first() == (0, 0, 0, 0, 0.0, 0.0)
    assert stats.reduction_percentiles(none).first() == (None, None)
    assert stats.freshness_summary(none).first().fresh_permille == 0.0


def test_changes_find_their_directory(spark):
    c = spark.createDataFrame([("src/a/x.ts", 1), ("lib/y.ts", 2)], "file string, seq int")
    s = spark.createDataFrame([("src",), ("src/b",)], "scope string")
    assert [(r.file, r.dir) for r in watch.tracked(c, s).collect()] == [("src/a/x.ts", "src")]
    assert [r.file for r in scan.dropped_files(c, c.where("seq = 1")).collect()] == ["lib/y.ts"]
