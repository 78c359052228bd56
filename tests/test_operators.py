import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from treelark import constants as k
from treelark.functions import text as t
from treelark.operators import evidence, extract, freshness, graph, history, policy, retrieval, scan, scoring, stats


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column).first()[0]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tokens_of_identifiers(spark):
    assert one(spark, t.tokens(F.col("x")), x="parseHTTPResponse2 of snake_case_name") == ["parsehttpresponse2", "parse", "http", "response", "snake_case_name", "snake", "case", "name"]
    assert one(spark, t.tokens(F.col("x"), True), x="of it") == ["of", "it"]
    assert t.plain_tokens("parseHTTPResponse2 of snake_case_name") == ["parsehttpresponse2", "parse", "http", "response", "snake_case_name", "snake", "case", "name"]


def test_token_rows_equal_the_ordered_tokens(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("aB_9 cD-é") for _ in range(60)) for _ in range(80)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, x string")
    exploded = {}
    for i, w in t.token_rows(df, ["id"], "x").collect():
        exploded.setdefault(i, []).append(w)
    for i, want in df.select("id", t.tokens(F.col("x"), True)).collect():
        assert sorted(exploded.get(i, [])) == sorted(want) == sorted(t.plain_tokens(texts[i], True))


@pytest.mark.parametrize(
    "pattern, yes, no",
    [("src/*.ts", ["src/a.ts"], ["src/a/b.ts", "src/a.tsx", "src/a.ts\n"]), ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]), ("*.{ts,js}", ["x.js"], ["x.py", "d/x.js"]), ("a?c", ["abc"], ["a/c", "ac"]), ("**", ["any/thing"], [])],
)
def test_globs(spark, pattern, yes, no):
    for path in yes + no:
        assert one(spark, t.matches_glob(F.col("p"), pattern), p=path) == (path in yes), path


def test_glob_lists_negate_in_order(spark):
    assert one(spark, t.matches_glob(F.col("p"), ["src/**", "!src/gen/**"]), p="src/gen/a") is False
    assert one(spark, t.matches_glob(F.col("p"), ["!src/gen/**"]), p="src/a") is False


def test_paths(spark):
    assert t.safe_relative("a/../../b") is None and t.safe_relative("/a") is None and t.safe_relative("./a//b/../c") == "a/c"
    assert one(spark, t.ancestors(F.col("p")), p="a/b/c") == ["a/b/c", "a/b", "a", "."]
    assert one(spark, t.in_scope(F.col("p"), F.lit("a")), p="ab/c") is False


def test_half_up_also_below_zero(spark):
    assert one(spark, t.round_half_up(F.col("x")), x=-0.25) == -0.2 and one(spark, t.round_half_up(F.col("x")), x=0.25) == 0.3


@pytest.mark.parametrize(
    "stored, now, sem0, sem1, want",
    [(None, "a", None, None, "missing"), ("a", "a", "s", "x", "fresh"), ("a", "b", None, "x", "cosmetic_stale"), ("a", "b", "s", None, "cosmetic_stale"), ("a", "b", "s", "s", "cosmetic_stale"), ("a", "b", "s", "x", "semantic_stale")],
)
def test_freshness_states(spark, stored, now, sem0, sem1, want):
    df = spark.createDataFrame([(stored, now, sem0, sem1)], "a string, b string, c string, d string")
    assert df.select(freshness.state(*map(F.col, "abcd"))).first()[0] == want


def test_semantic_fingerprint_ignores_order_and_sees_names(spark):
    mk = lambda x: spark.createDataFrame(x, "file string, kind string, name string, exported boolean")
    a = [("d/a", "function", "f", True), ("d/a", "class", "C", True), ("d/a", "function", "hidden", False)]
    of = lambda x: freshness.semantic_fingerprint(mk(x)).first()[1]
    assert of(a) == of(a[::-1]) == of([*a, ("d/b", "function", "other", False)]) != of([("d/a", "function", "g", True), *a[1:]])


def test_admission_passes_over_what_does_not_fit(spark):
    c = spark.createDataFrame([(chr(97 + i), n, 10.0 - i, 0.0) for i, n in enumerate([100, 900, 50, 700, 300, 20])], "scope string, tokens int, total double, must double")
    got = retrieval.admit(c, 1400).orderBy("position").collect()
    assert [r.scope for r in got] == ["a", "b", "c", "e", "f"] and got[0].used == 1370


def test_bm25_against_plain_python(spark):
    import math

    docs = [("a", "fresh cache fresh", "index"), ("b", "stale cache", ""), ("c", "nothing here", "cache index index")]
    df = spark.createDataFrame(docs, "scope string, summary string, constraints string")
    got = {r.scope: r.score for r in retrieval.bm25(df, ["summary", "constraints"], "cache index cache").collect()}
    toks = [{z: t.plain_tokens(x) for z, x in zip(("summary", "constraints"), d[1:])} for d in docs]
    n = len(docs)
    for d, z in zip(docs, toks):
        score = 0.0
        for q in ("cache", "index", "cache"):
            df_ = sum(any(q in y for y in x.values()) for x in toks)
            for zone, words in z.items():
                average = sum(len(x[zone]) for x in toks) / n or 1
                tf = words.count(q)
                score += math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * k.ZONE_WEIGHTS[zone] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / average))
        assert got.get(d[0], 0) == pytest.approx(score)


def test_resolution_order(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/a.js",), ("src/d/index.ts",), ("pkg/m.py",), ("pkg/m/__init__.py",)], "file string")
    edges = spark.createDataFrame([("src/x.ts", "./a.js"), ("src/x.ts", "./d"), ("src/x.ts", "./none")], "from_file string, raw string")
    got = dict(graph.resolve(edges, files, graph.script_candidates(F.col("from_file"), F.col("raw"))).select("raw", "resolved_to").collect())
    assert got == {"./a.js": "src/a.ts", "./d": "src/d/index.ts", "./none": None}
    py = spark.createDataFrame([("pkg/sub/x.py", "..m"), ("pkg/sub/x.py", "pkg.m"), ("pkg/x.py", ".m")], "from_file string, raw string")
    got = dict(graph.resolve(py, files, graph.python_candidates(F.col("from_file"), F.col("raw"))).select("raw", "resolved_to").collect())
    assert got == {"..m": "pkg/m.py", "pkg.m": "pkg/m.py", ".m": "pkg/m.py"}


def _impact(spark, seeds, depth=3, results=100):
    s = spark.createDataFrame([(1, "math", True), (2, "math", True), (3, "cmd", False), (4, "srv", True)], "id long, file string, exported boolean")
    r = spark.createDataFrame([(1, "cmd", 1), (2, "other", 1)], "symbol_id long, file string, line int")
    i = spark.createDataFrame([("cmd", "math"), ("other", "math"), ("srv", "cmd"), ("late", "srv")], "from_file string, resolved_to string")
    out, how = graph.impact(s, r, i, spark.createDataFrame(seeds, "file string, symbol_id long"), depth, results)
    return {x.file: x.hops for x in out.collect()}, how["stopped"]


def test_impact_hops(spark):
    # importers of the seed's file count at once; 'srv' exports something, so its importers don't
    assert _impact(spark, [("math", 1)]) == ({"cmd": 0, "other": 0, "srv": 1}, ["natural"])
    assert _impact(spark, [("math", 1)], depth=1)[1] == ["max_depth"]
    assert _impact(spark, [("math", 1)], results=2)[1] == ["max_results"]


def _moved(spark, run) -> int:
    """Rows that a run writes for shuffles."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    none, tasks = gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()

    def total() -> int:
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, none, tasks)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_impact_doesnt_shuffle_imports_or_references_in_each_hop(spark):
    n = 40_000
    symbols = spark.range(50).select("id", F.concat(F.lit("f"), F.col("id") % 7).alias("file"), F.lit(True).alias("exported"))
    references = spark.range(n).select((F.col("id") % 50).alias("symbol_id"), F.concat(F.lit("f"), F.col("id") % 11).alias("file"))
    imports = spark.range(n).select(F.concat(F.lit("f"), F.col("id") % 13).alias("from_file"), F.concat(F.lit("f"), F.when(F.col("id") % 9 == 0, F.col("id") % 7).otherwise(F.col("id"))).alias("resolved_to"))
    seeds = spark.createDataFrame([("f0", None)], "file string, symbol_id long")
    threshold, got = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), {}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = _moved(spark, lambda: got.update((x.file, x.hops) for x in graph.impact(symbols, references, imports, seeds)[0].collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {f"f{i}": 0 for i in range(1, 13)}
    assert moved < 1.2 * n  # the references once, to their symbols


@pytest.mark.parametrize("few", [0, 10_000])
def test_impact_by_shuffle_and_by_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(graph, "FEW", few)
    r = random.Random(5)
    for _ in range(3):
        symbols = [(i, f"f{r.randrange(30)}", r.random() < 0.4) for i in range(30)]
        references = [(r.randrange(30), f"f{r.randrange(30)}") for _ in range(25)]
        imports = [(f"f{r.randrange(30)}", r.choice([None, f"f{r.randrange(30)}"])) for _ in range(25)]
        seeds = [(symbols[3][1], None), (symbols[4][1], symbols[4][0]), (symbols[4][1], symbols[4][0])]
        exports, seen, frontier, want = {f for _, f, e in symbols if e}, {f for f, _ in seeds}, {f for f, _ in seeds}, {}
        for h in range(3):
            used = {u for i, u in references for j, f, e in symbols if i == j and e and f in frontier and (h or (f, None) in seeds)} | {u for i, u in references if not h and i == symbols[4][0]}
            frontier = (used | {a for a, b in imports if b in frontier and (not h or b not in exports)}) - seen
            want |= dict.fromkeys(frontier, h)
            seen |= frontier
        of = lambda rows, kinds: spark.createDataFrame(rows, kinds)
        out, _ = graph.impact(of(symbols, "id long, file string, exported boolean"), of(references, "symbol_id long, file string"), of(imports, "from_file string, resolved_to string"), of(seeds, "file string, symbol_id long"), results=1000)
        assert {x.file: x.hops for x in out.collect()} == want


def test_proximity_against_bfs(spark):
    r = random.Random(1)
    edges = {(f"d{r.randrange(12)}", f"d{r.randrange(12)}") for _ in range(14)}
    df = spark.createDataFrame([(a, b, 1) for a, b in edges if a != b], "from_dir string, to_dir string, weight int")
    seen, frontier = {"d0": 0}, ["d0"]
    for h in range(1, 5):
        frontier = sorted({y for x in frontier for a, b in edges for y in ((b,) if a == x else (a,) if b == x else ())} - set(seen))
        seen |= {x: h for x in frontier}
    got = {x.dir: x.hops for x in graph.proximity(df, spark.createDataFrame([("d0",)], "dir string")).collect()}
    assert got == seen


def test_rules_are_checked():
    assert policy.check_rule({"kind": "forbid_import", "from": "a", "to": "b"}) == []
    assert policy.check_rule({"kind": "nope"}) and policy.check_rule({"kind": "forbid_import", "from": "a"}) == ["missing to"]
    assert policy.check_rule({"kind": "max_file_lines", "value": 0}) and policy.check_rule({"kind": "forbid_import", "from": "a", "to": "b", "x": 1}) == ["unknown field x"]
    assert policy.check_rule({"kind": "evidence_requires", "typecheck": "errors"})


def test_external_imports_match_on_the_raw_name(spark):
    i = spark.createDataFrame([("src/a.ts", "lodash", None, 3), ("lib/a.ts", "lodash", None, 1)], "from_file string, raw string, resolved_to string, line int")
    v = policy.forbid_import({"imports": i}, {"kind": "forbid_import", "from": "**", "to": "lod*"}, "src").collect()
    assert [(x.file, x.line, x.to) for x in v] == [("src/a.ts", 3, "lodash")]


def test_parsers(spark):
    noise = 'starting...\n{"success": false, "numTotalTests": 3, "testResults": [{"name": "b", "status": "failed"}, {"name": "a", "status": "failed"}]} done'
    e = one(spark, evidence.test_json(F.col("o")), o=noise)
    assert (e.test_status, e.test_count, e.failing_tests) == ("failing", 3, ["a", "b"])
    assert one(spark, evidence.test_json(F.col("o")), o="no braces").test_status == "unknown"
    xml = '<testsuites><testsuite name="x" tests="3" failures="0" errors="0"/><testsuite tests="2" failures="1" errors="0"/></testsuites>'
    assert one(spark, evidence.junit(F.col("o")), o=xml).test_count == 5 and one(spark, evidence.junit(F.col("o")), o=xml).test_status == "failing"
    assert one(spark, evidence.junit(F.col("o"), True), o=xml).test_status == "passing"
    assert one(spark, evidence.coverage(F.col("o")), o='{"total": {"lines": {"pct": 140}}}').coverage_percent == 100.0
    assert one(spark, evidence.eslint(F.col("o")), o='[{"errorCount": 2}, {"errorCount": 0}]').lint_status == "errors"
    go = '{"Action":"pass","Test":"A"}\n{"Action":"fail","Test":"A"}\n{"Action":"skip","Test":"B"}\n{"Action":"pass","Test":"C"}'
    g = evidence.go_test(spark.createDataFrame([(1, go)], "id int, out string"), "id", "out").first().evidence
    assert (g.test_status, g.test_count, g.failing_tests) == ("failing", 2, ["A"])
    assert one(spark, evidence.parser_for(F.lit("test"), F.lit(None).cast("string"), F.col("c")), c="npx vitest run") == "vitest-json"


def test_merge_takes_the_last_value_by_field(spark):
    df = spark.createDataFrame([("s", 1, "passing", None, False), ("s", 2, None, "clean", True)], "scope string, o int, test_status string, typecheck string, build_failed boolean")
    assert evidence.merged(df, "scope", F.col("o")).first()[1:] == ("passing", "errors")


def test_scores(spark):
    e = F.array(F.lit("src/A.ts"), F.lit("b.py"))
    assert one(spark, scoring.list_coverage(F.col("r"), e), r="see SRC/a.ts") == 0.5
    assert one(spark, scoring.mrr(scoring.paths_in(F.col("r")), e), r="x/y.go then b.py") == 0.5
    assert one(spark, scoring.file_set_f1(scoring.paths_in(F.col("r")), e), r="b.py and q.py") == 0.5
    assert one(spark, scoring.abstained(F.col("r")), r="Sorry, I don't know.") and not one(spark, scoring.abstained(F.col("r")), r="known")
    assert one(spark, scoring.judged(F.col("r")), r=" 2 of 3") == pytest.approx(2 / 3)


def test_seeded_sample_is_a_partial_shuffle(spark):
    size, n, seed = 40, 7, 11
    state, copy = seed, list(range(size))
    for i in range(size - 1, size - 1 - n, -1):
        state = (state * 1664525 + 1013904223) & 0x7FFFFFFF
        j = int(state / 0x7FFFFFFF * (i + 1))
        copy[i], copy[j] = copy[j], copy[i]
    got = scoring.seeded_sample(spark.range(size).withColumn("v", F.col("id") * 2), "id", n, seed).orderBy("position").collect()
    assert [r.id for r in got] == copy[-n:]


def test_history(spark):
    c = spark.createDataFrame([("s", 1, 1, "a"), ("s", 2, 2, None), ("s", 3, 3, "a"), ("s", 4, 4, "b")], "scope string, ts int, seq int, fingerprint string")
    assert rows(history.transitions(c)) == [("s", 1)]
    a, b = spark.createDataFrame([("x", "1"), ("y", "1")], "k string, m string"), spark.createDataFrame([("y", "2"), ("z", "1")], "k string, m string")
    assert rows(history.classify(a, b, "k", "m")) == [("x", "removed"), ("y", "changed"), ("z", "added")]


def test_scan_and_min_tokens(spark):
    f = spark.createDataFrame([("src/a.ts",), ("node_modules/x.js",), (".hid/a.py",), ("src/gen/b.ts",), ("Makefile",), ("src/pic.png",)], "file string").select("file", t.dirname(F.col("file")).alias("dir"), t.basename(F.col("file")).alias("name"))
    assert rows(scan.scan(f, ["gen"]).select("file")) == [("Makefile",), ("src/a.ts",)]
    d = spark.createDataFrame([(".", 1), ("a", 1), ("a/b", 9), ("c", 2)], "dir string, tokens int")
    assert rows(stats.min_token_filter(d, 5)) == [(".", 1), ("a", 1), ("a/b", 9)]


def test_extraction(spark):
    files = spark.createDataFrame(
        [
            ("a.ts", "// TODO(ann): tidy this up\nimport { A, type B as C } from './m'\nimport D from \"./d\"\nimport './side'\nexport function run() {}\nfunction hidden() {}\nbus.emit('go'); console.on('x')\nconst k = process.env.API_KEY\nconst s = 'TODO: not this'\nexport interface P { id: string; n?: number }\n"),
            ("b.py", "from .pkg import one, two\nimport os\nX = os.getenv('TOKEN_X')\ndef public():\n    pass\ndef _private():\n    pass\n"),
        ],
        "file string, text string",
    )
    assert rows(extract.environment(files)) == [("a.ts", "API_KEY"), ("b.py", "TOKEN_X")]
    assert rows(extract.markers(files).select("file", "line", "marker", "author", "body")) == [("a.ts", 1, "TODO", "ann", "tidy this up")]
    assert rows(extract.events(files)) == [("a.ts", 'emit("go") via bus')]
    got = {(r.file, r.path): r.symbols for r in extract.import_bindings(files).collect()}
    assert got[("a.ts", "./m")] == ["A", "B as C"] and got[("a.ts", "./d")] == ["default as D"] and got[("b.py", ".pkg")] == ["one", "two"] and got[("a.ts", "./side")] == ["(side effect)"]
    assert rows(extract.exports(files)) == [("a.ts", "P"), ("a.ts", "run"), ("b.py", "public")]
    assert rows(extract.internals(files)) == [("a.ts", "hidden"), ("a.ts", "k"), ("a.ts", "s"), ("b.py", "_private")]
    assert rows(extract.internal_dependencies(files)) == [("a.ts", "./d"), ("a.ts", "./m"), ("b.py", ".pkg")]
    assert rows(extract.data_models(files).select("name", F.array_join("fields", ";"))) == [("P", "id: string;n?: number")]


def test_constants_are_whole():
    assert len(k.STOPWORDS) == 32 or len(k.STOPWORDS) == len(set(k.STOPWORDS))
    assert len(k.IGNORED_DIRS) == 28 and len(k.SPECIAL_FILES) == 12
    assert re.match(scoring.PATH, "a/b.ts")
