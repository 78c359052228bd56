"""Queries over artifacts - tool output, sources, paths - that are written from the driver's rows, a text per document; the
SQL twins know from the same rows what must be read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import evidence, extract, graph, reports, scan, scoring, stats
from .catalogue import query
from .relations import Tables, with_


def _cat(*parts) -> Column:
    """Strings and columns put together."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _artifacts(x: Tables, *parts, **more) -> DataFrame:
    """doc_id and a text of documents, and further columns."""
    return x.table("documents").select("doc_id", _cat(*parts).alias("out"), *(v.alias(k) for k, v in more.items()))


def _id() -> Column:
    return F.col("doc_id")


# resolution


@query(with_("files", ", e AS (SELECT dir || '/' || doc_id || '.py' AS from_file, CASE doc_id % 3 WHEN 0 THEN '.' || (doc_id + 1) WHEN 1 THEN '..' || lang || '.' || (doc_id + 1) ELSE lang || '.' || (doc_id + 1) END AS raw, dir, doc_id FROM files) SELECT e.from_file, e.raw, g.dir || '/' || g.doc_id || '.py' AS resolved_to FROM e LEFT JOIN files g ON g.doc_id = e.doc_id + 1 AND g.dir = e.dir"))
def python_imports(x: Tables) -> DataFrame:
    f = x.files().select("dir", "lang", "doc_id")
    raw = F.when(_id() % 3 == 0, _cat(".", _id() + 1)).when(_id() % 3 == 1, _cat("..", F.col("lang"), ".", _id() + 1)).otherwise(_cat(F.col("lang"), ".", _id() + 1))
    edges = f.select(_cat(F.col("dir"), "/", _id(), ".py").alias("from_file"), raw.alias("raw"))
    return graph.resolve(edges, f.select(_cat(F.col("dir"), "/", _id(), ".py").alias("file")), graph.python_candidates(F.col("from_file"), F.col("raw")))


@query(with_("files", ", s AS (SELECT doc_id % 20 AS t, doc_id % 5 AS n, min(doc_id) AS symbol_id FROM files GROUP BY ALL) SELECT symbol_id, file, doc_id AS at FROM files JOIN s ON t = doc_id % 20 AND n = doc_id % 5"))
def reference_backfill(x: Tables) -> DataFrame:
    f = x.files().select("file", "doc_id")
    edge = lambda more: f.select(F.col("file").alias("from_file"), _cat("m", _id() % 7).alias("raw"), _cat("t", (_id() + more) % 20).alias("resolved_to"), (_id() + more).alias("line"))
    symbols = f.select(_cat("t", _id() % 20).alias("file"), _cat("n", _id() % 5).alias("name"), _id().alias("id"), _id().alias("at"))
    return graph.backfill(f.select("file", _cat("m", _id() % 7).alias("raw"), _cat("n", _id() % 5).alias("name"), _id().alias("at")), edge(0).unionByName(edge(1)), symbols)


# evidence


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 2 AND doc_id % 4 = 0) THEN 'passing' ELSE 'failing' END AS test_status, CAST(CASE WHEN doc_id % 3 = 2 THEN 5 + doc_id % 4 ELSE doc_id % 90 END AS INT) AS test_count, CASE WHEN doc_id % 3 = 1 THEN 'a' || doc_id || ',b' END AS failing FROM documents")
def test_json_evidence(x: Tables) -> DataFrame:
    known = F.when(_id() % 3 < 2, _cat('"success": ', F.when(_id() % 3 == 0, "true").otherwise("false"), ', "numTotalTests": ', _id() % 90, ", ")).otherwise(F.lit(""))
    d = _artifacts(x, "starts\n{", known, '"numPassedTests": 5, "numFailedTests": ', _id() % 4, ', "testResults": [{"name": "b", "status": "failed"}, {"name": "c", "status": "passed"}, {"name": "a', _id(), '", "status": "failed"}]}\ndone')
    e = d.select("doc_id", evidence.test_json(F.col("out")).alias("e"))
    return e.select("doc_id", "e.test_status", "e.test_count", F.array_join("e.failing_tests", ",").alias("failing"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'unknown' WHEN doc_id % 3 + doc_id % 2 > 0 THEN 'failing' ELSE 'passing' END AS test_status, CAST(CASE WHEN doc_id % 5 < 4 THEN 7 + doc_id % 50 ELSE -1 END AS INT) AS test_count, CASE WHEN doc_id % 5 = 4 THEN 'unknown' WHEN doc_id % 2 > 0 THEN 'failing' ELSE 'passing' END AS first_status FROM documents")
def junit_evidence(x: Tables) -> DataFrame:
    suites = _cat('<testsuites><testsuite name="x" tests="7" failures="0" errors="', _id() % 2, "\"></testsuite>\n<testsuite failures='", _id() % 3, "' tests='", _id() % 50, "'/></testsuites>")
    d = _artifacts(x, F.when(_id() % 5 == 4, F.lit("no xml")).otherwise(suites))
    return d.select("doc_id", evidence.junit(F.col("out")).alias("e"), evidence.junit(F.col("out"), True).alias("f")).select("doc_id", "e.test_status", F.coalesce("e.test_count", F.lit(-1)).alias("test_count"), F.col("f.test_status").alias("first_status"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'failing' ELSE 'passing' END AS test_status, CAST(CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 2 END AS INT) AS test_count, CASE WHEN doc_id % 4 = 1 THEN 'T' || doc_id END AS failing FROM documents")
def go_test_evidence(x: Tables) -> DataFrame:
    line = lambda action, test: _cat('{"Action": "', action, '", "Package": "p", "Test": "', test, '"}\n')
    last = F.when(_id() % 4 == 1, F.lit("fail")).when(_id() % 4 == 2, F.lit("skip")).otherwise(F.lit("pass"))
    d = _artifacts(x, line("run", _cat("T", _id())), line("fail", _cat("T", _id())), line("fail", "U"), "not json\n", line(last, _cat("T", _id())), line("pass", "U"), '{"Action": "pass", "Package": "p"}')
    return evidence.go_test(d, "doc_id", "out").select("doc_id", "evidence.test_status", "evidence.test_count", F.array_join("evidence.failing_tests", ",").alias("failing"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 'unknown' WHEN doc_id % 3 = 0 THEN 'clean' ELSE 'errors' END AS lint_status, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 > 0 THEN 'clean' ELSE 'errors' END AS typecheck, least(greatest(CAST(doc_id % 130 AS DOUBLE) - 10, 0), 100) AS coverage FROM documents")
def lint_type_coverage(x: Tables) -> DataFrame:
    lint = F.when(_id() % 7 == 6, F.lit("crashed")).otherwise(_cat('warn [{"errorCount": ', _id() % 3, '}, {"errorCount": 0}, {}] end'))
    d = _artifacts(x, lint, tsc=F.when(_id() % 5 == 0, F.lit("a.ts(1,2): error TS2304: none")).otherwise(F.lit("ok")), cov=_cat('{"total": {"lines": {"pct": ', _id() % 130 - 10, "}}}"))
    return d.select("doc_id", evidence.eslint(F.col("out"))["lint_status"].alias("lint_status"), evidence.tsc((_id() % 2).cast("int"), F.col("tsc"))["typecheck"].alias("typecheck"), evidence.coverage(F.col("cov"))["coverage_percent"].alias("coverage"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'passing' ELSE 'failing' END AS test, CASE WHEN doc_id % 2 = 0 THEN 'clean' ELSE 'errors' END AS lint, CASE WHEN doc_id % 2 = 0 THEN 'clean' ELSE 'errors' END AS build FROM documents")
def exit_statuses(x: Tables) -> DataFrame:
    d, code = x.table("documents").select("doc_id"), (_id() % 2).cast("int")
    return d.select("doc_id", evidence.exit_status(code, "test")["test_status"].alias("test"), evidence.exit_status(code, "lint")["lint_status"].alias("lint"), evidence.exit_status(code, "build")["typecheck"].alias("build"))


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'own' ELSE ['jest-json', 'vitest-json', 'go-test-json', 'junit-xml', 'eslint-json', 'tsc', 'pytest-cov', 'istanbul-summary', 'exit-code', 'exit-code'][doc_id % 10 + 1] END AS parser FROM documents")
def parser_choice(x: Tables) -> DataFrame:
    kinds = F.array(*map(F.lit, ("test", "test", "test", "test", "lint", "typecheck", "coverage", "coverage", "test", "build")))
    commands = F.array(*map(F.lit, ("npx JEST --json", "vitest run", "go test ./...", "pytest -q", "eslint .", "tsc --noEmit", "pytest --cov", "nyc", "make", "jest")))
    d, at = x.table("documents").select("doc_id"), (_id() % 10 + 1).cast("int")
    return d.select("doc_id", evidence.parser_for(F.element_at(kinds, at), F.when(_id() % 11 == 0, "own"), F.element_at(commands, at)).alias("parser"))


@query("SELECT doc_id, CASE WHEN n_chars % 3 <= n_chars % 5 THEN 'clean' END AS typecheck, CASE WHEN n_chars % 3 <= n_chars % 4 THEN 'errors' END AS lint_status FROM documents")
def artifact_age(x: Tables) -> DataFrame:
    n = F.col("n_chars")
    d = x.table("documents").select("doc_id", F.lit("clean").alias("typecheck"), F.lit("errors").alias("lint_status"), (n % 3).alias("newest_source"), (n % 5).alias("typecheck_mtime"), (n % 4).alias("lint_status_mtime"))
    return evidence.by_artifact(d).select("doc_id", "typecheck", "lint_status")


@query(with_("files", "SELECT DISTINCT dir AS scope, CASE WHEN lang = 'en' THEN 'deep ' || dir WHEN CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'source ' || source ELSE 'root' END AS command FROM files"))
def command_overrides(x: Tables) -> DataFrame:
    f = x.files()
    rows = f.where("lang = 'en'").select(F.col("dir").alias("scope"), _cat("deep ", F.col("dir")).alias("command")).distinct()
    rows = rows.unionByName(f.where(F.substring("source", 4, 9).try_cast("int") % 2 == 0).select(F.col("source").alias("scope"), _cat("source ", F.col("source")).alias("command")).distinct())
    rows = rows.unionByName(x.spark.range(1).select(F.lit(".").alias("scope"), F.lit("root").alias("command")))
    return evidence.command_for(f.select(F.col("dir").alias("scope")).distinct(), rows)


# sources


def _sources(x: Tables) -> DataFrame:
    body = _cat(
        "// import { no } from './comment'\nimport { a", _id(), ", b as c } from './m", _id() % 100, "';\nimport d", _id(), " from \"../n\";\nimport './effect';\nconst r = require('./r", _id() % 10, "');\n",
        "export async function f", _id(), "(x) {}\nclass Hidden", _id(), " {}\nexport const k", _id(), " = 1;\ninterface Shape", _id(), " {\n  readonly left: number;\n  right?: string;\n}\n",
    )
    return x.table("documents").select(_cat(_id(), ".ts").alias("file"), body.alias("text"))


@query("SELECT doc_id || '.ts' AS file, unnest(['f' || doc_id, 'k' || doc_id]) AS name FROM documents")
def export_names(x: Tables) -> DataFrame:
    return extract.exports(_sources(x))


@query("SELECT doc_id || '.ts' AS file, unnest(['Hidden' || doc_id, 'Shape' || doc_id, 'r']) AS name FROM documents")
def internal_names(x: Tables) -> DataFrame:
    return extract.internals(_sources(x))


@query("SELECT doc_id || '.ts' AS file, unnest(['./m' || doc_id % 100, '../n', './r' || doc_id % 10]) AS target FROM documents")
def relative_imports(x: Tables) -> DataFrame:
    return extract.internal_dependencies(_sources(x))


@query("SELECT doc_id || '.ts' AS file, unnest(['./m' || doc_id % 100, '../n', './effect']) AS path, unnest(['a' || doc_id || '|b as c', 'default as d' || doc_id, '(side effect)']) AS symbols FROM documents")
def imported_symbols(x: Tables) -> DataFrame:
    return extract.import_bindings(_sources(x)).withColumn("symbols", F.array_join("symbols", "|"))


@query("SELECT doc_id || '.ts' AS file, 'Shape' || doc_id AS name, 'left: number|right?: string' AS fields FROM documents")
def model_fields(x: Tables) -> DataFrame:
    return extract.data_models(_sources(x)).withColumn("fields", F.array_join("fields", "|"))


# paths, tables, reports


@query(with_("files", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '.' ELSE dir END AS dir, doc_id || '.Tar.GZ' AS name, '.gz' AS ext, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 3 END AS depth FROM files"))
def path_parts(x: Tables) -> DataFrame:
    f = x.files().select("doc_id", F.when(_id() % 4 == 0, _cat(_id(), ".Tar.GZ")).otherwise(_cat(F.col("dir"), "/", _id(), ".Tar.GZ")).alias("p"))
    return f.select("doc_id", t.dirname(F.col("p")).alias("dir"), t.basename(F.col("p")).alias("name"), t.extension(F.col("p")).alias("ext"), t.depth(F.col("p")).alias("depth"))


@query("SELECT doc_id, doc_id % 6 IN (0, 1, 2) AS generated, doc_id % 6 = 3 AS in_tests FROM documents")
def path_kinds(x: Tables) -> DataFrame:
    shapes = F.array(*map(F.lit, ("a/dist/x.js", "lib/x.min.js", "x_pb2.py", "a/__tests__/x.ts", "distance/x.ts", "latest/x.ts")))
    d = x.table("documents").select("doc_id", F.element_at(shapes, (_id() % 6 + 1).cast("int")).alias("p"))
    return d.select("doc_id", reports.is_generated(F.col("p")).alias("generated"), reports.in_test_dir(F.col("p")).alias("in_tests"))


@query("SELECT doc_id AS scope, lang, 2 AS version FROM documents")
def projected_fields(x: Tables) -> DataFrame:
    d = x.table("documents").select(_id().alias("scope"), "lang", "source", "text", F.lit(2).alias("version"))
    return scan.project(d, ["lang", "nothing_such"])


@query("SELECT doc_id || '.md' AS file, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS size FROM documents WHERE doc_id % 7 <> 3 OR doc_id % 5 = 0")
def replaced_files(x: Tables) -> DataFrame:
    d = x.table("documents").select(_cat(_id(), ".md").alias("file"), F.col("n_chars").alias("size"), "doc_id")
    fresh = d.where(_id() % 5 == 0).select("file", (F.col("size") + 1).alias("size"))
    return scan.replace_files(d.select("file", "size"), fresh, d.where(_id() % 7 == 3).select("file"))


@query("SELECT doc_id || '.md' AS file FROM documents WHERE doc_id % 3 = 1")
def dropped_files(x: Tables) -> DataFrame:
    d = x.table("documents").select(_cat(_id(), ".md").alias("file"), "doc_id")
    return scan.dropped_files(d.select("file"), d.where(_id() % 3 != 1).select("file"))


@query(with_("files", ", d AS (SELECT dir, CAST(ceil(sum(size) / 4) AS BIGINT) AS tokens, sum(size) % 5000 AS chars, any_value(lang) AS lang FROM files GROUP BY dir) SELECT dir, tokens AS source_tokens, CASE WHEN lang <> 'de' THEN CAST(ceil(chars / 4) AS BIGINT) ELSE -1 END AS context_tokens, CASE WHEN lang <> 'de' THEN greatest(tokens - CAST(ceil(chars / 4) AS BIGINT), 0) ELSE 0 END AS saved, lang <> 'de' AS tracked FROM d"))
def scope_rows(x: Tables) -> DataFrame:
    f = x.files()
    c = f.where("lang <> 'de'").groupBy(F.col("dir").alias("scope")).agg((F.sum("size") % 5000).alias("context_chars"))
    return stats.scope_rows(stats.dir_tokens(f), c).withColumn("context_tokens", F.coalesce("context_tokens", F.lit(-1)))


_STATES = "CASE doc_id % 5 WHEN 0 THEN 'fresh' WHEN 1 THEN 'cosmetic_stale' WHEN 2 THEN 'semantic_stale' WHEN 3 THEN 'missing' END"


def _states(x: Tables) -> DataFrame:
    return x.files().select(F.col("file").alias("scope"), "doc_id", "dir", F.expr(_STATES).alias("state"))


@query(f"SELECT count(*) AS scopes, count(*) FILTER (s = 'fresh') AS fresh, count(*) FILTER (s = 'cosmetic_stale') AS cosmetic_stale, count(*) FILTER (s = 'semantic_stale') AS semantic_stale, count(*) FILTER (s = 'missing') AS missing, count(*) FILTER (s IS NULL) AS unknown, count(*) FILTER (doc_id % 9 = 0) AS violations FROM (SELECT doc_id, {_STATES} AS s FROM documents)")
def view_totals(x: Tables) -> DataFrame:
    return reports.view_totals(_states(x), _states(x).where(_id() % 9 == 0))


@query(with_("files", f"SELECT dir, CAST(doc_id AS VARCHAR) AS name, coalesce({_STATES}, 'missing') AS state FROM files"))
def child_states(x: Tables) -> DataFrame:
    s = _states(x)
    return reports.child_states(s.select(F.col("scope").alias("dir"), F.col("dir").alias("parent")), s.select("scope", "state"))


@query("SELECT source, count(*) AS n, floor(count(*) * 1000 / any_value(total) + 0.5) / 10 AS share FROM documents, (SELECT count(*) AS total FROM documents) GROUP BY source")
def generation_metrics(x: Tables) -> DataFrame:
    return reports.generation_metrics(x.table("documents").select("source"))


@query(f"SELECT conv_id, turn, regexp_matches(text, '{scoring.ABSTAIN.replace(chr(39), chr(39) * 2)}') AS abstained, CASE WHEN regexp_matches(trim(CAST(turn % 6 AS VARCHAR)), '^[0-3]') THEN turn % 6 / 3 ELSE 0.0 END AS judged FROM (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'I don''t know ' WHEN 1 THEN 'There is NO information on ' ELSE '' END || text AS text FROM conversations WHERE text IS NOT NULL)")
def abstentions(x: Tables) -> DataFrame:
    begin = F.when(F.col("conv_id") % 4 == 0, "I don't know ").when(F.col("conv_id") % 4 == 1, "There is NO information on ").otherwise("")
    c = x.table("conversations").where("text IS NOT NULL")
    return c.select("conv_id", "turn", scoring.abstained(F.concat(begin, F.col("text"))).alias("abstained"), scoring.judged(_cat(" ", F.col("turn") % 6, " of 3")).alias("judged"))
