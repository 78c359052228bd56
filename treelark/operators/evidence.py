"""Evidence: parsers of test, type, lint and coverage output, merging, and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as k
from ..functions import text as t

_EVIDENCE = ("test_status", "test_count", "failing_tests", "typecheck", "lint_status", "coverage_percent")


def _struct(**c: Column) -> Column:
    kinds = {"test_status": "string", "test_count": "int", "failing_tests": "array<string>", "typecheck": "string", "lint_status": "string", "coverage_percent": "double"}
    return F.struct(*(c.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in _EVIDENCE))


def test_json(out: Column) -> Column:
    """Runner JSON, noise before and after the outermost braces left out; failing suites sorted, at most 50."""
    j = F.from_json(F.regexp_extract(out, r"(?s)\{.*\}", 0), "success boolean, numTotalTests int, numPassedTests int, numFailedTests int, testResults array<struct<name:string,status:string>>")
    failing = F.slice(F.array_sort(F.transform(F.filter(j["testResults"], lambda s: (s["status"] == "failed") & s["name"].isNotNull()), lambda s: s["name"])), 1, k.CAPS["failing_tests"])
    passed, failed = j["numPassedTests"], j["numFailedTests"]
    known = j["success"].isNotNull()
    both = passed.isNotNull() & failed.isNotNull()
    return _struct(
        test_status=F.when(known, F.when(j["success"], "passing").otherwise("failing")).when(both, F.when(failed == 0, "passing").otherwise("failing")).otherwise("unknown"),
        test_count=F.when(known, j["numTotalTests"]).when(both, passed + failed), failing_tests=F.when(known & ~j["success"] & (F.size(failing) > 0), failing),
    )


def junit(out: Column, first: bool = False) -> Column:
    """JUnit XML attributes, summed over suites or (first) of the first one."""

    def number(name: str) -> Column:
        all_ = F.transform(F.regexp_extract_all(out, F.lit(rf"""<testsuite\b[^>]*?\s{name}=["'](\d+)["']"""), F.lit(1)), lambda x: x.cast("int"))
        return F.coalesce(F.get(all_, F.lit(0)), F.lit(0)) if first else F.aggregate(all_, F.lit(0), lambda a, x: a + x)

    bad = number("failures") + number("errors")
    some = out.rlike(r"<testsuite\b")
    return _struct(test_status=F.when(~some, "unknown").when(bad > 0, "failing").otherwise("passing"), test_count=F.when(some, number("tests")))


def go_test(rows: DataFrame, key: str, out: str) -> DataFrame:
    """(key, evidence): the last action of each test decides, skipped ones don't count; failing ones sorted, at most 50."""
    lines = rows.select(key, F.posexplode(F.split(out, "\n")).alias("at", "line")).select(key, "at", F.from_json("line", "Action string, Test string, Package string").alias("j"))
    last = lines.where("j.Test IS NOT NULL AND j.Action IN ('pass', 'fail', 'skip')").groupBy(key, "j.Package", "j.Test").agg(F.max_by("j.Action", "at").alias("action")).where("action <> 'skip'")
    per = last.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("action") == "fail", F.col("Test")))).alias("failing"))
    return per.select(key, _struct(test_status=F.when(F.size("failing") > 0, "failing").otherwise("passing"), test_count=F.col("n"), failing_tests=F.when(F.size("failing") > 0, F.slice("failing", 1, k.CAPS["failing_tests"]))).alias("evidence"))


def eslint(out: Column) -> Column:
    files = F.from_json(F.regexp_extract(out, r"(?s)\[.*\]", 0), "array<struct<errorCount:int>>")
    errors = F.aggregate(files, F.lit(0), lambda a, x: a + F.coalesce(x["errorCount"], F.lit(0)))
    return _struct(lint_status=F.when(files.isNull(), "unknown").when(errors > 0, "errors").otherwise("clean"))


def tsc(exit_code: Column, out: Column) -> Column:
    return _struct(typecheck=F.when((exit_code == 0) & ~out.rlike(r"error TS\d+"), "clean").otherwise("errors"))


def coverage(out: Column, path: str = "$.total.lines.pct") -> Column:
    """A percentage in JSON, kept within 0 to 100; path '$.totals.percent_covered' for the other common format."""
    value = F.get_json_object(out, path).try_cast("double")
    return _struct(coverage_percent=F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)))


def exit_status(exit_code: Column, kind: str) -> Column:
    good, bad = {"test": ("passing", "failing"), "lint": ("clean", "errors"), "typecheck": ("clean", "errors"), "build": ("clean", "errors")}[kind]
    status = F.when(exit_code == 0, good).otherwise(bad)
    return _struct(**{{"test": "test_status", "lint": "lint_status"}.get(kind, "typecheck"): status})


def parser_for(kind: Column, explicit: Column, command: Column) -> Column:
    """The parser named, or guessed from the command, or the kind's own."""
    cmd = F.lower(F.coalesce(command, F.lit("")))
    has = lambda *w: F.greatest(*(F.contains(cmd, F.lit(x)) for x in w), F.lit(False))
    guess = (
        F.when((kind == "test") & has("jest"), "jest-json").when((kind == "test") & has("vitest"), "vitest-json").when((kind == "test") & has("go test"), "go-test-json")
        .when((kind == "test") & has("pytest", "junit", "surefire"), "junit-xml").when((kind == "lint") & has("eslint"), "eslint-json").when((kind == "typecheck") & has("tsc"), "tsc")
        .when((kind == "coverage") & has("pytest", "--cov"), "pytest-cov").when(kind == "coverage", "istanbul-summary").otherwise("exit-code")
    )
    return F.coalesce(explicit, guess)


def merged(evidence: DataFrame, key: str, order: Column) -> DataFrame:
    """Later kinds win, field by field, where they have a value; a failed build makes the type check fail."""
    fields = [f for f in _EVIDENCE if f in evidence.columns]
    out = evidence.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields), *([F.bool_or("build_failed").alias("build_failed")] if "build_failed" in evidence.columns else []))
    if "build_failed" in out.columns and "typecheck" in fields:
        out = out.withColumn("typecheck", F.when(F.col("build_failed"), "errors").otherwise(F.col("typecheck"))).drop("build_failed")
    return out


def command_for(scopes: DataFrame, commands: DataFrame) -> DataFrame:
    """(scope, command): the deepest ancestor's override wins. An equi-join over ancestors."""
    up = scopes.select("scope", F.explode(t.ancestors(F.col("scope"))).alias("at"))
    return up.join(commands.select(F.col("scope").alias("at"), "command"), "at").groupBy("scope").agg(F.max_by("command", t.depth(F.col("at"))).alias("command"))


def by_artifact(scopes: DataFrame) -> DataFrame:
    """Type and lint status count only where their artifact is no older than the newest source."""
    ok = lambda c: F.when(F.col(f"{c}_mtime") >= F.col("newest_source"), F.col(c))
    return scopes.withColumns({"typecheck": ok("typecheck"), "lint_status": ok("lint_status")})


def health(evidence: DataFrame) -> DataFrame:
    """One row: counts by status, tests, coverage (null without any) and the scopes whose tests fail."""
    n = lambda c, v: F.count_if(F.col(c) == v)
    return evidence.agg(
        F.count_if(F.col("test_status").isNotNull() | F.col("lint_status").isNotNull()).alias("with_evidence"), n("test_status", "passing").alias("passing"), n("test_status", "failing").alias("failing"),
        n("lint_status", "clean").alias("lint_clean"), n("lint_status", "errors").alias("lint_errors"), F.coalesce(F.sum("test_count"), F.lit(0)).alias("tests"),
        F.count("coverage").alias("covered"), t.round_half_up(F.avg("coverage")).alias("coverage_avg"), F.min("coverage").alias("coverage_min"), F.max("coverage").alias("coverage_max"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("test_status") == "failing", F.col("scope")))), ",").alias("failing_scopes"),
    )


def scope_status(results: DataFrame) -> DataFrame:
    """(scope, status) of results(scope, ok, has_context): ok, partial, failed or no_context."""
    good, bad = F.count_if("ok"), F.count_if(~F.col("ok"))
    return results.groupBy("scope").agg(F.when(~F.bool_or("has_context"), "no_context").when(bad == 0, "ok").when(good == 0, "failed").otherwise("partial").alias("status"))
