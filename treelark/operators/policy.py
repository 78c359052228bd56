"""Policy rules as queries over the index; each gives violations (rule, kind, scope, file, line, symbol, to, message)."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as k
from ..functions import text as t

VIOLATION = ("rule", "kind", "scope", "file", "line", "symbol", "to", "message")


def violation(rows: DataFrame, rule: dict, scope: str, message: Column, **columns: Column) -> DataFrame:
    types = {"line": "int"}
    cols = [columns.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c) for c in ("file", "line", "symbol", "to")]
    return rows.select(F.lit(rule.get("name", rule["kind"])).alias("rule"), F.lit(rule["kind"]).alias("kind"), F.lit(scope).alias("scope"), *cols, message.alias("message"))


def forbid_import(index: dict[str, DataFrame], rule: dict, scope: str) -> DataFrame:
    target = F.coalesce("resolved_to", "raw")
    rows = index["imports"].where(t.in_scope(F.col("from_file"), F.lit(scope)) & t.matches_glob(F.col("from_file"), rule["from"]) & t.matches_glob(target, rule["to"]))
    return violation(rows, rule, scope, F.concat(F.lit("forbidden import of "), target), file=F.col("from_file"), line=F.col("line"), to=target)


def require_import(index: dict[str, DataFrame], rule: dict, scope: str) -> DataFrame:
    files = index["files"].where(t.in_scope(F.col("file"), F.lit(scope)) & t.matches_glob(F.col("file"), rule["from"])).select("file")
    ok = index["imports"].where(t.matches_glob(F.coalesce("resolved_to", "raw"), rule["to"])).select(F.col("from_file").alias("file"))
    return violation(files.join(ok, "file", "left_anti"), rule, scope, F.lit(f"imports nothing that matches {rule['to']}"), file=F.col("file"))


def require_export(index: dict[str, DataFrame], rule: dict, scope: str) -> DataFrame:
    own = index["symbols"].where(F.col("exported") & t.in_scope(F.col("file"), F.lit(scope)) & (F.col("name") == rule["symbol"]))
    if rule.get("symbol_kind"):
        own = own.where(F.col("kind") == rule["symbol_kind"])
    none = own.agg(F.count("*").alias("n")).where("n = 0")
    return violation(none, rule, scope, F.lit(f"no export named {rule['symbol']}"), symbol=F.lit(rule["symbol"]))


def max_file_lines(index: dict[str, DataFrame], rule: dict, scope: str) -> DataFrame:
    rows = index["files"].where(t.in_scope(F.col("file"), F.lit(scope)) & F.col("text").isNotNull())
    if rule.get("exclude"):
        rows = rows.where(~t.matches_glob(F.col("file"), rule["exclude"]))
    rows = rows.withColumn("n", t.line_count(F.col("text"))).where(F.col("n") > rule["value"])
    return violation(rows, rule, scope, F.concat(F.col("n").cast("string"), F.lit(f" lines, {rule['value']} allowed")), file=F.col("file"), line=F.col("n"))


def require_test_file(index: dict[str, DataFrame], rule: dict, scope: str) -> DataFrame:
    """The template's {name} and {ext} come from the source; a test may lie anywhere."""
    base = F.regexp_replace(t.basename(F.col("file")), r"\.[^.]*$", "")
    ext = F.regexp_replace(t.extension(F.col("file")), r"^\.", "")
    wanted = F.replace(F.replace(F.lit(rule["pattern"]), F.lit("{name}"), base), F.lit("{ext}"), ext)
    files = index["files"].select("file")
    sources = files.where(t.in_scope(F.col("file"), F.lit(scope)) & t.matches_glob(F.col("file"), rule["source"]) & ~t.basename(F.col("file")).rlike(r"(^test_|[._-](test|spec)\.)"))
    have = files.select(t.basename(F.col("file")).alias("wanted"))
    return violation(sources.withColumn("wanted", wanted).join(have, "wanted", "left_anti"), rule, scope, F.concat(F.lit("no test file "), F.col("wanted")), file=F.col("file"))


def dependency_boundary(index: dict[str, DataFrame], rule: dict, scope: str) -> DataFrame:
    target = F.coalesce("resolved_to", "raw")
    rows = index["imports"].where(t.in_scope(F.col("from_file"), F.lit(scope)) & t.matches_glob(F.col("from_file"), rule["from"]) & ~t.matches_glob(target, rule["allowed_to"]))
    return violation(rows, rule, scope, F.concat(F.lit("crosses the boundary to "), target), file=F.col("from_file"), line=F.col("line"), to=target)


def evidence_requires(index: dict[str, DataFrame], rule: dict, scope: str) -> DataFrame:
    """One row for a scope without evidence, else one for each field that fails, in a fixed order."""
    rows = index["evidence"].where(t.in_scope(F.col("scope"), F.lit(scope)))
    fields = [f for f in ("test_status", "typecheck", "lint_status", "coverage_min") if f in rule]
    checks = []
    for i, f in enumerate(fields):
        have = F.col("coverage" if f == "coverage_min" else f)
        ok = have >= rule[f] if f == "coverage_min" else have == rule[f]
        checks.append(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(i).alias("i"), F.lit(f).alias("field"))))
    failed = F.filter(F.array(*checks), lambda x: x.isNotNull())
    bare = F.col("test_status").isNull() & F.col("lint_status").isNull()
    each = rows.select("scope", F.explode(F.when(bare, F.array(F.struct(F.lit(-1).alias("i"), F.lit("evidence").alias("field")))).otherwise(failed)).alias("f"))
    return violation(each, rule, scope, F.concat(F.col("f.field"), F.lit(" doesn't hold in "), F.col("scope")), file=F.col("scope"), symbol=F.col("f.field"))


EVALUATORS: dict[str, Callable] = {f.__name__: f for f in (forbid_import, require_import, require_export, max_file_lines, require_test_file, dependency_boundary, evidence_requires)}
_FIELDS = {
    "forbid_import": ({"from", "to"}, set()), "require_import": ({"from", "to"}, set()), "require_export": ({"symbol"}, {"symbol_kind"}), "max_file_lines": ({"value"}, {"exclude"}),
    "require_test_file": ({"source", "pattern"}, set()), "dependency_boundary": ({"from", "allowed_to"}, set()), "evidence_requires": (set(), {"test_status", "typecheck", "lint_status", "coverage_min"}),
}


def check_rule(rule: dict) -> list[str]:
    """What is wrong with a rule: its kind, missing and unknown fields, limits."""
    kind = rule.get("kind")
    if kind not in _FIELDS:
        return [f"unknown kind {kind!r}"]
    need, may = _FIELDS[kind]
    names = set(rule) - {"kind", "name", "message"}
    out = [f"missing {x}" for x in sorted(need - names)] + [f"unknown field {x}" for x in sorted(names - need - may)]
    if kind == "max_file_lines" and not (isinstance(rule.get("value"), int) and rule["value"] > 0):
        out.append("value must be a positive whole number")
    if kind == "evidence_requires" and rule.get("typecheck") not in (None, "clean"):
        out.append("typecheck can only ask for clean")
    if kind == "require_export" and not re.fullmatch(r"[A-Za-z_$][\w$ ]*", str(rule.get("symbol", ""))):
        out.append("symbol must be an identifier")
    return out


def evaluate(index: dict[str, DataFrame], rules: list[tuple[str, dict]]) -> DataFrame:
    """Violations of (scope, rule) pairs, by scope and in the order given; a plan of one branch per rule."""
    parts = [EVALUATORS[r["kind"]](index, r, s).withColumn("rule_order", F.lit(i)) for i, (s, r) in enumerate(sorted(rules, key=lambda x: x[0]))]
    if not parts:
        return next(iter(index.values())).sparkSession.createDataFrame([], "rule string, kind string, scope string, file string, line int, symbol string, to string, message string, rule_order int")
    return reduce(DataFrame.unionByName, parts)


def report(index: dict[str, DataFrame], rules: list[tuple[str, dict]], cap: int = k.VIOLATION_CAP) -> DataFrame:
    """The first violations in order."""
    return evaluate(index, rules).orderBy("rule_order", "file", "line", "to").limit(cap)


def summary(index: dict[str, DataFrame], rules: list[tuple[str, dict]], cap: int = k.VIOLATION_CAP) -> DataFrame:
    """One row: rules evaluated and passed, violations, ok, truncated."""
    by = evaluate(index, rules).groupBy("rule_order").agg(F.count("*").alias("n"))
    n = len(rules)
    total = F.coalesce(F.sum("n"), F.lit(0))
    return by.agg(F.lit(n).cast("long").alias("evaluated"), (F.lit(n) - F.count("*")).alias("passed"), total.alias("violations"), (total == 0).alias("ok"), (total > cap).alias("truncated"))


def overlapping(violations: DataFrame, scopes: DataFrame) -> DataFrame:
    """Violations that lie in a chosen scope, or whose scope holds or is held by one: ancestors are joined, not prefixes."""
    up = violations.withColumn("_id", F.xxhash64(*violations.columns))  # equal rows have equal answers
    above = up.select("_id", F.explode(F.array_union(t.ancestors(F.col("scope")), F.when(F.col("file").isNotNull(), t.ancestors(F.col("file"))).otherwise(F.array().cast("array<string>")))).alias("at"))
    down = scopes.select(F.explode(t.ancestors(F.col("scope"))).alias("at")).distinct()
    hit = above.join(scopes.select(F.col("scope").alias("at")), "at").select("_id").unionByName(up.join(down, F.col("scope") == F.col("at")).select("_id")).distinct()
    return up.join(hit, "_id", "left_semi").drop("_id")


def attributed(violations: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, violations): counts by every scope that is a violation's own or an ancestor of its file."""
    each = violations.select(F.explode(F.array_distinct(F.concat(F.array("scope"), F.when(F.col("file").isNotNull(), t.ancestors(F.col("file"))).otherwise(F.array().cast("array<string>"))))).alias("at"))
    return each.join(scopes.select(F.col("scope").alias("at")).distinct(), "at").groupBy(F.col("at").alias("scope")).agg(F.count("*").alias("violations"))
