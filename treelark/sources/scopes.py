"""Scope records: one YAML document per directory, read, validated against the closed schema, and written."""

from __future__ import annotations

import json
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import constants as k
from ..functions import text as t
from ..operators import policy

NAME = ".context.yaml"
VERSION = 1
_S, _L = T.StringType(), T.ArrayType(T.StringType())


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_PART = lambda *names: T.ArrayType(_struct(**dict.fromkeys(names, _S)))
EVIDENCE = _struct(collected_at=_S, commit_sha=_S, test_status=_S, test_count=T.IntegerType(), failing_tests=_L, test_tool=_S, typecheck=_S, typecheck_tool=_S, lint_status=_S, lint_tool=_S, coverage_percent=T.DoubleType())
SCHEMA = _struct(
    version=T.IntegerType(), last_updated=_S, fingerprint=_S, semantic_fingerprint=_S, scope=_S, summary=_S, maintenance=_S,
    files=_PART("name", "purpose", "test_file"), interfaces=_PART("name", "description"), decisions=_PART("what", "why", "tradeoff"),
    constraints=_L, environment=_L, testing=_L, todos=_L, data_models=_L, events=_L, config=_L, exports=_L,
    dependencies=_struct(internal=_L, external=_L), current_state=_struct(working=_L, broken=_L, in_progress=_L),
    subdirectories=_PART("name", "summary"), imports=T.ArrayType(_struct(path=_S, symbols=_L)), internals=_PART("name", "kind", "file"),
    project=_struct(name=_S, description=_S, language=_S, framework=_S, package_manager=_S), structure=_PART("path", "summary"),
    evidence=EVIDENCE, rules=_L, derived_fields=_L,
)
_REQUIRED = ("version", "last_updated", "fingerprint", "scope", "summary", "maintenance")
_OPTIONAL_IN = {"files": {"test_file"}, "decisions": {"tradeoff"}, "project": {"language", "framework", "package_manager"}}
_CHOICES = {"test_status": {"passing", "failing", "unknown"}, "typecheck": {"clean", "errors", "unknown"}, "lint_status": {"clean", "errors", "unknown"}}
_INTERNAL_KINDS = {"function", "class", "interface", "type", "enum", "const"}


class UnsupportedVersion(ValueError):
    """A record of a later version than this code knows."""


def findings(record) -> list[str]:
    """What is wrong with a record; nothing for a valid one."""
    if not isinstance(record, dict):
        return ["not a mapping"]
    out = [f"missing {n}" for n in _REQUIRED if n not in record]
    fields = {f.name: f.dataType for f in SCHEMA.fields}
    out += [f"unknown field {n}" for n in record if n not in fields]
    if "version" in record and record["version"] is not True and record["version"] != VERSION:
        out.append("version must be 1")

    def check(value, kind, where: str, name: str) -> None:
        if isinstance(kind, T.StringType):
            if not isinstance(value, str):
                out.append(f"{where} must be a string")
        elif isinstance(kind, T.IntegerType):
            if not isinstance(value, int) or isinstance(value, bool):
                out.append(f"{where} must be a whole number")
        elif isinstance(kind, T.DoubleType):
            if not isinstance(value, int | float) or isinstance(value, bool):
                out.append(f"{where} must be a number")
        elif isinstance(kind, T.ArrayType):
            if not isinstance(value, list):
                out.append(f"{where} must be a list")
            else:
                for i, x in enumerate(value):
                    check(x, kind.elementType, f"{where}[{i}]", name)
        elif not isinstance(value, dict):
            out.append(f"{where} must be a mapping")
        else:
            known = {f.name: f.dataType for f in kind.fields}
            out.extend(f"{where}: unknown field {n}" for n in value if n not in known)
            if name not in ("evidence", "dependencies", "current_state"):
                out.extend(f"{where}: missing {n}" for n in known if n not in value and n not in _OPTIONAL_IN.get(name, set()))
            for n, x in value.items():
                if n in known:
                    check(x, known[n], f"{where}.{n}", name)

    for n, x in record.items():
        if n == "rules":
            if not isinstance(x, list):
                out.append("rules must be a list")
            else:
                out += [f"rules[{i}]: {e}" for i, r in enumerate(x) for e in (policy.check_rule(r) if isinstance(r, dict) else ["not a mapping"])]
        elif n in fields and n != "version":
            check(x, fields[n], n, n)
    if isinstance(record.get("semantic_fingerprint"), str) and not re.fullmatch("[0-9a-f]{12}", record["semantic_fingerprint"]):
        out.append("semantic_fingerprint must be 12 hex digits")
    e = record.get("evidence")
    if isinstance(e, dict):
        out += [f"evidence.{n} must be one of {', '.join(sorted(c))}" for n, c in _CHOICES.items() if n in e and e[n] not in c]
        c = e.get("coverage_percent")
        if isinstance(c, int | float) and not 0 <= c <= 100:
            out.append("evidence.coverage_percent must be within 0 and 100")
    for x in record.get("internals") or []:
        if isinstance(x, dict) and isinstance(x.get("kind"), str) and x["kind"] not in _INTERNAL_KINDS:
            out.append(f"internals: unknown kind {x['kind']}")
    return out


def load(text: str):
    """A record from YAML, or a string that says why there is none."""
    import yaml

    try:
        record = yaml.safe_load(text)
    except yaml.YAMLError:
        return "bad YAML"
    if isinstance(record, dict):
        record = {k: (str(v) if k == "last_updated" and v is not None and not isinstance(v, str | int | float) else v) for k, v in record.items()}
    return record


@F.pandas_udf(T.StructType([T.StructField("record", _S), T.StructField("newer", T.BooleanType()), T.StructField("findings", _L)]))
def parse(content: pd.Series) -> pd.DataFrame:
    """JSON of each valid record, whether its version is a later one, and what is wrong with it."""
    out = []
    for raw in content:
        record = load(bytes(raw).decode("utf-8", "replace") if not isinstance(raw, str) else raw) if raw is not None else "missing"
        if isinstance(record, str):
            out.append((None, False, [record]))
            continue
        bad = findings(record)
        newer = isinstance(record, dict) and isinstance(record.get("version"), int) and record["version"] > VERSION
        if isinstance(record, dict) and isinstance(record.get("rules"), list):
            record = record | {"rules": [json.dumps(r, sort_keys=True, default=str) for r in record["rules"]]}
        out.append((json.dumps(record, default=str) if not bad else None, newer, bad))
    return pd.DataFrame(out, columns=["record", "newer", "findings"])


class ScopeYaml(DataSource):
    """spark.read.format('scope_yaml').option('path', root): (path, content) of every record. File sources of Spark skip
    names that begin with a dot, so directories are listed here; files are read by the tasks."""

    @classmethod
    def name(cls) -> str:
        return "scope_yaml"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path", "."), self.options.get("name", NAME))


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str, name: str):
        self.root, self.name = root, name

    def partitions(self):
        found = []
        for here, dirs, files in os.walk(self.root):
            dirs[:] = sorted(d for d in dirs if d not in k.IGNORED_DIRS and not d.startswith("."))
            if self.name in files:
                found.append(os.path.join(here, self.name))
        return [_Files(found[i : i + 256]) for i in range(0, len(found), 256)] or [_Files([])]

    def read(self, partition):
        for path in partition.paths:
            with open(path, encoding="utf-8", errors="replace") as f:
                yield path, f.read()


def checked(spark: SparkSession, root: str, name: str = NAME) -> DataFrame:
    """(path, record JSON or null, newer, findings) of every scope record below root."""
    spark.dataSource.register(ScopeYaml)
    files = spark.read.format("scope_yaml").option("path", root).option("name", name).load()
    return files.select("path", parse("content").alias("p")).select("path", "p.record", "p.newer", "p.findings")


def read(spark: SparkSession, root: str, name: str = NAME, strict: bool = False) -> DataFrame:
    """The valid records as columns, in order of scope. Invalid ones are left out; strict: a later version raises."""
    rows = checked(spark, root, name)
    if strict and not rows.where("newer").isEmpty():
        raise UnsupportedVersion(f"a record below {root} has a version above {VERSION}")
    return rows.where("record IS NOT NULL").select(F.from_json("record", SCHEMA).alias("r")).select("r.*").orderBy(F.collate("scope", "UNICODE"))


def write(record: dict, path: str) -> None:
    """A valid record as YAML, whole or not at all."""
    import yaml

    bad = findings(record)
    if bad:
        raise ValueError("; ".join(bad))
    draft = f"{path}.{os.getpid()}.tmp"
    with open(draft, "w", encoding="utf-8") as f:
        yaml.safe_dump(record, f, sort_keys=False, allow_unicode=True)
    os.replace(draft, path)


def zones(records: DataFrame) -> DataFrame:
    """scope and the seven zone texts of records."""
    names = lambda c, *f: F.transform(c, lambda x: F.concat_ws(" ", *(x[n] for n in f)))
    j = lambda *parts: F.concat_ws(" ", *parts)
    return records.select(
        "scope", j("summary", "project.description").alias("summary"), j(names(F.col("decisions"), "what", "why", "tradeoff")).alias("decisions"),
        j("constraints", names(F.col("interfaces"), "description")).alias("constraints"),
        j("exports", names(F.col("internals"), "name"), names(F.col("interfaces"), "name"), "data_models", "events", names(F.col("files"), "name"), names(F.col("subdirectories"), "name")).alias("symbols"),
        j("environment", "testing", "config", "todos").alias("facets"), j("current_state.working", "current_state.broken", "current_state.in_progress").alias("state"), F.regexp_replace("scope", "[/._-]", " ").alias("path"),
    )


def nearest(records: DataFrame, path: str) -> DataFrame:
    """The record of the deepest scope that holds a path."""
    return records.where(t.in_scope(F.lit(path), F.col("scope"))).orderBy(F.desc(t.depth(F.col("scope")))).limit(1)
