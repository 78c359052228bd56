"""Directories and files: what counts as source, what is pruned, nearest scopes and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as k
from ..functions import text as t


def is_source(name: Column) -> Column:
    return name.isin(k.SPECIAL_FILES) | t.extension(name).isin(k.SOURCE_EXTENSIONS) | F.lower(name).rlike(r"^\.(" + "|".join(e[1:] for e in k.SOURCE_EXTENSIONS) + r")\z")


def read_tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(file, dir, name, size, mtime) below root. Content isn't read: the column is pruned from the source."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    base = root.rstrip("/") + "/"
    file = F.regexp_replace(F.expr("path"), "^(?:file:)?/*" + base.replace(".", r"\.").lstrip("/"), "")
    rows = reader.load(root).select(file.alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return rows.select("file", t.dirname(F.col("file")).alias("dir"), t.basename(F.col("file")).alias("name"), "size", "mtime")


def scan(files: DataFrame, ignore: list[str] | None = None, max_depth: int = 10) -> DataFrame:
    """Source files in directories that aren't pruned: always-ignored names, dot directories, patterns, depth."""
    parts = F.filter(F.split(F.col("dir"), "/"), lambda s: s != ".")
    pruned = F.exists(parts, lambda s: s.isin(k.IGNORED_DIRS) | s.startswith("."))
    kept = files.where(is_source(F.col("name")) & ~pruned & (t.depth(F.col("dir")) <= max_depth))
    if ignore:
        above = F.filter(t.ancestors(F.col("dir")), lambda d: d != ".")
        kept = kept.where(~F.exists(above, lambda d: t.ignored(d, ignore)))
    return kept


def directories(files: DataFrame) -> DataFrame:
    """(dir, parent, depth, files): directories with files below them, files their own."""
    own = files.groupBy("dir").agg(F.count("*").alias("files"))
    every = own.select(F.explode(t.ancestors(F.col("dir"))).alias("dir")).distinct()
    parent = F.when(F.col("dir") == ".", F.lit(None)).otherwise(t.dirname(F.col("dir")))
    return every.join(own, "dir", "left").select("dir", parent.alias("parent"), t.depth(F.col("dir")).alias("depth"), F.coalesce("files", F.lit(0)).alias("files"))


def bottom_up(dirs: DataFrame) -> DataFrame:
    return dirs.orderBy(F.desc("depth"), "dir")


def ignore_lines(spark: SparkSession, path: str) -> list[str]:
    """The rules of an ignore file; comments and blank lines go. A rule file is small."""
    return [r[0] for r in spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')").select(F.trim("value")).collect()]


def shard(file: Column) -> Column:
    """A table's shard: the first segment of the path, cleaned, or __root__."""
    return F.when(F.instr(file, "/") == 0, "__root__").otherwise(F.regexp_replace(F.substring_index(file, "/", 1), r"[^A-Za-z0-9._-]", "_"))


def nearest_scope(items: DataFrame, scopes: DataFrame, path: str = "dir") -> DataFrame:
    """items with scope, the deepest tracked ancestor or self: ancestors exploded and joined by equality."""
    up = items.select(path).distinct().select(path, F.explode(t.ancestors(F.col(path))).alias("scope"))
    best = up.join(scopes.select("scope").distinct(), "scope").groupBy(path).agg(F.max_by("scope", t.depth(F.col("scope"))).alias("scope"))
    return items.join(best, path, "left")


def scope_window(dirs: DataFrame, scope: str) -> DataFrame:
    """Root, parent, the scope and its children among dirs(dir, parent)."""
    up = scope.rsplit("/", 1)[0] if "/" in scope else "."
    return dirs.where(F.col("dir").isin(".", up, scope) | (F.col("parent") == scope)).select("dir", F.when(F.col("dir") == scope, "self").when(F.col("dir") == up, "parent").when(F.col("dir") == ".", "root").otherwise("child").alias("role"))


def child_summaries(dirs: DataFrame, summaries: DataFrame) -> DataFrame:
    """(dir, subdirectories: array of name and summary) in order of name."""
    c = dirs.where("parent IS NOT NULL").select(F.col("parent").alias("at"), t.basename(F.col("dir")).alias("name"), F.col("dir"))
    own = c.join(summaries.select(F.col("scope").alias("dir"), "summary"), "dir")
    return own.groupBy(F.col("at").alias("dir")).agg(F.array_sort(F.collect_list(F.struct("name", "summary"))).alias("subdirectories"))


def project(rows: DataFrame, fields: list[str], always: tuple[str, ...] = ("version", "scope", "fingerprint", "last_updated")) -> DataFrame:
    """The fixed metadata columns and the fields asked for; unknown ones are ignored."""
    return rows.select(*[c for c in rows.columns if c in always or c in fields])


def replace_files(index: DataFrame, fresh: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """An index table with the rows of changed files replaced and of dropped files gone."""
    gone = fresh.select("file").distinct() if dropped is None else fresh.select("file").unionByName(dropped.select("file")).distinct()
    return index.join(gone, "file", "left_anti").unionByName(fresh)


def dropped_files(index: DataFrame, incoming: DataFrame) -> DataFrame:
    return index.select("file").distinct().join(incoming.select("file"), "file", "left_anti")
