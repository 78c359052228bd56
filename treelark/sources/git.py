"""A repository's history, read by git subprocesses."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as t

SCHEMA = "sha string, author_name string, author_email string, ts long, subject string, seq int, files array<string>"


class GitError(RuntimeError):
    """What git said when it failed."""


def _git(root: str, *args: str) -> str:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=120, check=False)
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def _maybe(root: str, *args: str) -> str | None:
    """None where git fails, which for these questions means that there is no such thing."""
    try:
        return _git(root, *args)
    except GitError:
        return None


def log(root: str, path: str | None = None, limit: int | None = None, since: str | None = None, until: str | None = None, follow: bool = False) -> list[tuple]:
    """Commits, newest first, with the files they touch; follow goes on through renames of path."""
    if _maybe(root, "rev-parse", "--verify", "HEAD") is None:
        _git(root, "rev-parse", "--git-dir")  # raises outside a repository; one without commits has no history
        return []
    args = ["log", "--format=%x1e%H%x1f%an%x1f%ae%x1f%ct%x1f%s%x1f", "--name-only"] + ([f"-n{limit}"] if limit else [])
    args += [f"--{k}={v}" for k, v in (("since", since), ("until", until)) if v] + (["--follow"] if follow and path else []) + (["--", path] if path else [])
    out = []
    for i, part in enumerate(x for x in _git(root, *args).split("\x1e") if x.strip()):
        sha, name, mail, ts, subject, files = part.split("\x1f", 5)
        out.append((sha, name, mail, int(ts), subject, i, [f for f in files.split("\n") if f]))
    return out


def show(root: str, rev: str, path: str) -> str | None:
    return _maybe(root, "show", f"{rev}:{path}")


def tree(root: str, rev: str, glob: str | None = None) -> list[str]:
    """Files of a revision; glob as in policies."""
    found = [x for x in _git(root, "ls-tree", "-r", "--name-only", rev).split("\n") if x]
    return found if glob is None else [x for x in found if re.search(t.glob_regex(glob), x)]


def rev_parse(root: str, rev: str = "HEAD") -> str | None:
    return (_maybe(root, "rev-parse", "--verify", rev) or "").strip() or None


def merge_base(root: str, a: str, b: str) -> str | None:
    return (_maybe(root, "merge-base", a, b) or "").strip() or None


def changed(root: str, a: str, b: str = "HEAD") -> list[str]:
    return [x for x in _git(root, "diff", "--name-only", a, b).split("\n") if x]


class GitLog(DataSource):
    """spark.read.format('git_log').option('path', repository).option('file', path).load()"""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.file = options.get("path", "."), options.get("file")

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        yield from log(self.path, self.file)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitLog)


def read_log(spark: SparkSession, root: str, file: str | None = None) -> DataFrame:
    register(spark)
    r = spark.read.format("git_log").option("path", root)
    return (r.option("file", file) if file else r).load()
