"""The index as tables partitioned by shard, with a manifest that names the live version."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, history, scan

VERSION = 1
RELATIONS = {"symbols": "file", "imports": "from_file", "references": "file"}


class IndexUnavailable(RuntimeError):
    """The index is missing or was made by other code or for another project."""


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a newline-delimited JSON file; lines that aren't JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write(index: dict[str, DataFrame], root: str, project: str) -> None:
    """A new version beside the old one; the manifest is swapped last, so readers see one or the other."""
    version = f"v{time.time_ns()}"
    for name, df in index.items():
        key = RELATIONS.get(name)
        out = df.withColumn("shard", scan.shard(F.col(key))) if key else df
        (out.write.partitionBy("shard") if key else out.write).parquet(f"{root}/{version}/{name}")
    os.makedirs(root, exist_ok=True)
    draft = f"{root}/manifest.{os.getpid()}.tmp"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump({"index_version": VERSION, "project_root": project, "version": version, "last_full_build": time.time(), "relations": sorted(index)}, f)
    os.replace(draft, f"{root}/manifest.json")


def state(root: str, project: str) -> str:
    """ready, missing or stale."""
    try:
        with open(f"{root}/manifest.json", encoding="utf-8") as f:
            m = json.load(f)
    except (OSError, ValueError):
        return "missing"
    return "ready" if m.get("index_version") == VERSION and m.get("project_root") == project else "stale"


def read(spark: SparkSession, root: str, project: str) -> dict[str, DataFrame]:
    now = state(root, project)
    if now != "ready":
        raise IndexUnavailable(now)
    with open(f"{root}/manifest.json", encoding="utf-8") as f:
        m = json.load(f)
    return {n: spark.read.parquet(f"{root}/{m['version']}/{n}") for n in m["relations"]}


def of_file(relation: DataFrame, file: str, key: str = "file") -> DataFrame:
    """A file's rows; the shard is given too, so that one partition is read."""
    shard = "__root__" if "/" not in file else "".join(ch if ch.isalnum() or ch in "._-" else "_" for ch in file.split("/")[0])
    return relation.where((F.col("shard") == shard) & (F.col(key) == file))


def refresh(index: dict[str, DataFrame], prior: DataFrame, now: DataFrame, fresh: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """An index brought up to date: rows of files that were added, changed or removed between prior and now(file,
    content_hash) go, the fresh rows of added and changed ones come in, and directory edges are counted anew."""
    changed = history.classify(prior, now, "file", "content_hash").where("change <> 'unchanged'")
    out = {}
    for name, key in RELATIONS.items():
        gone, come = changed.select(F.col("file").alias(key)), changed.where("change <> 'removed'").select(F.col("file").alias(key))
        out[name] = index[name].join(gone, key, "left_anti").select(fresh[name].columns).unionByName(fresh[name].join(come, key, "left_semi"))
    out["dir_edges"] = graph.dir_edges(out["imports"])
    return out
