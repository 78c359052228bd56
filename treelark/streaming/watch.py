"""Change monitoring: debounced changes and state transitions, as streams and as their batch twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAP, LATENESS = "500 milliseconds", "10 seconds"


def changes_from(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A change log as a stream: a file source sees new files, so edits and deletions come as rows of a log."""
    return spark.readStream.schema(schema).parquet(path)


def tracked(changes: DataFrame, scopes: DataFrame, path: str = "file") -> DataFrame:
    """changes with dir, the nearest tracked directory; a row at a time, so that a stream needs no state for it."""
    from ..functions import text as t

    up = changes.withColumn("_up", t.ancestors(t.dirname(F.col(path))))
    known = scopes.agg(F.collect_set("scope").alias("_known"))  # the tracked directories of one project
    near = F.try_element_at(F.filter("_up", lambda d: F.array_contains("_known", d)), F.lit(1))
    return up.crossJoin(F.broadcast(known)).withColumn("dir", near).where("dir IS NOT NULL").drop("_known", "_up")


def debounced(changes: DataFrame, gap: str = GAP) -> DataFrame:
    """(dir, first_change, last_change, changes): one row per quiet period's end; equal to the gap merges."""
    s = changes.groupBy("dir", F.session_window("ts", gap).alias("w"))
    return s.agg(F.min("ts").alias("first_change"), F.max("ts").alias("last_change"), F.count("*").alias("changes")).drop("w")


def debounced_stream(changes: DataFrame, gap: str = GAP, lateness: str = LATENESS) -> DataFrame:
    """The same of a stream; rows later than the watermark are dropped."""
    return debounced(changes.withWatermark("ts", lateness), gap)


def snapshot(changes: DataFrame) -> DataFrame:
    """(dir, state): the newest state of each."""
    return changes.groupBy("dir").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"))


def transitions_of(changes: DataFrame) -> DataFrame:
    """(dir, ts, before, after): where a directory's state differs from the one before; the first counts."""
    w = Window.partitionBy("dir").orderBy("ts", "seq")
    return changes.withColumn("before", F.lag("state").over(w)).where("before IS NULL OR before <> state").select("dir", "ts", "before", F.col("state").alias("after"))


class TransitionProcessor(StatefulProcessor):
    """Keeps a directory's last state and emits only changes of it; rows of a batch are put in order first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        out = []
        for ts, state in zip(batch["ts"], batch["state"]):
            if state != before:
                out.append((key[0], ts, before, state))
                before = state
        if before is not None:
            self.last.update((before,))
        yield pd.DataFrame(out, columns=["dir", "ts", "before", "after"])

    def close(self) -> None:
        pass


def transition_stream(changes: DataFrame) -> DataFrame:
    """transitions_of() of a stream, with state per directory."""
    kind = dict(changes.dtypes)
    return changes.groupBy("dir").transformWithStateInPandas(TransitionProcessor(), outputStructType=f"dir {kind['dir']}, ts {kind['ts']}, before string, after string", outputMode="Append", timeMode="None")
