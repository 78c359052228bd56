"""Finding all windows of a fixed length that occur elsewhere, by content-chosen anchors.

Both long-repeat operators work so. A function of a window's content alone picks an anchor in it (a position, with a key),
so equal windows have equal keys at equal offsets. Consecutive windows with one anchor form a region, which is hashed
whole (128 bits). Then

1. anchors whose key occurs once are dropped: their windows can't occur elsewhere;
2. regions equal to another are repeated as a whole, and copies, however many, collapse in map-side aggregates;
3. keys with several different regions are compared window by window, on one representative of each region, by the
   operator's own method; what occurs in thousands of copies is one region here. Where only smaller doc_ids count, marks
   of a representative are carried to the other places of its region in the same doc_id.

Anchors are about one to a hundred bytes of text, and only they are shuffled; texts are joined to marks by row. No group
is gathered but the marks of one document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: place holds lo, pos - lo and hi - lo in 43, 10 and 10 bits: windows are of under 1,024 items.
ANCHOR = "key long, h1 long, h2 long, doc_id long, rk long, place long"
MARK = "doc_id long, rk long, lo int, hi int"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.row_key().alias("rk"), "text")


def anchor_batch(doc_id: pa.Array, rk: pa.Array, row: np.ndarray, key, h1, h2, pos, lo, hi) -> pa.RecordBatch:
    """row: each anchor's row in the batch; positions are within the row."""
    at = pa.array(row)
    i64 = lambda x: pa.array(x.view(np.int64))
    return pa.RecordBatch.from_arrays([i64(key), i64(h1), i64(h2), doc_id.take(at).cast(pa.int64()), rk.take(at), pa.array((lo << 20) | (pos - lo) << 10 | (hi - lo))], names=[x.split()[0] for x in ANCHOR.split(", ")])


def _lo(place):
    return F.shiftright(place, 20).cast("int")


def _hi(place):
    return (F.shiftright(place, 20) + place.bitwiseAND(1023)).cast("int")


def unplaced(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lo, pos and hi."""
    lo = place >> 20
    return lo, lo + (place >> 10 & 1023), lo + (place & 1023)


def find(docs: DataFrame, anchors: Callable, extract: Callable, extracted: str, compare: Callable[[DataFrame], DataFrame], earlier: bool) -> DataFrame:
    """Marks (window starts lo..hi by row) of the windows that occur elsewhere; with earlier, in a smaller doc_id.

    anchors: batches of keyed rows to batches of ANCHOR. extract: batches (doc_id, rk, z, list of wanted regions x) to rows
    of schema extracted. compare: such rows to marks. Rows that are repeated whole hold only regions that are repeated
    whole, so that their being extracted twice changes nothing.
    """
    rows = keyed(docs)
    if earlier:
        rows = rows.where("doc_id IS NOT NULL")
    every = c.written(rows.mapInArrow(anchors, ANCHOR), "anchors")
    shared = every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    some = c.written(every.join(shared, "key", "left_semi"), "shared")
    c.dropped(every)
    regions = c.written(some.groupBy("key", "h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rk", "place")).alias("r"), F.min("doc_id").alias("first")), "regions")

    whole = regions.where("n > 1").select("key", "h1", "h2", "first")
    full = some.join(whole, ["key", "h1", "h2"])
    full = (full.where("doc_id > first") if earlier else full).select("doc_id", "rk", _lo(F.col("place")).alias("lo"), _hi(F.col("place")).alias("hi"))

    several = regions.groupBy("key").agg(F.count("*").alias("many"), F.min("first").alias("a"), F.max("first").alias("b")).where("many > 1 AND a < b" if earlier else "many > 1").select("key", "many")
    wanted = regions.join(several, "key").select("r.doc_id", "r.rk", F.struct("key", F.col("n").cast("int").alias("n"), F.col("many").cast("int").alias("many"), "r.place").alias("x"))
    wanted = wanted.groupBy("doc_id", "rk").agg(F.collect_list("x").alias("x"))
    texts = c.deflated(rows).alias("d").join(wanted.alias("w"), F.col("d.rk").eqNullSafe(F.col("w.rk")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))
    parts = c.written(texts.select("d.doc_id", "d.rk", "d.z", "w.x").mapInArrow(extract, extracted), "parts")
    found = compare(parts)
    if not earlier:
        return full.unionByName(found)
    # what a representative shares with smaller doc_ids, the other places of its region in its own doc_id share too
    found = c.written(found.distinct(), "found")
    again = regions.where("n > 1").join(several, "key", "left_semi").select("key", "h1", "h2", "r")
    others = some.join(again, ["key", "h1", "h2"]).where("doc_id = r.doc_id AND (rk <> r.rk OR place <> r.place)").select("doc_id", "rk", "place", "r").distinct()
    at = others.select("doc_id", "rk", F.col("r.rk").alias("of"), (_lo(F.col("place")) - _lo(F.col("r.place"))).alias("by"), F.explode(F.sequence(_lo(F.col("r.place")), _hi(F.col("r.place")))).alias("lo"))
    single = found.select("doc_id", F.col("rk").alias("of"), F.explode(F.sequence("lo", "hi")).alias("lo"))
    carried = at.join(single, ["doc_id", "of", "lo"]).select("doc_id", "rk", (F.col("lo") + F.col("by")).alias("lo"), (F.col("lo") + F.col("by")).alias("hi"))
    return full.unionByName(found).unionByName(carried)


def marked(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, z as by deflated) with the list x of its marks (null: none)."""
    by_row = marks.groupBy("doc_id", "rk").agg(F.collect_set(F.struct("lo", "hi")).alias("x"))
    d, m = c.deflated(keyed(docs)).alias("d"), by_row.alias("m")
    return d.join(m, F.col("d.rk").eqNullSafe(F.col("m.rk")) & F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), "left").select("d.doc_id", "d.z", "m.x")


def listed(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Rows and fields of a column of lists of structs."""
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), lengths), {f.name: np.asarray(flat.field(i)) for i, f in enumerate(flat.type)}


def spans(lo: np.ndarray, hi: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n items are covered by a window that starts in lo..hi."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, lo, 1)
    np.add.at(d, hi + window, -1)
    return np.cumsum(d[:-1]) > 0
