"""Operator 4, exact dedup by a minimal perfect hash over historical distinct digests.

The history is a table of distinct digests with the row that won each (its locator) and how many rows had it. It is split
into shards of bounded size by a hash of the digest; each shard becomes a minimal perfect hash (hash and displace): n slots
for n digests, each holding the full digest and its locator. Rows are routed to their shard, look up one slot and compare
all bytes of the digest: members repeat a historical text, nonmembers are grouped among themselves by digest.

Routing is a repartition and a sort within partitions, streamed through mapInArrow: the shard's slots come first, then its
rows, so that no group is gathered. A shard with many rows is salted: its rows are spread over parts, its slots are sent to
each. A digest that a third of all rows carry meets only map-side aggregates and joins that AQE can split.

Nulls count as empty texts. Rows without a doc_id are never preferred: they stay only in a group that has no doc_id at
all, where keep_id is null. Repeated rows of one doc_id and text are one document: each row is listed, as kept if the
document is. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Digests in a shard (about 50 bytes each), and rows that one salted part of a shard is to take.
SHARD_DIGESTS = 1 << 16
PART_ROWS = 1 << 18


def digest(text: Column) -> Column:
    """SHA-256 of a text whose runs of white space became one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), c.SPACE, " "), 256)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests, by hash and displace."""

    def __init__(self, seeds: np.ndarray, slots: np.ndarray, locator: np.ndarray, count: np.ndarray):
        self.seeds, self.slots, self.locator, self.count = seeds, slots, locator, count

    @staticmethod
    def _hashes(digests: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        halves = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
        return (halves[:, 0] % np.uint64(buckets)).astype(np.int64), halves[:, 1].copy()

    @staticmethod
    def _slot(h: np.ndarray, seed: np.ndarray, n: int) -> np.ndarray:
        """A negative seed names a slot outright."""
        moved = c.mix(h + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)
        return np.where(seed < 0, -seed - 1, moved.astype(np.int64))

    @classmethod
    def build(cls, digests: np.ndarray, locator: np.ndarray, count: np.ndarray) -> "PerfectHash":
        n = len(digests)
        buckets = max(1, n // 3)
        which, h = cls._hashes(digests, buckets)
        order = np.argsort(which, kind="stable")
        size = np.bincount(which, minlength=buckets)
        begin = np.cumsum(size) - size
        taken, seeds = np.zeros(n, bool), np.zeros(buckets, np.int64)
        by_size = np.argsort(-size, kind="stable")
        place = np.empty(n, np.int64)
        tries = np.arange(1, 65, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        for b in by_size[: int((size > 1).sum())].tolist():
            own = order[begin[b] : begin[b] + size[b]]
            base = 0
            while True:
                moved = tries + np.full((1, 1), base, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                at = (c.mix(h[own] + moved) % np.uint64(n)).astype(np.int64)
                free = ~taken[at].any(1)
                for k in np.flatnonzero(free).tolist():
                    if len(set(at[k].tolist())) == len(own):
                        break
                else:
                    base += 64
                    continue
                break
            seeds[b] = base + k + 1
            taken[at[k]] = True
            place[own] = at[k]
        single = by_size[int((size > 1).sum()) : int((size > 0).sum())]
        left = np.flatnonzero(~taken)[: len(single)]
        seeds[single] = -left - 1
        place[order[begin[single]]] = left
        slots, loc, num = np.empty((n, 32), np.uint8), np.empty(n, np.int64), np.empty(n, np.int64)
        slots[place], loc[place], num[place] = digests, locator, count
        return cls(seeds, slots, loc, num)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, or -1 where the slot's bytes differ."""
        n = len(self.slots)
        if not n or not len(digests):
            return np.full(len(digests), -1, np.int64)
        which, h = self._hashes(digests, len(self.seeds))
        at = self._slot(h, self.seeds[which], n)
        return np.where((self.slots[at] == digests).all(1), at, -1)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.seeds), len(self.slots)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.seeds, self.locator, self.count, self.slots))

    @classmethod
    def from_bytes(cls, raw: bytes) -> "PerfectHash":
        b, n = np.frombuffer(raw, "<i8", 2).tolist()
        longs = np.frombuffer(raw, "<i8", b + 2 * n, 16)
        return cls(longs[:b], np.frombuffer(raw, np.uint8, 32 * n, 16 + 8 * (b + 2 * n)).reshape(n, 32), longs[b : b + n], longs[b + n :])


def _unhex(column: pa.Array) -> np.ndarray:
    data, offsets = c.text_buffer(column)
    return np.frombuffer(bytes.fromhex(data[offsets[0] : offsets[-1]].tobytes().decode("ascii")), np.uint8).reshape(-1, 32)


def _build(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    column = lambda name: table.column(name).combine_chunks() if isinstance(table.column(name), pa.ChunkedArray) else table.column(name)
    chunk = column("digest")
    hashed = PerfectHash.build(_unhex(chunk), *(np.asarray(column(x).fill_null(-1 << 62), np.int64) for x in ("keep", "n")))
    return pa.table({"shard": pa.array([column("shard")[0].as_py()], pa.int64()), "slots": pa.array([hashed.to_bytes()], pa.binary())})


def index(history: DataFrame, shards: int) -> DataFrame:
    """(shard, slots) of history(digest, keep, n), whose digests are distinct. A group is one shard, of bounded size."""
    return history.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards))).groupBy("shard").applyInArrow(_build, "shard long, slots binary")


_OUT = "doc_id long, rk long, digest string, keep long, n long"


def _look_up(it):
    hashed, shard = None, None
    for batch in it:
        shards, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(2))
        edges = np.flatnonzero(np.append(True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1]))).tolist() if len(shards) else []
        for i, j in zip(edges, [*edges[1:], len(shards)]):
            if kinds[i] == 0:
                hashed, shard = PerfectHash.from_bytes(batch.column(6)[i].as_py()), shards[i]
                continue
            part = batch.slice(i, j - i)
            if shard == shards[i]:
                at = hashed.find(_unhex(part.column(5)))
                got = at >= 0
                keep, n = hashed.locator[at], hashed.count[at]
                keep, n = pa.array(keep, mask=~got | (keep == -1 << 62)), pa.array(n, mask=~got)
            else:
                keep = n = pa.nulls(j - i, pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (3, 4, 5)), keep, n], names=["doc_id", "rk", "digest", "keep", "n"])


def look_up(rows: DataFrame, slots: DataFrame, shards: int) -> DataFrame:
    """rows(doc_id, rk, digest) with keep and n of the historical digest, null for nonmembers."""
    n = F.pmod(F.xxhash64("digest"), F.lit(shards))
    sizes = rows.groupBy(n.alias("shard")).count()
    parts = sizes.select("shard", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("parts"))
    spread = rows.select(n.alias("shard"), "doc_id", "rk", "digest").join(parts, "shard").select("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "doc_id", "rk", "digest", F.lit(None).cast("binary").alias("slots"))
    copies = slots.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("rk"), F.lit(None).cast("string").alias("digest"), "slots")
    return spread.unionByName(copies).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind").mapInArrow(_look_up, _OUT)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Groups docs(doc_id, text) by equal text.

    history(digest, keep, n): distinct digests of earlier texts; where none is given, the older half of the doc_ids, by
    their middle value, is taken as ingested before. Returns doc_id, keep_id, group_size, kept, text_sha256; with a given
    history, group_size counts its rows too and keep_id may name one of them.
    """
    spark = docs.sparkSession
    rows = c.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.row_key().alias("rk"), digest(F.col("text")).alias("digest")), "digests")
    new = rows
    if history is None:
        ends = rows.agg(F.min("doc_id"), F.max("doc_id")).first()  # whose sum may be more than a long holds
        middle = None if ends[0] is None else (ends[0] + ends[1]) // 2
        old = F.coalesce(F.col("doc_id") <= F.lit(middle), F.lit(False))
        history = rows.where(old).groupBy("digest").agg(F.min("doc_id").alias("keep"), F.count("*").alias("n"))
        new = rows.where(~old)
    history = c.written(history, "history")
    shards = max(1, -(-history.count() // SHARD_DIGESTS))
    found = c.written(look_up(rows, index(history, shards), shards), "found")
    later = new.groupBy("digest").agg(F.min("doc_id").alias("later"), F.count("*").alias("m"))
    keep = F.least("keep", "later")
    return (
        found.join(later, "digest", "left")
        .select("doc_id", "rk", keep.alias("keep_id"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(c.documents(spark, sf_dir)).drop("rk")


OP4_SQL = f"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{c.SPACE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)"""
