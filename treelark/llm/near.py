"""Operator 5, near-duplicates by SetSketch registers, banding, a joint likelihood estimate and verification.

A document's set is its distinct word shingles. Register i of its sketch is floor(1 - log_b h_i), truncated to 0..q + 1,
of the smallest of exponentially distributed hashes h_i of the set's members: sketches merge by maximum, and registers of
two sets are equal about as often as their Jaccard similarity says.

1. Documents with one and the same set collapse in an aggregate (by two 64-bit sums over the set): copies, however many,
   are one node.
2. Bands of registers give buckets. Within each, every set is paired with the bucket's smallest one; pairs whose joint
   maximum-likelihood estimate (from the counts of larger, equal and smaller registers and the two known sizes) is well
   under the threshold go, the others are verified on full sets.
3. Verified links give components. Buckets that still hold several components are compared pair by pair, between
   components only, in blocks of bounded size (a hot bucket is cut into blocks, and every two blocks meet); again only
   pairs with a high estimate are emitted, and verified. No partner or candidate is capped.

The chance that two sets of similarity 0.85 share no band is under 1e-8. Links, components and sketches stay distributed.

Rows without a doc_id, without words or without text are linked with nothing. Rows that share a doc_id are one document
when components are formed. Repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .components import components

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: A pair whose estimated similarity is so far under the threshold isn't verified: five deviations of the estimate.
MARGIN = 0.14
BLOCK = 1024
_U = np.uint64
_FACTORS = c.mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _U(0x9E6C63D0876A9A47)) | _U(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of rows of lower-cased bytes, in row order, and the row of each."""
    starts, ends, at = c.words(data, offsets)
    items = c.span_hash(data, starts, ends)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    keys, rows = [], []
    if len(items) >= k:
        h = c.gram_hash(items, k)
        ok = row[: len(h)] == row[k - 1 :]
        keys.append(h[ok])
        rows.append(row[: len(h)][ok])
    short = np.flatnonzero((n > 0) & (n < k))
    for size in range(1, k):
        own = short[n[short] == size]
        if len(own):
            keys.append(c.gram_hash(items, size)[at[own]] ^ _U(size))
            rows.append(own)
    key = np.concatenate(keys) if keys else np.zeros(0, _U)
    rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    order = np.argsort(rows, kind="stable")
    key, rows = key[order], rows[order]
    _, first, _ = c.distinct(key ^ c.mix(rows.astype(_U) + _U(1)))
    first.sort()
    return key[first], rows[first]


def sketch(key: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (uint16) of the sets key[starts[i]:starts[i + 1]], none of them empty."""
    least = np.empty((len(starts), REGISTERS), np.float64)
    moved = np.empty_like(key)
    for i in range(REGISTERS):
        np.multiply(key, _FACTORS[i], out=moved)
        least[:, i] = np.minimum.reduceat(moved, starts)
    exponential = -np.log1p(-np.minimum((least + 1) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of a union."""
    return np.maximum(a, b)


def estimate(larger: np.ndarray, smaller: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities from the counts of registers of a above and below those of b."""
    equal = REGISTERS - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    top = np.minimum(u / v, v / u)
    for j in np.linspace(0.4, 1.0, 121):
        a, b = p(u - v * j), p(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            fit = np.where(larger > 0, larger * np.log(a), 0) + np.where(smaller > 0, smaller * np.log(b), 0) + np.where(equal > 0, equal * np.log(np.maximum(1 - a - b, 1e-300)), 0)
        fit = np.where(j <= top + 1e-9, fit, -np.inf)
        better = fit > best
        best[better], at[better] = fit[better], j
    return at


def _sets(k: int):
    def run(it):
        for batch in it:
            data, offsets = c.text_buffer(batch.column(2))
            for i, j in c.runs(offsets):
                raw, at = c.LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                key, row = shingles(raw, at, k)
                n = np.bincount(row, minlength=j - i)
                some = np.flatnonzero(n)
                start = np.cumsum(n[some]) - n[some]
                sums = np.zeros((2, j - i), _U)
                packed: list = [None] * (j - i)
                if len(some):
                    sums[0, some] = np.add.reduceat(c.mix(key + _U(1)), start)
                    sums[1, some] = np.add.reduceat(c.mix(key ^ _U(0x5851F42D4C957F2D)), start)
                    for r, s in zip(some.tolist(), sketch(key, start)):
                        packed[r] = s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(n), *(pa.array(x.view(np.int64)) for x in sums), pa.array(packed, pa.binary())], names=["doc_id", "rk", "n", "s1", "s2", "sketch"])
            c.trim()

    return run


def _bands(it):
    for batch in it:
        registers = _registers(batch.column(3))
        n = len(batch)
        bands = np.ascontiguousarray(registers).reshape(n, BANDS, ROWS).astype(_U)
        h = np.zeros((n, BANDS), _U)
        for r in range(ROWS):
            h = c.mix(h * _U(0x9FB21C651E98DF25) + bands[:, :, r] + _U(1))
        h ^= c.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        at = pa.array(np.repeat(np.arange(n), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(c.mix(h.reshape(-1)).view(np.int64)), *(batch.column(k).take(at) for k in range(3))], names=["bucket", "id", "rk", "n"])


def _registers(column: pa.Array) -> np.ndarray:
    data, offsets = c.text_buffer(column)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint16).reshape(-1, REGISTERS)


def _likely(threshold: float):
    """Pairs (id, rk, n, sketch of either side) that may be similar enough."""

    def run(it):
        for batch in it:
            if not len(batch):
                continue
            a, b = _registers(batch.column(6)), _registers(batch.column(7))
            n_a, n_b = np.asarray(batch.column(4), float), np.asarray(batch.column(5), float)
            ok = estimate((a > b).sum(1), (a < b).sum(1), n_a, n_b) >= threshold - MARGIN
            yield batch.filter(pa.array(ok)).select([0, 1, 2, 3])

    return run


def _crossed(threshold: float):
    """Likely pairs between components within groups (bucket, x, y); groups come sorted and are of bounded size."""

    def group(n: np.ndarray, component: np.ndarray, registers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different components, of sizes that allow the threshold, with many equal registers."""
        left, right = [], []
        step = max(1, (1 << 13) // len(n))  # rows compared at once, so that memory is bounded
        for a in range(0, len(n), step):
            some = slice(a, a + step)
            ok = (component[some, None] != component[None, :]) & (np.minimum(n[some, None], n[None, :]) >= (threshold - 0.01) * np.maximum(n[some, None], n[None, :]))
            i, j = np.nonzero(ok)
            later = j > i + a
            i, j = i[later] + a, j[later]
            for q in range(0, len(i), 1 << 13):
                x, y = i[q : q + (1 << 13)], j[q : q + (1 << 13)]
                same = (registers[x] == registers[y]).sum(1) >= (threshold - 2 * MARGIN) * REGISTERS
                left.append(x[same])
                right.append(y[same])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2

    def run(it):
        held: list = []

        def done(batch):
            names = ("bucket", "x", "y", "id", "rk", "n", "component")
            rows = {k: np.asarray(batch.column(i)) for i, k in enumerate(names)}
            registers = _registers(batch.column(7))
            cut = np.flatnonzero(np.append(True, (np.diff(rows["bucket"]) != 0) | (np.diff(rows["x"]) != 0) | (np.diff(rows["y"]) != 0))).tolist() + [len(registers)]
            found = [tuple(x + a for x in group(rows["n"][a:b], rows["component"][a:b], registers[a:b])) for a, b in zip(cut, cut[1:])]
            left, right = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            good = []
            for q in range(0, len(left), 1 << 14):
                x, y = left[q : q + (1 << 14)], right[q : q + (1 << 14)]
                likely = estimate((registers[x] > registers[y]).sum(1), (registers[x] < registers[y]).sum(1), rows["n"][x].astype(float), rows["n"][y].astype(float)) >= threshold - MARGIN
                good.append(q + np.flatnonzero(likely))
            good = np.concatenate(good) if good else np.zeros(0, np.int64)
            left, right = left[good], right[good]
            return pa.RecordBatch.from_arrays([pa.array(rows[k][s]) for k, s in (("id", left), ("rk", left), ("id", right), ("rk", right))], names=["a", "ra", "b", "rb"])

        for batch in it:
            if not len(batch):
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = [np.asarray(table.column(i)) for i in range(3)]
            last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield done(table.slice(0, cut))
            held = [table.slice(cut)]
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _verify(k: int, num: int, den: int):
    """Links (u, v) among pairs (a, b, za, zb): shared * den >= num * all."""

    def run(it):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in it:
            ids, parts, size = [], [], 0

            def done():
                both = [x for pair in parts for x in pair]
                raw = np.frombuffer(b"".join(both), np.uint8)
                key, row = shingles(c.LOWER[raw], c.prefix(np.array([len(x) for x in both], np.int64)), k)
                n = np.bincount(row, minlength=len(both)).reshape(-1, 2).sum(1)
                pair = row >> 1
                order, same, _ = c.twins(key ^ c.mix(pair.astype(_U) + _U(1)))
                shared = np.bincount(pair[order[1:][same]], minlength=len(parts))
                ok = (shared > 0) & (den * shared >= num * (n - shared))
                return pa.RecordBatch.from_arrays([pa.array(np.array([p[s] for p in ids], np.int64)[ok]) for s in (0, 1)], names=["u", "v"])

            for a, b, x, y in zip(*(batch.column(i) for i in range(4))):
                ids.append((a.as_py(), b.as_py()))
                parts.append((unpack(x.as_buffer()), unpack(y.as_buffer())))
                size += len(parts[-1][0]) + len(parts[-1][1])
                if size >= c.RUN_BYTES:
                    yield done()
                    ids, parts, size = [], [], 0
            if ids:
                yield done()

    return run


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, rk, n_shingles and component_id of each row of docs(doc_id, text): links are pairs of sets of k-word
    shingles whose shared shingles are at least num / den of all."""
    threshold = num / den
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), c.row_key().alias("rk"), "text")
    sets = c.written(rows.mapInArrow(_sets(k), "doc_id long, rk long, n long, s1 long, s2 long, sketch binary"), "sets")
    nodes = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "rk")).alias("r"), F.first("sketch").alias("sketch"))
    nodes = c.written(nodes.select(F.col("r.doc_id").alias("id"), F.col("r.rk").alias("rk"), "n", "s1", "s2", "sketch"), "nodes")

    bands = nodes.select("id", "rk", "n", "sketch").mapInArrow(_bands, "bucket long, id long, rk long, n long")
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("id", "rk", "n")).alias("least")).where("size > 1")
    members = c.written(bands.join(buckets, "bucket"), "members")
    pairs = members.where(F.struct("id", "rk") != F.struct("least.id", "least.rk"))
    pairs = pairs.where(F.least("n", "least.n") >= (threshold - 0.001) * F.greatest("n", "least.n")).select(F.col("least.id").alias("a"), F.col("least.rk").alias("ra"), F.col("id").alias("b"), F.col("rk").alias("rb")).distinct()
    side = lambda s, r: nodes.select(F.col("id").alias(s), F.col("rk").alias(r), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    likely = pairs.join(side("b", "rb"), ["b", "rb"]).join(side("a", "ra"), ["a", "ra"]).select("a", "ra", "b", "rb", "na", "nb", "sa", "sb").mapInArrow(_likely(threshold), "a long, ra long, b long, rb long")

    wanted = members.select(F.col("id").alias("doc_id"), "rk").distinct()
    texts = c.written(c.deflated(rows).join(wanted, ["doc_id", "rk"], "left_semi").dropDuplicates(["doc_id", "rk"]), "texts")

    def links(found: DataFrame) -> DataFrame:
        t = lambda s, r: texts.select(F.col("doc_id").alias(s), F.col("rk").alias(r), F.col("z").alias(f"z{s}"))
        return c.written(found.join(t("b", "rb"), ["b", "rb"]).join(t("a", "ra"), ["a", "ra"]).select("a", "b", "za", "zb").mapInArrow(_verify(k, num, den), "u long, v long"), "links")

    first = links(likely)
    component = components(first)

    labelled = members.join(component.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = labelled.where("size > 2").groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("bucket")
    rest = labelled.join(open_, "bucket", "left_semi").where(F.struct("id", "rk") != F.struct("least.id", "least.rk"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id", "rk"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    spread = rest.select("bucket", own.alias("own"), other.alias("other"), "id", "rk", "n", "component").select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "rk", "n", "component")
    spread = spread.join(nodes.select("id", "rk", "sketch"), ["id", "rk"]).select("bucket", "x", "y", "id", "rk", "n", "component", "sketch").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    crossed = spread.mapInArrow(_crossed(threshold), "a long, ra long, b long, rb long").distinct()
    second = links(crossed)
    joined = component.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(second)
    component = components(joined)

    classes = nodes.select("n", "s1", "s2", F.col("id").alias("node")).join(component, "node", "left").select("n", "s1", "s2", F.coalesce("component", "node").alias("component_id"))
    linked = sets.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "rk", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).select("doc_id", "rk", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0 OR doc_id IS NULL").select("doc_id", "rk", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(c.documents(spark, sf_dir), k=3, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


OP5_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{c.WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, CAST(len(w) > 0 AS INT) + 1))) AS i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, v FROM r JOIN both_ways ON u = seen)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS component_id FROM r GROUP BY node) m USING (doc_id)"""
