"""Operator 10, suffix-array dedup: repeats of 400 bytes by deep-shallow sorting of sparse suffixes.

Anchors are the smallest of the hashes of 100-byte strings in each 400-byte window (see repeats). The suffixes that begin
at anchors, and the reversed prefixes that end there, are sorted within their key: multikey quicksort by 8-byte symbols to
a shallow depth, then a blind trie for each group with a longer common prefix. With the common prefixes of neighbours in
the two arrays, a window that reaches a bytes to the left of its anchor is repeated if another suffix is in the same run
of common prefixes of 400 - a bytes to the right and in the same run of a bytes to the left: bytes, not hashes, decide.

A key with more than GROUP different regions isn't sorted in one place: its windows are compared by 128-bit hashes in a
distributed aggregate, which gives the same windows. Work in memory is bounded by BATCH regions of under 800 bytes.

A null text is empty, nothing is removed from it; repeated rows are repeats of each other, whatever their doc_id; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import repeats

WINDOW, GRAM = 400, 100
SIDE = WINDOW - GRAM
WIDTH = -(-SIDE // 8) * 8
#: Different regions of a key that are sorted together, regions in memory at once, and the shallow depth in bytes.
GROUP, BATCH, SHALLOW = 4096, 8192, 32
EXTRACTED = "key long, doc_id long, rk long, pos int, lo int, hi int, n int, many int, bytes binary"


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w consecutive values."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def choose(windows: c.Windows, offsets: np.ndarray):
    """Row, key, position and first and last window start of each anchor, positions in the data of windows."""
    nothing = (np.zeros(0, np.int64),) * 5
    lengths = np.diff(offsets) - WINDOW + 1
    rows = np.flatnonzero(lengths > 0)
    if not len(rows):
        return nothing
    h = windows.every(GRAM)
    bits = np.uint64(len(h).bit_length())
    low = sliding_min((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), SIDE + 1)
    starts = c.ranges(offsets[rows], lengths[rows])
    row = np.repeat(rows, lengths[rows])
    pos = (low[starts] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    edge = np.flatnonzero(np.append(True, (pos[1:] != pos[:-1]) | (row[1:] != row[:-1])))
    last = np.append(edge[1:], len(pos)) - 1
    return row[edge], h[pos[edge]], pos[edge], starts[edge], starts[last]


def _anchors(it):
    for batch in it:
        data, offsets = c.text_buffer(batch.column(2))
        for i, j in c.runs(offsets):
            raw, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            windows = c.byte_windows(raw)
            row, key, pos, lo, hi = choose(windows, at)
            if len(row):
                begin = at[row]
                where = ((pos - lo) * WINDOW + (hi - lo)).astype(np.uint64)
                h1, h2 = (c.mix(w.at(lo, hi + WINDOW) + where) for w in (windows, c.byte_windows(raw, 1)))
                yield repeats.anchor_batch(batch.column(0), batch.column(1), row + i, key, h1, h2, pos - begin, lo - begin, hi - begin)


def _extract(it):
    for batch in it:
        owner, x = repeats.listed(batch.column(3))
        for i, j, data, offsets in c.inflated(batch.column(2)):
            a, b = np.searchsorted(owner, [i, j])
            r, part = owner[a:b], {k: v[a:b] for k, v in x.items()}
            lo, pos, hi = repeats.unplaced(part["place"])
            for k in range(0, len(r), BATCH):
                some = slice(k, k + BATCH)
                length = hi[some] + WINDOW - lo[some]
                raw = data[c.ranges(offsets[r[some] - i] + lo[some], length)]
                at = pa.array(r[some])
                body = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(c.prefix(length).astype(np.int32)), pa.py_buffer(raw)])
                ints = [pa.array(v[some].astype(np.int32)) for v in (pos, lo, hi, part["n"], part["many"])]
                yield pa.RecordBatch.from_arrays([pa.array(part["key"][some]), batch.column(0).take(at), batch.column(1).take(at), *ints, body], names=[n.split()[0] for n in EXTRACTED.split(", ")])


class BlindTrie:
    """Patricia trie over distinct byte strings of one width; finds its place by one comparison with a leaf."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.width, self.root = strings, len(strings[0]), 0
        for i in range(1, len(strings)):
            self._insert(i)

    def _insert(self, i: int) -> None:
        s, node, path = self.strings[i], self.root, []
        while not isinstance(node, int):  # blindly: only the branching bytes are looked at
            path.append(node)
            node = node[1].get(s[node[0]])
            if node is None:
                node = next(iter(path[-1][1].values()))
        differ = int.from_bytes(s) ^ int.from_bytes(self.strings[node])
        depth = self.width - (differ.bit_length() + 7) // 8
        parent, below = None, self.root
        for inner in path:
            if inner[0] >= depth:
                below = inner
                break
            parent = inner
            below = inner[1].get(s[inner[0]])
        if parent is not None and below is None:
            parent[1][s[parent[0]]] = i
            return
        if not isinstance(below, int) and below[0] == depth:
            below[1][s[depth]] = i
            return
        leaf = below
        while not isinstance(leaf, int):
            leaf = next(iter(leaf[1].values()))
        fresh = (depth, {self.strings[leaf][depth]: below, s[depth]: i})
        if parent is None:
            self.root = fresh
        else:
            parent[1][s[parent[0]]] = fresh

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, int):
                out.append(node)
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def deep_shallow(group: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Order of strings (n x WIDTH bytes) by group (ascending already) and then by bytes."""
    n = len(group)
    symbols = strings.view(">u8").astype(np.uint64)
    order = np.arange(n)
    label = np.append(0, np.cumsum(group[1:] != group[:-1])) if n else group
    for d in range(SHALLOW // 8):  # multikey quicksort, all groups at once: only groups of several go on
        size = np.bincount(label)
        live = np.flatnonzero(size[label] > 1)
        if not len(live):
            return order
        key = symbols[order[live], d]
        by = np.lexsort((key, label[live]))
        order[live], key = order[live][by], key[by]
        split = np.zeros(n, bool)
        split[live[1:]] = (key[1:] != key[:-1]) & (label[live[1:]] == label[live[:-1]])
        label = np.cumsum(split | np.append(False, label[1:] != label[:-1]))
    size = np.bincount(label)
    first = np.cumsum(size) - size
    for g in np.flatnonzero(size > 1).tolist():
        own = order[first[g] : first[g] + size[g]]
        same: dict[bytes, list[int]] = {}
        for i in own.tolist():
            same.setdefault(strings[i].tobytes(), []).append(i)
        distinct = list(same)
        sorted_ = BlindTrie(distinct).order()
        order[first[g] : first[g] + size[g]] = [i for k in sorted_ for i in same[distinct[k]]]
    return order


def _sorted_side(group: np.ndarray, raw: np.ndarray, begin: np.ndarray, step: int, length: np.ndarray):
    """Order, and common prefix of each ordered string with the one before (-1 at a group's start)."""
    reach = np.minimum(length, WIDTH)
    index = begin[:, None] + step * np.arange(WIDTH)
    index[np.arange(WIDTH) >= reach[:, None]] = len(raw) - 1  # a zero byte
    strings = raw[index]
    order = deep_shallow(group, strings)
    a = strings[order]
    differ = a[1:] != a[:-1]
    common = np.where(differ.any(1), differ.argmax(1), WIDTH)
    common = np.minimum(common, np.minimum(reach[order][1:], reach[order][:-1]))
    common[group[order][1:] != group[order][:-1]] = -1
    return order, np.append(-1, common)


def repeated_windows(group: np.ndarray, raw: np.ndarray, offsets: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """For regions raw[offsets[i]:offsets[i + 1]] whose anchor stands before[i] bytes into them, and whose last window
    starts behind[i] bytes before the anchor: which windows, by the bytes they reach to the left of the anchor, another
    region of the group holds too (n x (SIDE + 1))."""
    n = len(group)
    raw = np.append(raw, np.uint8(0))
    right_at = offsets[:-1] + before + GRAM
    right, common_right = _sorted_side(group, raw, right_at, 1, offsets[1:] - right_at)
    left, common_left = _sorted_side(group, raw, offsets[:-1] + before - 1, -1, before)
    out = np.zeros((n, SIDE + 1), bool)
    class_right, class_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(int(behind.min()), int(before.max()) + 1):
        some = np.flatnonzero((a <= before) & (a >= behind))
        if len(some) < 2:
            continue
        class_right[right] = np.cumsum(common_right < SIDE - a)
        class_left[left] = np.cumsum(common_left < a)
        pair = class_right[some] * (n + 1) + class_left[some]
        out[some, a] = c.twins(pair)[2]
    return out


def _compare(it):
    def done(table: pa.Table):
        table = table.combine_chunks()
        if not len(table):
            return
        column = lambda k: table.column(k).chunk(0)
        number = lambda k: np.asarray(column(k), np.int64)
        data, offsets = c.text_buffer(column("bytes"))
        raw, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        pos, lo, hi = number("pos"), number("lo"), number("hi")
        hit = repeated_windows(number("key"), raw, offsets, pos - lo, pos - hi)
        hit[number("n") > 1] = False  # these are known to be repeated as a whole
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([column("doc_id").take(at), column("rk").take(at), pa.array((pos[row] - end + 1).astype(np.int32)), pa.array((pos[row] - begin).astype(np.int32))], names=["doc_id", "rk", "lo", "hi"])

    held, count = [], 0
    for batch in it:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count >= BATCH:
            table = pa.Table.from_batches(held)
            keys = np.asarray(table.column("key").combine_chunks() if table.column("key").num_chunks == 1 else pa.concat_arrays(table.column("key").chunks))
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from done(table.slice(0, cut))
            rest = table.slice(cut)
            held, count = rest.combine_chunks().to_batches(), len(rest)
    if held:
        yield from done(pa.Table.from_batches(held))


def _hashes(it):
    """Both hashes of each window of the extracted regions."""
    for batch in it:
        data, offsets = c.text_buffer(batch.column(8))
        for i, j in c.runs(offsets):
            raw, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            n = np.diff(at) - WINDOW + 1
            starts, row = c.ranges(at[:-1], n), np.repeat(np.arange(i, j), n)
            h1, h2 = (c.byte_windows(raw, t).every(WINDOW)[starts].view(np.int64) for t in (0, 1))
            lo = np.asarray(batch.column(4))[row] + (starts - at[row - i])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(1).take(take), batch.column(2).take(take), pa.array(lo.astype(np.int32))], names=["h1", "h2", "doc_id", "rk", "lo"])


def _marks(parts: DataFrame) -> DataFrame:
    near = parts.where(F.col("many") <= GROUP).repartition("key").sortWithinPartitions("key").mapInArrow(_compare, repeats.MARK)
    far = parts.where(F.col("many") > GROUP).mapInArrow(_hashes, "h1 long, h2 long, doc_id long, rk long, lo int")
    twice = far.groupBy("h1", "h2").count().where("count > 1")
    return near.unionByName(far.join(twice, ["h1", "h2"], "left_semi").select("doc_id", "rk", "lo", F.col("lo").alias("hi")))


def find_repeats(docs: DataFrame) -> DataFrame:
    """Marks: by row (doc_id, rk), ranges lo..hi of byte positions at which a repeated string of WINDOW bytes starts."""
    return repeats.find(docs, _anchors, _extract, EXTRACTED, _marks, earlier=False)


def _cut(it):
    for batch in it:
        row, x = repeats.listed(batch.column(2))
        for i, j, raw, at in c.inflated(batch.column(1)):
            a, b = np.searchsorted(row, [i, j])
            begin = at[row[a:b] - i]
            gone = repeats.spans(begin + x["lo"][a:b], begin + x["hi"][a:b], WINDOW, len(raw))
            total = c.prefix(gone)
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            inner = at[:-1][at[:-1] < len(raw)]
            edge[inner] = gone[inner]
            kept = raw[~gone]
            cut = at - total[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array(np.diff(at)), pa.array(c.per_row(total, at)), pa.array(c.per_row(c.prefix(edge), at)), pa.array([hashlib.sha256(kept[p:q]).hexdigest() for p, q in zip(cut.tolist(), cut[1:].tolist())], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def op10_digests(docs: DataFrame) -> DataFrame:
    return repeats.marked(docs, find_repeats(docs)).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return op10_digests(c.documents(spark, sf_dir))


def _keep(it):
    for batch in it:
        row, x = repeats.listed(batch.column(2))
        texts = []
        for k, _, raw, _ in c.inflated(batch.column(1), 0):
            a, b = np.searchsorted(row, [k, k + 1])
            gone = repeats.spans(x["lo"][a:b].astype(np.int64), x["hi"][a:b].astype(np.int64), WINDOW, len(raw)) if b > a else np.zeros(len(raw), bool)
            texts.append(raw[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, bytes): each text without its repeats. Cuts may fall inside a character, so bytes come back."""
    return repeats.marked(docs, find_repeats(docs)).mapInArrow(_keep, "doc_id long, bytes binary")


#: By hexadecimal digits, cut into pieces of 1,000 starts so that taking a window costs little.
OP10_SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j, substr(h, 2000 * j + 1, {2 * (1000 + WINDOW - 1)}) AS c FROM h, LATERAL (SELECT unnest(range(0, length(h) // 2000 + 1)) AS j)),
g AS (SELECT doc_id, 1000 * j + i AS i, md5(substr(c, 2 * i - 1, {2 * WINDOW})) AS k FROM c, LATERAL (SELECT unnest(range(1, length(c) // 2 - {WINDOW - 2})) AS i)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM m)),
s AS (SELECT doc_id, s, min(i) AS a, max(i) + {WINDOW - 1} AS b FROM r GROUP BY doc_id, s),
k AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS p, a - 1 AS q FROM s UNION ALL SELECT doc_id, max(b) + 1, NULL FROM s GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(CASE WHEN q IS NULL THEN substr(h, 2 * p - 1) ELSE substr(h, 2 * p - 1, 2 * (q - p + 1)) END, '' ORDER BY p) AS kept FROM k JOIN h USING (doc_id) GROUP BY doc_id)
SELECT h.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t.kept, h.h))) AS kept_sha256
FROM h LEFT JOIN (SELECT doc_id, sum(b - a + 1) AS removed, count(*) AS spans FROM s GROUP BY doc_id) n USING (doc_id) LEFT JOIN t USING (doc_id)"""
