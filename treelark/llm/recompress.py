"""Operator 3, substring dedup by recompression: repeats of 50 words across documents.

Words become symbols; runs of one word become one symbol; then each round splits the alphabet in two by a bit of the
symbol and replaces every pair of a left and a right symbol by a new one. A symbol's name is a 64-bit hash of what it
replaces, so that every task of every round gives equal strings the same name, over the whole corpus, without a
dictionary to shuffle; the rounds run on arrays of a task's documents. Along with a symbol goes the stretch of words
that its forming depended on. Symbols whose stretch lies in a window are the same in every copy of that window: each
window takes as anchor the symbol of the highest level it has (of several the smallest hash), at worst a word. Anchors
shared between documents reveal repeats; 128-bit hashes of words verify them (see repeats).

A window is removed where a document with a smaller doc_id has the same words. Rows without a doc_id take no part: they
lose nothing, and nothing is lost for them. Rows that share a doc_id are one document here. A null text has no words; a
text of fewer than 50 words loses nothing. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from . import repeats

WINDOW, ROUNDS = 50, 6
EXTRACTED = "doc_id long, rk long, lo int, h1 long, h2 long"
_U = np.uint64


def levels(items: np.ndarray, at: np.ndarray, rounds: int = ROUNDS):
    """Per level, of documents items[at[i]:at[i + 1]]: symbols, their first words, and the words they depend on (first,
    last), which lie outside the document where they depend on its end."""
    n = len(items)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    sym, pos = items, np.arange(n)
    first, last = pos, pos
    out = [(sym, pos, first, last)]
    if not n:
        return out
    left_end, right_end = at[row] - 1, at[row + 1]

    def ends(index):  # of the symbols index: whether a row begins or ends there
        r = row[index]
        return np.append(True, r[1:] != r[:-1]), np.append(r[1:] != r[:-1], True)

    begins, stops = ends(pos)
    lead = np.append(True, sym[1:] != sym[:-1]) | begins  # block compression of runs of a word
    index = np.flatnonzero(lead)
    size = np.diff(np.append(index, n))
    tail = index + size - 1
    before, behind = np.where(begins[index], left_end[index], index - 1), np.where(stops[tail], right_end[tail], tail + 1)
    sym = np.where(size > 1, c.mix(sym[index] + size.astype(_U) * _U(0xA0761D6478BD642F)), sym[index])
    pos, first, last = index, before, behind
    out.append((sym, pos, first, last))
    for k in range(rounds):
        begins, stops = ends(pos)
        side = (c.mix(sym + _U((k + 1) * 0x9E3779B97F4A7C15 & c._MASK)) >> _U(63)).astype(bool)  # True: a right symbol
        pair = ~side & np.append(side[1:], False) & ~stops
        taken = np.append(False, pair[:-1])
        low, high = first.copy(), last.copy()
        high[:-1] = np.where(~side[:-1], np.maximum(high[:-1], last[1:]), high[:-1])
        low[1:] = np.where(side[1:], np.minimum(low[1:], first[:-1]), low[1:])
        edge = ~side & stops
        high[edge] = right_end[pos[edge]]
        edge = side & begins
        low[edge] = left_end[pos[edge]]
        low[:-1] = np.where(pair[:-1], np.minimum(first[:-1], first[1:]), low[:-1])
        fresh = sym.copy()
        p = np.flatnonzero(pair)
        fresh[p] = c.mix(sym[p] * _U(0xE7037ED1A0B428DB) + c.mix(sym[p + 1] + _U(k + 1)))
        stay = ~taken
        sym, pos, first, last = fresh[stay], pos[stay], low[stay], high[stay]
        out.append((sym, pos, first, last))
    return out


def choose(items: np.ndarray, at: np.ndarray):
    """Row, key, position, first and last window start (as word numbers in items) of each anchor."""
    lengths = np.diff(at) - WINDOW + 1
    rows = np.flatnonzero(lengths > 0)
    if not len(rows):
        return (np.zeros(0, np.int64),) * 5
    starts = c.ranges(at[rows], lengths[rows])
    row = np.repeat(rows, lengths[rows])
    key, place, running = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64), c.Windows(items)
    todo = np.arange(len(starts))
    for k, (sym, pos, first, last) in reversed(list(enumerate(levels(items, at)))):
        s = starts[todo]
        a, b = np.searchsorted(first, s), np.searchsorted(last, s + WINDOW - 1, "right")
        ok = b > a
        if ok.any():
            name = c.mix(sym + _U(k * 0xD6E8FEB86659FD93 & c._MASK))
            bits = _U(len(sym).bit_length())
            table = [(name >> bits << bits) | np.arange(len(sym), dtype=np.uint64)]
            a, b = a[ok], b[ok]
            step = np.floor(np.log2(b - a)).astype(np.int64)
            for d in range(int(step.max())):
                table.append(np.minimum(table[-1][: -(1 << d)], table[-1][1 << d :]))
            best = np.empty(len(a), np.uint64)
            for d in range(len(table)):
                own = step == d
                best[own] = np.minimum(table[d][a[own]], table[d][b[own] - (1 << d)])
            best = (best & _U((1 << int(bits)) - 1)).astype(np.int64)
            # all words the symbol depends on are in the window: the key names them too
            key[todo[ok]], place[todo[ok]] = name[best] ^ running.at(first[best], last[best] + 1), pos[best]
        todo = todo[~ok]
        if not len(todo):
            break
    edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    end = np.append(edge[1:], len(starts)) - 1
    return row[edge], key[edge], place[edge], starts[edge], starts[end]


def _anchors(it):
    for batch in it:
        data, offsets = c.text_buffer(batch.column(2))
        for i, j in c.runs(offsets):
            raw, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, at = c.words(raw, cut)
            items = c.span_hash(raw, starts, ends)
            row, key, pos, lo, hi = choose(items, at)
            if len(row):
                where = ((pos - lo) * WINDOW + (hi - lo)).astype(_U)
                both = (c.span_hash(raw, starts, ends, 1), items)
                h1, h2 = (c.mix(c.Windows(x, t).at(lo, hi + WINDOW) + where) for x, t in zip(both, (1, 0)))
                begin = at[row]
                yield repeats.anchor_batch(batch.column(0), batch.column(1), row + i, key, h1, h2, pos - begin, lo - begin, hi - begin)


def _extract(it):
    """Both hashes of every window of the wanted regions."""
    for batch in it:
        owner, x = repeats.listed(batch.column(3))
        for i, j, raw, cut in c.inflated(batch.column(2)):
            starts, ends, at = c.words(raw, cut)
            a, b = np.searchsorted(owner, [i, j])
            if a == b:
                continue
            r, part = owner[a:b], {k: v[a:b] for k, v in x.items()}
            lo, _, hi = repeats.unplaced(part["place"])
            s = c.ranges(at[r - i] + lo, hi - lo + 1)
            h1, h2 = (c.Windows(c.span_hash(raw, starts, ends, t), t).every(WINDOW)[s].view(np.int64) for t in (1, 0))
            row = np.repeat(r, hi - lo + 1)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((s - at[row - i]).astype(np.int32)), pa.array(h1), pa.array(h2)], names=[n.split()[0] for n in EXTRACTED.split(", ")])


def _marks(parts: DataFrame) -> DataFrame:
    earliest = parts.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2", "a")
    return parts.join(earliest, ["h1", "h2"]).where("doc_id > a").select("doc_id", "rk", "lo", F.col("lo").alias("hi"))


def find_repeats(docs: DataFrame) -> DataFrame:
    """Marks: by row (doc_id, rk), ranges lo..hi of word numbers at which a window starts that an earlier document has."""
    return repeats.find(docs, _anchors, _extract, EXTRACTED, _marks, earlier=True)


def _kept(batch: pa.RecordBatch):
    """Per run of rows: first, end, words by row, words removed by row, kept words joined by a space and where rows are in it."""
    owner, x = repeats.listed(batch.column(2))
    for i, j, raw, cut in c.inflated(batch.column(1)):
        starts, ends, at = c.words(raw, cut)
        a, b = np.searchsorted(owner, [i, j])
        if b > a:
            begin = at[owner[a:b] - i]
            gone = repeats.spans(begin + x["lo"][a:b], begin + x["hi"][a:b], WINDOW, len(starts))
        else:
            gone = np.zeros(len(starts), bool)
        s, length = starts[~gone], (ends - starts)[~gone] + 1
        joined = np.append(raw, np.uint8(32))[c.ranges(s, length)]
        total = np.cumsum(length)
        joined[total - 1] = 32
        removed = c.prefix(gone)
        yield i, j, np.diff(at), c.per_row(removed, at), joined, np.append(0, total)[at - removed[at]]


def _digests(it):
    for batch in it:
        for i, j, n, removed, joined, cut in _kept(batch):
            texts = [hashlib.sha256(joined[p : max(p, q - 1)]).hexdigest() for p, q in zip(cut.tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n), pa.array(removed), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _texts(it):
    for batch in it:
        for i, j, n, removed, joined, cut in _kept(batch):
            texts = [joined[p : max(p, q - 1)].tobytes().decode("utf-8", "replace") for p, q in zip(cut.tolist(), cut[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(texts, pa.string())], names=["doc_id", "text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the words that stay, joined by one space."""
    return repeats.marked(docs, find_repeats(docs)).mapInArrow(_texts, "doc_id long, text string")


def op3_digests(docs: DataFrame) -> DataFrame:
    return repeats.marked(docs, find_repeats(docs)).mapInArrow(_digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return op3_digests(c.documents(spark, sf_dir))


OP3_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{c.WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i)),
m AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY h) AS again FROM g),
k AS (SELECT w.doc_id, t.i, w.w[t.i] AS word, coalesce(max(CAST(again AS INT)) OVER (PARTITION BY w.doc_id ORDER BY t.i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w) t JOIN w USING (doc_id) LEFT JOIN m ON m.doc_id = t.doc_id AND m.i = t.i)
SELECT doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(s.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count_if(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id) s USING (doc_id)"""
