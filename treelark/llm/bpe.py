"""Operator 7, byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A queue keeps, for each merge rank, a bucket of linked-list positions; a bitmap of 64-way levels finds the smallest rank
that has a bucket by find-first-set. Entries whose pair has changed since are skipped when they come up. Many pieces
share one queue: positions of one rank in different pieces don't touch, so a bucket is merged by a few array
operations, and a very long piece costs its merges times a logarithm, never their square. Where a merge of some rank
could give a pair of a smaller rank, only the leftmost entry of each piece is merged before the queue is asked again; so
the result is that of merging the lowest rank first, leftmost first.

Distinct pieces are encoded once and kept in a table by hash (of bounded size). Every run is decoded again and compared
with its bytes, so that a collision of hashes can't pass: such a run is encoded anew without the table.

Nulls and empty texts: no ids. Repeated rows are encoded each on its own; other columns are ignored. No shuffle.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .pretokens import pieces

#: Bytes of text whose new pieces are looked up together, bytes of new pieces that share a queue (a longer piece has one of its
#: own), and pieces kept in a worker's table.
GROUP_BYTES = 16 << 20
QUEUE_BYTES = 1 << 19
TABLE_PIECES = 1_200_000


class BitmapQueue:
    """A set of small integers with find-first-set over levels of 64-bit words."""

    def __init__(self, size: int):
        self.levels = []
        while True:
            size = (size + 63) >> 6
            self.levels.append([0] * size)
            if size == 1:
                break

    def add(self, x: int) -> None:
        for level in self.levels:
            w = x >> 6
            before = level[w]
            level[w] = before | 1 << (x & 63)
            if before:
                return
            x = w

    def remove(self, x: int) -> None:
        for level in self.levels:
            w = x >> 6
            level[w] &= ~(1 << (x & 63))
            if level[w]:
                return
            x = w

    def first(self) -> int:
        """The smallest member, or -1."""
        x = 0
        for level in reversed(self.levels):
            word = level[x]
            if not word:
                return -1
            x = x << 6 | (word & -word).bit_length() - 1
        return x


class Ranks:
    """A rank file: token bytes by id, pairs by rank, and the batch encoder."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        self.size = max(found) + 1
        tokens = [found.get(i, b"") for i in range(self.size)]
        self.id_of = {t: i for i, t in found.items()}
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.byte_id = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        left, right, rank = [], [], []
        for t, i in self.id_of.items():
            for k in range(1, len(t)):
                if (a := self.id_of.get(t[:k])) is not None and (b := self.id_of.get(t[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(i)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        self.inverting = np.zeros(self.size, bool)
        self.inverting[left[left > rank]] = True
        self.inverting[right[right > rank]] = True
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.int64(1) << 62), np.append(rank[order], -1)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces flat[offsets[i]:offsets[i + 1]], one after the other, and the count of each."""
        n = len(flat)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
        piece = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        ids = self.byte_id[flat]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        cut = np.flatnonzero(piece[1:] != piece[:-1])
        after[cut], before[cut + 1] = -1, -1
        after[-1] = -1
        pair = np.full(n, -1, np.int64)
        linked = np.flatnonzero(after >= 0)
        pair[linked] = self.rank_of(ids[linked], ids[linked + 1])
        queue, buckets = BitmapQueue(self.size), {}

        def push(at: np.ndarray, ranks: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            edge = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
            edge.append(len(at))
            for i, r in enumerate(ranks[edge[:-1]].tolist()):
                part = at[edge[i] : edge[i + 1]]
                if r in buckets:
                    buckets[r].append(part)
                else:
                    buckets[r] = [part]
                    queue.add(r)

        some = np.flatnonzero(pair >= 0)
        if len(some):
            push(some, pair[some])
        while (r := queue.first()) >= 0:
            queue.remove(r)
            parts = buckets.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[pair[at] == r]
            if len(at) > 1:
                at = np.unique(at)
                if self.inverting[r]:
                    lead = np.empty(len(at), bool)
                    lead[0] = True
                    np.not_equal(piece[at[1:]], piece[at[:-1]], out=lead[1:])
                    if not lead.all():
                        buckets[r] = [at[~lead]]
                        queue.add(r)
                        at = at[lead]
                else:
                    touch = after[at[:-1]] == at[1:]
                    if touch.any():
                        index = np.arange(len(at))
                        chain = np.where(np.append(True, ~touch), index, 0)
                        at = at[(index - np.maximum.accumulate(chain)) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            behind = after[gone]
            ids[at], ids[gone], pair[gone] = r, -1, -1
            after[at] = behind
            has = behind >= 0
            before[behind[has]] = at[has]
            ahead = before[at]
            pair[at] = -1
            left = np.concatenate([at[has], ahead[ahead >= 0]])
            if len(left):
                ranks = self.rank_of(ids[left], ids[after[left]])
                pair[left] = ranks
                good = ranks >= 0
                if good.any():
                    push(left[good], ranks[good])
        alive = ids >= 0
        return ids[alive], np.bincount(piece[alive], minlength=len(offsets) - 1)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids."""
        return self.flat[c.ranges(self.begin[ids], self.length[ids])]


class PieceTable:
    """Ids of known pieces by the hash of their bytes."""

    def __init__(self, encode, base: Ranks | None = None):
        self.encode, self.base = encode, base
        self.reset()

    def reset(self) -> None:
        self.keys, (self.begin, self.count, self.ids) = np.zeros(0, np.uint64), (np.zeros(0, np.int32) for _ in range(3))
        if self.base is not None:  # a piece that is a token is that token
            whole = np.flatnonzero(self.base.length)
            self._merge(c.span_hash(self.base.flat, self.base.begin[whole], self.base.begin[whole] + self.base.length[whole]), whole, np.ones(len(whole), np.int64))

    def _merge(self, keys, ids, count) -> None:
        begin = (len(self.ids) + np.cumsum(count) - count).astype(np.int32)
        self.ids, count = np.concatenate([self.ids, ids.astype(np.int32)]), count.astype(np.int32)
        keys, begin, count = np.concatenate([self.keys, keys]), np.concatenate([self.begin, begin]), np.concatenate([self.count, count])
        order = np.argsort(keys)
        self.keys, self.begin, self.count = keys[order], begin[order], count[order]

    def learn(self, keys: np.ndarray, flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> None:
        """Adds distinct new pieces; a queue's arrays take many times its bytes, so that many pieces have several queues."""
        parts = [self.encode(flat[c.ranges(begin[i:j], lengths[i:j])], c.prefix(lengths[i:j])) for i, j in c.runs(c.prefix(lengths), QUEUE_BYTES)]
        self._merge(keys, *(np.concatenate(x) for x in zip(*parts)))

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys aren't known."""
        if not len(self.keys):
            return np.ones(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] != keys

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)


def groups(data: np.ndarray, offsets: np.ndarray, table: PieceTable):
    """Yields, run by run of documents, (first row, end row, bytes, row offsets, ids, offsets of rows among the ids)."""
    for i, j in c.runs(offsets, GROUP_BYTES):
        parts, new = [], {}
        if len(table.keys) > TABLE_PIECES:
            table.reset()
        for a, b in c.runs(offsets[i : j + 1]):
            a, b = a + i, b + i
            raw, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts = pieces(raw, at)
            ends = np.append(starts[1:], len(raw)) if len(starts) else starts
            keys = c.span_hash(raw, starts, ends)
            distinct, first, inverse = c.distinct(keys)
            unknown = np.flatnonzero(table.missing(distinct))
            first = first[unknown]
            new.setdefault("keys", []).append(distinct[unknown])
            lengths = ends[first] - starts[first]
            new.setdefault("flat", []).append(raw[c.ranges(starts[first], lengths)])
            new.setdefault("length", []).append(lengths)
            parts.append((a, b, raw, at, np.searchsorted(starts, at), distinct, inverse.astype(np.int32)))  # kept for the group, so small
        keys, flat, lengths = (np.concatenate(new[k]) for k in ("keys", "flat", "length"))
        c.trim()
        if len(keys):
            keys, first, _ = c.distinct(keys)
            begin = (np.cumsum(lengths) - lengths)[first]
            table.learn(keys, flat, begin, lengths[first])
        del new, keys, flat, lengths
        c.trim()
        for a, b, raw, at, edges, distinct, inverse in parts:
            slot = table.look_up(distinct)
            count = table.count[slot][inverse]
            ids = table.ids[c.ranges(table.begin[slot][inverse], count)]
            total = c.prefix(count)
            rows = total[edges]
            yield a, b, raw, at, ids, rows


@lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(2)
def _table(path: str) -> PieceTable:
    return PieceTable(ranks(path).encode, ranks(path))


def encoded(data: np.ndarray, offsets: np.ndarray, path: str):
    """As groups(), with the decoded bytes at the end, which are compared with the texts."""
    vocabulary, table = ranks(path), _table(path)
    for a, b, raw, at, ids, rows in groups(data, offsets, table):
        back = vocabulary.decode(ids)
        if not np.array_equal(back, raw):
            fresh = [encode_plain(bytes(raw[x:y]), vocabulary) for x, y in zip(at, at[1:])]
            ids, rows = np.concatenate(fresh), np.append(0, np.cumsum([len(x) for x in fresh]))
            back = vocabulary.decode(ids)
        yield a, b, raw, at, ids, rows, back


def encode_plain(text: bytes, vocabulary: Ranks) -> np.ndarray:
    """One text without the table of pieces."""
    raw = np.frombuffer(text, np.uint8)
    starts = pieces(raw, np.array([0, len(raw)]))
    parts = [text[x:y] for x, y in zip(starts, [*starts[1:], len(raw)])]
    whole = [vocabulary.id_of.get(p) for p in parts]
    rest = [p for p, w in zip(parts, whole) if w is None]
    ids, count = vocabulary.encode(np.frombuffer(b"".join(rest), np.uint8), np.append(0, np.cumsum([len(p) for p in rest])).astype(np.int64))
    cut = iter(np.split(ids, np.cumsum(count)[:-1]) if len(count) else [])
    out = [next(cut) if w is None else np.array([w]) for w in whole]
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _digests(path: str):
    def run(it):
        for batch in it:
            data, offsets = c.text_buffer(batch.column(1))
            for a, b, _, _, ids, rows, back in encoded(data, offsets, path):
                raw = ids.astype("<u4").tobytes()
                bounds = c.prefix(ranks(path).length[ids])[rows]
                n = np.diff(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b].cast(pa.int64()), pa.array(n),
                        pa.array([hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(rows.tolist(), rows[1:].tolist())], pa.string()),
                        pa.array([hashlib.sha256(back[x:y]).hexdigest() for x, y in zip(bounds.tolist(), bounds[1:].tolist())], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _arrays(path: str):
    def run(it):
        for batch in it:
            data, offsets = c.text_buffer(batch.column(1))
            for a, b, _, _, ids, rows, _ in encoded(data, offsets, path):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int64()), pa.array(np.diff(rows)), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "n_tokens", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>) of each row of docs(doc_id, text); path: a rank file."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_arrays(path), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded_docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of each row of (doc_id, ids array<int>)."""

    def run(it):
        vocabulary = ranks(path)
        for batch in it:
            column = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            texts = [vocabulary.decode(np.asarray(x.values, np.int64)).tobytes().decode("utf-8", "replace") if len(x) else "" for x in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded_docs.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests(rank_file()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
