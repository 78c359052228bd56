"""Terms counted over Arrow batches: the tokens of text.tokens(), found on the bytes of many texts at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .. import constants as k
from . import text as t

#: Bytes of text that are worked on at a time; a longer text is alone.
SLICE = 4_000_000
#: The first bytes of combining marks, of little else.
MARKED = re.compile(b"[\xcc\xcd]")
LOWER, UPPER, DIGIT, SCORE = 1, 2, 3, 4
_KIND, _LOWERED = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
for _kind, _bytes in ((LOWER, b"abcdefghijklmnopqrstuvwxyz"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, b"0123456789"), (SCORE, b"_")):
    _KIND[list(_bytes)] = _kind
_LOWERED[65:91] += 32
_STOP = pa.array([w.encode() for w in k.STOPWORDS], pa.large_binary())


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, and where each begins and ends; null counts as empty."""
    a = pc.fill_null(texts.cast(pa.large_binary()), b"")
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = a.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _composed(texts: pa.Array) -> pa.Array:
    """text.composed(), where a text may hold combining marks."""
    return pa.array([re.sub(t.COMPOSING, "\u00e9", x.decode(errors="replace")).encode() if x and MARKED.search(x) else x for x in texts.cast(pa.large_binary()).to_pylist()], pa.large_binary())


def _parts(fragment: str, known: dict[str, list[bytes]]) -> list[bytes]:
    """What a structured fragment has beside itself."""
    if fragment not in known:
        if len(known) >= 50_000:
            known.clear()
        known[fragment] = [x.encode() for x in t.plain_tokens(fragment, keep_stopwords=True)[1:]]
    return known[fragment]


def tokens(texts: pa.Array, known: dict[str, list[bytes]]) -> tuple[pa.Array, np.ndarray]:
    """Tokens of texts and the number of the text that each is of, in no order; stopwords are left in."""
    data, at = _bytes_of(texts)
    if ((data == 0xCC) | (data == 0xCD)).any():
        data, at = _bytes_of(_composed(texts))
    kind = _KIND[data]
    inside = kind > 0
    first = np.zeros(len(data) + 1, bool)
    first[at] = True  # no fragment goes on from one text to the next
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    short = stop - start < 2
    inside[start[short]] = False
    start, stop = start[~short], stop[~short]
    lengths = stop - start
    doc = np.searchsorted(at, start, "right") - 1
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])
    own, which = data[inside], kind[inside]
    if not len(lengths):
        return pa.array([], pa.large_binary()), doc
    last = ends[1:] - 1
    turn = np.zeros(len(own), bool)  # lower to upper
    turn[:-1] = (which[:-1] == LOWER) & (which[1:] == UPPER)
    acronym = np.zeros(len(own), bool)
    acronym[:-2] = (which[:-2] == UPPER) & (which[1:-1] == UPPER) & (which[2:] == LOWER)
    turn[last] = acronym[last] = acronym[last - 1] = False
    structured = np.flatnonzero(np.logical_or.reduceat(turn | acronym | (which >= DIGIT), ends[:-1]))
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(_LOWERED[own]))])
    more, of = [], []
    for i in structured.tolist():
        for x in _parts(own[ends[i] : ends[i + 1]].tobytes().decode(), known):
            more.append(x)
            of.append(doc[i])
    return (pa.concat_arrays([found, pa.array(more, pa.large_binary())]), np.concatenate([doc, np.array(of, doc.dtype)])) if more else (found, doc)


def _counted(found: pa.Array, doc: np.ndarray, named: np.ndarray, stop: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms, how often each is there, and in how many texts that are named."""
    coded = found.dictionary_encode()
    code, many = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
    pairs = doc * many + code
    pairs.sort()
    once = pairs[np.concatenate([np.ones(min(1, len(pairs)), bool), pairs[1:] != pairs[:-1]])]
    n, docs = np.bincount(code, minlength=many), np.bincount((once % many)[named[once // many]], minlength=many)
    terms = coded.dictionary
    if not stop:
        return terms, n[: len(terms)], docs[: len(terms)]
    kept = ~pc.is_in(terms, value_set=_STOP).to_numpy(zero_copy_only=False)
    return terms.filter(pa.array(kept)), n[: len(terms)][kept], docs[: len(terms)][kept]


def _slices(batch: pa.RecordBatch, zones: list[str]) -> Iterator[pa.RecordBatch]:
    sizes = sum(pc.fill_null(pc.binary_length(batch[z]), 0).to_numpy(zero_copy_only=False).astype(np.int64) for z in zones)
    part = np.cumsum(sizes) // SLICE
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def counter(zones: list[str], joined: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over (scope, *zones), a scope being in one row: (term, zone, n, docs) of some texts at a time, to be
    summed up. Joined: a document counts once whatever its zones; zone is empty. Stopwords stay in symbols only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[bytes]] = {}
        for batch in batches:
            for rows in _slices(batch, zones) if batch.num_rows else ():
                named = pc.is_valid(rows["scope"]).to_numpy(zero_copy_only=False)
                each = [(z, *tokens(rows[z], known)) for z in zones]
                if joined:
                    plain = [(f.filter(pa.array(keep)), d[keep]) for z, f, d in each for keep in [np.ones(len(d), bool) if z == "symbols" else ~pc.is_in(f, value_set=_STOP).to_numpy(zero_copy_only=False)]]
                    each = [("", pa.concat_arrays([f for f, _ in plain]), np.concatenate([d for _, d in plain]))]
                for z, found, doc in each:
                    terms, n, docs = _counted(found, doc, named, not joined and z != "symbols")
                    yield pa.RecordBatch.from_arrays([terms.cast(pa.large_string()).cast(pa.string()), pa.array([z] * len(terms), pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["term", "zone", "n", "docs"])

    return run
