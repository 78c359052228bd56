"""Splits texts as public_tokenizers.PATTERN does, by array operations on whole runs of documents."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, BLANK, OTHER = 0, 1, 2, 3
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def _classes() -> np.ndarray:
    every = "".join(map(chr, [x if not 0xD800 <= x < 0xE000 else 32 for x in range(0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            out[m.start() : m.end()] = kind
    out[_WHITE] = BLANK
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which pieces start; offsets begin at 0, and no piece crosses a row."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data if len(lead) == len(data) else np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(cp)
    row = np.searchsorted(lead, offsets[:-1][offsets[1:] > offsets[:-1]])
    kind = _classes()[cp]
    fresh = np.zeros(n + 1, bool)
    fresh[row] = True
    turn = np.ones(n, bool)
    turn[1:] = kind[1:] != kind[:-1]
    start = fresh[:n] | turn
    inner = np.flatnonzero(turn & ~fresh[:n] & (kind != BLANK))
    inner = inner[kind[inner - 1] == BLANK]
    start[inner - 1] = True
    start[inner[cp[inner - 1] == 32]] = False
    # contractions: a lone apostrophe that no space precedes, then s t m d or re ve ll
    p = np.flatnonzero(cp == 39)
    if len(p):
        p = p[(p + 1 < n)]
        p = p[start[p] & ~fresh[p + 1] & (kind[p + 1] == LETTER)]
        c1 = cp[p + 1]
        one = (c1 == 115) | (c1 == 116) | (c1 == 109) | (c1 == 100)
        more = np.minimum(p + 2, n - 1)
        c2 = np.where((p + 2 < n) & ~fresh[p + 2], cp[more], 0)
        two = (((c1 == 114) | (c1 == 118)) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        for p, k in ((p[one], 2), (p[two & ~one], 3)):
            start[p + 1] = False
            after = p + k
            start[after[after < n]] = True
    return lead[np.flatnonzero(start)]
