"""An adaptive context-mixing range coder for token ids, run in lockstep over the lanes of a block.

A block starts afresh and is decoded by itself. It is cut into lanes of equal length, which are coded side by side by one
array operation each step and share one model, so that what one lane has seen helps all. The model predicts ids in three
orders: order 0 is the distribution of the block's ids so far; orders 1 and 2 keep, for the id before and for the two
before, the ids that follow (two and one) with their confidence. Mixed, they are one distribution

    P(x) = w2 [x = second-order id] + w1 [x = first first-order id] + v1 [x = second first-order id] + w0 P0(x),

whose four weights belong to the context of the three confidences (and whether the first two agree), and are learnt as the
block goes, from how much of the coded ids each part answered for. The range coder takes the part in 12 bits and, for order
0, the id in 22 more. Carries are kept in the digits and resolved once at the end.

Ids may be any whole numbers from 0 to 2**31 - 1; order 0 runs over the ids up to the block's largest, or, where that is
MANY or more, over a list of those that occur.
"""

from __future__ import annotations

import numpy as np

#: Ids and lanes of a full block; a block that is smaller has fewer lanes.
BLOCK, LANES, LEAST_STEPS, MANY = 1 << 21, 4096, 96, 1 << 20
#: Bits: of the parts and of order 0; the width never falls under 2**_LOW; of a digit.
_TOP, _ZERO, _LOW, _DIGIT = 12, 22, 38, 24
_SLOTS2, _SLOTS1 = 1 << 17, 1 << 16
#: An entry of a table is an id above this many bits of confidence, which can't overflow in a block.
_SURE = 24
_CONTEXTS = 16 * 8 * 4 * 2
_U = np.uint64
_FULL = _U((1 << 62) - 1)


class _Order0:
    """Cumulative frequencies of ids, of which every one may come."""

    def __init__(self, size: int):
        self.counts = np.zeros(size, np.int64)
        self.refresh(np.zeros(0, np.int64))

    def refresh(self, fresh: np.ndarray) -> None:
        self.counts += np.bincount(fresh, minlength=len(self.counts))
        seen = max(1, int(self.counts.sum()))
        self.upto = np.zeros(len(self.counts) + 1, np.int32)
        np.cumsum(self.counts * ((1 << _ZERO) - len(self.counts)) // seen + 1, out=self.upto[1:])


class _Model:
    def __init__(self, lanes: int, size: int):
        self.two, self.one, self.other = np.zeros(_SLOTS2, np.int64), np.zeros(_SLOTS1, np.int64), np.zeros(_SLOTS1, np.int64)
        self.before, self.older = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.zero = _Order0(size)
        self.answered = np.full((_CONTEXTS, 4), 0.4) + np.array([0, 0, 0, 1.0])
        self.steps, self.lanes = 0, lanes
        self._weigh()

    def _weigh(self) -> None:
        share = self.answered / self.answered.sum(1, keepdims=True)
        bounds = np.zeros((_CONTEXTS, 5), np.int64)
        np.cumsum((share * ((1 << _TOP) - 8)).astype(np.int64) + 2, 1, out=bounds[:, 1:])
        bounds[:, 4] = 1 << _TOP
        self.bounds = bounds.reshape(-1).astype(_U)
        self.inner = bounds[:, 1] | bounds[:, 2] << 16 | bounds[:, 3] << 32

    def predict(self) -> None:
        mixed = self.before * 0x9E3779B1
        self.at1 = mixed >> 15 & (_SLOTS1 - 1) if len(self.zero.counts) > _SLOTS1 else self.before
        mixed += self.older * 0x85EBCA77
        mixed >>= 15
        mixed &= _SLOTS2 - 1
        self.at2 = mixed
        self.e2, self.e1, self.eo = self.two.take(self.at2), self.one.take(self.at1), self.other.take(self.at1)
        self.c2, self.c1, self.co = self.e2 >> _SURE, self.e1 >> _SURE, self.eo >> _SURE
        low = (1 << _SURE) - 1
        self.s2, self.s1, self.so = self.e2 & low, self.e1 & low, self.eo & low
        ctx = np.minimum(self.s2, 15)
        ctx <<= 3
        ctx += np.minimum(self.s1 >> 1, 7)
        ctx <<= 2
        ctx += np.minimum(self.so, 3)
        ctx <<= 1
        ctx += self.c1 == self.c2
        self.ctx = ctx

    def part(self, x: np.ndarray) -> np.ndarray:
        """Which part answers for x: 0 order 2, 1 and 2 order 1, 3 order 0."""
        part = 3 - (x == self.co).view(np.int8)
        np.copyto(part, 1, where=x == self.c1)
        np.copyto(part, 0, where=x == self.c2)
        return part.astype(np.int64)

    def learn(self, x: np.ndarray, part: np.ndarray, table: np.ndarray) -> None:
        """A follower gains confidence when it comes, and loses it (half of it in order 2) when another does, until the
        other takes its place. Of equal places in one step the last lane's is kept, in coding as in decoding."""
        fresh = x << _SURE
        fresh += 1
        miss = x != self.c2
        lost = self.s2 + 1
        lost >>= 1
        lost += 1
        lost *= miss
        e2 = self.e2
        e2 += 1
        e2 -= lost
        np.copyto(e2, fresh, where=miss & (self.s2 < 2))
        self.two[self.at2] = e2
        first, second = x == self.c1, x == self.co
        e1, eo = self.e1, self.eo
        e1 += first
        e1 -= ~first & (self.s1 > 0)
        neither = ~(first | second)
        eo += second
        eo -= neither
        np.copyto(eo, fresh, where=neither & (self.so == 0))
        better = np.flatnonzero(second & (self.so >= self.s1))
        e1[better], eo[better] = eo[better], e1[better]
        self.one[self.at1] = e1
        self.other[self.at1] = eo
        self.ctx <<= 2
        self.ctx += part
        flat = self.answered.reshape(-1)
        flat += np.bincount(self.ctx, minlength=flat.size)
        self.older, self.before = self.before, x
        self.steps += 1
        n = self.steps
        if n < 16 or not n & 7:
            self._weigh()
        if not n & (n - 1) or not n & 63:
            last = n // 2 if not n & (n - 1) and n <= 64 else n - 64
            self.zero.refresh(table[last:n].reshape(-1))
            if self.answered.sum() > 1 << 21:
                self.answered *= 0.5


def _search(upto: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The last place at or under each value; sorted, they are found several times faster."""
    order = np.argsort(values)
    found = np.empty(len(values), np.int64)
    found[order] = np.searchsorted(upto, values[order], "right") - 1
    return found


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray) -> bytes:
    """A block: the header (ids, size of order 0, number of listed ids), the list, digits per lane, and the digits."""
    ids = np.asarray(ids, np.int64)
    if not len(ids):
        return np.zeros(3, "<i8").tobytes()
    size, listed = int(ids.max()) + 1, np.zeros(0, np.int64)
    if size >= MANY:
        listed, ids = np.unique(ids, return_inverse=True)
        size = len(listed)
    lanes, steps = _shape(len(ids))
    padded = np.zeros(lanes * steps, np.int64)
    padded[: len(ids)] = ids
    table = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    model = _Model(lanes, size)
    low, width = np.zeros(lanes, _U), np.full(lanes, _FULL)
    digits, count = np.zeros((steps + 8, lanes), np.uint32), np.zeros(lanes, np.int64)
    top, zero, floor, keep, shift, mask = _U(_TOP), _U(_ZERO), _U(1 << _LOW), _U(_LOW), _U(_DIGIT), _U((1 << _LOW) - 1)

    def emit(low, width):
        out = np.flatnonzero(width < floor)
        while len(out):
            nonlocal digits
            here = low[out]
            at = count[out]
            if int(at.max()) + 6 > len(digits):
                digits = np.concatenate([digits, np.zeros_like(digits[: steps // 2 + 8])])
            digits[at, out] = here >> keep
            low[out] = (here & mask) << shift
            width[out] <<= shift
            count[out] += 1
            out = out[width[out] < floor]

    for t in range(steps):
        x = table[t]
        model.predict()
        part = model.part(x)
        at = model.ctx * 5
        at += part
        lo, hi = model.bounds.take(at), model.bounds.take(at + 1)
        width >>= top
        low += width * lo
        hi -= lo
        width *= hi
        rest = np.flatnonzero(part == 3)
        if len(rest):
            own = x[rest]
            begin = model.zero.upto.take(own)
            step = width[rest] >> zero
            low[rest] += step * begin.astype(_U)
            width[rest] = step * (model.zero.upto.take(own + 1) - begin).astype(_U)
        emit(low, width)
        model.learn(x, part, table)
    for _ in range(3):  # flush
        digits[count, np.arange(lanes)] = low >> keep
        low = (low & mask) << shift
        count += 1
    for i in range(len(digits) - 1, 0, -1):
        digits[i - 1] += digits[i] >> np.uint32(_DIGIT)
    digits = digits.T
    body = digits[np.arange(digits.shape[1]) < count[:, None]].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    head = np.array([int(len(ids)), size, len(listed)], "<i8")
    return b"".join([head.tobytes(), listed.astype("<i8").tobytes(), count.astype("<u4").tobytes(), body.tobytes()])


def decode(raw: bytes) -> np.ndarray:
    """The ids that encode() took."""
    n, size, named = np.frombuffer(raw, "<i8", 3).tolist()
    if not n:
        return np.zeros(0, np.int32)
    listed = np.frombuffer(raw, "<i8", named, 24)
    lanes, steps = _shape(n)
    count = np.frombuffer(raw, "<u4", lanes, 24 + 8 * named).astype(np.int64)
    body = np.frombuffer(raw, np.uint8, 3 * int(count.sum()), 24 + 8 * named + 4 * lanes).reshape(-1, 3)
    digits = np.zeros((len(body) + 3, 4), np.uint8)
    digits[: len(body), :3] = body
    digits = digits.view("<u4").reshape(-1).astype(_U)
    end = np.cumsum(count)
    at = end - count
    # 62 bits: all of two digits, 14 of the third, of which ten are still to come
    code = digits[at] << _U(38) | digits[at + 1] << _U(14) | digits[at + 2] >> _U(10)
    rest = digits[at + 2] & _U(1023)
    at = at + 3
    table = np.zeros((steps, lanes), np.int64)
    model = _Model(lanes, size)
    width = np.full(lanes, _FULL)
    top, zero, floor, shift, ten, fourteen = _U(_TOP), _U(_ZERO), _U(1 << _LOW), _U(_DIGIT), _U(10), _U(14)
    for t in range(steps):
        model.predict()
        width >>= top
        value = (code // width).astype(np.int64)
        inner = model.inner.take(model.ctx)
        part = (value >= (inner & 0xFFFF)).astype(np.int64)
        inner >>= 16
        part += value >= (inner & 0xFFFF)
        inner >>= 16
        part += value >= inner
        base = model.ctx * 5
        base += part
        lo, hi = model.bounds.take(base), model.bounds.take(base + 1)
        code -= width * lo
        hi -= lo
        width *= hi
        x = np.where(part == 0, model.c2, np.where(part == 1, model.c1, model.co))
        some = np.flatnonzero(part == 3)
        if len(some):
            step = width[some] >> zero
            here = code[some]
            own = np.minimum(_search(model.zero.upto, (here // step).astype(np.int32)), size - 1)
            begin = model.zero.upto.take(own)
            code[some] = here - step * begin.astype(_U)
            width[some] = step * (model.zero.upto.take(own + 1) - begin).astype(_U)
            x[some] = own
        out = np.flatnonzero(width < floor)
        while len(out):
            after = at[out]
            fresh = np.where(after < end[out], digits[np.minimum(after, len(digits) - 1)], _U(0))
            code[out] = (code[out] << shift) | (rest[out] << fourteen) | (fresh >> ten)
            rest[out] = fresh & _U(1023)
            at[out] = after + 1
            width[out] <<= shift
            out = out[width[out] < floor]
        table[t] = x
        model.learn(x, part, table)
    ids = np.ascontiguousarray(table.T).reshape(-1)[:n]
    return (listed[ids] if named else ids).astype(np.int32)
