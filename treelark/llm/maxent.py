"""Operator 8, language-model scoring: a hashed maximum-entropy model with class-factored softmax.

P(word | context) = P(class | context) * P(word | class, context). Classes are bands of frequency within languages, one for
words seen once (half of its mass is for the unseen word), one for the end; languages beyond the LANGS - 1 commonest share
theirs. The first factor is a softmax over classes with hashed features: the word before, the word two before (a skip
feature), both together, and a bias. The second begins as the word's share of its class, and the features of the word
with the one and the two words before move it: their counts grow with the corpus, one hashed feature per different n-gram.

1. Texts become blocks of word numbers, with each block's distinct words as 64-bit hashes.
2. Blocks push their words' counts to slices of the hash's range, each of which adds up what it gets and answers every
   block; so do they then with their n-grams, hashed to a width that grows with the rows. Sorted hashes travel as packed
   differences, some two or three bytes each, and nothing is exploded to rows.
3. Each block then knows for each of its tokens the training counts of the word and of its n-grams.
4. Each round of training, tasks add up observed minus expected features over all training tokens, each different context
   once; the sums (of the class model's fixed size) are reduced in slices, in two steps, and the driver moves the weights:
   a gradient step with diagonal curvature. How far an n-gram's count is trusted is learnt too: for contexts seen about
   2**k times, the share of training tokens that would be new after them if left out is what the lower order gets.
5. All texts are scored in numpy batches.

Slices hold about SLICE entries. There are blocks x slices pieces, which is the square of the input, with few entries in
each: at 30 GB some 40 million; for far larger tables BLOCK_BYTES and SLICE are to grow.

Nulls count as empty texts (one end token); a null doc_id is a training row; repeated rows are counted and scored each; a
long text is a block of its own; an empty table gives an empty table. Columns but doc_id, text and lang are ignored, and
lang only helps to form classes. Without training rows base_score follows its formula, and score is the untrained model's.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

BLOCK_BYTES = 10 << 20
LANGS, BANDS = 8, (3e-3, 3e-4, 1e-5)
RARE, END = LANGS * (len(BANDS) + 1), LANGS * (len(BANDS) + 1) + 1
CLASSES = END + 1
FEATURES, ROUNDS, BATCH, SLICES = 1 << 15, 2, 1 << 15, 16
#: Entries (words or n-grams of blocks) that a slice takes, and most words before a token that its n-grams hold.
SLICE, ORDERS = 1 << 22, 2
_U = np.uint64

BLOCKS = "block long, doc_id array<long>, held array<boolean>, n array<long>, size long, train long, ends long, ids binary, keys binary, c binary, lang binary"
#: To blocks: of kind 0 about words, of kind 2 about n-grams; of kind 1, the classes' sums.
ANSWERS = "kind int, block long, slice int, n binary, class binary, at int, tokens long, types long"
READY = "kind int, doc_id array<long>, held array<boolean>, n array<long>, ids binary, words binary, classes binary, buckets binary, grams binary, at int, novel long, total long"
FINAL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}


def _fields(schema: str) -> list[list[str]]:
    return [x.split() for x in schema.split(", ")]


def _batch(schema: str, rows: int, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[k].cast(_KINDS[t]) if k in columns else pa.nulls(rows, _KINDS[t]) for k, t in _fields(schema)], names=[k for k, _ in _fields(schema)])


def _empty(schema: str) -> pa.Table:
    return pa.schema([(k, _KINDS[t]) for k, t in _fields(schema)]).empty_table()


def pack(x: np.ndarray) -> bytes:
    """Whole numbers by planes of bytes, compressed; high planes of small numbers cost next to nothing."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=_U(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, _U), dtype=_U)


def _blocks(it):
    task, serial = TaskContext.get().partitionId(), 0
    for batch in it:
        data, offsets = c.text_buffer(batch.column(3))
        held_out, lang = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        for i, j in c.runs(offsets, BLOCK_BYTES):
            block, serial = (task << 32) | serial, serial + 1
            keys, sizes = [], []
            for a, b in c.runs(offsets[i : j + 1]):
                raw, at = c.LOWER[data[offsets[i + a] : offsets[i + b]]], offsets[i + a : i + b + 1] - offsets[i + a]
                s, e, cut = c.words(raw, at)
                keys.append(c.span_hash(raw, s, e))
                sizes.append(np.diff(cut))
            n = np.concatenate(sizes)
            distinct, _, inverse = c.distinct(np.concatenate(keys))
            del keys
            rank = np.empty(len(distinct), np.int32)
            order = np.argsort(-np.bincount(inverse, minlength=len(distinct)), kind="stable")  # small numbers for frequent words
            rank[order] = np.arange(1, len(distinct) + 1)
            own = rank[inverse]
            del inverse
            train = ~held_out[i:j]
            of = np.repeat(train, n)
            by = np.bincount(own[of].astype(np.int64) * LANGS + np.repeat(lang[i:j], n)[of], minlength=(len(distinct) + 1) * LANGS).reshape(-1, LANGS)[1:]
            full = np.zeros(len(own) + j - i, np.int32)
            full[np.arange(len(own)) + np.repeat(np.arange(j - i), n)] = own
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), x)  # noqa: E731, B023
            yield _batch(
                BLOCKS, 1, block=pa.array([block]), doc_id=one(batch.column(0)[i:j]), held=one(pa.array(held_out[i:j])), n=one(pa.array(n + 1)), size=pa.array([len(distinct)]), train=pa.array([int(by.sum())]), ends=pa.array([int(train.sum())]),
                ids=pa.array([pack(full)], pa.binary()), keys=pa.array([distinct[order].tobytes()], pa.binary()), c=pa.array([pack(by.sum(1))], pa.binary()), lang=pa.array([pack(by.argmax(1).astype(np.uint8))], pa.binary()),
            )
            del full, own, by, distinct, order
            c.trim()


def blocks(docs: DataFrame) -> DataFrame:
    """The table of blocks of docs(doc_id, text, lang); the first word of a block has number 1, the end has 0."""
    langs = [r[0] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGS - 1).collect()]
    code = F.lit(LANGS - 1)
    for k, name in enumerate(langs):
        code = F.when(F.col("lang").eqNullSafe(F.lit(name)), k).otherwise(code)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))) % 5 == 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), code.cast("int").alias("lang"), "text")
    return c.written(rows.mapInArrow(_blocks, BLOCKS), "blocks")


def _bits(entries: int) -> int:
    """Leading bits of a hash that number its slice."""
    return max(0, (max(entries, 1) - 1) // SLICE).bit_length()


def _sliced(keys: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slices that sorted keys of so many bits fall in, and where each begins and ends."""
    of = (keys >> _U(width - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    return of[first], np.append(first, len(keys))


def _push_words(bits: int):
    def run(it):
        for batch in it:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], _U)
                order = np.argsort(keys)
                keys, times, lang = keys[order], unpack(row["c"], np.int64)[order], unpack(row["lang"], np.uint8)[order]
                of, cut = _sliced(keys, 64, bits)
                for s, a, b in zip(of.tolist(), cut.tolist(), cut[1:].tolist()):
                    yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([row["block"]]), *(pa.array([x], pa.binary()) for x in (keys[a:b].tobytes(), pack(times[a:b]), pack(lang[a:b])))], names=["slice", "block", "piece", "c", "lang"])

    return run


def _slices(it):
    """Tables of the rows of one slice each, of batches sorted by slice."""
    held: list = []
    for batch in it:
        of = np.asarray(batch.column(0))
        cut = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cut, cut[1:]):
            if held and a < b and held[-1].column(0)[0].as_py() != of[a]:
                yield pa.Table.from_batches(held)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Counts:
    """Totals that the scores need: training tokens, types, training rows and the classes' sizes."""

    def __init__(self, tokens: int, types: int, ends: int, by_class: dict[int, tuple[int, int]]):
        self.tokens, self.types, self.ends, self.by_class = tokens, types, ends, by_class
        #: Classes that the model tells apart: those with training tokens, the rare and the end. The others have no words.
        self.active = sorted({k for k, (n, _) in by_class.items() if n} | {RARE, END})


def class_of(n: np.ndarray, lang: np.ndarray, tokens: int) -> np.ndarray:
    band = np.full(len(n), len(BANDS))
    for k in reversed(range(len(BANDS))):
        band[n >= BANDS[k] * tokens] = k
    return np.where(n < 2, RARE, lang.astype(np.int64) * (len(BANDS) + 1) + band).astype(np.uint8)


def _total_words(tokens: int):
    def run(it):
        for table in _slices(it):
            pieces = [np.frombuffer(x.as_py(), _U) for x in table.column("piece")]
            times = np.concatenate([unpack(x.as_py(), np.int64) for x in table.column("c")])
            lang = np.concatenate([unpack(x.as_py(), np.uint8) for x in table.column("lang")])
            distinct, inverse = np.unique(np.concatenate(pieces), return_inverse=True)
            n = np.bincount(inverse, times, len(distinct)).astype(np.int64)
            most = np.zeros(len(distinct), np.int64)  # the language of the block that has a word most often, with its count
            np.maximum.at(most, inverse, times * LANGS + lang)
            kind = class_of(n, most % LANGS, tokens)
            cut = c.prefix(np.array([len(x) for x in pieces], np.int64)).tolist()
            for block, a, b in zip(table.column("block").to_pylist(), cut, cut[1:]):
                yield _batch(ANSWERS, 1, kind=pa.array([0]), block=pa.array([block]), slice=pa.array([table.column("slice")[0].as_py()]), n=pa.array([pack(n[inverse[a:b]])], pa.binary()), **{"class": pa.array([pack(kind[inverse[a:b]])], pa.binary())})
            sums, types = np.bincount(kind, n, CLASSES).astype(np.int64), np.bincount(kind, n > 0, CLASSES).astype(np.int64)
            yield _batch(ANSWERS, CLASSES, kind=pa.array(np.ones(CLASSES, np.int32)), at=pa.array(np.arange(CLASSES)), tokens=pa.array(sums), types=pa.array(types))
            c.trim()

    return run


def _reduced(pieces: DataFrame, bits: int, run, schema: str) -> DataFrame:
    """Pieces brought together by slice and given slice by slice to run."""
    parts = min(1 << bits, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pieces.repartition(parts, "slice").sortWithinPartitions("slice", "block").mapInArrow(run, schema)


def count_words(table: DataFrame) -> tuple[DataFrame, Counts]:
    """Counts and classes of each block's words, by slice, and the totals."""
    sizes = table.agg(F.sum("train"), F.sum("ends"), F.sum("size")).first()
    ends, bits = sizes[1] or 0, _bits(sizes[2] or 0)
    tokens = (sizes[0] or 0) + ends
    pieces = table.select("block", "keys", "c", "lang").mapInArrow(_push_words(bits), "slice int, block long, piece binary, c binary, lang binary")
    words = c.written(_reduced(pieces, bits, _total_words(tokens), ANSWERS), "words")
    by_class = {r[0]: (r[1], r[2]) for r in words.where("kind = 1").groupBy("at").agg(F.sum("tokens"), F.sum("types")).collect()}
    return words, Counts(tokens, sum(t for _, t in by_class.values()) + (ends > 0), ends, by_class)


def _ids(row: dict) -> np.ndarray:
    return unpack(row["ids"], np.int32)


def _docs(row: dict) -> np.ndarray:
    n = np.asarray(row["n"], np.int64)
    return np.repeat(np.arange(len(n)), n)


def histories(w: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """By order: a hash of the words before each token, of which those before the text count as one word."""
    out, history = [], np.zeros(len(w), _U)
    for k in range(1, ORDERS + 1):
        before = np.zeros(len(w), _U)
        before[k:] = np.where(doc[k:] == doc[:-k], w[:-k], _U(0))
        history = c.mix(history * _U(0xA0761D6478BD642F) + before + _U(k))
        out.append(history)
    return out


def _grams(row: dict, width: int):
    """By order: the distinct n-grams of a block, sorted hashes of so many bits, and the number of each token's."""
    w = np.append(_U(1), c.mix(np.frombuffer(row["keys"], _U) ^ _U(0x632BE59BD9B4E019)))[_ids(row)]
    for k, context in enumerate(histories(w, _docs(row))):
        gram = c.mix(context * _U(0xE7037ED1A0B428DB) + w + _U(k)) >> _U(64 - width)
        yield np.unique(gram, return_inverse=True)


def _push_grams(width: int, bits: int):
    def run(it):
        for batch in it:
            for row in batch.to_pylist():
                train = ~np.asarray(row["held"], bool)[_docs(row)]
                for k, (gram, inverse) in enumerate(_grams(row, width)):
                    times = np.bincount(inverse[train], minlength=len(gram)).astype(np.int32)
                    of, cut = _sliced(gram, width, bits)
                    for s, a, b in zip(of.tolist(), cut.tolist(), cut[1:].tolist()):
                        yield pa.RecordBatch.from_arrays([pa.array([(k << bits) + s], pa.int32()), pa.array([row["block"]]), *(pa.array([x], pa.binary()) for x in (pack_sorted(gram[a:b]), pack(times[a:b])))], names=["slice", "block", "piece", "c"])
                c.trim()

    return run


def _total_grams(it):
    for table in _slices(it):
        pieces = [unpack_sorted(x.as_py()) for x in table.column("piece")]
        times = np.concatenate([unpack(x.as_py(), np.int32) for x in table.column("c")])
        _, inverse = np.unique(np.concatenate(pieces), return_inverse=True)
        n = np.bincount(inverse, times).astype(np.int64)
        cut = c.prefix(np.array([len(x) for x in pieces], np.int64)).tolist()
        del pieces, times
        for block, a, b in zip(table.column("block").to_pylist(), cut, cut[1:]):
            yield _batch(ANSWERS, 1, kind=pa.array([2]), block=pa.array([block]), slice=pa.array([table.column("slice")[0].as_py()]), n=pa.array([pack(n[inverse[a:b]])], pa.binary()))
        c.trim()


def contexts_seen(grams: np.ndarray, before: np.ndarray, doc: np.ndarray, ends: int) -> np.ndarray:
    """By order and token: how often training has its context. grams: counts of each token's n-grams, by order; before: of
    each token's word. A context of one word is followed as often as the word comes, one of two as often as their n-gram."""
    first = np.append(True, doc[1:] != doc[:-1]) if len(doc) else np.zeros(0, bool)
    out = np.empty((ORDERS, len(doc)), np.int64)
    for k, x in enumerate((before, *grams[: ORDERS - 1])):
        out[k, 1:] = x[:-1]
        out[k, first] = ends
    return out


def _bucket(m: np.ndarray) -> np.ndarray:
    """The power of two that m reaches; 0 for none."""
    return np.frexp(m.astype(np.float64))[1]


BUCKETS = 64


def _ready(width: int, ends: int):
    def run(blocks_: pa.Table, answers: pa.Table) -> pa.Table:
        out, answers = [], answers.sort_by([("kind", "ascending"), ("slice", "ascending")])
        kinds = np.asarray(answers.column("kind").combine_chunks())
        about = lambda kind, name, of: np.concatenate([np.zeros(0, of), *(unpack(x.as_py(), of) for x in answers.column(name).filter(pa.array(kinds == kind)))])
        got = about(2, "n", np.int64)
        for row in blocks_.to_pylist():
            keys = np.frombuffer(row["keys"], _U)
            order = np.argsort(keys)
            words, classes = np.zeros(len(order), np.int64), np.zeros(len(order), np.uint8)
            words[order], classes[order] = about(0, "n", np.int64), about(0, "class", np.uint8)
            per_token, done = [], 0
            for gram, inverse in _grams(row, width):
                per_token.append(got[done : done + len(gram)][inverse])
                done += len(gram)
            per_token, doc, ids = np.stack(per_token), _docs(row), _ids(row)
            n = np.append(ends, words)
            train = ~np.asarray(row["held"], bool)[doc]
            seen = _bucket(contexts_seen(per_token, n[ids], doc, ends)[:, train])
            total = np.stack([np.bincount(x, minlength=BUCKETS) for x in seen])
            novel = np.stack([np.bincount(x[y == 1], minlength=BUCKETS) for x, y in zip(seen, per_token[:, train])])
            buckets = (keys >> _U(48)).astype(np.uint16)
            same = {k: pa.array([row[k]], _KINDS[t]) for k, t in _fields(READY) if k in ("doc_id", "held", "n", "ids")}
            out.append(_batch(READY, 1, kind=pa.array([0]), words=pa.array([pack(words)], pa.binary()), classes=pa.array([pack(classes)], pa.binary()), buckets=pa.array([buckets.tobytes()], pa.binary()), grams=pa.array([pack(per_token.reshape(-1))], pa.binary()), **same))
            out.append(_batch(READY, ORDERS * BUCKETS, kind=pa.array(np.ones(ORDERS * BUCKETS, np.int32)), at=pa.array(np.arange(ORDERS * BUCKETS)), novel=pa.array(novel.reshape(-1)), total=pa.array(total.reshape(-1))))
        c.trim()
        return pa.Table.from_batches(out) if out else _empty(READY)

    return run


def trusted(ready: DataFrame) -> np.ndarray:
    """By order and power of two of a context's count: what the lower order gets."""
    novel, total = np.zeros(ORDERS * BUCKETS), np.zeros(ORDERS * BUCKETS)
    for at, x, y in ready.where("kind = 1").groupBy("at").agg(F.sum("novel"), F.sum("total")).collect():
        novel[at], total[at] = x, y
    return np.clip((novel + 0.5) / (total + 1), 1e-3, 1 - 1e-3).reshape(ORDERS, BUCKETS)


def smoothed(p: np.ndarray, n: np.ndarray, m: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """n of m followers of a context, and the part rest of the lower order's p; p where the context wasn't seen."""
    return np.where(m > 0, (1 - rest) * n / np.maximum(m, 1) + rest * p, p)


def _features(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    """Slots of the features of the words (by bucket from 1; 0: before the text) one and two before."""
    return [(c.mix(x) >> _U(49)).astype(np.int32) for x in (one + _U(1 << 20), two + _U(1 << 21), (one << _U(24)) + two + _U(1 << 50))]


def _contexts(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Each token's context of the class model, as one number, and its document."""
    bucket = np.append(_U(0xFFFF), np.frombuffer(row["buckets"], np.uint16).astype(_U))[_ids(row)] + _U(1)
    doc = _docs(row)
    one, two = np.zeros(len(doc), _U), np.zeros(len(doc), _U)
    one[1:] = np.where(doc[1:] == doc[:-1], bucket[:-1], _U(0))
    two[2:] = np.where(doc[2:] == doc[:-2], bucket[:-2], _U(0))
    return one << _U(17) | two, doc


def logits(weights: np.ndarray, bias: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Classes x contexts: sums of the features' weights (classes x FEATURES) and the bias."""
    slots = _features(context >> _U(17), context & _U((1 << 17) - 1))
    x = np.repeat(bias[:, None], len(context), 1)
    for k in range(len(bias)):
        for f in slots:
            x[k] += weights[k].take(f)
    return x


def probabilities(weights: np.ndarray, bias: np.ndarray, context: np.ndarray) -> np.ndarray:
    """P(class | context), classes x contexts."""
    x = logits(weights, bias, context)
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _sums(state, places: np.ndarray):
    """Per task and slice of the classes' features, sums over training tokens: observed where state is None, else expected."""
    classes = int(places.max()) + 1

    def run(it):
        total = np.zeros((classes, FEATURES))
        weights, bias = state.value if state is not None else (None, None)
        for batch in it:
            for row in batch.to_pylist():
                context, doc = _contexts(row)
                use = ~np.asarray(row["held"], bool)[doc]
                context = context[use]
                if state is None:
                    kind = places[np.append(END, unpack(row["classes"], np.uint8))[_ids(row)]][use]
                    for f in _features(context >> _U(17), context & _U((1 << 17) - 1)):
                        total.reshape(-1)[:] += np.bincount(kind * FEATURES + f, minlength=total.size)
                    continue
                context, times = np.unique(context, return_counts=True)
                for a in range(0, len(context), BATCH):
                    some = context[a : a + BATCH]
                    p = probabilities(weights, bias, some) * times[a : a + BATCH]
                    for f in _features(some >> _U(17), some & _U((1 << 17) - 1)):
                        for k in range(classes):
                            total[k] += np.bincount(f, p[k], FEATURES)
        parts = np.ascontiguousarray(total.T).astype(np.float32).reshape(SLICES, -1)
        del total
        c.trim()
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array(np.full(SLICES, task)), pa.array([zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in parts], pa.binary())], names=["slice", "part", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = 0.0
    for x in table.column("sums"):
        total = total + np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer()), np.float32).astype(np.float64)
    return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int64()), "part": pa.array([table.column("part")[0].as_py()], pa.int64()), "sums": pa.array([zstandard.ZstdCompressor(level=1).compress(total.astype(np.float32).tobytes())], pa.binary())})


def _gather(ready: DataFrame, state, places: np.ndarray) -> np.ndarray:
    """The sums of all tasks, FEATURES x classes: added within about a square root of the tasks, then altogether."""
    schema = "slice long, part long, sums binary"
    parts = ready.select("held", "n", "ids", "classes", "buckets").mapInArrow(_sums(state, places), schema)
    wide = max(1, int(ready.rdd.getNumPartitions() ** 0.5))
    near = parts.withColumn("part", F.pmod("part", F.lit(wide))).groupBy("slice", "part").applyInArrow(_add, schema)
    rows = near.groupBy("slice").applyInArrow(_add, schema).collect()  # the model's size, whatever the input
    classes = int(places.max()) + 1
    out = np.zeros((SLICES, FEATURES // SLICES * classes))
    for r in rows:
        out[r["slice"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["sums"]), np.float32)
    return out.reshape(FEATURES, classes)


def placed(counts: Counts) -> np.ndarray:
    """The number, among the classes the model tells apart, of each class."""
    places = np.zeros(CLASSES, np.int64)
    places[counts.active] = np.arange(len(counts.active))
    return places


def train(ready: DataFrame, places: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights (classes x FEATURES) and bias of the class model."""
    seen = _gather(ready, None, places)
    share = (seen.sum(0) + 1) / (seen.sum() + seen.shape[1])
    bias = np.log(share)
    weights = 0.5 * (np.log((seen + 4 * share) / (seen.sum(1, keepdims=True) + 4)) - np.log(share))
    done = lambda: (np.ascontiguousarray(weights.T, np.float32), bias.astype(np.float32))
    for _ in range(rounds):
        state = ready.sparkSession.sparkContext.broadcast(done())  # of the model's fixed size
        expected = _gather(ready, state, places)
        weights += np.clip((seen - expected) / (expected + 2.0), -1.5, 3.0) / 2.0
        state.unpersist()
    return done()


def _score(state, rest: np.ndarray, counts: Counts):
    places = placed(counts)
    mass = np.ones(CLASSES)
    for k, (tokens, _) in counts.by_class.items():
        mass[k] = max(tokens, 1)
    once = max(counts.by_class.get(RARE, (0, 0))[1], 1)

    def run(it):
        weights, bias = state.value
        for batch in it:
            for row in batch.to_pylist():
                ids, (context, doc) = _ids(row), _contexts(row)
                n, kind = np.append(counts.ends, unpack(row["words"], np.int64)), np.append(END, unpack(row["classes"], np.uint8))
                base = np.log10((n + 0.5) / (counts.tokens + 0.5 * (counts.types + 1)))
                inner = np.maximum(n, 1) / mass[kind]
                inner[0] = 1.0
                inner[kind == RARE] = np.where(n[kind == RARE] > 0, 0.5 / once, 0.5)
                distinct, inverse = np.unique(context, return_inverse=True)
                own, p = places[kind[ids]], np.empty(len(ids))
                order = np.argsort(inverse, kind="stable")
                cut = np.searchsorted(inverse[order], np.arange(0, len(distinct) + BATCH, BATCH))
                for k, a in enumerate(range(0, len(distinct), BATCH)):
                    some = order[cut[k] : cut[k + 1]]
                    p[some] = probabilities(weights, bias, distinct[a : a + BATCH])[own[some], inverse[some] - a]
                p *= inner[ids]
                grams = unpack(row["grams"], np.int64).reshape(ORDERS, -1)
                for k, m in enumerate(contexts_seen(grams, n[ids], doc, counts.ends)):
                    p = smoothed(p, grams[k], m, rest[k][_bucket(m)])
                size = np.asarray(row["n"], np.int64)
                at = np.cumsum(size) - size
                add = lambda x: np.add.reduceat(x, at) if len(at) else np.zeros(0)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(size), pa.array(add((n > 0)[ids].astype(np.int64))), pa.array(add(base[ids])), pa.array(add(np.log10(np.maximum(p, 1e-300))))], names=[k for k, _ in _fields(FINAL)])
            c.trim()

    return run


class Fitted:
    """What was learnt, and the table of blocks to score."""

    def __init__(self, docs: DataFrame):
        width = min(64, 20 + max(8, docs.count().bit_length()))  # so that n-grams collide as seldom at every size
        table, spark = blocks(docs), docs.sparkSession
        words, self.counts = count_words(table)
        sizes = table.agg(F.sum(F.expr("aggregate(n, 0L, (x, y) -> x + y)"))).first()[0] or 0
        bits = _bits(2 * sizes)
        c.released(spark)
        pieces = table.select("block", "held", "n", "ids", "keys").mapInArrow(_push_grams(width, bits), "slice int, block long, piece binary, c binary")
        grams = c.written(_reduced(pieces, bits + 1, _total_grams, ANSWERS), "grams")
        del pieces
        c.released(spark)
        own, answers = table.select("block", "doc_id", "held", "n", "ids", "keys"), words.where("kind = 0").unionByName(grams)
        ready = c.written(own.groupBy("block").cogroup(answers.select("block", "kind", "slice", "n", "class").groupBy("block")).applyInArrow(_ready(width, self.counts.ends), READY), "ready", ["kind"])
        for done in (table, words, grams):
            c.dropped(done)
        del own, answers
        c.released(spark)
        self.rest = trusted(ready)
        self.ready = ready.where("kind = 0").select("doc_id", "held", "n", "ids", "words", "classes", "buckets", "grams")
        self.weights, self.bias = train(self.ready, placed(self.counts))

    def scores(self) -> DataFrame:
        state = self.ready.sparkSession.sparkContext.broadcast((self.weights, self.bias))
        return self.ready.mapInArrow(_score(state, self.rest, self.counts), FINAL)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs(doc_id, text, lang)."""
    fitted = Fitted(docs)
    return fitted.scores().select("doc_id", "held_out", "n_tokens", "n_known", F.lit(fitted.counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(c.documents(spark, sf_dir))
