"""Operator 9, token-ID output: files of range-coded blocks, written in doc_id order and read back.

Documents are range-partitioned and sorted by doc_id (nulls first, then by text, so that a rerun task writes the same
bytes); each task writes one file of segments. A segment holds whole documents of about BLOCK ids:

    magic 'TLK2', int64: documents, ids, blocks
    doc_id int64 and null flag uint8 per document, ids per document int64
    bytes per block int64, CRC-32 of the block's ids (little-endian uint32) per block
    the blocks (see idcoder), of equally many ids, about BLOCK; each is decoded by itself

A file gets its name by renaming when it is complete, so a lost executor leaves no half file behind. The manifest (file,
segment, place, documents, ids) is a written table; ids before a segment are running sums over it, by file and then
within the file. Distinct pieces of text are encoded once by the tokenizers library, then put together by arrays; a text
that holds an added token of the tokenizer file is encoded by the library as a whole.

Nulls and empty texts hold the end id alone. Repeated rows are documents of their own. Other columns are ignored. Empty
tables write empty files and give an empty table.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, idcoder
from . import common as c

MAGIC = b"TLK2"
MANIFEST = "file int, path string, segment int, place long, size long, docs long, ids long"


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(1)
def _alphabet() -> np.ndarray:
    """The characters that byte-level vocabularies write bytes with, by byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letters = np.arange(256, dtype="<u4")
    letters[hidden] = 256 + np.arange(len(hidden))
    return letters


def library_ids(parts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces, one after the other, and the count of each, by the library.

    A byte-level tokenizer without a normalizer does nothing to a piece but to write its bytes in its alphabet and give it
    to the model; so do we, which saves splitting it again. Others encode each piece as a text.
    """
    tokenizer = _tokenizer(path)
    before = tokenizer.pre_tokenizer
    if type(before).__name__ == "ByteLevel" and not before.add_prefix_space and tokenizer.normalizer is None:
        of, at = tokenizer.model.tokenize, c.prefix(np.fromiter(map(len, parts), np.int64, len(parts))).tolist()
        text = _alphabet()[np.frombuffer(b"".join(parts), np.uint8)].tobytes().decode("utf-32-le")
        found = [[t.id for t in of(text[x:y])] for x, y in zip(at, at[1:])]
    else:
        found = [e.ids for e in tokenizer.encode_batch_fast([p.decode("utf-8") for p in parts], add_special_tokens=False)]
    count = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((i for x in found for i in x), np.int64, int(count.sum())), count


@lru_cache(2)
def _table(path: str) -> bpe.PieceTable:
    def encode(flat: np.ndarray, offsets: np.ndarray):
        text, at = flat.tobytes(), offsets.tolist()
        return library_ids([text[x:y] for x, y in zip(at, at[1:])], path)

    return bpe.PieceTable(encode)


@lru_cache(2)
def _added(path: str) -> list[bytes]:
    return [t.content.encode() for t in _tokenizer(path).get_added_tokens_decoder().values() if t.content]


def whole_texts(raw: np.ndarray, at: np.ndarray, ids: np.ndarray, cut: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """ids and cut, with those texts raw[at[i]:at[i + 1]] that hold an added token encoded by the library as they are."""
    body, hit = raw.tobytes(), set()
    for token in _added(path):
        k = body.find(token)
        while k >= 0:
            i = int(np.searchsorted(at, k, "right")) - 1
            if k + len(token) <= at[i + 1]:
                hit.add(i)
            k = body.find(token, k + 1)
    if not hit:
        return ids, cut
    parts = [np.array(_tokenizer(path).encode(body[at[i] : at[i + 1]].decode("utf-8"), add_special_tokens=False).ids, np.int64) if i in hit else ids[cut[i] : cut[i + 1]] for i in range(len(at) - 1)]
    return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


def checksums(ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    at = (4 * cut).tolist()
    return np.array([zlib.crc32(raw[x:y]) for x, y in zip(at, at[1:])], np.int64)


def pack(doc_id: np.ndarray, null: np.ndarray, ids: np.ndarray, count: np.ndarray) -> bytes:
    """One segment."""
    cut = np.linspace(0, len(ids), max(1, round(len(ids) / idcoder.BLOCK)) + 1).astype(np.int64) if len(ids) else np.zeros(1, np.int64)
    blocks = [idcoder.encode(ids[x:y]) for x, y in zip(cut, cut[1:])]
    head = np.array([len(doc_id), len(ids), len(blocks)], "<i8")
    return b"".join([MAGIC, head.tobytes(), doc_id.astype("<i8").tobytes(), null.astype(np.uint8).tobytes(), count.astype("<i8").tobytes(), np.array([len(x) for x in blocks], "<i8").tobytes(), checksums(ids, cut).astype("<u4").tobytes(), *blocks])


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, null flags, ids and ids per document; raises where a block's checksum fails."""
    if raw[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    docs, n, blocks = np.frombuffer(raw, "<i8", 3, 4).tolist()
    at = 28
    out = []
    for kind, size in (("<i8", docs), ("u1", docs), ("<i8", docs), ("<i8", blocks), ("<u4", blocks)):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    doc_id, null, count, per_block, sums = out
    ends = at + np.cumsum(per_block)
    parts = [idcoder.decode(raw[y - x : y]) for x, y in zip(per_block.tolist(), ends.tolist())]
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    if len(ids) != n or not np.array_equal(checksums(ids, c.prefix(np.array([len(x) for x in parts], np.int64))), sums):
        raise ValueError("a block of token ids is damaged")
    return doc_id, null.astype(bool), ids, count


def _writer(folder: str, path: str, end: int):
    def run(it):
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/ids-{task.partitionId():06d}"
        draft = f"{name}.{task.taskAttemptId()}.tmp"
        rows = []
        with store.open_output_stream(draft) as out:
            for batch in it:
                column = batch.column(0)
                data, offsets = c.text_buffer(batch.column(1))
                held: list = []

                def flush():
                    if held:
                        doc = column.slice(held[0][0], held[-1][1] - held[0][0])
                        ids, count = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
                        raw = pack(np.asarray(doc.fill_null(0), np.int64), np.asarray(doc.is_null()), ids, count)
                        rows.append((len(rows), out.tell(), len(raw), len(doc), len(ids)))
                        out.write(raw)
                        held.clear()

                for a, b, raw, at, ids, cut in bpe.groups(data, offsets, _table(path)):
                    ids, cut = whole_texts(raw, at, ids, cut, path)
                    full = np.full(len(ids) + b - a, end, np.int32)
                    full[np.arange(len(ids)) + np.repeat(np.arange(b - a), np.diff(cut))] = ids
                    held.append((a, b, full, np.diff(cut) + 1))
                    if sum(len(x[2]) for x in held) >= idcoder.BLOCK:
                        flush()
                flush()
        if rows:
            store.move(draft, name)
        else:
            store.delete_file(draft)
        where = folder.rstrip("/") + "/" + name.rsplit("/", 1)[1]
        cols = list(zip(*rows)) or [()] * 5
        ints = [pa.array(np.array(x, np.int64)) for x in cols]
        k = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()] * k, pa.int32()), pa.array([where] * k, pa.string()), ints[0].cast(pa.int32()), *ints[1:]], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return run


def write_ids(docs: DataFrame, folder: str, path: str, end: int = 0) -> DataFrame:
    """Writes the ids of docs(doc_id, text) by the tokenizer file path, each with the end id, in doc_id order to folder.
    Returns the manifest, whose few rows are gathered before they are written: for each small file that a task writes without
    Hadoop's native library, the JVM starts processes, which count with its whole memory until they run a program."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return c.written(rows.mapInArrow(_writer(folder, path, end), MANIFEST).repartition("file"), "manifest")


def _reader(with_ids: bool):
    def run(it):
        for batch in it:
            for row in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(name) as f:
                    doc_id, null, ids, count = unpack(f.read_at(row["size"], row["place"]))
                cut = c.prefix(count)
                last = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)) if with_ids else pa.array(checksums(ids, cut))
                yield pa.RecordBatch.from_arrays([pa.array(doc_id.astype(np.int64), mask=null), pa.array(cut[:-1] + row["before"]), pa.array(count.astype(np.int64)), last], names=["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])

    return run


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and ids (or ids_crc32) of each document, from the files; a task reads neighbouring segments, one
    at a time."""
    files = manifest.groupBy("file").agg(F.sum("ids").alias("n"))
    files = files.withColumn("base", F.sum("n").over(Window.orderBy("file")) - F.col("n")).select("file", "base")
    before = F.sum("ids").over(Window.partitionBy("file").orderBy("segment")) - F.col("ids")
    placed = manifest.join(files, "file").select("path", "place", "size", (F.col("base") + before).alias("before"))
    spread = max(1, min(manifest.count(), int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return placed.repartitionByRange(spread, "before").mapInArrow(_reader(with_ids), "doc_id long, start long, n_tokens long, " + ("ids array<int>" if with_ids else "ids_crc32 long"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_file(spark, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(c.documents(spark, sf_dir), c.scratch(spark, "ids"), tokenizer_file()), with_ids=False)
