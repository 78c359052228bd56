"""Strings that collide under every polynomial hash modulo 2**64 must not collide here."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from treelark.llm import common, maxent, near, quality, recompress, suffixes, tokenfile


def thue_morse(n, swap=False):
    return "".join("ab"[bin(i).count("1") % 2 ^ swap] for i in range(n))


def spans(texts):
    raw = [x.encode() for x in texts]
    cut = common.prefix(np.array([len(x) for x in raw], np.int64))
    return np.frombuffer(b"".join(raw), np.uint8), cut


@pytest.mark.parametrize("n", [16, 64, 255, 256, 257, 1024, 4096])
@pytest.mark.parametrize("table", [0, 1])
def test_span_hash(n, table):
    texts = [thue_morse(n), thue_morse(n, True), thue_morse(n)]
    data, cut = spans(texts)
    h = common.span_hash(data, cut[:-1], cut[1:], table)
    assert h[0] == h[2] != h[1]


def test_lengths_and_places():
    r = np.random.default_rng(2)
    texts = ["".join(map(chr, r.integers(97, 99, r.integers(0, 40)))) for _ in range(20_000)] + ["a" * k for k in range(600)]
    data, cut = spans(texts)
    for t in (0, 1):
        h = common.span_hash(data, cut[:-1], cut[1:], t)
        assert len(set(h.tolist())) == len(set(texts)) and len(set(zip(h.tolist(), texts))) == len(set(texts))


def test_windows():
    r = np.random.default_rng(3)
    items = common.mix(r.integers(0, 3, 400).astype(np.uint64) + np.uint64(1))
    for t in (0, 1):
        lo = r.integers(0, 300, 3000)
        hi = lo + r.integers(1, 100, 3000)
        h = common.Windows(items, t).at(lo, hi).tolist()
        real = [items[a:b].tobytes() for a, b in zip(lo, hi)]
        assert len(set(h)) == len(set(real)) == len(set(zip(h, real)))
    data = r.integers(0, 2, 3000).astype(np.uint8)
    for t in (0, 1):
        lo = r.integers(0, 2000, 500)
        hi = lo + r.integers(400, 701, 500)
        few, all_ = common.byte_windows(data, t).at(lo, hi), common.byte_windows(data, t)
        all_.level(9)
        assert (few == all_.at(lo, hi)).all()
        assert len(set(common.byte_windows(data, t).every(100).tolist())) == len({data[i : i + 100].tobytes() for i in range(2901)})


@pytest.mark.parametrize("n", [1024, 4096])
def test_operators(spark, n):
    a, b = thue_morse(n), thue_morse(n, True)
    head = " ".join(f"w{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{head} {a}", "en"), (2, f"{head} {b}", "en"), (3, f"{a}\n{b}", "en"), (5, f"{a} {a} {b}", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.n_dup_lines for r in quality.quality_rules(docs).collect()} == {1: 0, 2: 0, 3: 0, 5: 0}
    assert {r.doc_id: r.n_removed for r in recompress.op3_digests(docs).collect()} == {1: 0, 2: 0, 3: 0, 5: 0}
    assert {r.doc_id for r in near.near_duplicates(docs.where("doc_id < 3"), k=60, num=99, den=100).collect() if r.component_id != r.doc_id} == set()
    t = Tokenizer.from_file(tokenfile.tokenizer_file())
    got = tokenfile.read_ids(tokenfile.write_ids(docs, common.scratch(spark, "ids"), tokenfile.tokenizer_file())).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [0] for r in docs.collect()}
    train = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    tokens = [w for r in train for w in r.text.split()] + ["\0end"] * len(train)
    size, v = len(tokens), len(set(tokens))
    score = lambda ws: sum(np.log10((tokens.count(w) + 0.5) / (size + 0.5 * (v + 1))) for w in ws)
    base = {r.doc_id: r.base_score for r in maxent.score(docs).collect()}
    assert base == pytest.approx({r.doc_id: score([*r.text.split(), "\0end"]) for r in docs.collect()})
    x, y = thue_morse(n) + thue_morse(n, True), thue_morse(n, True) + thue_morse(n)
    texts = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    windows = [{s[i : i + 400] for i in range(len(s) - 399)} for s in (x, y)]
    starts = [[s[i : i + 400] for i in range(len(s) - 399)] for s in (x, y)]
    every = starts[0] + starts[1]
    gone = []
    for s, own in zip((x, y), starts):
        hit = np.zeros(len(s), bool)
        for i, w in enumerate(own):
            if every.count(w) > 1:
                hit[i : i + 400] = True
        gone.append(int(hit.sum()))
    assert [r.n_removed for r in sorted(suffixes.op10_digests(texts).collect())] == gone and windows
