"""Each operator against brute force, on awkward documents and on an empty table."""

import base64
import collections
import hashlib
import math
import re
import tracemalloc
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from treelark.llm import bpe, common, exact, idcoder, maxent, mixing, near, pretokens, quality, recompress, repeats, secrets, suffixes, tokenfile
from treelark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def words(text, lower=False):
    return WORD.findall((text or "").translate(LOW) if lower else (text or ""))


def counted(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_quality(docs, rows, nothing):
    want = collections.Counter()
    for r in rows:
        w, text = words(r[1]), r[1] or ""
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        base = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want[(r[0], len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(hit), base)] += 1
    got = quality.quality_rules(docs)
    assert counted(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.where("base_failed AND kept").count() == 0
    kept = collections.Counter(r[0] for r in got.where("kept").collect())
    assert collections.Counter(r.doc_id for r in quality.accepted(docs).collect()) == kept and kept[5] == 1
    assert quality.quality_rules(nothing).count() == 0 and quality.accepted(nothing).count() == 0


def test_exact(docs, rows, nothing):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = collections.defaultdict(list)
    for r, x in zip(rows, norm):
        groups[x].append(r[0])
    want = collections.Counter()
    for r, x in zip(rows, norm):
        ids = [i for i in groups[x] if i is not None]
        keep = min(ids) if ids else None
        want[(r[0], keep, len(groups[x]), r[0] == keep, hashlib.sha256(x.encode()).hexdigest())] += 1
    assert counted(exact.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact.exact_dedup(nothing).count() == 0


def test_exact_against_a_given_history(spark, docs):
    d = hashlib.sha256(b"one").hexdigest()
    history = spark.createDataFrame([(d, -5, 4)], "digest string, keep long, n long")
    got = {r.doc_id: r for r in exact.exact_dedup(docs, history).collect()}
    assert (got[3].keep_id, got[3].group_size, got[3].kept) == (-5, 5, False) and got[4].kept


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 3000])
def test_perfect_hash(n):
    digests = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n + 50)), np.uint8).reshape(-1, 32)
    h = exact.PerfectHash.from_bytes(exact.PerfectHash.build(digests[:n], np.arange(n), np.arange(n) * 2).to_bytes())
    at = h.find(digests)
    assert (at[:n] >= 0).all() and len(set(at[:n].tolist())) == n and (at[n:] == -1).all()
    assert (h.locator[at[:n]] == np.arange(n)).all() and (h.count[at[:n]] == 2 * np.arange(n)).all()


def test_substring(docs, rows, nothing):
    first = {}
    for r in rows:
        w = words(r[1])
        if r[0] is not None:
            for i in range(len(w) - 49):
                k = tuple(w[i : i + 50])
                first[k] = min(first.get(k, r[0]), r[0])
    want = collections.Counter()
    for r in rows:
        w = words(r[1])
        gone = {j for i in range(len(w) - 49) if r[0] is not None and first[tuple(w[i : i + 50])] < r[0] for j in range(i, i + 50)}
        want[(r[0], len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())] += 1
    got = repeats.marked(docs, recompress.find_repeats(docs)).mapInArrow(recompress._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    assert counted(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want and sum(k[2] for k in want) > 100
    assert recompress.remove_repeats(nothing).count() == 0
    assert {r.text for r in recompress.remove_repeats(docs).where("doc_id = 3").collect()} == {"one"}


def _substring_want(rows):
    first = {}
    for i, text in rows:
        w = words(text)
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            first[k] = min(first.get(k, i), i)
    want = collections.Counter()
    for i, text in rows:
        w = words(text)
        gone = {x for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for x in range(j, j + 50)}
        want[(i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())] += 1
    return want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_substring_of_a_region_that_its_first_document_repeats(spark, seed):
    """X P Y, then Z P Z B Z P Z: also in two rows of one doc_id, and three times."""
    r = np.random.default_rng(seed)
    prose = lambda n: " ".join(f"w{x}" for x in r.integers(0, 10**6, n))
    x, y, z1, z2, a, b, e, p = (prose(60) for _ in range(8))
    rows = [(3, " ".join([x, p, y])), (5, " ".join([a, z1, p, z2, b, z1, p, z2, e])), (5, " ".join([e, z1, p, z2, a, z1, p, z2])), (6, " ".join([z1, p, z2])), (7, " ".join([b, p, b, p]))]
    got = repeats.marked(df := spark.createDataFrame(rows, "doc_id long, text string"), recompress.find_repeats(df)).mapInArrow(recompress._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    assert counted(got, "doc_id", "n_words", "n_removed", "kept_sha256") == _substring_want(rows)


def _suffix(docs):
    return repeats.marked(docs, suffixes.find_repeats(docs)).mapInArrow(suffixes._cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _suffix_want(rows):
    seen = collections.Counter()
    texts = [(r[1] or "").encode() for r in rows]
    for x in texts:
        seen.update(x[i : i + 400] for i in range(len(x) - 399))
    want = collections.Counter()
    for r, x in zip(rows, texts):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - 399):
            if seen[x[i : i + 400]] > 1:
                gone[i : i + 400] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(r[0], len(x), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    return want


@pytest.mark.parametrize("limit", [4096, 1])
def test_suffixes(docs, rows, nothing, limit, monkeypatch):
    """Also with keys sent to the distributed way."""
    monkeypatch.setattr(suffixes, "GROUP", limit)
    assert counted(_suffix(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == _suffix_want(rows)
    assert _suffix(nothing).count() == 0


def test_deep_shallow_sorts():
    r = np.random.default_rng(0)
    strings = r.integers(97, 99, (300, suffixes.WIDTH)).astype(np.uint8)
    strings[100:200, :150] = strings[0, :150]
    strings[150:160] = strings[120]
    group = np.sort(r.integers(0, 3, 300))
    order = suffixes.deep_shallow(group, strings)
    assert [(group[i], strings[i].tobytes()) for i in order] == sorted((group[i], strings[i].tobytes()) for i in range(300))


@pytest.mark.parametrize("k, num", [(3, 85), (5, 80)])
def test_near(docs, rows, nothing, k, num):
    def shingled(text):
        w = words(text, True)
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [shingled(r[1]) for r in rows]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and None not in (rows[i][0], rows[j][0]) and 100 * len(a & b) >= num * len(a | b):
                x, y = sorted((root(rows[i][0]), root(rows[j][0])))
                parent[y] = x
    want = collections.Counter((r[0], len(s), None if r[0] is None else root(r[0])) for r, s in zip(rows, sets))
    assert counted(near.near_duplicates(docs, k, num), "doc_id", "n_shingles", "component_id") == want
    assert near.near_duplicates(nothing).count() == 0


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = r.integers(0, 2**63, 3000).astype(np.uint64), r.integers(0, 2**63, 3000).astype(np.uint64)
    b[:2400] = a[:2400]
    x, y = near.sketch(a, np.array([0])), near.sketch(b, np.array([0]))
    assert (near.merge(x, y) == near.sketch(np.unique(np.concatenate([a, b])), np.array([0]))).all()
    j = near.estimate((x > y).sum(1), (x < y).sum(1), np.array([3000.0]), np.array([3000.0]))[0]
    assert abs(j - 2400 / 3600) < 0.12


def test_near_families_whose_smallest_member_is_no_hub(spark):
    """Members that only meet through another one than their bucket's smallest are still joined."""
    r = np.random.default_rng(3)
    hub = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(12):
        w = list(hub)
        for j in r.choice(400, 7, replace=False):
            w[j] = f"x{i}_{j}"
        texts.append(" ".join(w))
    rows = [(i, x) for i, x in enumerate(texts)] + [(99, " ".join(hub))]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    s = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (x.split() for _, x in rows)]
    linked = {i for i in range(12) if 100 * len(s[i] & s[12]) >= 85 * len(s[i] | s[12])}
    by = {r.doc_id: r.component_id for r in got.collect()}
    assert len(linked) >= 8 and len({by[i] for i in linked} | {by[99]}) == 1


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, rows, nothing, tiktoken_encoding):
    want = collections.Counter((r[0], tuple(tiktoken_encoding.encode_ordinary(r[1] or ""))) for r in rows)
    enc = bpe.encode(docs, bpe.rank_file())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in enc.collect()) == want
    assert counted(bpe.decode(enc, bpe.rank_file()), "doc_id", "text") == collections.Counter((r[0], r[1] or "") for r in rows)
    assert bpe.encode(nothing, bpe.rank_file()).count() == 0


def test_bitmap_queue():
    r = np.random.default_rng(0)
    q, s = bpe.BitmapQueue(50_000), set()
    for x in r.integers(0, 50_000, 4000).tolist():
        if x in s and x % 2:
            q.remove(x)
            s.discard(x)
        else:
            q.add(x)
            s.add(x)
        assert q.first() == min(s, default=-1)


def test_long_pretokens_and_plain_encoding(tiktoken_encoding):
    v = bpe.ranks(bpe.rank_file())
    for text in ("a" * 5000, "ab" * 2000 + "ba" * 999, "zq" * 300 + "é" * 700, "='" * 500):
        assert bpe.encode_plain(text.encode(), v).tolist() == tiktoken_encoding.encode_ordinary(text)


def test_new_pieces_take_little_memory(tiktoken_encoding):
    """A cold worker of the pipeline met so many new pieces at once that its executor passed its limit."""
    r = np.random.default_rng(0)
    letters = r.integers(97, 123, (250_000, 8), np.uint8)
    letters[:, 0] = 32
    data, offsets = letters.reshape(-1), np.array([0, 80, 80, 1_000_000, 2_000_000])
    path = bpe.rank_file()
    table = bpe.PieceTable(bpe.ranks(path).encode, bpe.ranks(path))
    pretokens.pieces(data[:80], offsets[:2])  # makes its table, which is no part of this
    tracemalloc.start()
    try:
        got = [ids[x:y].tolist() for _, _, _, _, ids, rows in bpe.groups(data, offsets, table) for x, y in zip(rows, rows[1:])]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == [tiktoken_encoding.encode_ordinary(data[x:y].tobytes().decode()) for x, y in zip(offsets, offsets[1:])]
    assert peak < 60 * len(data), peak


def test_pieces_follow_the_pattern():
    import public_tokenizers as p

    pattern, r = regex.compile(p.PATTERN), np.random.default_rng(0)
    letters = list("ab 's't're've'm'll'd'L  \n\t\r é日1٣²!?#.")
    texts = ["".join(r.choice(letters, r.integers(0, 30))) for _ in range(1500)]
    raw = [x.encode() for x in texts]
    offsets = np.append(0, np.cumsum([len(x) for x in raw]))
    want = {int(o) + len(x[: m.start()].encode()) for x, o in zip(texts, offsets) for m in pattern.finditer(x)}
    assert set(pretokens.pieces(np.frombuffer(b"".join(raw), np.uint8), offsets).tolist()) == want


def test_language_model(docs, rows, nothing):
    toks = [words(r[1], True) + [None] for r in rows]
    held = [maxent.held_out(r[0]) for r in rows]
    assert any(held)
    c = collections.Counter(w for h, t in zip(held, toks) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((r[0], h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 5)) for r, h, t in zip(rows, held, toks))
    got = maxent.score(docs)
    assert counted(got.withColumn("b", F.round("base_score", 5)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "b") == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.collect())
    assert maxent.score(nothing).count() == 0


def test_language_model_learns_contexts(spark):
    r = np.random.default_rng(0)
    text = lambda lang: " ".join(f"{lang}{int(x)}" for x in r.zipf(1.5, 80) % 50)
    df = spark.createDataFrame([(i, text("ab"[i % 2]), "ab"[i % 2]) for i in range(300)], "doc_id long, text string, lang string")
    held = maxent.score(df).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] * 0.95


def test_language_model_knows_each_word_by_the_word_before(spark):
    """More words than the class model can tell apart, each with one follower."""
    r = np.random.default_rng(0)
    text = lambda: " ".join(f"a{int(x)} b{int(x)}" for x in r.integers(0, 5000, 100))
    df = spark.createDataFrame([(i, text(), "en") for i in range(1000)], "doc_id long, text string, lang string")
    held = maxent.score(df).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1] * 0.75


def test_counts_are_a_distribution():
    p, n = np.array([0.5, 0.3, 0.2]), np.array([7, 0, 1])
    assert maxent.smoothed(p, n, n.sum(), 0.3).sum() == pytest.approx(1) and (maxent.smoothed(p, 0 * n, 0, 0.3) == p).all()


def test_class_model_is_a_distribution():
    r = np.random.default_rng(0)
    w, b = r.normal(size=(5, maxent.FEATURES)).astype(np.float32), r.normal(size=5).astype(np.float32)
    assert np.allclose(maxent.probabilities(w, b, r.integers(0, 1 << 34, 50).astype(np.uint64)).sum(0), 1, atol=1e-5)


def test_packing():
    r = np.random.default_rng(0)
    for x in (np.zeros(0, np.int64), r.integers(0, 1 << 40, 1000), r.integers(0, 5, 7)):
        assert (maxent.unpack(maxent.pack(x), np.int64) == x).all()
        y = np.sort(x).astype(np.uint64)
        assert (maxent.unpack_sorted(maxent.pack_sorted(y)) == y).all()


@pytest.mark.parametrize("slice_", [1 << 22, 50])
def test_language_model_scores_by_brute_force(spark, docs, rows, slice_, monkeypatch):
    """The whole score again by dictionaries, but for the class model's trained weights; with one slice and with many."""
    monkeypatch.setattr(maxent, "SLICE", slice_)
    fitted = maxent.Fitted(docs)
    toks = [words(r[1], True) + [None] for r in rows]
    train = [t for r, t in zip(rows, toks) if not maxent.held_out(r[0])]
    count = collections.Counter(w for t in train for w in t)
    pad = lambda t: ["", ""] + t
    grams = [collections.Counter(tuple(pad(t)[i - k : i + 1]) for t in train for i in range(2, len(t) + 2)) for k in (1, 2)]
    seen = [collections.Counter(tuple(pad(t)[i - k : i]) for t in train for i in range(2, len(t) + 2)) for k in (1, 2)]
    power = lambda m: m.bit_length()
    novel, total = collections.Counter(), collections.Counter()
    for k in (0, 1):
        for g, n in grams[k].items():
            at = (k, power(seen[k][g[:-1]]))
            novel[at] += n == 1
            total[at] += n
    rest = lambda k, m: min(max((novel[k, power(m)] + 0.5) / (total[k, power(m)] + 1), 1e-3), 1 - 1e-3)
    size = sum(count.values())
    key = lambda w: int(common.span_hash(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])
    bucket = lambda w: 0 if w == "" else 0x10000 if w is None else (key(w) >> 48) + 1
    # languages that tie for a word's class are settled by block, so classes are taken from the model's own table
    places = maxent.placed(fitted.counts)
    kinds = {}
    for b in fitted.ready.collect():
        ids, kind = maxent.unpack(b.ids, np.int32), maxent.unpack(b.classes, np.uint8)
        at = 0
        for d, n in zip(b.doc_id, b.n):
            mine = [t for r, t in zip(rows, toks) if r[0] == d and len(t) == n]
            for t in mine[:1] if len({tuple(x) for x in mine}) == 1 else []:
                kinds |= {w: int(kind[i - 1]) for w, i in zip(t[:-1], ids[at : at + n - 1])}
            at += n
    mass = collections.Counter()
    for w, n in count.items():
        if w is not None and w in kinds:
            assert (n < 2) == (kinds[w] == maxent.RARE)
            mass[kinds[w]] += n
    once = sum(n == 1 for w, n in count.items() if w is not None)
    want = []
    for r, t in zip(rows, toks):
        s = 0.0
        for i, w in enumerate(t, 2):
            two, one = pad(t)[i - 2 : i]
            kind = maxent.END if w is None else kinds[w]
            inner = 1.0 if w is None else (0.5 / max(once, 1) if count[w] else 0.5) if kind == maxent.RARE else count[w] / mass[kind]
            context = np.array([bucket(one) << 17 | bucket(two)], np.uint64)
            p = maxent.probabilities(fitted.weights, fitted.bias, context)[places[kind], 0] * inner
            for k, g in ((0, (one, w)), (1, (two, one, w))):
                m = seen[k][g[:-1]]
                p = (1 - rest(k, m)) * grams[k][g] / m + rest(k, m) * p if m else p
            s += math.log10(p)
        want.append((r[0], len(t), s))
    got = sorted(((r.doc_id, r.n_tokens, r.score) for r in fitted.scores().collect()), key=str)
    want = sorted(want, key=str)
    assert size == fitted.counts.tokens and len(got) == len(want)
    for x, y in zip(sorted(got, key=lambda r: (str(r[0]), r[1])), sorted(want, key=lambda r: (str(r[0]), r[1]))):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-4)


def test_token_files(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfile.tokenizer_file())
    m = tokenfile.write_ids(docs, common.scratch(spark, "ids"), tokenfile.tokenizer_file())
    got = tokenfile.read_ids(m).collect()
    want = collections.Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in rows)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    sums = {(r.doc_id, r.start): r.ids_crc32 for r in tokenfile.read_ids(m, with_ids=False).collect()}
    assert all(sums[(r.doc_id, r.start)] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert tokenfile.read_ids(tokenfile.write_ids(nothing, common.scratch(spark, "ids"), tokenfile.tokenizer_file())).count() == 0


def test_token_files_are_read_by_few_tasks_in_order(spark, docs):
    folder = common.scratch(spark, "ids")
    m = tokenfile.write_ids(docs, folder, tokenfile.tokenizer_file())
    assert len(m.inputFiles()) == 1  # however many tasks wrote ids
    many = spark.createDataFrame([(f, f"{folder}/{f}", k, 0, 1, 1, 10) for f in range(5) for k in range(8)], tokenfile.MANIFEST)
    assert tokenfile.read_ids(many).rdd.getNumPartitions() == 4  # spark.sql.shuffle.partitions, not one each
    got = [r.start for r in tokenfile.read_ids(m).collect()]
    assert got == sorted(got)


def test_token_file_of_texts_with_added_tokens(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfile.tokenizer_file())
    texts = ["one two", "a <|endoftext|> b", "<|endoftext|>", "ends in <|endof", "text|> begins", "x<|endoftext|><|endoftext|>é", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = tokenfile.read_ids(tokenfile.write_ids(df, common.scratch(spark, "ids"), tokenfile.tokenizer_file())).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: t.encode(x, add_special_tokens=False).ids + [0] for i, x in enumerate(texts)}


@pytest.mark.parametrize("n", [0, 1, 95, 96, 193, 4096 * 96 - 1, 450_001])
def test_range_coder_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 50_257, n), np.zeros(n, int), r.zipf(1.4, n) % 50_257, np.full(n, 65_535), np.full(n, 65_536), r.integers(0, 1 << 31, n), r.integers(0, 1 << 18, n)):
        assert (idcoder.decode(idcoder.encode(ids)) == ids).all()


def test_range_coder_learns():
    r = np.random.default_rng(3)
    follow = r.integers(0, 50_000, 2000)
    ids = np.empty(200_000, np.int64)
    ids[::2] = r.integers(0, 2000, 100_000)
    ids[1::2] = follow[ids[::2]]
    assert len(idcoder.encode(ids)) < 2 / 3 * 200_000 * math.log2(4000) / 8  # order 0 alone needs log2(4000) bits an id


def test_segments_of_several_blocks(monkeypatch):
    monkeypatch.setattr(idcoder, "BLOCK", 1000)
    ids = np.random.default_rng(1).zipf(1.3, 3700) % 70_000
    doc_id, null, back, count = tokenfile.unpack(tokenfile.pack(np.array([4, 9]), np.array([False, True]), ids, np.array([3000, 700])))
    assert (back == ids).all() and count.tolist() == [3000, 700] and null.tolist() == [False, True]


def test_damaged_blocks_are_noticed():
    raw = bytearray(tokenfile.pack(np.array([1]), np.array([False]), np.arange(500, dtype=np.int32), np.array([500])))
    raw[-40] ^= 1
    with pytest.raises(ValueError):
        tokenfile.unpack(bytes(raw))


def test_mixing(spark, docs, rows, nothing):
    got = mixing.mix(docs, topics=F.lit("t")).collect()
    assert len(got) == len(rows) and sum(r.n_tokens for r in got) == sum(len(words(r[1])) for r in rows)
    assert all(0 <= r.p <= 1 for r in got) and mixing.mix(nothing).count() == 0
    expected, total = sum(r.n_tokens * r.p for r in got), sum(r.n_tokens for r in got)
    assert expected == pytest.approx(0.8 * total, rel=1e-6)
    far = {r.source_c + r.lang_c + r.topic_c: r.p for r in mixing.mix(docs, topics=F.lit("t"), cells_limit=0).where("n_tokens > 0").collect()} if len(rows) < 20 else {}
    near_ = {r.source_c + r.lang_c + r.topic_c: r.p for r in got}
    assert all(far[k] == pytest.approx(near_[k], abs=1e-4) for k in far)
    assert collections.Counter(r.doc_id for r in mixing.sampled(docs).collect()) == collections.Counter(r.doc_id for r in mixing.mix(docs).where("kept").collect())


def test_raking_meets_the_marginals():
    r = np.random.default_rng(0)
    tokens = r.integers(1, 100, 24).astype(float)
    codes = [np.arange(24) % 4, np.arange(24) // 4 % 3, np.arange(24) // 12]
    goals = [np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.5, 0.3, 0.2]), np.array([0.25, 0.75])]
    share = mixing.rake(tokens, codes, goals)
    assert all(np.allclose(np.bincount(c, share), g, atol=1e-6) for c, g in zip(codes, goals))
    p = mixing.scale(tokens, share, 0.5)
    assert p.max() <= 1 and (tokens * p).sum() == pytest.approx(0.5 * tokens.sum())


def test_secrets(spark, nothing):
    found = secrets.labelled(1200, seed=99)
    forest = secrets.train(spark, secrets.labelled())
    docs = spark.createDataFrame([(i, b + v + a) for i, (b, v, a, _) in enumerate(found)] + [(-1, None), (-2, "")], "doc_id long, text string")
    got = secrets.scan(docs, forest).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    right = [any(r.kept for r in by[i]) == bool(y) for i, (*_, y) in enumerate(found)]
    assert sum(right) / len(right) > 0.95 and -1 not in by and -2 not in by
    assert secrets.scan(nothing, forest).count() == 0


def test_candidates_are_all_found_where_they_stand(spark):
    r = np.random.default_rng(4)
    texts = ["".join(r.choice(list("ab1_=/ .\né"), 400, p=[0.2, 0.2, 0.2, 0.1, 0.05, 0.05, 0.1, 0.03, 0.03, 0.04])) for _ in range(40)]
    texts.append("token=abcdefgh12345678 abcdefgh12345678 token=abcdefgh12345678")
    got = counted(secrets.candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "start", "value", "before", "after")
    want = collections.Counter()
    for i, x in enumerate(texts):
        for m in re.finditer(secrets.RUN, x):
            v = m.group()
            if re.search("[A-Za-z]", v) and re.search("[0-9]", v):
                want[(i, m.start() + 1, v, x[max(0, m.start() - 48) : m.start()], x[m.end() : m.end() + 24])] += 1
    assert got == want


def test_compiled_forest_equals_its_trees(spark):
    r = np.random.default_rng(0)
    x = r.random((200, 4))
    forest = secrets.fit(x, (x[:, 0] + x[:, 2] > 1).astype(float), trees=5, depth=4)

    def value(node, row):
        return node if isinstance(node, float) else value(node[2] if row[node[0]] <= node[1] else node[3], row)

    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double, d double")
    got = [v[0] for v in df.select(secrets.compiled(forest, {k: F.col(k) for k in "abcd"})).collect()]
    assert np.allclose(got, [np.mean([value(t, v) for t in forest]) for v in x])
