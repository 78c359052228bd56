"""Operator 1, quality rules: repetition coverage by rolling hashes of several n-gram lengths.

``repetition`` measures, per document, how many word characters lie in n-grams that occur twice or more in the same
document, and how many lines repeat. All of a document is looked at. One pass in numpy over runs of documents, no shuffle:
a run's memory follows RUN_BYTES, or its one longer document.

Nulls and empty texts: no words, all counts 0, rejected by the base rule. Repeated rows are measured each on its own. An
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: n-gram length in words -> largest share in per cent of word characters in repeated n-grams.
LIMITS = {5: 50, 6: 48, 10: 40}
#: Largest shares in per cent: of lines that repeat an earlier one, and of characters in them.
LINES, LINE_CHARS = 40, 40
WINDOW = 8
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, line_chars long, dup_line_chars long, n_repeat_words long, " + ", ".join(f"dup_chars_{n} long" for n in LIMITS)


def _measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    rows = len(offsets) - 1
    starts, ends, at = c.words(data, offsets)
    chars = c.prefix((data & 0xC0) != 0x80)
    word_chars = c.prefix(chars[ends] - chars[starts])
    n_words = np.diff(at)
    salt = c.mix(np.arange(1, rows + 1, dtype=np.uint64))

    breaks = np.flatnonzero(data == 10)
    per = np.diff(np.searchsorted(breaks, offsets)) + 1
    line_row = np.repeat(np.arange(rows), per)
    first, last = np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([offsets[1:], breaks]))
    has = np.searchsorted(starts, last) > np.searchsorted(starts, first)
    line_row, first, last = line_row[has], first[has], last[has]
    order, same, _ = c.twins(c.span_hash(data, first, last) ^ salt[line_row])
    again = order[1:][same]
    size = chars[last] - chars[first]

    items = c.span_hash(data, starts, ends)
    row_of = np.repeat(np.arange(rows), n_words)
    out, windows = [], c.Windows(items)
    for n in lengths:
        keys = windows.every(n)
        if not len(keys):
            out.append((np.zeros(rows, np.int64), np.zeros(rows, np.int64)))
            continue
        ok = np.flatnonzero(row_of[: len(keys)] == row_of[n - 1 :])
        _, _, twice = c.twins(keys[ok] ^ salt[row_of[ok]])
        hit = c.covered(ok[twice], n, len(items))
        out.append((c.per_row(c.prefix(hit), at), c.per_row(c.prefix(hit * np.diff(word_chars)), at)))
    grams = dict(zip(lengths, out))
    count = lambda w=None: np.bincount(line_row[again], w, rows).astype(np.int64)
    return [
        n_words, c.per_row(word_chars, at), c.per_row(c.prefix(_SYMBOLS[data]), offsets), np.bincount(line_row, minlength=rows).astype(np.int64), count(),
        np.bincount(line_row, size, rows).astype(np.int64), count(size[again]), grams[WINDOW][0], *(grams[n][1] for n in LIMITS),
    ]


def rejected(of):
    """(by the base rule, by the method's limits), of columns or of arrays: of(name) gives either. Shares are compared as
    whole numbers, so no rounding takes part."""
    base = (of("n_words") < 20) | (100 * of("n_repeat_words") > 30 * of("n_words"))
    bad = (100 * of("n_dup_lines") > LINES * of("n_lines")) | (100 * of("dup_line_chars") > LINE_CHARS * of("line_chars"))
    for n, limit in LIMITS.items():
        bad |= 100 * of(f"dup_chars_{n}") > limit * of("word_chars")
    return base, bad


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_LENGTHS = (WINDOW, *(n for n in LIMITS if n != WINDOW))


def _batches(it):
    for batch in it:
        data, offsets = c.text_buffer(batch.column(1))
        for i, j in c.runs(offsets):
            columns = _measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _LENGTHS)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].cast(pa.int64()), *map(pa.array, columns)], names=_NAMES)


def repetition(docs: DataFrame) -> DataFrame:
    """The measures of each row of docs(doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_batches, SCHEMA)


def verdicts(measures: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    base, bad = rejected(F.col)
    return measures.withColumn("base_failed", base).withColumn("kept", ~(base | bad))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; no shuffle."""
    at = docs.columns.index("text")

    def run(it):
        for batch in it:
            data, offsets = c.text_buffer(batch.column(at))
            keep = []
            for i, j in c.runs(offsets):
                found = dict(zip(_NAMES[1:], _measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _LENGTHS)))
                base, bad = rejected(found.__getitem__)
                keep.append(~(base | bad))
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame) -> DataFrame:
    return verdicts(repetition(docs))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(c.documents(spark, sf_dir))


def _gram_sql(n: int) -> str:
    places = f"range(1, len(w) - {n - 2})"
    return f"""g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) > 1 AS twice FROM (SELECT doc_id, unnest({places}) AS i, unnest(list_transform({places}, lambda i: md5(array_to_string(list_slice(w, i, i + {n - 1}), ' ')))) AS h FROM w)),
h{n} AS (SELECT doc_id, i + k AS i FROM g{n}, range({n}) t(k) WHERE twice GROUP BY ALL),
d{n} AS (SELECT doc_id, count(*) AS n, sum(n) AS chars FROM h{n} JOIN wl USING (doc_id, i) GROUP BY doc_id)"""


OP1_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{c.WORD}') AS w, coalesce(text, '') AS text FROM documents),
wl AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(list_transform(w, lambda x: length(x))) AS n FROM w),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{c.WORD}') GROUP BY ALL),
ll AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup_lines, sum(n * length(line)) AS line_chars, sum((n - 1) * length(line)) AS dup_line_chars FROM l GROUP BY doc_id),
{", ".join(_gram_sql(n) for n in (WINDOW, *LIMITS))},
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  {", ".join(f"CAST(coalesce({x}, 0) AS BIGINT) AS {x}" for x in ("n_lines", "n_dup_lines", "line_chars", "dup_line_chars"))},
  CAST(coalesce(d{WINDOW}.n, 0) AS BIGINT) AS n_repeat_words, {", ".join(f"CAST(coalesce(d{n}.chars, 0) AS BIGINT) AS dup_chars_{n}" for n in LIMITS)}
  FROM w LEFT JOIN ll USING (doc_id) {" ".join(f"LEFT JOIN d{n} USING (doc_id)" for n in (WINDOW, *LIMITS))})
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * n_dup_lines > {LINES} * n_lines OR 100 * dup_line_chars > {LINE_CHARS} * line_chars
  OR {" OR ".join(f"100 * dup_chars_{n} > {limit} * word_chars" for n, limit in LIMITS.items())}) AS kept
FROM m"""
