"""Quality rules by repetition coverage.

For every document the operator measures how many characters lie inside n-grams (of several
lengths, in words, and one in marks) that the same document holds more than once, and inside lines
that repeat an earlier line. n-grams are found with rolling hashes over all words of an Arrow block at once; a row's
number is mixed into each hash, so that one sort finds the repeats of thousands of documents.
The plan is a narrow map: no shuffle, no state across rows.

Defined results: a null or empty text has no words, all counts 0, and fails the base rule;
repeated rows give repeated results; extra columns pass through only if asked for (`keep`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from recollect.llm.common import SMALL_BYTES, blocks, unclashed, utf8
from recollect.llm.words import SEPARATOR, Words, mixed, per_row, windows, words_of

#: Characters counted as symbols (fixed value).
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

#: n-gram length -> the largest share of word characters inside repeated n-grams of that length.
NGRAM_LIMITS = {3: 0.50, 5: 0.25, 8: 0.22, 10: 0.20}
#: Characters of the n-grams of marks (ASCII punctuation), and the largest share of word characters inside
#: repeated ones: a string of marks glued to every word is a repeat that no n-gram of whole words shows.
MARK_NGRAM, MARK_LIMIT = 3, 0.10
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Largest share of word characters inside lines equal to an earlier line, and of such lines.
LINE_CHAR_LIMIT, LINE_LIMIT = 0.30, 0.30
MIN_WORDS = 10


def covered_words(w: Words, n: int) -> np.ndarray:
    """True for each word inside an n-word window that its row holds twice or more."""
    at, h = windows(w, n)
    cover = np.zeros(len(w.start) + 1, np.int32)
    if len(at):
        h ^= mixed(w.row[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(h)
        same = h[order[1:]] == h[order[:-1]]
        again = np.zeros(len(h), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        at = at[again]
        cover[at] += 1
        cover[at + n] -= 1
    return np.cumsum(cover[:-1]) > 0


def covered_marks(data: np.ndarray, offsets: np.ndarray, n: int = MARK_NGRAM) -> np.ndarray:
    """True for each byte inside n marks in a row that its row of text holds twice or more."""
    cover = np.zeros(len(data) + 1, np.int32)
    if len(data) >= n:
        mark = _MARK[data]
        all_of = mark[: len(data) - n + 1].copy()
        for k in range(1, n):
            all_of &= mark[k : len(data) - n + 1 + k]
        at = np.flatnonzero(all_of)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + n <= offsets[row + 1]
        at, gram = at[inside], row[inside].astype(np.uint64)
        for k in range(n):
            gram = (gram << np.uint64(8)) | data[at + k]
        order = np.argsort(gram)
        same = gram[order[1:]] == gram[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        np.add.at(cover, at[again], 1)
        np.add.at(cover, at[again] + n, -1)
    return np.cumsum(cover[:-1]) > 0


def repeated_lines(text: bytes) -> tuple[int, int, int]:
    """Lines with a word that equal an earlier line, their word characters, and all lines with a word."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0, 0, sum(1 for x in lines if x.strip(b" \t\n\v\f\r"))
    seen, again, chars, full = set(), 0, 0, 0
    for x in lines:
        words = x.split()
        if words:
            full += 1
            if x in seen:
                again += 1
                chars += sum(len(y.decode("utf-8", "replace")) for y in words)
            seen.add(x)
    return again, chars, full


def measured(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = utf8(column)
    w = words_of(data, offsets)
    first = w.first
    n_words = np.diff(first)
    lead = (data & 0xC0) != 0x80
    inside = ~SEPARATOR[data]
    word_chars = per_row(lead & inside, offsets)
    # code points of each word, to weigh covered words
    running = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=running[1:])
    chars = running[w.start + w.length] - running[w.start]
    raw = data.tobytes()
    lines = np.array([repeated_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64).reshape(-1, 3)
    total = np.maximum(word_chars, 1)
    ok = np.ones(len(n_words), bool)
    out = {}
    for n, limit in NGRAM_LIMITS.items():
        cover = covered_words(w, n)
        if n == 5:
            n_repeat = per_row(cover, first)
        share = per_row(np.where(cover, chars, 0), first) / total
        out[f"dup_{n}gram_chars"] = share
        ok &= share <= limit
    marks = per_row(covered_marks(data, offsets), offsets) / total
    ok &= marks <= MARK_LIMIT
    line_chars, line_share = lines[:, 1] / total, lines[:, 0] / np.maximum(lines[:, 2], 1)
    ok &= (line_chars <= LINE_CHAR_LIMIT) & (line_share <= LINE_LIMIT)
    n_symbols = per_row(_SYMBOL[data], offsets)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > 20 * n_words)
    base = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
        "n_dup_lines": lines[:, 0], "n_repeat_words": n_repeat, "base_failed": failed, "kept": ok & ~failed,
    }
    return base | out | {"dup_mark_chars": marks, "dup_line_chars": line_chars}


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, " + ", ".join(f"dup_{n}gram_chars double" for n in NGRAM_LIMITS) + ", dup_mark_chars double, dup_line_chars double"


def quality_rules(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per input row: the columns `keep` (default doc_id) and what RESULT lists.

    A kept column whose name clashes with a result's, or another's, is given the suffix _in.
    """
    keep = ["doc_id"] if keep is None else keep
    measures = T._parse_datatype_string(RESULT)
    names = unclashed(keep, measures.names)
    columns = [docs[k].alias(f"k{i}") for i, k in enumerate(keep)]
    at = keep.index(text) if text in keep else len(keep)  # the text travels once
    source = docs.select(*columns, *([docs[text].alias(f"k{at}")] if at == len(keep) else []))
    schema = T.StructType([T.StructField(n, docs.schema[k].dataType) for n, k in zip(names, keep, strict=True)] + measures.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, f"k{at}", SMALL_BYTES):
            got = measured(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(got[f]) for f in measures.names)], names=[*names, *measures.names])

    return source.mapInArrow(run, schema)
