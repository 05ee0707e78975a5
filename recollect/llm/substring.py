"""Removal of repeated passages by content-defined chunking.

A gear rolling hash over the last 16 bytes gives each word end a value; a chunk ends where that
value is the least among its neighbours. Cuts thus depend on nearby content alone: an insertion
moves the chunks behind it, but does not change them. Chunks have at least three words, five on
average, and are cut after MAX_WORDS at the latest.

What is compared are windows, by digest: the fewest chunks from each chunk on, and up to each
chunk, that hold MIN_WORDS. Where a window ends follows from its own words, so a run of chunks
that another text holds has the same windows there, and they cover it if it has MIN_WORDS. Chunks
that recur one by one, in different places, make no window.

Of SEND_ROWS windows a task sends one per digest, its first, to the digest's bucket, packed as one binary
row for each bucket; the count of buckets grows with the corpus. It knows already that its other
occurrences are repeats, and spreads these over all buckets, which just pass them on. So a passage
that a third of all documents share reaches its bucket once per SEND_ROWS windows of a task. The first occurrence (by id,
then place) of a window stays; the others are marked and cut out of the texts. Texts without a
mark are told by a Bloom filter over the marked ones (sized by their count, FILTER_BYTES at most;
where that can't hold them, all texts are joined) and don't take part in the join with the marks.
Up to about ten words at the edges of a passage may stay, where its surroundings shape the chunks.

Defined results: null texts stay null and have no words; null ids come last in the order of
occurrences; ids of a type other than integers are ordered by a 64-bit hash; rows that share id
and text count as one document and are cut alike; all columns pass through, whatever their names
(results' names get the suffix _dedup as often as it takes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import blocks, stored, unclashed, utf8
from recollect.llm.words import BYTE_HASH, Words, mixed, words_of

#: Words on both sides among which a cut's gear value is the least; bytes that value depends on.
REACH, GEAR_BYTES = 2, 16
#: Words of a passage from which on it is removed; most words of a chunk.
MIN_WORDS, MAX_WORDS = 25, 16
BUCKET_ROWS, SEND_ROWS = 1 << 18, 1 << 18
#: Most bytes of the filter of marked texts, which is broadcast; bits for each of them.
FILTER_BYTES, FILTER_BITS = 64 << 20, 16
_GEAR = (BYTE_HASH >> np.uint64(32)).astype(np.uint32)
_LAST = np.iinfo(np.int64).max
#: An odd factor and its inverse modulo 2**64.
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def gear(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of the last 16: the sum of table values, each shifted by its age."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[k:] = h[:-k] << np.uint32(k)
        h = h + older
    return h


def chunk_starts(data: np.ndarray, offsets: np.ndarray, w: Words) -> np.ndarray:
    """Index of the first word of each chunk."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64)
    end = w.start + w.length - 1
    value = gear(data)[end].astype(np.int64)
    value[end - offsets[w.row] < GEAR_BYTES] = 1 << 40  # it would depend on the row before
    cut = value < 1 << 40
    for k in range(1, REACH + 1):
        same = w.row[k:] == w.row[:-k]
        cut[k:] &= (value[k:] < value[:-k]) | ~same
        cut[:-k] &= (value[:-k] <= value[k:]) | ~same
    begin = np.zeros(n + 1, bool)
    begin[1:] = cut
    begin[w.first[:-1][np.diff(w.first) > 0]] = True
    at = np.flatnonzero(begin[:n])
    size = np.diff(np.append(at, n))
    parts = -(-size // MAX_WORDS)
    if (parts > 1).any():
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(at, parts) + step * MAX_WORDS
    return at


def digests(w: Words, at: np.ndarray) -> np.ndarray:
    """64-bit hash of each chunk's sequence of words."""
    size = np.diff(np.append(at, len(w.start)))
    place = np.arange(len(w.start)) - np.repeat(at, size)
    return mixed(np.add.reduceat(w.hash * (mixed(place.astype(np.uint64) + np.uint64(1)) | np.uint64(1)), at) + size.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)


def windows(row: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks [from, to) of each window, and its number within its row.

    The window from chunk i on has number 2i, the one up to chunk i has 2i + 1 (left out if it is
    also the window from its first chunk on). No window crosses rows.
    """
    n = len(sizes)
    total, at = np.concatenate([[0], np.cumsum(sizes)]), np.arange(n)
    begin, end = np.searchsorted(row, row), np.searchsorted(row, row, "right")
    to = np.searchsorted(total, total[:-1] + least)
    on = to <= end
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    up = start >= begin
    up &= to[np.maximum(start, 0)] != at + 1
    place = at - begin
    return np.concatenate([at[on], start[up]]), np.concatenate([to[on], at[up] + 1]), np.concatenate([2 * place[on], 2 * place[up] + 1]).astype(np.int32)


def window_digests(digest: np.ndarray, sizes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the digests of the chunks [begin, end): a polynomial in place, by differences."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    n = len(digest)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _STEP, np.uint64)]))
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BACK, np.uint64)]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(digest) * power[:-1])])
        return mixed((total[end] - total[begin]) * back[begin] + (end - begin).astype(np.uint64))


def _packed(bucket: np.ndarray, columns: list[np.ndarray], buckets: int, kind: int) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    rows = [b"".join(c[a:z].tobytes() for c in columns) for a, z in zip(edge[:-1], edge[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows, pa.binary())], names=["bucket", "kind", "data"])


#: Bytes of text worked on at once.
TEXT_BYTES = 1 << 20
#: First occurrences: digest, document's key, its id, window number. Later ones: key, the first one's id, number.
_KINDS, _LATER = (np.uint64, np.int64, np.int64, np.int32), (np.int64, np.int64, np.int32)


def _unpacked(data: bytes, kinds=_KINDS) -> list[np.ndarray]:
    n, at, out = len(data) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def _firsts(digest: np.ndarray, key: np.ndarray, ident: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by digest, id, key and chunk, and for each entry in it where its digest begins."""
    order = np.argsort(digest, kind="stable")
    d = digest[order]
    begin = np.concatenate([[True], d[1:] != d[:-1]]) if len(d) else np.zeros(0, bool)
    run = np.cumsum(begin) - 1
    many = (np.bincount(run) > 1)[run] if len(d) else begin
    some = order[many]
    order[many] = some[np.lexsort((chunk[some], key[some], ident[some], digest[some]))]
    return order, np.maximum.accumulate(np.where(begin, np.arange(len(d)), 0)) if len(d) else run


def marks(docs: DataFrame, buckets: int, min_words: int = MIN_WORDS) -> DataFrame:
    """(key, chunk, owner): numbers of windows that occur earlier, and the id of a document that holds them earlier.

    That is the first of all documents, or the first of those that the same task has read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, seen = [], 0, set()

        def send():
            digest, key, ident, chunk = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order, lead = _firsts(digest, key, ident, chunk)
            digest, key, ident, chunk = digest[order], key[order], ident[order], chunk[order]
            first = lead == np.arange(len(lead))
            place = lambda x: (x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            yield _packed(place(digest[first]), [digest[first], key[first], ident[first], chunk[first]], buckets, 0)
            later = ~first & ((key != key[lead]) | (chunk != chunk[lead]))
            if later.any():  # known to be repeats already: any bucket will do
                yield _packed(place(mixed(key[later].view(np.uint64))), [key[later], ident[lead][later], chunk[later]], buckets, 1)

        for b in blocks(batches, "text", TEXT_BYTES):
            data, offsets = utf8(b.column(2))
            w = words_of(data, offsets)
            at = chunk_starts(data, offsets, w)
            key = b.column(0).to_numpy(zero_copy_only=False)
            ident = b.column(1).fill_null(_LAST).to_numpy(zero_copy_only=False)
            sizes = np.diff(np.append(at, len(w.start)))
            begin, end, number = windows(w.row[at], sizes, min_words)
            row, digest = w.row[at][begin], window_digests(digests(w, at), sizes, begin, end)
            new = np.zeros(len(key), bool)
            for i, k in enumerate(key.tolist()):
                if k not in seen:
                    seen.add(k)
                    new[i] = True
            use = new[row]
            held.append((digest[use], key[row[use]], ident[row[use]], number[use]))
            count += int(use.sum())
            if count >= SEND_ROWS:
                yield from send()
                count = 0
        if count:
            yield from send()

    def judge(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        data = [x.as_py() for x in table.column("data")]
        out = [_unpacked(x, _LATER) for x, k in zip(data, kind, strict=True) if k == 1]
        sent = [_unpacked(x) for x, k in zip(data, kind, strict=True) if k == 0]
        if sent:
            digest, key, ident, chunk = (np.concatenate(c) for c in zip(*sent, strict=True))
            order, lead = _firsts(digest, key, ident, chunk)
            key, ident, chunk = key[order], ident[order], chunk[order]
            later = (key != key[lead]) | (chunk != chunk[lead])
            out.append([key[later], ident[lead][later], chunk[later]])
        k, o, c = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"key": k, "chunk": c.astype(np.int32), "owner": o})

    return docs.mapInArrow(run, "bucket int, kind int, data binary").groupBy("bucket").applyInArrow(judge, "key long, chunk int, owner long")


def key_filter(keys: DataFrame, count: int) -> np.ndarray | None:
    """A Bloom filter (one bit a key, FILTER_BITS places for each) as 64-bit words; None if it would be too large."""
    bits = 1 << max(12, (FILTER_BITS * count - 1).bit_length())
    if bits > 8 * FILTER_BYTES:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spot = mixed(b.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)
            at, local = np.unique(spot >> np.uint64(6), return_inverse=True)
            words = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(words, local, np.uint64(1) << (spot & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(words.view(np.int64))], names=["at", "word"])

    got = keys.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()  # FILTER_BYTES at most
    words = np.zeros(bits // 64, np.uint64)
    words[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return words


def within(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    spot = mixed(key.view(np.uint64)) & np.uint64(64 * len(words) - 1)
    return (words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) > 0


def spans(marked: np.ndarray, sizes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs [from, to) of marked chunks that hold at least so many words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    total = np.concatenate([[0], np.cumsum(sizes)])
    return [(a, z) for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if total[z] - total[a] >= least]


RESULT = "n_words long, removed_words long, spans array<struct<start:long,end:long,owner:long>>"


def without_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of docs, the text without its repeated passages, and what RESULT lists.

    Spans are byte offsets into the UTF-8 of the old text. owner is the id of an earlier document
    that holds the span's first window (see marks; null if that id is null, and the xxhash64 of an
    id that is no integer).
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(1, int(total / 30 / BUCKET_ROWS))
    key = F.xxhash64(docs[ident].cast("string"), docs[text])
    whole = isinstance(docs.schema[ident].dataType, T.IntegralType)
    order = docs[ident].cast("long") if whole else F.when(docs[ident].isNotNull(), F.xxhash64(docs[ident].cast("string")))
    found = marks(docs.select(key.alias("key"), order.alias("ident"), docs[text].alias("text")), buckets, min_words)
    listed = stored(found.groupBy("key").agg(F.collect_set(F.struct("chunk", "owner")).alias("marks")), "marks")
    old = docs.schema.fields
    results = T._parse_datatype_string(RESULT).fields
    extra = [T.StructField(n, f.dataType) for n, f in zip(unclashed([f.name for f in results], docs.columns, "_dedup"), results, strict=True)]
    source = docs.select(key.alias("key"), *[docs[f.name].alias(f"k{i}") for i, f in enumerate(old)])
    position = docs.columns.index(text)
    names = [f.name for f in old] + [f.name for f in extra]
    kept_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("owner", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, f"k{position}", TEXT_BYTES):
            data, offsets = utf8(b.column(position))
            w = words_of(data, offsets)
            removed, listed_spans, columns = np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)], list(b.columns[: len(old)])
            marked = b.column(len(old)) if b.num_columns > len(old) else None
            if marked is not None and marked.null_count < b.num_rows:
                columns[position] = pa.array(_shortened(b.column(position).to_pylist(), marked.to_pylist(), data, offsets, w, min_words, removed, listed_spans), b.column(position).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(w.first)), pa.array(removed), pa.array(listed_spans, kept_type)], names=names)

    schema = T.StructType(old + extra)
    words = key_filter(listed.select("key"), listed.count())
    if words is None:
        return source.join(listed, "key", "left").drop("key").mapInArrow(cut, schema)
    sent = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def perhaps(key: pd.Series) -> pd.Series:
        return pd.Series(within(sent.value, key.to_numpy(np.int64)))

    flagged = source.withColumn("perhaps", perhaps("key"))
    clean = flagged.filter(~F.col("perhaps")).drop("key", "perhaps").mapInArrow(cut, schema)
    return clean.unionAll(flagged.filter("perhaps").drop("perhaps").join(listed, "key", "left").drop("key").mapInArrow(cut, schema))


def _shortened(texts: list, marked: list, data: np.ndarray, offsets: np.ndarray, w: Words, min_words: int, removed: np.ndarray, found: list[list]) -> list:
    """The texts of a block without their marked passages; removed and found get the words and spans taken out."""
    at = chunk_starts(data, offsets, w)
    first = np.searchsorted(at, w.first)  # chunks never cross rows
    size = np.diff(np.append(at, len(w.start)))
    begins, ends, number = windows(w.row[at], size, min_words)
    order = np.lexsort((number, w.row[at][begins]))
    begins, ends, number = begins[order], ends[order], number[order]
    lead = np.searchsorted(w.row[at][begins], np.arange(len(texts) + 1))
    for r, m in enumerate(marked):
        if not m:
            continue
        a, z = int(first[r]), int(first[r + 1])
        hit, owner = np.zeros(z - a, bool), {}
        of = number[lead[r] : lead[r + 1]]
        for x in m:
            k = lead[r] + np.searchsorted(of, x["chunk"])
            i = int(begins[k] - a)
            hit[i : ends[k] - a] = True
            owner[i] = min(owner.get(i, _LAST), x["owner"])
        raw, parts, done = data[offsets[r] : offsets[r + 1]].tobytes(), [], 0
        for i, j in spans(hit, size[a:z], min_words):
            begin = int(w.start[at[a + i]] - offsets[r])
            end = int(w.start[at[a + j]] - offsets[r]) if a + j < z else len(raw)
            parts.append(raw[done:begin])
            done = end
            removed[r] += size[a + i : a + j].sum()
            found[r].append({"start": begin, "end": end, "owner": None if owner[i] == _LAST else owner[i]})
        if found[r]:
            texts[r] = b"".join([*parts, raw[done:]]).decode()
    return texts
