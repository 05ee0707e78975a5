"""A kept full-text index with positions: phrases and words near one another.

A posting is (slot, term, id, n, deltas): the n places of a term among a memory's terms, each as the
distance from the one before. Slots are ranges of term hashes; files are in order of slot and
term, and the table's log knows the slots of each file, so a search opens the files of its terms only.
New memories are appended as they come, and small files are put together in ranges of slots.

Terms are lower-case runs of ASCII letters and digits. A null text has none. A memory is added once;
one that changes is removed first (removed). Words of a query go through the same rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import terms
from recollect.sources.storage import kept
from recollect.sources.tables import Tables

#: Slots of term hashes, postings of a file, and of a block of memories (about); words put in order together (about).
SLOTS, POSTINGS, HELD, WORDS = 1 << 16, 1 << 20, 1 << 20, 1 << 20
POSTING = "slot long, term string, id long, n long, deltas array<int>"


def slot_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("long")


def postings(memories: DataFrame) -> DataFrame:
    """(slot, term, id, n, deltas) of memories (id, content): a narrow map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(pc.list_value_length(b.column(1)).to_numpy().astype(np.int64))
            first = 0
            while first < b.num_rows:  # so many words at a time, whole memories
                end = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + WORDS, "right")))
                yield _grouped(b.slice(first, end - first))
                first = end

    listed = memories.select(F.col("id").cast("long").alias("id"), F.coalesce(terms(F.col("content")), F.array().cast("array<string>")).alias("terms"))
    return listed.mapInArrow(run, "term string, id long, n long, deltas array<int>").select(slot_of(F.col("term")).alias("slot"), "term", "id", "n", "deltas")


def _grouped(b: pa.RecordBatch) -> pa.RecordBatch:
    """Postings of some memories (id, terms): words are numbered and put in order of memory and number."""
    n = pc.list_value_length(b.column(1)).to_numpy().astype(np.int64)
    coded = pc.list_flatten(b.column(1)).dictionary_encode()
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    deltas = np.diff(place, prepend=0)
    deltas[new] = place[new]
    ends = np.append(new, len(key))
    words, ids = coded.dictionary.take(coded.indices.take(pa.array(order[new]))), b.column(0).take(pa.array(row[order[new]]))
    return pa.RecordBatch.from_arrays([words, ids, pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(deltas.astype(np.int32)))], names=["term", "id", "n", "deltas"])


def placed(found: DataFrame) -> DataFrame:
    """Postings with `places` instead of their differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.list_value_length(b.column(2)).to_numpy().astype(np.int64)
            total = np.cumsum(pc.list_flatten(b.column(2)).to_numpy().astype(np.int64))
            first = np.cumsum(n) - n
            before = np.where(first > 0, total[np.maximum(first - 1, 0)], 0) if len(total) else np.zeros(len(n), np.int64)
            places = (total - np.repeat(before, n)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(places))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["term", "id", "places"])

    return found.select("term", "id", "deltas").mapInArrow(run, "term string, id long, places array<int>")


class Index:
    """The index in a folder of its own, or among other tables."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.tables = Tables(spark, base, {"postings": POSTING}, {"postings": "slot"})
        self.tables.set_up()

    def add(self, memories: DataFrame) -> None:
        """Index memories (id, content) that are not in it yet."""
        new = kept(postings(memories), "postings")
        files = -(-new.count() // POSTINGS) or 1
        self.tables.append("postings", new.repartitionByRange(files, "slot", "term").sortWithinPartitions("slot", "term", "id"))
        self.tables.tidy("postings")

    def removed(self, ids: DataFrame) -> None:
        """Take memories (id) out."""

        def work(t) -> None:
            t.replace("postings", t.read("postings").join(ids.select("id").distinct(), "id", "left_anti").select("slot", "term", "id", "n", "deltas"))

        self.tables.transact(work)

    def compact(self) -> int:
        """Put files together that are not half full; what an add of many postings has written stays."""
        return self.tables.compact("postings", max(1, POSTINGS // 2))

    def of(self, words: Iterable[str]) -> DataFrame:
        """Postings of a few terms: the files of their slots, filtered by slot and term in the scan."""
        words = sorted(set(words))
        slots = sorted({r.s for r in self.spark.range(1).select(F.explode(F.array(*map(F.lit, words)).cast("array<string>")).alias("t")).select(slot_of(F.col("t")).alias("s")).collect()})
        return self.tables.begin().read("postings", slots).filter(F.col("slot").isin(slots) & F.col("term").isin(words))

    def whole(self) -> DataFrame:
        return self.tables.read("postings")

    def phrase(self, text: str) -> DataFrame:
        """(id, n): memories that hold the words of the text one after another, and how often."""
        words = _words(self.spark, text)
        one = self.spark.range(1).select(F.lit(0).alias("query_id"), F.array(*map(F.lit, words)).cast("array<string>").alias("words"))
        return phrases_each(self.of(words), one).select("id", "n")

    def near(self, a: str, b: str, between: int = 10) -> DataFrame:
        """(id): memories where both words occur with at most so many terms between them, in any order."""
        a, b = (_words(self.spark, x) for x in (a, b))
        if len(a) != 1 or len(b) != 1:
            raise ValueError("near() takes two words")
        one = self.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(a[0]).alias("a"), F.lit(b[0]).alias("b"))
        return near_each(self.of([a[0], b[0]]), one, between).select("id")


def _words(spark: SparkSession, text: str) -> list[str]:
    return spark.range(1).select(terms(F.lit(text))).first()[0]


def _by_memory(index: DataFrame, words: list[str]) -> DataFrame:
    """Postings of the words, by memory: rows (block, ids, codes, counts, deltas) of packed numbers; a word's code is its place in the list."""
    spark = index.sparkSession
    coded = spark.createDataFrame(pa.table({"term": pa.array(words, pa.string()), "code": pa.array(np.arange(len(words)))}))
    some = index.join(F.broadcast(coded), "term").select("id", "code", "n", "deltas")
    blocks = max(1, -(-index.count() // HELD))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, codes, n = (b.column(k).to_numpy() for k in range(3))
            deltas = pc.list_flatten(b.column(3)).to_numpy().astype(np.int32)
            block = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % blocks
            order = np.argsort(block, kind="stable")
            first = np.cumsum(n) - n
            own = np.repeat(first[order] - (np.cumsum(n[order]) - n[order]), n[order]) + np.arange(n.sum())
            edge = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0]))
            ends, upto = [*edge[1:].tolist(), len(order)], np.concatenate([[0], np.cumsum(n[order])])
            ids, codes, n, deltas = ids[order], codes[order].astype(np.int32), n[order].astype(np.int32), deltas[own]
            cut = lambda x, at: pa.array([x[p:q].tobytes() for p, q in at], pa.binary())
            rows = list(zip(edge.tolist(), ends, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(block[order][edge]), *(cut(x, rows) for x in (ids, codes, n)), cut(deltas, [(upto[p], upto[q]) for p, q in rows])], names=["block", "ids", "codes", "counts", "deltas"])

    return some.mapInArrow(pack, "block long, ids binary, codes binary, counts binary, deltas binary").repartition(blocks, "block").sortWithinPartitions("block")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, places, codes) of the packed words of a block of memories, in order of id and place."""
    held, now = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[0] != now:
                yield _unpacked(held)
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield _unpacked(held)


def _unpacked(rows: list[tuple[bytes, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, codes, n, deltas = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*rows, strict=True), (np.int64, np.int32, np.int32, np.int32), strict=True))
    total, first = np.cumsum(deltas.astype(np.int64)), np.cumsum(n.astype(np.int64)) - n
    places = total - np.repeat(np.where(first > 0, total[np.maximum(first - 1, 0)], 0), n)
    ids, codes = np.repeat(ids, n), np.repeat(codes, n)
    order = np.lexsort((places, ids))
    return ids[order], places[order], codes[order]


def _found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each key in wanted (sorted), or -1."""
    if not len(wanted):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return np.where(wanted[at] == keys, at, -1)


def phrases_each(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, id, n): memories that hold each query's `words` one after another, and how often; postings in index.

    Postings of the words asked for are put together by memory, and each place is looked up among the phrases, so
    the work grows with the places and the results, not with their product with the queries. The phrases, each once,
    are known to all tasks. A query without words finds nothing.
    """
    spark = index.sparkSession
    asked = kept(queries.select("query_id", "words"), "asked").filter("size(words) > 0")
    phrases = asked.select("words").distinct().toArrow().column("words").to_pylist()
    words = sorted({w for p in phrases for w in p})
    code = {w: k for k, w in enumerate(words)}
    # level t: beginnings of t + 1 words as (number of the beginning of t words) * len(words) + code, sorted
    levels, begun = [], [0] * len(phrases)
    for t in range(max(map(len, phrases), default=0)):
        keys = [begun[i] * len(words) + code[p[t]] if len(p) > t else -1 for i, p in enumerate(phrases)]
        levels.append(np.unique([k for k in keys if k >= 0]))
        begun = [int(np.searchsorted(levels[t], k)) if k >= 0 else begun[i] for i, k in enumerate(keys)]
    lengths = [len(p) for p in phrases]
    known = spark.sparkContext.broadcast((levels, len(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, n_words = known.value
        for ids, places, codes in _texts(batches):
            at, number = np.arange(len(ids)), np.zeros(len(ids), np.int64)
            for t, level in enumerate(levels):
                ok = at + t < len(ids)
                at, number = at[ok], number[ok]
                ok = (ids[at + t] == ids[at]) & (places[at + t] == places[at] + t)
                at, number = at[ok], number[ok]
                number = _found(number * n_words + codes[at + t], level)
                at, number = at[number >= 0], number[number >= 0]
                order = np.lexsort((ids[at], number))
                a, b = number[order], ids[at][order]
                new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
                many = np.diff(np.concatenate([new, [len(a)]])) if len(a) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), t + 1, np.int32)), pa.array(a[new]), pa.array(b[new]), pa.array(many.astype(np.int64))], names=["size", "number", "id", "n"])

    found = _by_memory(index, words).mapInArrow(run, "size int, number long, id long, n long")
    numbered = pa.table({"words": pa.array(phrases, pa.list_(pa.string())), "size": pa.array(lengths, pa.int32()), "number": pa.array(begun, pa.int64())})
    named = asked.join(F.broadcast(spark.createDataFrame(numbered)), "words").select("query_id", "size", "number")
    return found.join(F.broadcast(named), ["size", "number"]).select("query_id", "id", "n")


def near_each(index: DataFrame, queries: DataFrame, between: int) -> DataFrame:
    """(query_id, id): memories where the words a and b of a query occur with at most so many terms between them, in any order.

    As phrases_each: words that are that near are looked up among the pairs asked for. A word near itself has to occur twice.
    """
    spark = index.sparkSession
    asked = kept(queries.select("query_id", "a", "b"), "asked").filter("a is not null and b is not null")
    asked = asked.select("query_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = [(r.a, r.b) for r in asked.select("a", "b").distinct().collect()]
    words = sorted({w for p in pairs for w in p})
    code = {w: k for k, w in enumerate(words)}
    keys = [code[a] * len(words) + code[b] for a, b in pairs]
    known = spark.sparkContext.broadcast((np.unique(np.array(keys, np.int64)), len(words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, n_words = known.value
        for ids, places, codes in _texts(batches):
            known_ids, rank = np.unique(ids, return_inverse=True)
            codes, hits = codes.astype(np.int64), [np.zeros(0, np.int64)]
            for d in range(1, between + 2):
                x, y = codes[:-d], codes[d:]
                at = _found(np.minimum(x, y) * n_words + np.maximum(x, y), wanted)
                ok = (at >= 0) & (ids[:-d] == ids[d:]) & (places[d:] - places[:-d] <= between + 1)
                hits.append(np.unique(at[ok] * len(known_ids) + rank[:-d][ok]))
            every = np.unique(np.concatenate(hits))
            yield pa.RecordBatch.from_arrays([pa.array(wanted[every // max(1, len(known_ids))]), pa.array(known_ids[every % max(1, len(known_ids))])], names=["pair", "id"])

    found = _by_memory(index, words).mapInArrow(run, "pair long, id long")
    numbered = pa.table({"a": pa.array([a for a, _ in pairs], pa.string()), "b": pa.array([b for _, b in pairs], pa.string()), "pair": pa.array(keys, pa.int64())})
    named = asked.join(F.broadcast(spark.createDataFrame(numbered)), ["a", "b"]).select("query_id", "pair")
    return found.join(F.broadcast(named), "pair").select("query_id", "id")


def phrase_words(content: Column, first: int, n: int) -> Column:
    """n terms of a text from the place `first` on (from 1)."""
    return F.slice(terms(content), first, n)

