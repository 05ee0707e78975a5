"""Packing of tokenised documents into sequences by best-fit decreasing.

Documents are cut into full windows and a rest. Rests are placed longest first, each into the tightest
open window that still holds it; a segment tree indexed by remaining capacity finds that window. What
a placement depends on are lengths alone, of which there are fewer than a window has tokens. So tasks
number their pieces by length, the counts of all tasks together are packed at once (equal windows in
groups, however many), and each piece finds its place by its number: one packing over the whole
corpus, whatever its partitions, without a shuffle of ids.

Defined results: a null or empty text has one token, the end mark; pieces of equal length take
their places in order of task and row; repeated rows are packed twice; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.bytebpe import default_tokenizer, encoder
from recollect.llm.common import SMALL_BYTES, blocks, stored

WINDOW, END = 2048, 1


class Capacities:
    """Groups of open windows by remaining capacity; a segment tree over 0..size finds the tightest fit."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)  # groups below each node
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, first: int, count: int) -> None:
        """`count` windows from `first` on have that capacity left."""
        self.open[capacity].append((first, count))
        at = capacity + self.leaves
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int, int] | None:
        """Remove a group of the smallest capacity that is at least `least`: (capacity, first, count)."""
        tree, at = self.tree, least + self.leaves
        while not tree[at]:  # climb to a node whose right neighbour has something
            while at & 1:
                at >>= 1
                if not at:
                    return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not tree[at]:
                at += 1
        capacity = at - self.leaves
        while at:
            tree[at] -= 1
            at >>= 1
        return capacity, *self.open[capacity].pop()


#: A slot: pieces of `length` from number `base` on go to the windows first, first + 1, ... of `count`, at `offset`; the next `count` of them behind these, and so on.
SLOT = np.dtype([("length", "i8"), ("base", "i8"), ("first", "i8"), ("count", "i8"), ("offset", "i8")])


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> tuple[np.ndarray, int]:
    """Slots for so many pieces of each length, in order of length and base, and the count of windows.

    Of equal pieces the first goes into the tightest window, the second into the same one if it
    still fits (nothing is tighter), so a window of capacity c takes c // length of them; windows
    that are alike stay one group, and a length splits one group at most.
    """
    open_windows, slots, windows = Capacities(window), [], 0
    for length in sorted(counts, reverse=True):
        left, base = counts[length], 0
        while left:
            found = open_windows.take(length)
            if found is None:
                each = window // length
                found = window, windows, -(-left // each)
                windows += found[2]
            capacity, first, count = found
            each = capacity // length
            filled = min(count, left // each)
            for n, at, some in ((each, first, filled), (left - filled * each if filled < count else 0, first + filled, 1)):
                if n and some:
                    slots.append((length, base, at, some, window - capacity))
                    base += n * some
                    left -= n * some
                    if capacity > n * length:
                        open_windows.add(capacity - n * length, at, some)
                    filled = at + some - first
            if filled < count:
                open_windows.add(capacity, first + filled, count - filled)
    table = np.array(slots, SLOT)
    return table[np.lexsort((table["base"], table["length"]))], windows


def places(slots: np.ndarray, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of the pieces of these lengths and numbers."""
    begins = np.searchsorted(slots["length"], length)
    ends = np.searchsorted(slots["length"], length, "right")
    while (open_ := ends - begins > 1).any():  # the last slot of the length whose base is not above the number
        middle = (begins + ends) // 2
        right = open_ & (slots["base"][np.minimum(middle, len(slots) - 1)] <= number)
        begins, ends = np.where(right, middle, begins), np.where(open_ & ~right, middle, ends)
    slot = slots[begins]
    layer, window = np.divmod(number - slot["base"], slot["count"])
    return slot["first"] + window, slot["offset"] + layer * length


def pieces(docs: DataFrame, ident: str, text: str, tokenizer: str, window: int, end: int, with_ids: bool) -> DataFrame:
    """Every piece with its task and its number among the task's pieces of its length."""
    fields = [T.StructField(ident, docs.schema[ident].dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "part", "nth"))]
    schema = T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)
    stop = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, task = np.zeros(window + 1, np.int64), TaskContext.get().partitionId()
        for b in blocks(batches, "t", SMALL_BYTES):
            rows, starts, lengths, sums, tokens, parts = [], [], [], [], [], []
            for k, ids in enumerate(encoder(tokenizer).encode(b.column(1).to_pylist())):
                ids += stop
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append(k), starts.append(start), lengths.append(len(part) // 4), sums.append(zlib.crc32(part)), tokens.append(n)
                    if with_ids:
                        parts.append(part)
            length = np.array(lengths, np.int64)
            order = np.argsort(length, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], length[order][1:] != length[order][:-1]]))
            nth = np.empty(len(length), np.int64)
            nth[order] = seen[length[order]] + np.arange(len(length)) - np.repeat(first, np.diff(np.append(first, len(length))))
            seen += np.bincount(length, minlength=window + 1)
            columns = [b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (starts, length, sums, tokens)), pa.array(np.full(len(length), task)), pa.array(nth)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(parts, pa.binary())] * with_ids, names=schema.names)

    return docs.select(docs[ident].alias("k"), docs[text].alias("t")).mapInArrow(run, schema)


def packed(docs: DataFrame, ident: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    cut = stored(pieces(docs, ident, text, tokenizer or default_tokenizer(), window, end, with_ids), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length: `window` at most
    slots, _ = best_fit_decreasing(totals, window)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", F.col("length").alias("of_length"), F.coalesce(before, F.lit(0)).alias("number_before"))
    names = [ident, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    plain = cut.toDF(*[f"c{i}" for i in range(len(cut.columns))])
    numbered = plain.join(bases, (plain.c5 == bases.part) & (plain.c2 == bases.of_length)).select(*plain.columns[:5], (F.col("c6") + F.col("number_before")).alias("number"), *plain.columns[7:])
    schema = T.StructType([T.StructField(n, cut.schema[n].dataType if n in cut.columns else T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, offset = places(slots, b.column(2).to_numpy(), b.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at), pa.array(offset), *b.columns[6:]], names=names)

    return numbered.mapInArrow(run, schema)
