"""Audit of sources: how the terms of each (lang, source) group diverge from those of the other groups.

Tokenizer: a lookup table over the concatenated UTF-8 bytes of an Arrow block finds the boundaries of all
terms at once. Within a block xxhash groups the slices, and every slice is compared byte by byte with the
first of its group, so that a collision splits the group. Blocks give (lang, source, term,
occurrences, documents); Spark adds these up, map-side first, so no key is hot.

Divergences: the terms of a language are dealt by hash into slices; a task gets one slice as a CSR
matrix of its groups and terms and gives, for each pair of groups, the sum of its terms' differences
(np.add.reduceat over the rows), and for each group its highest terms. A slice holds a bounded number
of entries, or as many as it gives pairs. What a language has most is its groups squared, which the
result lists anyhow.

Shares are integers, 1 + floor(10^9 (count + 5) / (N + 5 V)), and so are all sums.

Defined results: null text, lang and source are ''; a text without terms counts for its group's being there
only; repeated rows count each; a language without kept terms has pairs of value 0 and no term rows; a
language with one source has no pairs; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import BLOCK_BYTES, blocks, discard, stored, utf8

MIN_DOCUMENTS, SMOOTHING, SCALE, TOP = 30, 5, 10**9, 50
#: Entries (group, term) of a slice, at least.
SLICE = 1 << 13

#: Bytes of terms: letters and all of a multi-byte character.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z become a-z, all else stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of each term of the concatenated texts; rows meet at offsets."""
    inside = TERM[data]
    row_begins = np.zeros(len(data) + 1, bool)
    row_begins[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | row_begins[1:-1]
    ends[:-1] &= ~inside[1:] | row_begins[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether data[a:a+length] and data[b:b+length] agree, for each entry."""
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    equal = data[np.repeat(a, length) + within] == data[np.repeat(b, length) + within]
    return np.logical_and.reduceat(equal, first) if len(a) else np.zeros(0, bool)


def grouped_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(number of the term of each slice, a slice of each term): equal numbers mean equal bytes."""
    raw = memoryview(data.tobytes())
    n = len(start)
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64, n)
    _, head, term = np.unique(hashes, return_index=True, return_inverse=True)
    length = end - start
    alike = length == length[head[term]]
    alike[alike] = same_bytes(data, start[alike], start[head[term[alike]]], length[alike])
    heads, split = head.tolist(), {}
    for i in np.flatnonzero(~alike):  # another term of the same hash
        word = (int(term[i]), bytes(raw[start[i] : end[i]]))
        if word not in split:
            split[word] = len(heads)
            heads.append(int(i))
        term[i] = split[word]
    return term, np.array(heads, np.int64)


def counted_terms(text: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of a block whose row r belongs to group[r]."""
    data, offsets = utf8(text)
    data = LOWER[data]
    start, end, row = boundaries(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    term, head = grouped_slices(data, start, end)
    order = np.lexsort((row, group[row], term))
    t, g, r = term[order], group[row][order], row[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
    new_document = new.copy()
    new_document[1:] |= r[1:] != r[:-1]
    at = np.flatnonzero(new)
    slices = head[t[at]]
    length = end[slices] - start[slices]
    ends = np.cumsum(length)
    within = np.arange(int(ends[-1])) - np.repeat(ends - length, length)
    letters = data[np.repeat(start[slices], length) + within]
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())).cast(pa.string())
    return g[at], terms, np.diff(np.append(at, len(t))), np.add.reduceat(new_document.astype(np.int64), at)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, occurrences, documents), one row each."""
    source = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 2 * BLOCK_BYTES):
            lang, name = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
            width = len(name.dictionary)
            group = lang.indices.to_numpy().astype(np.int64) * width + name.indices.to_numpy()
            g, terms, count, documents = counted_terms(b.column(2), group)
            yield pa.RecordBatch.from_arrays(
                [lang.dictionary.take(pa.array(g // width)), name.dictionary.take(pa.array(g % width)), terms, pa.array(count.astype(np.int64)), pa.array(documents)],
                names=["lang", "source", "term", "occurrences", "documents"],
            )

    counts = source.mapInArrow(run, "lang string, source string, term string, occurrences long, documents long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))


def shares(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 * terms)), digit by digit in base 1000, so that nothing overflows."""
    above, below = count + SMOOTHING, total + SMOOTHING * terms
    out, rest = above // below, above % below
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // below, rest % below
    return 1 + out


def pair_sums(ptr: np.ndarray, column: np.ndarray, share: np.ndarray, base: np.ndarray, width: int) -> np.ndarray:
    """Sums of |p_a - p_b| over `width` columns for all pairs of rows of a CSR matrix whose missing entries are base[row].

    Row a is laid out densely. Against the base of row b all columns are summed by a search in the sorted
    row; the entries that row b has are then corrected, and reduceat adds the corrections up by row.
    """
    rows = len(base)
    sums = np.zeros((rows, rows), np.int64)
    full = np.flatnonzero(np.diff(ptr))
    owner = np.repeat(np.arange(rows), np.diff(ptr))
    for a in range(rows):
        dense = np.full(width, base[a], np.int64)
        dense[column[ptr[a] : ptr[a + 1]]] = share[ptr[a] : ptr[a + 1]]
        ordered = np.sort(dense)
        upto = np.concatenate([[0], np.cumsum(ordered)])
        at = np.searchsorted(ordered, base)
        sums[a] = base * at - upto[at] + (upto[-1] - upto[at]) - base * (width - at)
        mine = dense[column]
        corrections = np.abs(share - mine) - np.abs(base[owner] - mine)
        if len(full):
            sums[a, full] += np.add.reduceat(corrections, ptr[full])
    return sums


RESULT = "lang string, source string, part string, item string, value long"


def _sliced(key, entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Pair sums and highest terms of one slice: entries (source, term, occurrences, lang_occurrences) and all groups of the language."""
    groups = groups.sort_by("source")
    names, total = groups["source"].combine_chunks(), groups["total"].to_numpy()
    lang, width_of_lang = key[0].as_py(), groups["terms"][0].as_py()
    terms = entries["term"].combine_chunks().dictionary_encode()
    row = pc.index_in(entries["source"].combine_chunks(), names).to_numpy(zero_copy_only=False)
    order = np.argsort(row, kind="stable")
    row, column = row[order].astype(np.int64), terms.indices.to_numpy()[order]
    count = entries["occurrences"].to_numpy()[order]
    ptr = np.searchsorted(row, np.arange(len(names) + 1))
    out = {"source": [], "part": [], "item": [], "value": []}

    def add(part: str, sources: pa.Array, items: pa.Array, values: np.ndarray) -> None:
        out["source"].append(sources), out["part"].append(pa.array([part] * len(values), pa.string())), out["item"].append(items), out["value"].append(pa.array(values, pa.int64()))

    if width_of_lang:
        share = shares(count, total[row], width_of_lang)
        sums = pair_sums(ptr, column, share, shares(np.zeros(len(names), np.int64), total, width_of_lang), len(terms.dictionary))
        a, b = np.nonzero(~np.eye(len(names), dtype=bool))
        add("pair", names.take(pa.array(a)), names.take(pa.array(b)), sums[a, b])
        above = share - shares(entries["lang_occurrences"].to_numpy()[order], np.full(len(row), total.sum()), width_of_lang)
        words = pc.rank(terms.dictionary.cast(pa.binary()), "ascending", tiebreaker="dense").to_numpy()[column] if len(row) else column
        best = np.lexsort((words, -above, row))
        place = np.arange(len(best)) - ptr[row[best]]
        best = best[(place < TOP) & (above[best] > 0)]
        add("term", names.take(pa.array(row[best])), terms.dictionary.take(pa.array(column[best])), above[best])
    else:
        add("pair", *[pa.array([], pa.string())] * 2, np.zeros(0, np.int64))
    merged = {k: pa.concat_arrays(v) for k, v in out.items()}
    return pa.table({"lang": pa.array([lang] * len(merged["value"]), pa.string()), **merged})


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank for every group (lang, source) of docs.

    pair: each other source of the language, by the sum over all kept terms of the difference of
    shares. term: the terms, `top` at most, whose share in the group is above that in its language.
    """
    if top > TOP:
        raise ValueError(f"top is {TOP} at most")
    by_term, by_source = Window.partitionBy("lang", "term"), Window.partitionBy("lang", "source")
    counted = stored(term_counts(docs), "terms")
    kept = counted.select("*", F.sum("documents").over(by_term).alias("in_lang"), F.sum("occurrences").over(by_term).alias("lang_occurrences"), F.row_number().over(by_term.orderBy("source")).alias("nth"))
    kept = stored(kept.filter(F.col("in_lang") >= min_documents).drop("documents", "in_lang"), "kept-terms")
    known = kept.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"), F.sum((F.col("nth") == 1).cast("long")).alias("first"), F.count("*").alias("entries"))
    present = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = stored(present.join(known, ["lang", "source"], "left").fillna(0), "groups")
    langs = groups.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("entries").alias("entries"), F.count("*").alias("sources"))
    size = F.greatest(F.lit(SLICE), F.col("sources") * F.col("sources"))
    langs = stored(langs.select("lang", "terms", F.greatest(F.lit(1), F.ceil(F.col("entries") / size)).alias("slices")), "langs")
    entries = kept.join(langs.select("lang", "slices"), "lang").withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")))
    wide = groups.select("lang", "source", "total").join(langs, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    slices = entries.select("lang", "slice", "source", "term", "occurrences", "lang_occurrences").groupBy("lang", "slice").cogroup(wide.drop("slices").groupBy("lang", "slice")).applyInArrow(_sliced, RESULT)
    parts = stored(slices, "divergences")
    sums = parts.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(by_source.orderBy(F.desc("value"), "item")))
    result = ranked(pairs).union(ranked(parts.filter("part = 'term'").select(*pairs.columns)).filter(F.col("rank") <= top))
    discard(counted, kept, langs)
    return result
