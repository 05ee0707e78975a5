"""N-gram Jaccard join by parity sketches.

Two sets with Jaccard similarity of at least t differ in at most d = (|A| + |B|)(1 - t)/(1 + t)
elements. Deal the universe of shingles out to blocks by hash, and let a block's signature be the
XOR of its members' hashes. Each differing element changes the signature of one block, so the
number of differing blocks (a Hamming distance) never exceeds the symmetric difference. Hence, if
both sets list their non-empty blocks in one global order, their first d + 1 blocks share a
signature: a pigeonhole join on (band, block, signature) loses no pair. Bands are powers of two of
|A| + |B|, so that both sides use the same blocks and few more of them than d + 1.

Any global order is right; frequent shingles are put last, which keeps passages that thousands of
documents share out of the join. Signatures travel packed: a task sends each bucket one binary row
per million signatures, and the count of buckets grows with the corpus, so a bucket stays small;
of a signature that a task meets often it sends a few entries only.

Candidates are then compared by parity bit sketches of two bits or more per shingle (their
Hamming distance bounds the symmetric difference from below), and what passes is verified on the
sets. First each member of a run (texts with a common signature) is compared with a leader of its
size; then, in runs that still hold several components, with the run's hub, the text that shares
most signatures with others (of a group of near copies, its original); and last with all members
of other components. So groups of copies cost their size, not its square, and the components are
those of all links.

Texts that are equal word for word are one node. A node's id is a 64-bit hash; should two texts
ever share it, a second hash shows that and everything is redone under another seed.

Defined results: A-Z are lower-cased; null, empty and blank texts have an empty set, are linked
with nothing and are their own component; with fewer words than a shingle the whole sequence is
one; repeated rows link like any equal texts; rows with a null id count for the components of
others only if all ids there are null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import blocks, discard, sized, stored, utf8
from recollect.llm.components import components, joined
from recollect.llm.words import Words, mixed, rolled, windows, words_of

SHINGLE, PERCENT = 5, 75
#: A shingle in so many texts of the corpus (as far as tasks notice) comes late in the order of blocks.
FREQUENT, MOST_FREQUENT = 16, 1 << 18
#: Signatures in a bucket, about; signatures a task holds before it sends them.
BUCKET_ROWS, SEND_ROWS = 1 << 20, 1 << 18
#: Bytes of text worked on at once.
TEXT_BYTES = 1 << 20
#: Pairs that a task compares, at least.
PAIRS_A_TASK = 4000
#: Sums of set sizes below 2**FINE use a block for each shingle.
FINE = 8
#: Entries of one signature in a task from which on it sends only the leaders among them.
LONG = 64
#: Bits for each key of the filter by which tasks skip texts that no pair needs, and its most bytes.
FILTER_BITS, FILTER_BYTES = 16, 64 << 20


class Sets:
    """Shingle sets of a block's rows: distinct hashes in text order, rows one after another."""

    def __init__(self, column: pa.Array, seed: int, size: int = SHINGLE):
        data, offsets = utf8(column)
        w = words_of(data, offsets, fold=True)
        self.key, self.check = keys(w, seed)
        n_words = np.diff(w.first)
        at, h = windows(w, size)
        row = w.row[at]
        for n in range(1, size):  # short texts are one shingle
            rows = np.flatnonzero(n_words == n)
            if len(rows):
                row = np.concatenate([row, rows])
                h = np.concatenate([h, mixed(rolled(w.hash, n)[w.first[rows]] + np.uint64(n))])
        order = np.argsort(h ^ mixed(row.astype(np.uint64) + np.uint64(1)))
        fresh = np.ones(len(h), bool)
        fresh[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
        h, row = h[fresh], row[fresh]
        if len(row) and (np.diff(row) < 0).any():
            by_row = np.argsort(row, kind="stable")
            h, row = h[by_row], row[by_row]
        self.hash, self.row = h, row
        self.size = np.bincount(row, minlength=len(n_words)) if len(row) else np.zeros(len(n_words), np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])


def keys(w: Words, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's sequence of words."""
    place = (np.arange(len(w.row)) - w.first[w.row] + 1).astype(np.uint64)
    out = []
    for salt in (2 * seed, 2 * seed + 1):
        total = np.zeros(len(w.row) + 1, np.uint64)
        np.cumsum(w.hash * (mixed(place + np.uint64(salt << 40)) | np.uint64(1)), out=total[1:])
        out.append(mixed(total[w.first[1:]] - total[w.first[:-1]]).view(np.int64))
    return out[0], out[1]


def _unseen(key: np.ndarray, use: np.ndarray, seen: set) -> np.ndarray:
    """The rows in use whose key this task has not met before."""
    out = np.zeros(len(key), bool)
    for i in np.flatnonzero(use):
        k = int(key[i])
        if k not in seen:
            seen.add(k)
            out[i] = True
    return out


def frequent_in(h: np.ndarray) -> tuple[bytes, bytes]:
    """Hashes met more than once, and how often."""
    found, n = np.unique(h, return_counts=True)
    return found[n > 1].tobytes(), n[n > 1].astype(np.int32).tobytes()


def inventory(docs: DataFrame, seed: int) -> DataFrame:
    """For each row id, key, check and set size; besides, rows with shingles that tasks met repeatedly."""
    schema = T.StructType([T.StructField("id", docs.schema["id"].dataType)] + T._parse_datatype_string("key long, check long, n int, hot binary, times binary").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, kind = set(), [], None

        def hot():
            h, n = frequent_in(np.concatenate(held))
            held.clear()
            if h:
                yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([h]), pa.array([n])], names=schema.names)

        for b in blocks(batches, "text", TEXT_BYTES):
            kind, s = b.column(0).type, Sets(b.column(1), seed)
            new = _unseen(s.key, s.size > 0, seen)
            held.append(s.hash[new[s.row]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.key), pa.array(s.check), pa.array(s.size.astype(np.int32)), pa.nulls(len(s.key), pa.binary()), pa.nulls(len(s.key), pa.binary())], names=schema.names)
            if sum(map(len, held)) > 4 << 20:
                yield from hot()
        if held:
            yield from hot()

    return docs.mapInArrow(run, schema)


def frequent_shingles(found: DataFrame) -> np.ndarray:
    """Hashes of the most frequent shingles, at most MOST_FREQUENT of them; they only set an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, n in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_py(), np.int64)), pa.array(np.frombuffer(n.as_py(), np.int32))], names=["h", "n"])

    counts = found.filter("hot is not null").select("hot", "times").mapInArrow(run, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    top = counts.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toPandas()
    return np.sort(top["h"].to_numpy(np.int64).view(np.uint64))


def most_differing(total: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of two linked sets whose sizes add up to total."""
    return total * (100 - percent) // (100 + percent)


def signatures(s: Sets, use: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the first d + 1 non-empty blocks of each row in use, per band: (signature, row)."""
    chosen = use[s.row]
    h, row = s.hash[chosen], s.row[chosen]
    late = np.zeros(len(h), bool)
    if len(frequent) and len(h):
        spot = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
        late = frequent[spot] == h
    n = s.size
    least, most = n + -(-n * percent // 100), n + n * 100 // percent
    low = np.floor(np.log2(np.maximum(least, 1))).astype(np.int64)
    high = np.floor(np.log2(np.maximum(most, 1))).astype(np.int64)
    out = []
    for band in range(int(low[use].min()), int(high[use].max()) + 1) if use.any() else ():
        rows = use & (low <= band) & (band <= high)
        own = rows[row]
        if not own.any():
            continue
        x, r = h[own], row[own].astype(np.uint64)
        block = x & np.uint64((1 << 32) - 1 if band < FINE else (1 << min(band - 1, 32)) - 1)
        place = (r << np.uint64(34)) | (late[own].astype(np.uint64) << np.uint64(33)) | block
        order = np.argsort(place)
        place, x = place[order], x[order]
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        xor = np.bitwise_xor.reduceat(mixed(x), begin)
        place = place[begin]
        r = (place >> np.uint64(34)).astype(np.int64)
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        keep = rank <= most_differing(np.minimum(most, (2 << band) - 1), percent)[r]
        tag = mixed((place[keep] & np.uint64((1 << 34) - 1)) | np.uint64((band + 1) << 40))
        out.append((mixed(xor[keep] ^ tag), r[keep]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def leaders(sig: np.ndarray, key: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Entries in order of signature, size class and key, each once; whether each leads its class; and (leader, key) pairs.

    The leader of a class of a run is its smallest key: the same few texts lead most runs of a group
    of copies, so pairs recur. Leaders of neighbouring classes are paired too.
    """
    band = np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)
    order = np.lexsort((key, band, sig))
    sig, key, n, band = sig[order], key[order], n[order], band[order]
    fresh = np.ones(len(sig), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
    sig, key, n, band = sig[fresh], key[fresh], n[fresh], band[fresh]
    begin = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
    head = begin.copy()
    head[1:] |= band[1:] != band[:-1]
    at = np.arange(len(sig))
    lead = np.maximum.accumulate(np.where(head, at, 0)) if len(sig) else at
    prior = np.where(head & ~begin, lead[np.maximum(at - 1, 0)], at)
    a = np.where(head, prior, lead)
    fits = (a != at) & (100 * np.minimum(n, n[a]) >= percent * np.maximum(n, n[a]))
    pairs = np.unique(np.column_stack([key[a[fits]], key[fits]]), axis=0) if fits.any() else np.zeros((0, 2), np.int64)
    return sig, key, n, begin, head, pairs


def packed_signatures(docs: DataFrame, seed: int, frequent, percent: int, buckets: int) -> DataFrame:
    """(bucket, data, pairs, members): for each task and bucket, packed signatures, keys and set sizes.

    Of a signature that a task has met LONG times or more, the bucket gets the leaders only, marked
    as such; the pairs with them, and the other members, are known here already and go to
    any bucket, which passes them on. So no bucket gets all of a large group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, count = set(), [], 0
        hot = frequent.value

        def send():
            sig, key, n = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            sig = sig >> np.uint64(16)  # so much of it travels
            order = np.argsort(sig, kind="stable")
            sig, key, n = sig[order], key[order], n[order].astype(np.int32)
            edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]]))
            long = np.repeat(np.diff(edge) >= LONG, np.diff(edge))
            yield rows_of(sig[~long], key[~long], n[~long], 1)
            if long.any():
                sig, key, n, _, head, pairs = leaders(sig[long], key[long], n[long], percent)
                yield rows_of(sig[head], key[head], n[head], -1)
                yield from spread(pairs, sig[~head], key[~head], n[~head])

        def rows_of(sig, key, n, sign):
            """Packed entries, in order of signature, a row for each bucket; a negative count marks leaders of long runs."""
            bucket = ((sig >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(sig) else np.zeros(1, np.int64)
            rows = []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                ids, which = np.unique(key[a:z], return_index=True)
                local = np.searchsorted(ids, key[a:z]).astype(np.uint16 if len(ids) < 1 << 16 else np.uint32)
                short = sig[a:z].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append(np.int64(sign * len(ids)).tobytes() + ids.tobytes() + n[a:z][which].astype(np.int32).tobytes() + short.tobytes() + local.tobytes())
            none = pa.nulls(len(rows), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]]), pa.array(rows, pa.binary()), none, none], names=names)

        def spread(pairs, s, k, m):
            """Known pairs and members in parts of a few thousand, each to a bucket of its own choice."""
            step = 1 << 13
            for at in range(0, max(len(pairs), len(s)), step):
                p = pairs[at : at + step].tobytes()
                x = s[at : at + step].astype("<u8").tobytes() + k[at : at + step].tobytes() + m[at : at + step].tobytes()
                place = int(mixed(np.array([zlib.crc32(p + x)], np.uint64))[0] % np.uint64(buckets))
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([None], pa.binary()), pa.array([p], pa.binary()), pa.array([x], pa.binary())], names=names)

        for b in blocks(batches, "text", TEXT_BYTES):
            s = Sets(b.column(0), seed)
            sig, row = signatures(s, _unseen(s.key, s.size > 0, seen), hot, percent)
            if len(sig):
                held.append((sig, s.key[row], s.size[row]))
                count += len(sig)
            if count >= SEND_ROWS:
                yield from send()
                count = 0
        if held:
            yield from send()

    names = ["bucket", "data", "pairs", "members"]
    return docs.select("text").mapInArrow(run, "bucket int, data binary, pairs binary, members binary")


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures (their upper 48 bits), keys and set sizes (negative for leaders of long runs) of one packed row."""
    m = int(np.frombuffer(data, np.int64, 1)[0])
    sign, m = np.int32(1 if m > 0 else -1), abs(m)
    ids, n, at = np.frombuffer(data, np.int64, m, 8), np.frombuffer(data, np.int32, m, 8 + 8 * m), 8 + 12 * m
    kind = np.uint16 if m < 1 << 16 else np.uint32
    count = (len(data) - at) // (6 + np.dtype(kind).itemsize)
    wide = np.zeros((count, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, 6 * count, at).reshape(-1, 6)
    local = np.frombuffer(data, kind, count, at + 6 * count)
    return wide.view("<u8").ravel(), ids[local], sign * n[local]


def matches(packed: DataFrame, percent: int) -> DataFrame:
    """Entries that share a signature: (leader, key) pairs, sig null; and members (sig, key, n) of larger runs."""
    schema = pa.schema([("sig", pa.int64()), ("leader", pa.int64()), ("key", pa.int64()), ("n", pa.int32())])

    def given(pairs: np.ndarray, sig: np.ndarray, key: np.ndarray, n: np.ndarray) -> list[pa.Table]:
        none = pa.nulls(len(pairs), pa.int64()), pa.nulls(len(sig), pa.int64())
        return [
            pa.Table.from_arrays([none[0], pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int32())], schema=schema),
            pa.Table.from_arrays([pa.array(sig.astype(np.int64)), none[1], pa.array(key), pa.array(n.astype(np.int32))], schema=schema),
        ]

    def run(table: pa.Table) -> pa.Table:
        out = []
        for p, x in zip(table.column("pairs").drop_null(), table.column("members").drop_null(), strict=True):
            x = x.as_py()
            m = len(x) // 20
            out += given(np.frombuffer(p.as_py(), np.int64).reshape(-1, 2), np.frombuffer(x, np.uint64, m), np.frombuffer(x, np.int64, m, 8 * m), np.frombuffer(x, np.int32, m, 16 * m))
        sent = [unpacked(x.as_py()) for x in table.column("data").drop_null()]
        if sent:
            sig, key, n = (np.concatenate(c) for c in zip(*sent, strict=True))
            ordered = np.sort(sig)
            twice = np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], sig[n < 0]])
            some = np.isin(sig, twice, kind="sort") if len(twice) else np.zeros(len(sig), bool)
            sig, key, n = sig[some], key[some], n[some]
            long = np.unique(sig[n < 0])
            sig, key, n, begin, _, pairs = leaders(sig, key, np.abs(n), percent)
            length = np.bincount(np.cumsum(begin) - 1)[np.cumsum(begin) - 1] if len(sig) else np.zeros(0, np.int64)
            many = length > 2
            if len(long):
                many |= np.isin(sig, long, kind="sort")
            out += given(pairs, sig[many], key[many], n[many])
        return pa.concat_tables(out) if out else schema.empty_table()

    return packed.groupBy("bucket").applyInArrow(run, "sig long, leader long, key long, n int")


def bloom(ids: DataFrame) -> np.ndarray:
    """A filter with the bit of every key set, as 64-bit words; its size follows the keys, up to FILTER_BYTES.

    Beyond that it lets more keys by than it must, which costs time but loses none.
    """
    count = ids.count()
    bits = min(8 * FILTER_BYTES, 1 << max(12, (FILTER_BITS * count - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spot = mixed(b.column(0).to_numpy().view(np.uint64)) & np.uint64(bits - 1)
            at, local = np.unique(spot >> np.uint64(6), return_inverse=True)
            words = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(words, local, np.uint64(1) << (spot & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(words.view(np.int64))], names=["at", "word"])

    got = ids.mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got.column("at").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return words


def needed_sets(docs: DataFrame, seed: int, ids: DataFrame) -> DataFrame:
    """(key, n, sketch, members) of the texts that pairs need, once per task, and of a few more that the filter lets by."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in blocks(batches, "text", TEXT_BYTES):
            s = Sets(b.column(0), seed)
            rows = np.flatnonzero(_unseen(s.key, _in_bloom(bits.value, s.key) & (s.size > 0), seen))
            members = [np.sort(s.hash[s.first[r] : s.first[r + 1]]) for r in rows]
            yield pa.RecordBatch.from_arrays([
                pa.array(s.key[rows]), pa.array(s.size[rows].astype(np.int32)), pa.array([parity(m).tobytes() for m in members], pa.binary()),
                pa.array([m.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() for m in members], pa.binary()),
            ], names=["key", "n", "sketch", "members"])

    return docs.select("text").mapInArrow(run, "key long, n int, sketch binary, members binary")


def _in_bloom(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    spot = mixed(key.view(np.uint64)) & np.uint64(64 * len(words) - 1)
    return (words[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1) > 0


def only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of the given keys (and of a few others), each once; the others don't reach the shuffle."""
    bits = sets.sparkSession.sparkContext.broadcast(bloom(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_in_bloom(bits.value, b.column(0).to_numpy())))

    return sets.mapInArrow(run, sets.schema).dropDuplicates(["key"])


def parity(members: np.ndarray) -> np.ndarray:
    """Parity bit sketch: each member flips one bit; a power of two of bits, at least two a member."""
    bits = max(64, 1 << int(2 * len(members) - 1).bit_length())
    flips = np.bincount((mixed(members) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def hamming(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two parity sketches; the longer is folded onto the shorter first."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _compared(pairs: DataFrame, sets: DataFrame, what: str, test) -> DataFrame:
    """The pairs (a, b) for which test(n_a, n_b, value_a, value_b) is a number, as `far`; value: a column of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                a, c, na, nb, x, y = b.columns
                far = pa.array([test(m, n, u.as_py(), v.as_py()) for m, n, u, v in zip(na.to_pylist(), nb.to_pylist(), x, y, strict=True)], pa.float64())
                mask = far.is_valid()
                yield pa.RecordBatch.from_arrays([a.filter(mask), c.filter(mask), far.filter(mask)], names=["a", "b", "far"])

    total = pairs.count()
    joined = pairs.select("a", "b")
    for k, other in (("a", "b"), ("b", "a")):
        joined = spread(joined, sets.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col(what).alias(f"v{k}")), pairs, k, other, total)
    return sized(joined.select("a", "b", "na", "nb", "va", "vb"), total, PAIRS_A_TASK).mapInArrow(run, "a long, b long, far double")


def _hashes(packed: bytes) -> np.ndarray:
    """A set's hashes (48 bits of each) in order, each once."""
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, 2:] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    out = wide.view("<u8").ravel()
    return out if (out[1:] != out[:-1]).all() else np.unique(out)


def sure(percent: int):
    """The exact test, on sets of hashes."""

    def test(m: int, n: int, x: bytes, y: bytes) -> float | None:
        both = len(np.intersect1d(_hashes(x), _hashes(y), assume_unique=True))
        return 1.0 if 100 * both >= percent * (m + n - both) else None

    return test


def likely(percent: int):
    """The test by parity sketches: it passes all links and few others."""

    def test(m: int, n: int, x: bytes, y: bytes) -> float | None:
        if 100 * min(m, n) < percent * max(m, n):
            return None
        far = hamming(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
        return far / (m + n) if far <= (m + n) * (100 - percent) // (100 + percent) else None

    return test


#: Members of a run that are compared in one group; longer runs are dealt out in pairs of parts.
PART = 1024


#: Rounds of comparing with hubs before all pairs across components are.
HUB_ROUNDS = 1


#: A key that holds more than one in so many rows is joined by broadcast; there are fewer such keys than this.
LARGE = 1000


def by_size(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with table (one row a key, `size` tells its rows): keys of more than a LARGE-th of `total` rows by broadcast.

    There are fewer than LARGE of those, whatever the input, and no task gets all rows of one.
    """
    large = F.broadcast(table.filter(F.col("size") > total / LARGE))
    rest = rows.join(large.select(key), key, "left_anti").join(table.filter(F.col("size") <= total / LARGE), key)
    return rows.join(large, key).unionByName(rest)


def spread(rows: DataFrame, table: DataFrame, pairs: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """rows joined with table (one row a key): a key that is in more than a LARGE-th of `total` pairs is dealt out by its partners.

    There are fewer than LARGE such keys, and their table rows are repeated fewer than 2 * LARGE times in all.
    """
    most = max(1, total // LARGE)
    heavy = F.broadcast(pairs.groupBy(key).agg(F.ceil(F.count("*") / most).cast("int").alias("deals")).filter("deals > 1"))
    deals = F.coalesce("deals", F.lit(1))
    left = rows.join(heavy, key, "left").withColumn("deal", F.pmod(F.xxhash64(other), deals).cast("int")).drop("deals")
    right = table.join(heavy, key, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    return left.join(right, [key, "deal"]).drop("deal")


def hub_pairs(rows: DataFrame, percent: int, total: int, used: list[DataFrame]) -> DataFrame:
    """Pairs of each member and its run's hub, where sizes allow a link and labels differ.

    rows: sig, key, n, label and the size of the run. The hub has the most company in all its runs.
    used gets the frames to delete once the pairs are no longer needed.
    """
    company = rows.groupBy("key").agg(F.sum("size").alias("company"))
    hubs = rows.join(company, "key").groupBy("sig").agg(F.max(F.struct("company", "key", "n", "label")).alias("hub"), F.first("size").alias("size"))
    used.append(stored(hubs, "hubs"))
    met = by_size(rows.drop("size"), used[-1], "sig", total).filter((F.col("label") != F.col("hub.label")) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n")))
    return met.select(F.least("key", "hub.key").alias("a"), F.greatest("key", "hub.key").alias("b")).distinct()


def across(runs: DataFrame, sketches: DataFrame, percent: int, total: int, used: list[DataFrame]) -> DataFrame:
    """Pairs (a, b) of one run, but different labels, that pass the size and sketch tests.

    runs: sig, key, n, label. Members of a run's largest component are compared with those outside
    of it only, in numpy, and only what passes is given out. Runs of more than PART members are
    dealt out in parts, so no task gets it all: the largest component has the first parts; they meet
    the others, and these one another.
    """
    parts = lambda n: F.ceil(n / PART).cast("int")
    sizes = runs.groupBy("sig", "label").agg(F.count("*").alias("members")).groupBy("sig").agg(F.max(F.struct("members", "label")).alias("main"), F.sum("members").alias("size"))
    sizes = sizes.select("sig", F.col("main.label").alias("main"), parts(F.col("main.members")).alias("inner"), parts(F.col("size") - F.col("main.members")).alias("outer"), "size")
    used.append(stored(sizes, "sizes"))
    counted = by_size(runs, used[-1], "sig", total)
    inside = F.col("label") == F.col("main")
    spot = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
    short = F.col("size") <= PART
    own = counted.withColumn("part", F.when(short, 0).when(inside, spot(F.col("inner"))).otherwise(F.col("inner") + spot(F.col("outer"))))
    others = F.when(short, F.array(F.lit(0))).otherwise(F.sequence(F.when(inside, F.col("inner")).otherwise(0), F.col("inner") + F.col("outer") - 1))
    dealt = own.withColumn("other", F.explode(others)).select("sig", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "key", "n", "label")
    rows = dealt.join(sketches, "key").select("sig", "lo", "hi", "part", "key", "n", "label", "sketch")

    def compared(key, n, label, part, sketch, apart: bool) -> np.ndarray:
        """Pairs of a group that pass; members outside of its most frequent label are taken one by one, against all others."""
        order = np.argsort(n, kind="stable")
        key, n, label, part = key[order], n[order], label[order], part[order]
        _, number, count = np.unique(label, return_inverse=True, return_counts=True)
        inner = number == count.argmax()
        if inner.all():
            return np.zeros((0, 2), np.int64)
        sketch = [np.frombuffer(sketch[i], np.uint64) for i in order]
        width = np.array([len(x) for x in sketch])  # grows with n, so equal widths stand together
        edge = np.flatnonzero(np.concatenate([[True], width[1:] != width[:-1], [True]]))
        tables = [(a, z, np.vstack(sketch[a:z])) for a, z in zip(edge[:-1], edge[1:], strict=True)]
        upto, out = np.searchsorted(n, n * 100 // percent, "right"), []
        since = np.searchsorted(n, -(-n * percent // 100))
        for i in np.flatnonzero(~inner):
            for begin, z, table in tables:
                a, z = max(begin, since[i]), min(z, upto[i])
                if a >= z:
                    continue
                use = number[a:z] != number[i]
                use &= inner[a:z] | (np.arange(a, z) > i)
                if apart:
                    use &= part[a:z] != part[i]
                at = a + np.flatnonzero(use)
                if not len(at):
                    continue
                x, y = sketch[i], table[at - begin]
                while y.shape[1] > len(x):  # fold the longer sketches onto the shorter
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                while len(x) > y.shape[1]:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                near = at[np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most_differing(n[i] + n[at], percent)]
                if len(near):
                    out.append(np.column_stack([np.minimum(key[i], key[near]), np.maximum(key[i], key[near])]))
        return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = [], []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            """Work on the groups that are complete: all but the last one, whose rows may go on."""
            table = pa.Table.from_batches(held)
            sig, lo, hi, part, key, n, label = (table.column(k).to_numpy() for k in range(7))
            edge = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True]]))
            stop = len(edge) - 1 if last else len(edge) - 2
            for a, z in zip(edge[:stop], edge[1 : stop + 1], strict=True):
                found.append(compared(key[a:z], n[a:z].astype(np.int64), label[a:z], part[a:z], table.column(7).slice(a, z - a).to_pylist(), bool(hi[a] != lo[a])))
                if sum(map(len, found)) > 200_000:
                    found[:] = [np.unique(np.concatenate(found), axis=0)]
                    if len(found[0]) > 100_000:
                        yield given()
            held[:] = [] if last else table.slice(edge[stop]).to_batches()
            if last and found:
                found[:] = [np.unique(np.concatenate(found), axis=0)]
                yield given()

        def given() -> pa.RecordBatch:
            pairs = found.pop()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for b in batches:
            if b.num_rows:
                held.append(b)
                yield from done(False)
        if held:
            yield from done(True)

    dealt_out = sized(rows.repartition("sig", "lo", "hi"), total, 8 * PAIRS_A_TASK)
    return dealt_out.sortWithinPartitions("sig", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def linked(docs: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles and component_id (the smallest id it is linked with)."""
    spark = docs.sparkSession
    source = docs.select(docs[ident].alias("id"), docs[text].alias("text"))
    seed = 0
    while True:
        found = stored(inventory(source, seed), "inventory")
        nodes = found.filter("key is not null")
        clash = nodes.groupBy("key").agg((F.min("check") != F.max("check")).alias("bad"))
        if not clash.filter("bad").limit(1).count():
            break
        discard(found)
        seed += 1
    frequent = spark.sparkContext.broadcast(frequent_shingles(found))
    volume = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(volume * 0.5 / BUCKET_ROWS))

    entries = stored(matches(packed_signatures(source, seed, frequent, percent, buckets), percent), "matches")
    first = stored(entries.filter("sig is null").select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b")).distinct(), "first")
    members = entries.filter("sig is not null").select("sig", "key", "n")
    sets = stored(needed_sets(source, seed, first.select("a").union(first.select("b")).union(members.select("key"))), "sets")
    sketches = sets.select("key", "n", "sketch").dropDuplicates(["key"])
    passed = stored(_compared(first, sketches, "sketch", likely(percent)), "passed")
    verified = lambda pairs: stored(_compared(pairs, only(sets, pairs.select("a").union(pairs.select("b"))), "members", sure(percent)).select("a", "b"), "links")
    tag = lambda df, k: df.join(labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}")), k, "left").withColumn(f"l{k}", F.coalesce(f"l{k}", k))
    # a forest is enough to begin with: each node is verified against the nearest of its leaders
    chosen = stored(passed.groupBy("b").agg(F.min(F.struct("far", "a")).alias("best")).select("best.a", "b"), "chosen")
    links = verified(chosen)
    labels = components(links)
    # then the other leaders where components still differ, with hubs of the runs that hold several
    # of them, and last all pairs across components
    more = tag(tag(passed, "a"), "b").filter("la <> lb").select("a", "b")
    tried = chosen
    for last in [False] * HUB_ROUNDS + [True]:
        tagged = stored(tag(members, "key").withColumnRenamed("lkey", "label"), "tagged")
        open_runs = stored(tagged.groupBy("sig").agg((F.min("label") != F.max("label")).alias("open"), F.count("*").alias("size")).filter("open").select("sig", "size"), "runs")
        open_rows = stored(by_size(tagged, open_runs, "sig", tagged.count()), "open")
        total, used = open_rows.count(), [open_rows, tagged, open_runs]
        if last:
            more = across(open_rows.drop("size"), sketches.drop("n"), percent, total, used).join(passed, ["a", "b"], "left_anti")
        else:
            hubs = stored(hub_pairs(open_rows, percent, total, used), "hubs")
            more = more.union(_compared(hubs, sketches, "sketch", likely(percent)).select("a", "b")).distinct()
        more = stored(more.join(tried, ["a", "b"], "left_anti"), "more")
        discard(*used)
        if more.limit(1).count():
            tried = tried.union(more)
            fresh = verified(more)
            labels = joined(labels, stored(tag(tag(fresh, "a"), "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "contracted"))
            discard(fresh)
    discard(entries, first, sets, passed, chosen, tried, links)
    placed = nodes.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    groups = placed.filter("n > 0").groupBy("label").agg(F.min("id").alias("smallest"), F.count("*").alias("size")).filter("size > 1")
    return named(placed, stored(groups, "groups"), found.count(), ident)


def named(placed: DataFrame, groups: DataFrame, rows: int, ident: str) -> DataFrame:
    """The rows of placed (id, key, n, label) with the smallest id of their group; those without a group with their own.

    Groups of more than a LARGE-th of all rows, of which there are fewer than LARGE, are broadcast;
    their rows take part in the join with the other groups under their own keys, where they meet none.
    """
    large = F.col("size") > rows / LARGE
    first = placed.join(F.broadcast(groups.filter(large).select("label", F.col("smallest").alias("large_id"), F.lit(True).alias("large"))), "label", "left")
    place = F.when(F.col("large").isNull(), F.col("label")).otherwise(F.col("key"))
    out = first.withColumn("place", place).join(groups.filter(~large).select(F.col("label").alias("place"), "smallest", F.lit(True).alias("small")), "place", "left")
    component = F.when(F.col("large"), F.col("large_id")).when(F.col("small"), F.col("smallest")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(ident), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, component).otherwise(F.col("id")).alias("component_id"))
