"""Scores of texts under a subword lattice model, beside an add-one unigram score of their words.

The lattice of a word holds every way to write it as pieces of an existing vocabulary. Pieces are
weighted by their probability, and the forward recursion in log space sums over all ways, so a
word's probability is marginal. A text is its words in turn and one end mark; the sum of their
logarithms is `score`.

The weights are the vocabulary's scores (those of a unigram file as they are; the file used here
scores a piece by minus its rank, which stands for a Zipf law of the ranks), adapted to the
training texts by expectation maximisation with the vocabulary's weights as prior. Two more
columns follow: `vocabulary_score` is the marginal under the vocabulary's weights alone, and in
`mixed_score` a word of the training texts is one more arc, from its start to its end: with c
occurrences among N tokens of V kinds it has the probability (c + V * lattice) / (N + V). As pieces
never cross a word's start, all need each distinct word once, with its count. So the plan is:

1. every block of texts lists its distinct words and their training counts, packed in one binary
   row for each bucket of words, and its texts as positions in that list;
2. a bucket merges these lists: words, counts, and who asked for what (one shuffle, of distinct
   words per block, so no word is hot);
3. EM sums expected piece counts, a vector as long as the vocabulary, from all buckets;
4. each bucket answers every block with counts and log probabilities of its words, and blocks add
   them up (one shuffle).

Words are grouped by a 64-bit hash, and compared letter by letter within a group; should two ever
share a hash, the block or bucket is grouped by the words themselves. All counts cover the whole
corpus; nothing but vocabulary-sized vectors and three totals reaches the driver.

Defined results: A-Z are lower-cased; a null or empty text is one end token; a null id is not held
out; repeated rows count and score each; without training texts all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import blocks, stored, utf8
from recollect.llm.words import word_hashes, words_of

HOLDOUT_FOLDS, HOLDOUT = 7, 2
BUCKET_ROWS = 1 << 20
ROUNDS = 2
#: Weight, in pieces, of the first weights beside the expected counts.
PRIOR = 1000.0
#: Words of a length whose lattices are worked on together.
TOGETHER = 1 << 15
_BASE = np.uint64(0x100000001B3)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _press(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def _take(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def weights(score: np.ndarray) -> np.ndarray:
    """Unnormalised probabilities: exp of scores, if they can be logarithms of probabilities, else a Zipf law of their ranks."""
    if (score != np.round(score)).any() and 0.5 < np.exp(score).sum() < 2:  # ranks are whole numbers
        return np.exp(score)
    rank = np.zeros(len(score))
    rank[np.argsort(-score, kind="stable")] = np.arange(len(score))
    return 1 / (rank + 10)


class Vocabulary:
    """Pieces as bytes (a word's start is a space), found by the hash of their prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[bytes, int] = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                pieces.setdefault(sp.id_to_piece(i).replace("▁", " ").encode(), i)
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):  # for bytes that are no piece by themselves
                pieces.setdefault(bytes([int(sp.id_to_piece(i)[3:5], 16)]), i)
        self.size = sp.get_piece_size() + 1  # the last is the end of a text
        score = np.array([sp.get_score(i) for i in range(self.size - 1)])
        used = np.array(sorted(pieces.values()))
        plain = [i for i in used if not sp.is_byte(int(i))]
        score[[i for i in used if sp.is_byte(int(i))]] = score[plain].min() - 1  # bytes have no score of their own: they come last
        weight = np.zeros(self.size)
        weight[used] = weights(score[used])
        weight[-1] = weight.sum() / 1000
        self.first = weight / weight.sum()
        prefixes: dict[int, int] = {}
        for piece, i in pieces.items():
            h = 0
            for k, byte in enumerate(piece):
                h = (h * int(_BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
                if k + 1 == len(piece):
                    prefixes[h] = i
                else:
                    prefixes.setdefault(h, -1)
        self.longest = max(map(len, pieces))
        self.hash = np.array(sorted(prefixes), np.uint64)
        self.piece = np.array([prefixes[int(h)] for h in self.hash], np.int32)

    def edges(self, word: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Of words of one length (a matrix of bytes): from, to, rows and pieces of each set of edges."""
        n, length = word.shape
        for i in range(length):
            live, h = np.arange(n), np.zeros(n, np.uint64)
            for j in range(i, min(length, i + self.longest)):
                h = h * _BASE + (word[live, j].astype(np.uint64) + np.uint64(1))
                at = np.searchsorted(self.hash, h)
                at[at == len(self.hash)] = 0
                ok = self.hash[at] == h
                live, h, at = live[ok], h[ok], at[ok]
                if not len(live):
                    break
                piece = self.piece[at]
                whole = piece >= 0
                if whole.any():
                    yield i, j + 1, live[whole], piece[whole]


def forward(v: Vocabulary, word: np.ndarray, logs: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Log forward probabilities [word, position]; keep gets the edges."""
    alpha = np.full((word.shape[1] + 1, word.shape[0]), -np.inf)
    alpha[0] = 0
    for i, j, rows, piece in v.edges(word):
        alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + logs[piece])
        if keep is not None:
            keep.append((i, j, rows, piece))
    return alpha


def along(edges: list, word: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """forward() over edges that are known already."""
    alpha = np.full((word.shape[1] + 1, word.shape[0]), -np.inf)
    alpha[0] = 0
    for i, j, rows, piece in edges:
        alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + logs[piece])
    return alpha


def expected(v: Vocabulary, word: np.ndarray, count: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in words that occur so often."""
    found: list = []
    alpha = forward(v, word, logs, found)
    beta = np.full_like(alpha, -np.inf)
    beta[-1] = 0
    out = np.zeros(v.size)
    # edges come in order of their start, so backwards each end is complete when it is needed
    for i, j, rows, piece in reversed(found):
        through = logs[piece] + beta[j, rows]
        beta[i, rows] = np.logaddexp(beta[i, rows], through)
        out += np.bincount(piece, np.exp(alpha[i, rows] + through - alpha[-1, rows]) * count[rows], v.size)
    return out


def by_length(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words in groups of one length: their numbers and a matrix of bytes, a space before each."""
    order = np.argsort(length, kind="stable")
    edge = np.flatnonzero(np.diff(np.concatenate([[-1], length[order], [-1]])))
    for a, z in zip(edge[:-1], edge[1:], strict=True):
        n = int(length[order[a]])
        step = max(1, min(TOGETHER, (1 << 22) // (n + 1)))
        for k in range(a, z, step):
            some = order[k : min(z, k + step)]
            word = np.full((len(some), n + 1), 32, np.uint8)
            word[:, 1:] = data[start[some][:, None] + np.arange(n)]
            yield some, word


def _words(data: bytes) -> tuple[np.ndarray, ...]:
    """Bytes, starts, lengths and counts of packed words."""
    raw = _take(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    count, length = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 8 * n).astype(np.int64)
    return np.frombuffer(raw, np.uint8, offset=8 + 12 * n), np.cumsum(length) - length, length, count


def _pack_words(data: np.ndarray, start: np.ndarray, length: np.ndarray, count: np.ndarray) -> bytes:
    at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    return _press(np.array([len(start)], np.int64), count.astype(np.int64), length.astype(np.uint32), data[at])


def alike(data: np.ndarray, start: np.ndarray, length: np.ndarray, other: np.ndarray) -> bool:
    """Whether the words from start on equal those of the same length from other on."""
    step = 1 << 17
    for k in range(0, len(start), step):
        n = length[k : k + step]
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(start[k : k + step], n) + place] != data[np.repeat(other[k : k + step], n) + place]).any():
            return False
    return True


def distinct(data: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct word occurs first, in order of hash, and the number of each word among them."""
    _, spot, local = np.unique(h, return_index=True, return_inverse=True)
    if (length[spot][local] == length).all() and alike(data, start, length, start[spot][local]):
        return spot, local
    texts = [data[a : a + n].tobytes() for a, n in zip(start.tolist(), length.tolist(), strict=True)]
    first: dict[bytes, int] = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    order = sorted(first.values(), key=lambda i: (int(h[i]), texts[i]))
    number = {texts[i]: k for k, i in enumerate(order)}
    return np.array(order, np.int64), np.array([number[t] for t in texts], np.int64)


def listed(docs: DataFrame, buckets: int) -> DataFrame:
    """Columns id, train, text -> for each block a row of its texts (bucket -1) and rows of its words."""
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("data", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for b in blocks(batches, "text", 8 << 20):
            raw, offsets = utf8(b.column(2))
            data = _LOWER[raw]
            w = words_of(data, offsets)
            spot, local = distinct(data, w.start, w.length, w.hash)
            word = w.hash[spot]
            train = b.column(1).to_numpy(zero_copy_only=False)[w.row]
            count = np.bincount(local[train], minlength=len(word))
            texts = _press(np.diff(w.first).astype(np.uint32), local.astype(np.uint32))
            bucket = ((word >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(word) else np.zeros(1, np.int64)
            rows = [(block, -1, b.column(0).to_pylist(), texts)]
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                rows.append((block, int(bucket[a]), None, _pack_words(data, w.start[spot[a:z]], w.length[spot[a:z]], count[a:z])))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(b.schema.types[0])), pa.array(columns[3], pa.binary())], names=schema.names)
            block += 1

    return docs.select("id", "train", "text").mapInArrow(run, schema)


def merged(lists: DataFrame) -> DataFrame:
    """For each bucket its distinct words with their counts, and for each block where its words are."""
    members = pa.list_(pa.struct([("block", pa.int64()), ("at", pa.binary())]))

    def run(table: pa.Table) -> pa.Table:
        parts = [_words(x.as_py()) for x in table.column("data")]
        shift = np.cumsum([0] + [len(p[0]) for p in parts])
        data = np.concatenate([p[0] for p in parts])
        start = np.concatenate([p[1] + s for p, s in zip(parts, shift, strict=False)])
        length, count = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        spot, at = distinct(data, start, length, word_hashes(data, start, length, False))
        total = np.zeros(len(spot), np.int64)
        np.add.at(total, at, count)
        ends = np.cumsum([len(p[1]) for p in parts])
        asked = [{"block": k.as_py(), "at": _press(at[e - len(p[1]) : e].astype(np.uint32))} for k, p, e in zip(table.column("block"), parts, ends.tolist(), strict=True)]
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "words": pa.array([_pack_words(data, start[spot], length[spot], total)]), "known": [int((total > 0).sum())], "seen": [int(total.sum())], "asked": pa.array([asked], members)})

    return lists.filter("bucket >= 0").select("bucket", "block", "data").groupBy("bucket").applyInArrow(run, "bucket int, words binary, known long, seen long, asked array<struct<block:long,at:binary>>")


def adapted(buckets: DataFrame, path: str, weights: np.ndarray, ends: int) -> np.ndarray:
    """One round of expectation maximisation: the new probability of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        logs = np.log(np.maximum(weights, 1e-300))
        out = np.zeros(v.size)
        for b in batches:
            for x in b.column(0):
                data, start, length, count = _words(x.as_py())
                some = np.flatnonzero(count > 0)
                for rows, word in by_length(data, start[some], length[some]):
                    out += expected(v, word, count[some[rows]].astype(np.float64), logs)
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(out[at])], names=["piece", "n"])

    v = vocabulary(path)
    got = buckets.select("words").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # one row a piece
    total = np.zeros(v.size)
    total[got["piece"].to_numpy(np.int64)] = got["n"].to_numpy()
    total[-1] = ends
    total += PRIOR * v.first
    return total / total.sum()


def answers(buckets: DataFrame, path: str, weights: np.ndarray) -> DataFrame:
    """(block, bucket, data): counts and two natural log probabilities of the words that a block asked for.

    The first is under these weights, the second under the vocabulary's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        logs, own = (np.log(np.maximum(x, 1e-300)) for x in (weights, v.first))
        for b in batches:
            for bucket, packed, asked in zip(*b.columns, strict=True):
                data, start, length, count = _words(packed.as_py())
                p, q = np.zeros(len(start)), np.zeros(len(start))
                for rows, word in by_length(data, start, length):
                    edges: list = []
                    p[rows] = forward(v, word, logs, edges)[-1]
                    q[rows] = along(edges, word, own)[-1]
                blocks_, out = [], []
                for who in asked.as_py():
                    at = np.frombuffer(_take(who["at"]), np.uint32)
                    blocks_.append(who["block"])
                    out.append(_press(count[at], p[at], q[at]))
                yield pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int64()), pa.array([bucket.as_py()] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["block", "bucket", "data"])

    return buckets.select("bucket", "words", "asked").mapInArrow(run, "block long, bucket int, data binary")


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, values.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some])
    return out


def in_training(ident: Column) -> Column:
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % HOLDOUT_FOLDS != HOLDOUT, F.lit(True))


def likelihoods(docs: DataFrame, ident: str = "doc_id", text: str = "text", path: str | None = None, rounds: int = ROUNDS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score and mixed_score (log10) of every row."""
    path = path or default_vocabulary()
    source = docs.select(docs[ident].alias("id"), in_training(docs[ident]).alias("train"), docs[text].alias("text"))
    size, ends = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    lists = stored(listed(source, max(1, int(size / 32 / BUCKET_ROWS))), "lists")
    buckets = stored(merged(lists), "words")
    known, seen = buckets.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    total, distinct_tokens = seen + ends, known + (ends > 0)
    own = now = vocabulary(path).first
    for _ in range(rounds):
        now = adapted(buckets, path, now, ends)
    floor, stop, own_stop = float(np.log10(total + distinct_tokens + 1)), float(np.log(now[-1])), float(np.log(own[-1]))
    kinds = max(1, distinct_tokens)
    kind = docs.schema[ident].dataType
    schema = T.StructType([T.StructField("id", kind), *T._parse_datatype_string("n_tokens long, n_known long, base_score double, score double, vocabulary_score double, mixed_score double").fields])

    def add(texts: pa.Table, replies: pa.Table) -> pa.Table:
        raw = _take(texts.column("data")[0].as_py())
        ids = texts.column("ids").combine_chunks().flatten()
        n = np.frombuffer(raw, np.uint32, len(ids)).astype(np.int64)
        local, first = np.frombuffer(raw, np.uint32, offset=4 * len(ids)), np.concatenate([[0], np.cumsum(n)])
        parts = [_take(x) for _, x in sorted(zip(replies.column("bucket").to_pylist(), replies.column("data").to_pylist(), strict=True))]
        m = [len(x) // 24 for x in parts]
        count, p, q = (np.concatenate([np.frombuffer(x, t, k, j * 8 * k) for x, k in zip(parts, m, strict=True)] or [np.zeros(0, t)]) for j, t in enumerate((np.int64, np.float64, np.float64)))
        base = _sums(np.log10(count + 1)[local], first) + np.log10(ends + 1) - (n + 1) * floor
        score, plain = (_sums(x[local], first) / np.log(10) + y / np.log(10) for x, y in ((p, stop), (q, own_stop)))
        arc = lambda c, x: np.log10(c + kinds * np.exp(x)) - np.log10(total + kinds)
        mixed = _sums(np.where(count > 0, arc(count, p), p / np.log(10) + np.log10(kinds / (total + kinds)))[local], first) + arc(ends, stop)
        return pa.table({"id": ids, "n_tokens": n + 1, "n_known": _sums((count > 0).astype(np.int64)[local], first) + (ends > 0), "base_score": base, "score": score, "vocabulary_score": plain, "mixed_score": mixed})

    texts = lists.filter("bucket = -1").select("block", "ids", "data")
    out = texts.groupBy("block").cogroup(answers(buckets, path, now).groupBy("block")).applyInArrow(add, schema)
    return out.select(F.col("id").alias(ident), (~in_training(F.col("id"))).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "vocabulary_score", "mixed_score")
