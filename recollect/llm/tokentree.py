"""Token counts that follow edits.

A document's pre-tokens stand in the leaves of a segment tree whose nodes sum characters and
tokens. An edit descends to the leaves it touches, re-encodes the text from the last pre-token
that it can't affect on until a new boundary coincides with an old one, and updates the sums on
the way up. Leaves that grow beyond twice their size are split, and emptied ones are dropped.
The pre-tokenizer's pattern decides a match by its own text and two characters behind it; an added
token of the vocabulary is a pre-token of its own and ends what is before it. So the context
re-encoded before an edit is CONTEXT characters and the longest added token.

Trees are kept: token_trees() gives a table of texts and packed trees (for each pre-token its
characters and tokens, a byte each as a rule), edited() takes such a table with edits and gives
the next one. Loading a tree runs neither pattern nor encoder; leaves become strings when an edit
touches them. A document's edits are applied in order, each to the text as it then is; a task
holds one document's tree at a time. Nothing is shuffled unless edits come as a table
(with_edits), which is grouped by id first.

Defined results: null texts count as empty; positions are code points, cut to the text; a null
replacement is empty; null edits change nothing; repeated rows are counted each. Tokens are those
of the tokenizers library with add_special_tokens=False.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.bytebpe import default_tokenizer, encoder
from recollect.llm.common import blocks, stored

#: Characters behind a pre-token that its match may depend on; pre-tokens in a leaf; remembered counts.
CONTEXT, LEAF, CACHE = 3, 32, 400_000
#: Characters that are pre-tokenised at first when looking for a common boundary.
WINDOW = 64


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


class Counter:
    """Pre-tokens of texts and the number of tokens in each."""

    def __init__(self, path: str):
        import public_tokenizers

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.core = encoder(path).core
        if self.core is None:
            raise ValueError(f"{path}: counts by pre-token need a plain byte-level vocabulary")
        self.added = sorted(self.core.special_tokens_set, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.context = CONTEXT + max(map(len, self.added), default=0)
        self.known: dict[str, int] = dict.fromkeys(self.added, 1)

    def split(self, text: str) -> list[str]:
        if not any(x in text for x in self.added):
            return self.pattern.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):  # every second one is an added token
            out += [part] if k % 2 else self.pattern.findall(part)
        return out

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        for p in set(pieces).difference(known):
            known[p] = len(self.core.encode_ordinary(p))
        out = list(map(known.__getitem__, pieces))
        if len(known) > CACHE:
            self.known = dict.fromkeys(self.added, 1)
        return out


def packed(sizes: np.ndarray, counts: np.ndarray) -> bytes:
    """Characters and tokens of each pre-token: a byte each, and four more where that is 255 or more."""
    out = [np.array([len(sizes)], "<u4").tobytes()]
    for x in (sizes, counts):
        out += [np.minimum(x, 255).astype(np.uint8).tobytes(), x[x >= 255].astype("<u4").tobytes()]
    return b"".join(out)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, at, out = int(np.frombuffer(data, "<u4", 1)[0]), 4, []
    for _ in range(2):
        x = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        large = np.flatnonzero(x == 255)
        x[large] = np.frombuffer(data, "<u4", len(large), at + n)
        at += n + 4 * len(large)
        out.append(x)
    return out[0], out[1]


class TokenTree:
    """Pre-tokens of one text under a segment tree of characters and tokens.

    A leaf is (text, sizes, counts) of its pre-tokens, or (pieces, None, counts) once an edit has
    touched it.
    """

    def __init__(self, text: str, c: Counter, data: bytes | None = None):
        self.c, self.encoded = c, 0  # encoded: characters that edits have re-encoded
        if data is None:
            pieces = c.split(text)
            sizes, counts = np.array(list(map(len, pieces)), np.int64), np.array(c.counts(pieces), np.int64)
        else:
            sizes, counts = unpacked(data)
        at = np.arange(0, len(sizes), LEAF)
        chars, tokens = (np.add.reduceat(x, at) if len(at) else np.zeros(1, np.int64) for x in (sizes, counts))
        end = np.cumsum(chars).tolist()
        self.leaf: list[tuple] = [(text[z - n : z], sizes[k : k + LEAF], counts[k : k + LEAF]) for k, z, n in zip(at.tolist(), end, chars.tolist(), strict=False)] or [([], None, [])]
        self._sum(chars, tokens)

    def _sum(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        """Build the nodes above the leaves, level by level."""
        self.leaves = 1 << (len(self.leaf) - 1).bit_length()
        out = []
        for x in (chars, tokens):
            levels = [np.concatenate([x, np.zeros(self.leaves - len(x), np.int64)])]
            while len(levels[-1]) > 1:
                levels.append(levels[-1][::2] + levels[-1][1::2])
            out.append([0, *np.concatenate(levels[::-1]).tolist()])
        self.chars, self.tokens = out

    @property
    def total(self) -> int:
        return self.tokens[1]

    def pieces(self, k: int) -> tuple[list[str], list[int]]:
        """Pre-tokens of a leaf and their tokens."""
        text, sizes, counts = self.leaf[k]
        if sizes is None:
            return text, counts
        out, at = [], 0
        for n in sizes.tolist():
            out.append(text[at : at + n])
            at += n
        self.leaf[k] = out, None, counts.tolist()
        return out, self.leaf[k][2]

    def text(self) -> str:
        return "".join(x if sizes is not None else "".join(x) for x, sizes, _ in self.leaf)

    def packed(self) -> bytes:
        sizes = [np.array(list(map(len, x)), np.int64) if sizes is None else sizes for x, sizes, _ in self.leaf]
        return packed(np.concatenate(sizes), np.concatenate([np.asarray(counts, np.int64) for *_, counts in self.leaf]))

    def _at(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character `at`, and where that leaf begins."""
        k, begin = 1, 0
        while k < self.leaves:
            k *= 2
            if at >= begin + self.chars[k] and self.chars[k + 1]:
                begin += self.chars[k]
                k += 1
        return k - self.leaves, begin

    def _set(self, first: int, last: int, pieces: list[str], counts: list[int]) -> None:
        """Put these pre-tokens in the place of the leaves first to last."""
        if first == last and 0 < len(pieces) <= 2 * LEAF:
            self.leaf[first] = pieces, None, counts
            k, chars, tokens = self.leaves + first, sum(map(len, pieces)), sum(counts)
            more, extra = chars - self.chars[k], tokens - self.tokens[k]
            while k:
                self.chars[k] += more
                self.tokens[k] += extra
                k >>= 1
            return
        new = [(pieces[k : k + LEAF], None, counts[k : k + LEAF]) for k in range(0, len(pieces), LEAF)]
        sums = [np.array(x[self.leaves : self.leaves + len(self.leaf)], np.int64) for x in (self.chars, self.tokens)]
        own = [np.array([sum(map(len, x)) for x, *_ in new], np.int64), np.array([sum(n) for *_, n in new], np.int64)]
        self.leaf[first : last + 1] = new
        sums = [np.concatenate([x[:first], y, x[last + 1 :]]) for x, y in zip(sums, own, strict=True)]
        if not self.leaf:
            self.leaf, sums = [([], None, [])], [np.zeros(1, np.int64)] * 2
        self._sum(*sums)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the characters [start, end) by new."""
        size, context = self.chars[1], self.c.context
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        # the last pre-token that ends `context` characters before the edit, and all before it, stay
        leaf, begin = self._at(max(0, start - context))
        kept, at = 0, begin
        for p in self.pieces(leaf)[0]:
            if at + len(p) > start - context:
                break
            at += len(p)
            kept += 1
        # gather old pre-tokens from there on; `last` is the leaf that holds the next one
        old, bounds, last, spot, pos = [], [], leaf, kept, at
        window = WINDOW

        def more(upto: int) -> None:
            nonlocal last, spot, pos
            while pos < upto:
                held = self.pieces(last)[0]
                if spot == len(held):
                    if last + 1 == len(self.leaf):
                        return
                    last, spot = last + 1, 0
                    continue
                p = held[spot]
                spot += 1
                pos += len(p)
                old.append(p)
                bounds.append((pos, last, spot))

        while True:
            more(end + window)
            whole = pos >= size
            tail = "".join(old)
            text = tail[: start - at] + new + tail[end - at :]
            fresh = self.c.split(text)
            shift = len(new) - (end - start)
            where = {b + shift: (last_, spot_) for b, last_, spot_ in bounds if b >= end}
            done, reach, stop = [], at, None
            for p in fresh:
                done.append(p)
                reach += len(p)
                if reach in where and (whole or reach <= at + len(text) - context):
                    stop = where[reach]
                    break
            if stop is None and whole:
                stop = (len(self.leaf) - 1, len(self.pieces(len(self.leaf) - 1)[0]))
            if stop is not None:
                break
            window *= 4
        self.encoded += sum(map(len, done))
        to, cut = stop
        behind, before = ([x[cut:] for x in self.pieces(to)], [x[:kept] for x in self.pieces(leaf)])
        self._set(leaf, to, before[0] + done + behind[0], before[1] + self.c.counts(done) + behind[1])


def with_edits(docs: DataFrame, edits: DataFrame, ident: str = "doc_id", order: str = "seq") -> DataFrame:
    """docs with an array column `edits` from a table of (id, seq, start, end, replacement)."""
    listed = edits.groupBy(ident).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, "start", "end", "replacement"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("replacement"))).alias("edits"))
    return docs.join(listed, ident, "left")


def token_trees(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """id, text, tree, n_tokens (and the column `keep`) of every row: each text is encoded once."""
    path = tokenizer or default_tokenizer()
    schema = T.StructType([T.StructField(ident, docs.schema[ident].dataType), *T._parse_datatype_string("text string, tree binary, n_tokens long").fields, *([T.StructField(keep, docs.schema[keep].dataType)] if keep else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in blocks(batches, "t"):
            trees, total = [], []
            for t in b.column(1).to_pylist():
                pieces = c.split(t or "")
                counts = np.array(c.counts(pieces), np.int64)
                trees.append(packed(np.array(list(map(len, pieces)), np.int64), counts))
                total.append(int(counts.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(trees, pa.binary()), pa.array(total, pa.int64()), *b.columns[2:]], names=schema.names)

    return docs.select(docs[ident].alias("k"), docs[text].alias("t"), *([docs[keep].alias("e")] if keep else [])).mapInArrow(run, schema)


def edited(trees: DataFrame, ident: str = "doc_id", edits: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """id, text, tree, n_tokens after the edits, and n_tokens_before, reencoded_chars, n_chars.

    trees: id, text, tree, n_tokens, and an array of structs (start, end, replacement). Text and
    tree are worked out only where the plan asks for them.
    """
    path = tokenizer or default_tokenizer()
    schema = T.StructType([T.StructField(ident, trees.schema[ident].dataType), *T._parse_datatype_string("text string, tree binary, n_tokens long, n_tokens_before long, reencoded_chars long, n_chars long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in blocks(batches, "text"):
            rows = []
            for t, data, before, changes in zip(*(b.column(k).to_pylist() for k in range(1, 5)), strict=True):
                tree = TokenTree(t or "", c, data)
                some = [e for e in changes or () if e is not None and e["start"] is not None and e["end"] is not None]
                for e in some:
                    tree.edit(e["start"], e["end"], e["replacement"] or "")
                rows.append((tree.text(), tree.packed(), tree.total, before, tree.encoded, tree.chars[1]) if some else (t or "", data, before, before, 0, tree.chars[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, f) for x, f in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), *[pa.int64()] * 4), strict=True))], names=schema.names)

    return trees.select(trees[ident].alias("k"), "text", "tree", "n_tokens", trees[edits].alias("e")).mapInArrow(run, schema)


def edited_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", edits: str = "edits", tokenizer: str | None = None, with_text: bool = False) -> DataFrame:
    """id, n_tokens, n_tokens_after, reencoded_chars, n_chars_after (and the edited text) of every row.

    The trees of docs are written to the shared folder and edited from there; callers that edit
    the same documents again keep such a table themselves.
    """
    trees = stored(token_trees(docs, ident, text, edits, tokenizer), "trees", compression="zstd")
    after = edited(trees, ident, edits, tokenizer)
    return after.select(ident, F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_after"), "reencoded_chars", F.col("n_chars").alias("n_chars_after"), *([F.col("text").alias("text_after")] if with_text else []))
