"""SentencePiece encoding and decoding by a streaming Viterbi search.

The files at hand are of kind BPE: ids follow from merges in order of rank, not from a best sum
of scores. The search therefore scores a path by admissibility: two neighbouring pieces may follow
each other only if merging their joined text gives just these two. For every prefix of a text
exactly one piece ends it on an admissible path, so each position keeps one backpointer, and the
path to the end is the library's own encoding (tests compare them).

The search keeps a window only. Later pieces begin at most `longest` positions back; once the
paths of all these positions meet in one boundary, the ids before it are final and are committed.
That happens at every space after a visible character at the latest, since no piece crosses one.
So words can be encoded one by one, and frequent ones are remembered.

Defined results: null texts give null ids, empty texts no ids; a space is put before a text, as
the library does; characters outside the vocabulary become byte pieces; decoding replaces broken
byte sequences, and null ids give null.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.llm.common import blocks

SPACE = "▁"
_UNEVEN = re.compile("^ |  | $")
#: Words and parts of words remembered (twice as many, old ones included), and positions between looks for a common boundary.
CACHE_WORDS, CACHE_PARTS, STRIDE = 300_000, 200_000, 64


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(n) if not special[i] and not sp.is_byte(i)}
        self.id = {p: sp.piece_to_id(p) for p in self.rank}
        # pieces that their own merges don't reproduce never occur
        for p in [p for p in self.rank if len(p) > 1 and self.merge(p) != [p]]:
            del self.id[p]
        self.longest = max(map(len, self.id))
        #: Ends of pieces: the id of a whole piece, -1 for what is only a part.
        self.ends: dict[str, int] = {}
        #: Neighbouring characters inside pieces; between others there is always a boundary.
        self.inside: set[str] = set()
        for p, i in self.id.items():
            self.inside.update(p[k : k + 2] for k in range(len(p) - 1))
            for k in range(1, len(p)):
                self.ends.setdefault(p[k:], -1)
            self.ends[p] = i
        self.piece = {i: p for p, i in self.id.items()}
        crossing = [p for p in self.rank if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces go on beyond a space: {crossing[:3]}")
        self.out = [b"" if special[i] else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.pairs: dict[int, bool] = {}
        # what was met lately, and before that: a full cache gets old, and what recurs moves up again
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merges in order of rank, leftmost first."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank), default=None)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def admissible(self, a: int, b: int) -> bool:
        """Whether the second piece may follow the first; remembered."""
        if len(self.pairs) > 1 << 20:
            self.pairs.clear()
        x, y = self.piece[a], self.piece[b]
        got = self.pairs[a << 20 | b] = self.merge(x + y) == [x, y]
        return got

    def _step(self, text: str, i: int, begin: int, last) -> int:
        """The piece that ends at i on an admissible path: its id, or -1 for a character without one.

        A character outside the vocabulary takes part in no merge, so anything may stand beside it.
        """
        ends, pairs = self.ends, self.pairs
        for k in range(i - 1, begin - 1, -1):
            piece = ends.get(text[k:i])
            if piece is None:
                break
            if piece >= 0:
                before = last[k]
                if before < 0:
                    return piece
                fits = pairs.get(before << 20 | piece)
                if fits or fits is None and self.admissible(before, piece):
                    return piece
        return -1

    def stream(self, text: str) -> Iterator[int | str]:
        """Pieces of a text whose spaces are marked, committed as soon as they are final."""
        last: dict[int, int] = {0: -1}  # the piece that ends at each position of the window
        begin = 0
        for i in range(1, len(text) + 1):
            last[i] = self._step(text, i, begin, last)
            if not i % STRIDE:
                ends = {p for p in range(max(begin, i - self.longest + 1), i + 1)}
                while len(ends) > 1:  # follow the paths back until they meet
                    p = max(ends)
                    ends.remove(p)
                    ends.add(p - self._length(last[p]))
                meet = ends.pop()
                if meet > begin:
                    yield from self._path(text, last, begin, meet)
                    for p in range(begin, meet):
                        last.pop(p, None)
                    begin = meet
        yield from self._path(text, last, begin, len(text))

    def _length(self, piece: int) -> int:
        return len(self.piece[piece]) if piece >= 0 else 1

    def _whole(self, text: str) -> list[int | str]:
        """stream() of a text that fits into one stride: the window is all of it; _step() in place."""
        ends, pairs, last = self.ends, self.pairs, [-1]
        for i in range(1, len(text) + 1):
            found = -1
            for k in range(i - 1, -1, -1):
                piece = ends.get(text[k:i])
                if piece is None:
                    break
                if piece >= 0:
                    before = last[k]
                    if before < 0:
                        found = piece
                        break
                    fits = pairs.get(before << 20 | piece)
                    if fits or fits is None and self.admissible(before, piece):
                        found = piece
                        break
            last.append(found)
        return self._path(text, last, 0, len(text))

    def _path(self, text: str, last, begin: int, end: int) -> list[int | str]:
        """Ids of the path back from end to begin; a character without one stands for itself."""
        out: list[int | str] = []
        while end > begin:
            piece = last[end]
            out.append(piece if piece >= 0 else text[end - 1])
            end -= self._length(piece)
        return out[::-1]

    def _part(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.stream(text) if len(text) > STRIDE else self._whole(text):
            if isinstance(piece, str):
                ids += [self.bytes[b] for b in piece.encode()]
            else:
                ids.append(piece)
        return struct.pack(f"<{len(ids)}i", *ids)

    def word(self, text: str) -> bytes:
        """Ids of one word with the spaces before it: of its parts between certain boundaries."""
        text, inside, known, out, at = text.replace(" ", SPACE), self.inside, self.parts, [], 0
        cuts = [k for k, pair in enumerate(map(add, text, text[1:]), 1) if pair not in inside]
        for k in (*cuts, len(text)):
            part = text[at:k]
            got = known.get(part)
            if got is None:
                got = self.old_parts.get(part) or self._part(part)
                if len(part) <= STRIDE:
                    known[part] = got
            out.append(got)
            at = k
        if len(known) > CACHE_PARTS:
            self.parts, self.old_parts = {}, known
        return out[0] if len(out) == 1 else b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, little-endian 32-bit."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        # a word's key lacks the one space that every word has before it
        split = [w[1:] for w in re.findall(" *[^ ]+| +", f" {text}")] if _UNEVEN.search(text) else text.split(" ")
        known, old = self.words, self.old_words
        for w in set(split).difference(known):
            known[w] = old.get(w) or self.word(f" {w}")
        out = b"".join(map(known.__getitem__, split))
        if len(text) > 1 << 20:  # not worth keeping
            self.words = {}
        elif len(known) > CACHE_WORDS:
            self.words, self.old_words = {}, known
        return out

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encoded(docs: DataFrame, text: str = "text", to: str = "ids", model: str | None = None) -> DataFrame:
    """docs with a binary column of ids (little-endian 32-bit); a column of that name is replaced."""
    path = model or default_model()
    return _mapped(docs, text, to, T.BinaryType(), pa.binary(), lambda x: None if x is None else codec(path).encode(x))


def decoded(docs: DataFrame, ids: str = "ids", to: str = "decoded", model: str | None = None) -> DataFrame:
    """docs with a column of the texts that the ids stand for."""
    path = model or default_model()
    return _mapped(docs, ids, to, T.StringType(), pa.string(), lambda x: None if x is None else codec(path).decode(x))


def _mapped(docs: DataFrame, column: str, to: str, kind: T.DataType, arrow: pa.DataType, change) -> DataFrame:
    kept = [f for f in docs.schema.fields if f.name != to]
    schema = T.StructType([*kept, T.StructField(to, kind)])
    source = docs.select(*[docs[f.name].alias(f"k{i}") for i, f in enumerate(kept)], docs[column].alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            text = whole.column(len(kept))
            for b in blocks(iter([whole]), "x") if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([change(x) for x in b.column(len(kept)).to_pylist()], arrow)], names=schema.names)

    return source.mapInArrow(run, schema)


def round_trips(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_ids, ids_crc32, decoded_crc32 and whether decoding gave the text back."""
    both = decoded(encoded(docs.select(docs[ident].alias("k"), docs[text].alias("t")), "t"))
    return both.select(
        F.col("k").alias(ident), (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), F.col("decoded").eqNullSafe(F.translate("t", SPACE, " ")).alias("round_trip"),
    )
