"""Fingerprints: SimHash and MinHash as columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASHES = 128
TERM = re.compile("[a-z0-9_]+")
#: Texts fingerprinted together; hashes of terms that a task remembers.
PRINT_ROWS, KNOWN_TERMS = 100, 100_000


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash(docs: DataFrame, ident: str = "id", text: str = "content") -> DataFrame:
    """(id, simhash): 64 bits, each the sign of a sum over the text's term counts; no terms give 0.

    Terms are hashed by the first 64 bits of MD5, so any engine can repeat it. A narrow map over
    Arrow blocks: nothing is shuffled, and a task hashes each term once as a rule.
    """
    return _mapped(docs, ident, text, _term_hash)


def _mapped(docs: DataFrame, ident: str, text: str, hashed: Callable[[str], int]) -> DataFrame:
    fields = [T.StructField(ident, docs.schema[ident].dataType), T.StructField("simhash", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, PRINT_ROWS):
                b = batch.slice(at, PRINT_ROWS)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_simhashes(b.column(1).to_pylist(), known, hashed))], names=[ident, "simhash"])
                if len(known) > KNOWN_TERMS:
                    known.clear()

    return docs.select(docs[ident], docs[text]).mapInArrow(run, T.StructType(fields))


def _term_hash(term: str) -> int:
    d = md5(term.encode(), usedforsecurity=False).digest()
    return int.from_bytes(d[:4], "big") | int.from_bytes(d[4:8], "big") << 32  # bits 0 to 31 from the first four bytes


def _simhashes(texts: list[str | None], known: dict[str, int], hashed: Callable[[str], int] = _term_hash) -> np.ndarray:
    found = [Counter(TERM.findall((t or "").lower())) for t in texts]
    terms = list(set().union(*found))
    for t in terms:
        if t not in known:
            known[t] = hashed(t)
    place = {t: k for k, t in enumerate(terms)}
    hashes = np.array([known[t] for t in terms], np.uint64)
    signs = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * np.int8(2) - np.int8(1)
    out = np.zeros(len(texts), np.uint64)
    for k, counts in enumerate(found):
        if counts:
            tf = np.fromiter(counts.values(), np.int64, len(counts))
            total = tf @ signs[np.fromiter((place[t] for t in counts), np.int64, len(counts))].astype(np.int64)
            out[k] = np.packbits((total > 0).astype(np.uint8), bitorder="little").view("<u8")[0]
    return out.view(np.int64)


def _literal_term_hash(term: str) -> int:
    """32-bit FNV-1a as double-precision arithmetic gives it, then spread by 65599."""
    h = 2166136261
    for c in term:
        h = ((h ^ ord(c)) + (1 << 31)) % (1 << 32) - (1 << 31)
        h = (int(float(h) * 16777619.0) + (1 << 31)) % (1 << 32) - (1 << 31)
    return (((h >> 16) & 0xFFFF) * 65599 + (h & 0xFFFF)) & 0xFFFFFFFF


def literal_simhash(docs: DataFrame, ident: str = "id", text: str = "content") -> DataFrame:
    """(id, simhash): the 32 bits that the surveyed arithmetic keeps, unsigned; blank texts give 0. A narrow map, as simhash()."""
    return _mapped(docs, ident, text, _literal_term_hash)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    return rng.integers(1, 1 << 31, HASHES).astype(np.uint64), rng.integers(0, 1 << 31, HASHES).astype(np.uint64)


def _signature(t: str | None, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    t = (t or "").lower()
    if not t.strip():
        return np.zeros(HASHES, np.int64)
    c = np.frombuffer(f"  {t}  ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    grams = np.unique((c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:])
    h = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    a, b = a.astype(np.uint32)[:, None], b.astype(np.uint32)[:, None]
    best = np.full(HASHES, (1 << 32) - 1, np.uint32)
    for k in range(0, len(h), 1024):  # modulo 2**32 is what the type does
        best = np.minimum(best, (a * h[k : k + 1024] + b).min(axis=1))
    return best.astype(np.int64)


def minhash(text: Column) -> Column:
    """128 minima over the text's 3-grams (two blanks at both ends); blank texts give zeros.

    Distinct 3-grams are hashed once, then 128 linear permutations modulo 2**32 are taken in numpy.
    """
    a, b = _permutations()

    @F.pandas_udf("array<long>")
    def signature(texts: pd.Series) -> pd.Series:
        return pd.Series([_signature(t, a, b) for t in texts])

    return signature(text)


def prints(docs: DataFrame, ident: str = "id", text: str = "content") -> DataFrame:
    """(id, simhash, minhash): both fingerprints from one reading of the texts."""
    fields = [T.StructField(ident, docs.schema[ident].dataType), T.StructField("simhash", T.LongType()), T.StructField("minhash", T.ArrayType(T.LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        a, b = _permutations()
        for batch in batches:
            for at in range(0, batch.num_rows, PRINT_ROWS):
                some = batch.slice(at, PRINT_ROWS)
                texts = some.column(1).to_pylist()
                signatures = np.concatenate([_signature(t, a, b) for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * HASHES, pa.int32()), pa.array(signatures))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(_simhashes(texts, known)), lists], names=[ident, "simhash", "minhash"])
                if len(known) > KNOWN_TERMS:
                    known.clear()

    return docs.select(docs[ident], docs[text]).mapInArrow(run, T.StructType(fields))


def signature_similarity(x: Column, y: Column) -> Column:
    """Share of equal positions; 1 for two empty ones, 0 for different lengths."""
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, e: s + e)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), 1.0).when(F.size(x) != F.size(y), 0.0).otherwise(same / F.size(x))


def minhash_sql(name: str = "sig") -> str:
    """Common table expressions that end in `name` (id, minhash): the same signatures in SQL, from documents."""
    a, b = _permutations()
    mins = ", ".join(f"min((({int(x)}::UBIGINT * h) + {int(y)}) & 4294967295)" for x, y in zip(a, b, strict=True))
    return f"""code AS (SELECT doc_id AS id, list_transform(string_split('  ' || lower(text) || '  ', ''), lambda c: CAST(unicode(c) AS UBIGINT)) AS c FROM documents WHERE regexp_matches(text, '\\S')),
 gram AS (SELECT DISTINCT id, xor(xor(x << 42, y << 21), z) AS g FROM (SELECT id, unnest(c[1:len(c) - 2]) AS x, unnest(c[2:len(c) - 1]) AS y, unnest(c[3:len(c)]) AS z FROM code)),
 hash AS (SELECT id, CAST(((CAST(g AS HUGEINT) * {0x9E3779B97F4A7C15}::HUGEINT) % 18446744073709551616::HUGEINT) // 4294967296 AS UBIGINT) AS h FROM gram),
 least128 AS (SELECT id, [{mins}] AS minhash FROM hash GROUP BY id),
 {name} AS (SELECT d.doc_id AS id, coalesce(minhash, list_transform(range(0, {HASHES}), lambda x: CAST(0 AS UBIGINT))) AS minhash FROM documents d LEFT JOIN least128 m ON m.id = d.doc_id)"""


def leading_gram(text: Column) -> Column:
    """What the literal MinHash of the model comes to: the smallest 3-gram of the padded text."""

    @F.pandas_udf("string")
    def smallest(texts: pd.Series, lengths: pd.Series) -> pd.Series:
        def one(t: str | None, n: int) -> str | None:
            if t is None:
                return None
            c = np.frombuffer(f"  {t}  ".encode("utf-32-le"), np.uint32).astype(np.uint64)
            least = int(((c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:])[: int(n) + 2].min())
            return "".join(chr(least >> k & 0x1FFFFF) for k in (42, 21, 0))

        return pd.Series([one(t, n) for t, n in zip(texts, lengths, strict=True)], dtype=object)

    return F.when(F.trim(text) == "", "").otherwise(smallest(F.lower(text), F.length(text)))
