"""Secrets with their places, and texts without them.

The patterns are those of text.SECRETS. A block of texts is searched by all of them at once in Arrow
to find the few that hold anything; these are scanned pattern by pattern, and of matches that overlap
the one that begins first stays (of those the longest, then the pattern named first in the table). What is
replaced in every text is replaced in Arrow too, whose patterns take time in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.text import SECRETS, strip_private_tags

#: What stands for a secret, and what names of keys and assignments of tokens become afterwards: blanks as in ECMAScript's \\s (fixed values).
REDACTED = "[REDACTED]"
BLANKS = "\\t\\n\\x0b\\f\\r \\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SECOND_PASS = [
    (f"([a-zA-Z0-9_-]*[Aa]pi[_-]?[Kk]ey|Bearer[{BLANKS}]+[^{BLANKS}]+)", "[API_KEY]"),
    (f"(?i)(token|jwt|bearer)[{BLANKS}=:]+[^{BLANKS},]+", "[TOKEN]"),
]

_SCAN = [(kind, re.compile(pattern)) for kind, (pattern, _) in SECRETS.items()]
_ANY = "|".join(f"(?:{pattern})" for pattern, _ in SECRETS.values())
#: Texts that are searched and replaced at a time.
ROWS = 256


def _folded(words: str) -> str:
    """words in either case, of ASCII letters only: Arrow's own (?i) also takes U+017F for s and U+212A for k."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _arrow(pattern: str) -> str:
    """A pattern of SECOND_PASS as Arrow writes it."""
    pattern = re.sub(r"^\(\?i\)(\([a-z|]+\))", lambda m: _folded(m[1]), pattern)
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)


_PRIVATE = [(f"(?s)<{_folded(tag)}>.*?</{_folded(tag)}>", f"[{tag.upper()}]") for tag in ("private", "secret")]
_SECOND = [(_arrow(pattern), new) for pattern, new in SECOND_PASS]


def found(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of each secret in order, in characters, none of which overlap."""
    every = sorted((m.start(), -m.end(), k) for k, (_, p) in enumerate(_SCAN) for m in p.finditer(text))
    out, last = [], 0
    for start, end, k in every:
        if start >= last:
            out.append((_SCAN[k][0], start, -end))
            last = -end
    return out


def secret_spans(texts: DataFrame, ident: str = "id", text: str = "content") -> DataFrame:
    """(id, type, start, end): a row a secret; start and end are characters from 0, end not included. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = b.filter(pc.fill_null(pc.match_substring_regex(b.column(1), _ANY), False))
            rows = [(i, *span) for i, t in enumerate(hit.column(1).to_pylist()) for span in found(t)]
            at, kind, start, end = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([hit.column(0).take(pa.array(at, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64())], names=[ident, "type", "start", "end"])

    fields = [T.StructField(ident, texts.schema[ident].dataType), T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    return texts.select(texts[ident], texts[text]).mapInArrow(run, T.StructType(fields))


def _cut(texts: pa.Array) -> pa.Array:
    for pattern, new in _PRIVATE:
        texts = pc.replace_substring_regex(texts, pattern, new)
    hit = pc.fill_null(pc.match_substring_regex(texts, _ANY), False)
    if pc.any(hit).as_py():
        cut = []
        for t in texts.filter(hit).to_pylist():
            for _, start, end in reversed(found(t)):
                t = t[:start] + REDACTED + t[end:]
            cut.append(t)
        texts = pc.replace_with_mask(texts, hit, pa.array(cut, texts.type))
    for pattern, new in _SECOND:
        texts = pc.replace_substring_regex(texts, pattern, new)
    return texts


def redacted(text: Column, mode: str = "moderate") -> Column:
    """The text as it may be stored: private parts and, unless mode is off, secrets replaced, from the last to the first, then names of keys and assignments of tokens."""
    if mode == "off":
        return strip_private_tags(text)

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        parts = [_cut(texts.slice(k, ROWS)) for k in range(0, len(texts), ROWS)]
        return pa.concat_arrays(parts) if parts else texts

    return cut(text)
