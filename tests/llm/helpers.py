from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "lorem ipsum dolor sit amet consectetur " * 4000 + "x" * 3000 + " " + "é" * 500

#: Nulls in any column, empty and blank texts, a long one, ties and repeated rows, odd characters.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all.", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (4, " \n\t ", "en", "s"), (5, "one two three", "en", "s"),
    (6, "ONE two THREE", "en", "s"), (None, "a text without an id that has some words in it", "en", "s"), (7, LONG, "en", "s"), (8, LONG, "en", "s"),
    (9, "repeated row", "en", "s"), (9, "repeated row", "en", "s"), (10, "wörter mit ümlaut 😀 字 \x1c end", "de", None), (11, "▁ <|endoftext|> \x00 odd\r\nlines", "en", "s"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def table(spark: SparkSession, rows=None) -> DataFrame:
    return spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)


def clashing(spark: SparkSession) -> DataFrame:
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    return table(spark).select("*", *[F.lit(1).alias(c) for c in ("id", "key", "n", "score", "kept", "chunk", "owner", "t", "k0", "ids", "n_words", "spans")])


def words(text: str | None, fold: bool = False) -> list[str]:
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if fold else text)


def texts(spark: SparkSession, sf: str) -> dict[int, str]:
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
