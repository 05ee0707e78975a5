"""A project's context as a Markdown document: a managed section, and notes behind it that stay.

Documents are built and parsed as columns; write_documents puts one file per project where the
given base folder is, read_documents reads them back with Spark's text source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks of the managed section (fixed values).
OPEN, CLOSE = "<recollect-context>", "</recollect-context>"


def dated(at: Column) -> Column:
    return F.date_format(at, "MM/dd/yyyy")


def context_document(project: Column, path: Column, updated: Column, activity: Column, observations: Column, notes: Column) -> Column:
    """activity: array of (at, text); observations: array of (text, type). Empty blocks are left out."""
    entry = lambda r: F.concat(F.lit("- ["), dated(r["at"]), F.lit("] "), F.replace(F.substring(r["text"], 1, 80), F.lit("\n"), F.lit(" ")), F.lit("..."))
    seen = lambda r: F.concat(F.lit("- "), r["text"], F.lit(" ("), r["type"], F.lit(")"))
    block = lambda title, rows, show: F.when(F.size(rows) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(F.transform(rows, show), "\n"), F.lit("\n")))
    return F.concat_ws(
        "\n", F.concat(F.lit("# Context of "), project), F.lit(""), F.lit(OPEN), F.lit(""), F.concat(F.lit("**Project**: "), path), F.concat(F.lit("**Last Updated**: "), updated), F.lit(""),
        block("Recent Activity", activity, entry), block("Key Observations", observations, seen), F.concat(F.lit(CLOSE), F.coalesce(notes, F.lit("\n"))),
    )


def managed(document: Column) -> Column:
    """The managed section, or null."""
    got = F.regexp_extract(document, f"(?s){OPEN}(.*?){CLOSE}", 1)
    return F.when(document.contains(CLOSE), got)


def notes(document: Column) -> Column:
    """What stands behind the managed section; null without one."""
    return F.when(document.contains(CLOSE), F.regexp_extract(document, f"(?s){CLOSE}(.*)", 1))


def field(document: Column, name: str) -> Column:
    got = F.regexp_extract(managed(document), rf"\*\*{name}\*\*:\s*(.+)", 1)
    return F.when(got != "", got)


def write_documents(documents: DataFrame, base: str) -> None:
    """documents: name, content. One folder per name, with the document as its only text."""
    documents.select("name", F.col("content").alias("value")).repartition("name").write.mode("overwrite").partitionBy("name").option("lineSep", "\n\x1e\n").text(base)


def read_documents(spark: SparkSession, base: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n\x1e\n").text(base)
    return read.select(F.col("name").cast("string"), F.col("value").alias("content"))
