"""Summary numbers of the stores; each is one aggregation with map-side partials."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, column: str, values: list[str], name: str = "n") -> DataFrame:
    """A row for each value of a closed list, zero where it does not occur."""
    counts = [F.struct(F.lit(v).alias(column), F.count_if(F.col(column) == v).alias(name)) for v in values]
    return df.agg(F.array(*counts).alias("rows")).select(F.inline("rows"))


def _detection() -> list[Column]:
    c = F.count_if
    return [F.count("*").alias("total"), c(F.col("is_mergeable") & ~F.col("is_merged") & F.col("is_active")).alias("mergeable"), c("is_merged").alias("merged"), c("is_canonical").alias("canonical")]


def detection_stats(memories: DataFrame) -> DataFrame:
    return memories.agg(*_detection())


def detection_by_type(memories: DataFrame) -> DataFrame:
    """The same numbers for each type that occurs."""
    return memories.groupBy("type").agg(*_detection())


def merge_stats(memories: DataFrame, proposals: DataFrame, statuses: list[str], history: DataFrame | None = None) -> DataFrame:
    """One row: memory counts, proposals by status, merges undone (of a history), and the mean size of a merge (1 without any)."""
    one = lambda df: df.withColumn("one", F.lit(1))
    both = one(detection_stats(memories)).join(one(proposals.agg(*[F.count_if(F.col("status") == s).alias(f"proposals_{s}") for s in statuses])), "one")  # one row each
    if history is not None:
        both = both.join(one(history.agg(F.count_if("is_reversed").alias("reversed"))), "one")
    size = F.when(F.col("canonical") > 0, F.round((F.col("merged") + F.col("canonical")) / F.col("canonical"))).otherwise(1)
    return both.drop("one").withColumn("mean_merge_size", size.cast("long"))


def token_stats(df: DataFrame, tokens: Column) -> DataFrame:
    """Sum, extremes, mean and exact median; the median is taken from the counts of distinct values, which lengths bound."""
    counts = df.select(tokens.alias("t")).filter("t is not null").groupBy("t").agg(F.count("*").alias("n"))
    return counts.agg(
        F.sum(F.col("t") * F.col("n")).alias("total"), F.min("t").alias("least"), F.max("t").alias("most"), F.round(F.sum(F.col("t") * F.col("n")) / F.sum("n")).cast("long").alias("mean"),
        F.round(F.percentile("t", F.lit(0.5), F.col("n"))).cast("long").alias("median"),
    )


def savings(df: DataFrame, saved: str, tokens: str, *by: str) -> DataFrame:
    """Tokens saved by merges, per group: sum, count, mean and share of all tokens."""
    out = df.groupBy(*by).agg(F.sum(saved).alias("saved"), F.count("*").alias("merges"), F.sum(tokens).alias("tokens"))
    return out.withColumns({"mean_saved": F.round(F.col("saved") / F.col("merges")).cast("long"), "percent": F.when(F.col("tokens") > 0, F.round(100 * F.col("saved") / F.col("tokens"), 6)).otherwise(0.0)})


def fact_stats(facts: DataFrame, now: Column) -> DataFrame:
    expired = F.col("valid_to").isNotNull() & (F.col("valid_to") < now)
    return facts.agg(
        F.count("*").alias("total"), F.count_if(expired).alias("expired"), F.count_if(~expired).alias("active"),
        F.round(F.avg(F.coalesce("confidence", F.lit(0))), 6).alias("mean_confidence"), F.round(F.avg(F.timestamp_diff("SECOND", F.col("valid_from"), now) / 86400), 6).alias("mean_age_days"),
    )


def summary_stats(summaries: DataFrame, types: list[str]) -> DataFrame:
    """Counts by type, tokens saved, and the mean of saved / (source * 100) over all rows."""
    ratio = F.when(F.col("compressed_from") > 0, F.col("tokens_saved") / (F.col("compressed_from") * 100)).otherwise(0)
    return summaries.agg(F.count("*").alias("total"), *[F.count_if(F.col("summary_type") == t).alias(f"n_{t}") for t in types], F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("tokens_saved"), F.round(F.sum(ratio) / F.count("*"), 6).alias("mean_ratio"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
