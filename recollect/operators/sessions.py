"""Session summaries and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import first_words, tokens_by_length


def chunked(messages: DataFrame, size: int) -> DataFrame:
    """Number the chunks of `size` messages of each conversation, in order of turn."""
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    return messages.withColumn("chunk", F.floor((n - 1) / size).cast("int"))


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation; none for n = 0."""
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("from_end", rank).filter(F.col("from_end") <= n).drop("from_end")


def extracted(messages: DataFrame, *keys: str) -> DataFrame:
    """Per group: counts by role, tools in order of first use, topics, last activity."""
    user = F.col("role") == "user"
    tools = F.sort_array(F.collect_set(F.when(F.col("tool").isNotNull(), F.struct("first_use", "tool"))))
    first = F.min("turn").over(W.partitionBy(*keys, "tool"))
    marked = messages.withColumn("first_use", F.when(F.col("tool").isNotNull(), first))
    return marked.groupBy(*keys).agg(
        F.count_if(user).alias("n_user"), F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.transform(tools, lambda t: t["tool"]).alias("tools"),
        F.min_by(F.when(user, F.col("content")), F.when(user, F.col("turn"))).alias("first_text"), F.max_by(F.when(user, F.col("content")), F.when(user, F.col("turn"))).alias("last_text"),
        F.max_by("created_at", "turn").alias("last_at"),
    )


def topics() -> Column:
    """First ten words of the first and the last user message, equal ones once, without empties."""
    return F.filter(F.array_distinct(F.array(first_words(F.coalesce("first_text", F.lit(""))), first_words(F.coalesce("last_text", F.lit(""))))), lambda t: t != "")


def summary_text() -> Column:
    """The extractive summary of one extracted() row; parts that have nothing to say are left out."""
    join = lambda label, x, by: F.when(F.size(x) > 0, F.concat(F.lit(label), F.array_join(x, by)))
    return F.concat_ws(
        ". ", F.when(F.col("n_user") > 0, F.concat(F.lit("User prompts: "), "n_user")), F.when(F.col("n_assistant") > 0, F.concat(F.lit("Assistant responses: "), "n_assistant")),
        join("Tools used: ", F.col("tools"), ", "), join("Topics: ", topics(), "; "), F.concat(F.lit("Last activity: "), F.coalesce(F.col("last_at").cast("string"), F.lit("unknown"))),
    )


def incremental(messages: DataFrame, size: int) -> DataFrame:
    """Summaries of chunks, joined by a rule, for each conversation."""
    parts = extracted(chunked(messages, size), "conv_id", "chunk").select("conv_id", "chunk", summary_text().alias("part"))
    return parts.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "part"))), lambda p: p["part"]), "\n---\n").alias("summary"))


def rolling(messages: DataFrame, n: int) -> DataFrame:
    return extracted(last_messages(messages, n), "conv_id").select("conv_id", summary_text().alias("summary"))


def final(messages: DataFrame) -> DataFrame:
    return extracted(messages, "conv_id").select("conv_id", summary_text().alias("summary"))


def with_savings(summaries: DataFrame, messages: DataFrame) -> DataFrame:
    """summaries with the messages they stand for and the tokens saved, at least 0."""
    source = messages.groupBy("conv_id").agg(F.count("*").alias("compressed_from"), F.sum(tokens_by_length(F.col("content"))).alias("source_tokens"))
    return summaries.join(source, "conv_id").withColumn("tokens_saved", F.greatest(F.lit(0).cast("long"), F.col("source_tokens") - tokens_by_length(F.col("summary"))))


def line_diff(before: Column, after: Column) -> Column:
    """Lines only after (added) and only before (removed), in order, with repeats; null if none."""
    old, new = F.split(before, "\n"), F.split(after, "\n")
    only = lambda x, y: F.filter(x, lambda line: ~F.array_contains(y, line))
    some = lambda x: F.when(F.size(x) > 0, x)
    return F.struct(some(only(new, old)).alias("added"), some(only(old, new)).alias("removed"))


def snapshot(memories: DataFrame, kind: str, now: Column, before: DataFrame | None = None) -> DataFrame:
    """Snapshots (memory_id, snapshot_type, content, metadata, created_at, diff) of memories.

    metadata has the type, tags, relevance, confidence, sector and visibility. One of kind `after`
    holds the difference from the snapshot in `before` of the same memory.
    """
    fields = [c for c in ("type", "tags", "relevance", "confidence", "sector", "visibility") if c in memories.columns]
    rows = memories.select(F.col("id").alias("memory_id"), F.lit(kind).alias("snapshot_type"), "content", F.to_json(F.struct(*fields)).alias("metadata"), now.alias("created_at"))
    none = F.lit(None).cast("struct<added:array<string>,removed:array<string>>").alias("diff")
    if kind != "after" or before is None:
        return rows.select("*", none)
    old = before.select("memory_id", F.col("content").alias("old"))
    return rows.join(old, "memory_id", "left").withColumn("diff", F.when(F.col("old").isNotNull(), line_diff(F.col("old"), F.col("content")))).drop("old")


def newest(df: DataFrame, limit: int, ident: str, at: str = "created_at") -> DataFrame:
    """Snapshots (50 as a rule) or summaries (10), newest first."""
    return df.orderBy(F.desc(at), F.desc(ident)).limit(limit)


def snapshot_stats(snapshots: DataFrame, types: list[str]) -> DataFrame:
    return snapshots.agg(F.count("*").alias("total"), *[F.count_if(F.col("snapshot_type") == t).alias(f"n_{t}") for t in types], F.min("created_at").cast("string").alias("oldest"), F.max("created_at").cast("string").alias("newest"))


def every_nth(observations: DataFrame, n: int, group: str = "project_id") -> DataFrame:
    """Observations that trigger a summary: each n-th of its group."""
    count = F.row_number().over(W.partitionBy(group).orderBy("created_at", "id"))
    return observations.withColumn("count", count).filter(F.pmod("count", F.lit(n)) == 0)
