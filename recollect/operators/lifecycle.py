"""Decay, tiers, eviction, retention and governance; every step returns a new frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.scoring import age_days, decayed_relevance, tier


def decay(memories: DataFrame, now: Column) -> DataFrame:
    """Lower the relevance of unprotected memories whose sector's time has passed; note when."""
    days = age_days(F.col("last_decay_at"), now)
    new = decayed_relevance(F.col("sector"), days, F.col("is_protected"), F.col("relevance"))
    changed = new != F.col("relevance")
    return memories.withColumns({"decayed": changed, "relevance": new, "last_decay_at": F.when(changed, now).otherwise(F.col("last_decay_at"))})


def assign_tiers(memories: DataFrame, now: Column) -> DataFrame:
    """tier from age, coactivation and relevance (null or 0 counts as 50)."""
    relevance = F.when(F.col("relevance").isNull() | (F.col("relevance") == 0), 50).otherwise(F.col("relevance"))
    return memories.withColumn("tier", tier(age_days(F.col("created_at"), now), F.col("coactivation"), relevance))


def evictable(now: Column, days: int = 180, relevance: int = 20) -> Column:
    return (age_days(F.col("created_at"), now) > days) & ~F.col("is_protected") & ~F.col("is_pinned") & (F.col("tier") == "cold") & (F.col("relevance") < relevance)


def maintained(memories: DataFrame, now: Column, days: int = 180) -> DataFrame:
    """Decay, then tiers (which see the decayed relevance), then eviction, in one narrow plan."""
    return assign_tiers(decay(memories, now), now).withColumn("evicted", evictable(now, days))


def retained(df: DataFrame, now: Column, days: int, at: str = "created_at") -> DataFrame:
    """Rows not older than so many days."""
    return df.filter(age_days(F.col(at), now) <= days)


def unexpired(df: DataFrame, now: Column, at: str = "expires_at") -> DataFrame:
    """Rows without an expiry time, or one that has not passed."""
    return df.filter(F.col(at).isNull() | (F.col(at) > now))


def flagged(memories: DataFrame, ids: DataFrame, flag: str, value: bool = True, reason: str | None = None, now: Column | None = None) -> DataFrame:
    """Set a flag (protected, pinned) on the ids of a frame; a reason replaces the metadata, with the time if given."""
    marked = memories.join(ids.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    hit = F.col("hit").isNotNull()
    out = marked.withColumn(flag, F.when(hit, value).otherwise(F.col(flag)))
    if reason is not None:
        entries = [F.lit(f"{flag.removeprefix('is_')}_reason"), F.lit(reason)] + ([F.lit(f"{flag.removeprefix('is_')}_at"), now.cast("string")] if now is not None else [])
        old = F.col("metadata") if "metadata" in memories.columns else F.lit(None).cast("map<string,string>")
        out = out.withColumn("metadata", F.when(hit, F.create_map(*entries)).otherwise(old))
    return out.select(*memories.columns, *([] if reason is None or "metadata" in memories.columns else ["metadata"]))
