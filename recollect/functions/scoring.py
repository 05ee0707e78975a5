"""Scores, tiers, confidence and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after which a sector's memories lose relevance (fixed values).
DECAY_DAYS = {"episodic": 30, "semantic": 90, "procedural": 180, "autobiographical": 365, "working": 7}
#: Tier limits: age in days, coactivation, relevance (fixed values).
HOT, WARM = (7, 10, 70), (30, 5, 50)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector; vectors of different length are an error."""
    bad = F.raise_error(F.lit("vectors differ in length")).cast("double")
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), bad).when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def age_days(created: Column, now: Column) -> Column:
    return F.timestamp_diff("SECOND", created, now) / 86400


def age_decayed(score: Column, days: Column, half_life: float = 30.0) -> Column:
    return score * F.pow(F.lit(0.5), days / half_life)


def confidence_decayed(confidence: Column, days: Column, rate: float = 0.01) -> Column:
    """Never below 0; of a fact that begins later than now it grows, up to the greatest integer."""
    power = F.when(-rate * days > 700, 700.0).otherwise(-rate * days)  # beyond that e to it is infinite
    return F.least(F.lit(2.0**31 - 1), F.greatest(F.lit(0.0), confidence * F.exp(power))).cast("int")


def tier(days: Column, coactivation: Column, relevance: Column) -> Column:
    within = lambda t: (days <= t[0]) & (coactivation >= t[1]) & (relevance >= t[2])
    return F.when(within(HOT), "hot").when(within(WARM), "warm").otherwise("cold")


def decayed_relevance(sector: Column, days_since_decay: Column, protected: Column, relevance: Column, factor: float = 0.9) -> Column:
    limit = F.create_map(*[F.lit(x) for pair in DECAY_DAYS.items() for x in pair])
    due = (days_since_decay > F.element_at(limit, sector)) & ~protected
    return F.when(due, F.greatest(F.lit(0), F.floor(relevance * factor))).otherwise(relevance).cast("int")


def tag_overlap(a: Column, b: Column) -> Column:
    """Jaccard of two tag lists; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def length_ratio(a: Column, b: Column) -> Column:
    """Shorter by longer; 1 if both are 0."""
    return F.when(F.greatest(a, b) == 0, 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def confidence_level(similarity: Column, same_type: Column, overlap: Column) -> Column:
    return F.when(similarity >= 0.9, F.when(same_type | (overlap > 0.3), "high").otherwise("medium")).when(similarity >= 0.8, "medium").otherwise("low")


def merge_reason(similarity: Column, type_a: Column, type_b: Column, overlap: Column, ratio: Column, level: Column) -> Column:
    parts = [
        F.format_string("Semantic similarity: %.1f%%", similarity * 100),
        F.when(type_a == type_b, F.format_string("Same type (%s)", type_a)).otherwise(F.format_string("Different types (%s vs %s)", type_a, type_b)),
        F.when(overlap > 0, F.format_string("%d%% tag overlap", F.round(overlap * 100).cast("long"))),
        F.format_string("Content length difference: %d%%", F.round((1 - ratio) * 100).cast("long")),
        F.concat(F.lit("Confidence: "), level),
    ]
    return F.concat_ws(" • ", *parts)


def read_scope(visibility: Column, agent: Column, project: Column) -> Column:
    own, shared = F.concat(F.lit("agent:"), agent), F.concat(F.lit("project:"), F.coalesce(project, F.lit("*")))
    return F.when(visibility == "private", F.array(own)).when(visibility == "project", F.array(own, shared)).when(visibility == "team", F.array(own, shared, F.lit("team:*"))).otherwise(F.array(F.lit("*")))


def tokens_text(n: Column, context: int = 128_000, recall: int = 32_000) -> Column:
    return F.when(n < 1000, F.format_string("%d tokens (%.3f%% of context)", n, n * 100 / context)).otherwise(F.format_string("%.1fk tokens (%.1f%% of typical recall window)", n / 1000, n * 100 / recall))
