"""Co-activation graph: edges from baskets, statistics, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.operators.search import top


#: Rows that one task takes (about): items of baskets, or edges.
ITEMS = 1 << 17


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys, in as many partitions as so many rows need: what a task holds does not grow with the table."""
    return df.repartition(max(1, -(-rows // ITEMS)), *keys)


def coactivated(baskets: DataFrame, basket: str, item: str, weight: int = 1, around: int | None = None) -> DataFrame:
    """Directed edges between different items of a basket, both ways, with weight and count.

    A basket is what was active together (a handful of items), and an equi-join on its key, whose
    skewed keys AQE splits. Nearly every pair is a new one, so pairs are dealt out before they are counted, each
    in one of its two directions. With `around`, only edges from that item: only baskets that hold it take
    part, and of these only the pairs with it.
    """
    counted = ((F.count("*") * weight).alias("weight"), F.count("*").alias("coactivations"))
    if around is not None:
        items = baskets.select(basket, item).distinct()
        source = items.filter(F.col(item) == around)
        pairs = source.withColumnRenamed(item, "source").join(items.withColumnRenamed(item, "target"), basket).filter("source <> target")
        return pairs.groupBy("source", "target").agg(*counted)
    rows = baskets.count()
    items = dealt(baskets.select(basket, item), rows, basket).distinct()
    pairs = items.withColumnRenamed(item, "source").join(items.withColumnRenamed(item, "target"), basket).filter("source < target").select("source", "target")
    edges = dealt(pairs, 2 * rows, "source", "target").groupBy("source", "target").agg(*counted)
    ends = F.explode(F.array(F.struct("source", "target"), F.struct(F.col("target").alias("source"), F.col("source").alias("target"))))
    return edges.select(ends.alias("e"), "weight", "coactivations").select("e.source", "e.target", "weight", "coactivations")


def associated(edges: DataFrame, new: DataFrame, rows: int | None = None) -> DataFrame:
    """edges after upserts: weights and counts add up, the first type stays. rows: about how many edges both have (counted if not given)."""
    both = edges.withColumn("order", F.lit(0)).unionByName(new.withColumn("order", F.lit(1)))
    both = dealt(both.sortWithinPartitions("source", "target"), both.count() if rows is None else rows, "source", "target")  # rows in order pack better
    return both.groupBy("source", "target").agg(F.sum("weight").alias("weight"), F.sum("coactivations").alias("coactivations"), F.min_by("kind", "order").alias("kind"))


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("mean_weight"), F.max("weight").alias("most_weight"))


def stats_by_kind(edges: DataFrame) -> DataFrame:
    """(kind, n): edges of each type."""
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def related(edges: DataFrame, node: int, k: int) -> DataFrame:
    """The k neighbours of a node, either way, by weight."""
    ends = edges.filter((F.col("source") == node) | (F.col("target") == node)).select(F.when(F.col("source") == node, F.col("target")).otherwise(F.col("source")).alias("id"), "weight")
    return top(ends.groupBy("id").agg(F.max("weight").alias("weight")), k, F.desc("weight"), F.asc("id"))


def pruned(edges: DataFrame, least: int = 5) -> DataFrame:
    return edges.filter(F.col("weight") > least)
