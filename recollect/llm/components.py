"""Connected components of an edge table, without gathering any of it on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, sized, stored

#: Edges that a task works on, at least.
ROWS_A_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node it is linked with.

    Each round hands every node the smallest label among its neighbours, aggregated map-side
    before the shuffle, and then follows the label's own label, which halves long chains. Rounds
    are written to the shared folder, so that a lost executor costs one round at most.
    """
    rows = 2 * edges.count()
    small = lambda df: sized(df, rows, ROWS_A_TASK)
    both = stored(small(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()), "edges")
    labels = stored(small(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label"))), "labels")
    while True:
        heard = small(both.join(labels.withColumnRenamed("node", "b"), "b")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("mid"))
        step = lower.join(labels.select(F.col("node").alias("mid"), F.col("label").alias("far")), "mid", "left")
        after = stored(small(step.select("node", F.least("mid", "far").alias("label"), "old")), "labels")
        changed = after.filter("label <> old").limit(1).count()
        discard(labels)
        labels = after.drop("old")
        if not changed:
            discard(both)
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after links (a, b) between labels, or nodes that have none: only the links are followed, not what made the labels."""
    above = components(links)
    raised = labels.join(above.select(F.col("node").alias("label"), F.col("label").alias("higher")), "label", "left").select("node", F.coalesce("higher", "label").alias("label"))
    return stored(raised.unionByName(above.join(labels, "node", "left_anti")), "labels")
