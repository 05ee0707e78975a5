"""From raw documents to packed training sequences.

Each stage gets the session, what its predecessor left, and the folder of the tables. run() writes
every stage's rows as Parquet into the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import gam, jaccard, packing, repetition, substring
from recollect.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.

    A null or empty text has no words and goes; repeated rows fare alike; other columns may be null or
    have any name, they pass through; an empty table stays empty.
    """
    names = docs.columns
    judged = repetition.quality_rules(docs.toDF(*[f"doc_{i}" for i in range(len(names))]), f"doc_{names.index('text')}", [f"doc_{i}" for i in range(len(names))])
    return judged.filter("kept").select(*[F.col(f"doc_{i}").alias(n) for i, n in enumerate(names)])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1; learnt from the labels of documents that are still here.

    A null text is scored as an empty one; repeated rows fare alike; a null id is scored, and its label
    ignored. Without labels all scores are 0.5, without both classes the mean of the labels. Other
    columns pass through under any name; an empty table stays empty.
    """
    names = docs.columns
    model = gam.fit(*gam.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    plain = docs.toDF(*[f"doc_{i}" for i in range(len(names))])
    scores = gam.scored(plain, model, plain.columns, f"doc_{names.index('text')}")
    return scores.filter(F.col("score") >= gam.THRESHOLD).select(*[F.col(f"doc_{i}").alias(n) for i, n in enumerate(names)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of linked documents; of repeated rows one.

    The ids to drop are written first: few of them are broadcast, by the size of their files, so the
    texts stay where they are; many are joined by sort and merge. Where ids are null or repeated,
    rows are told apart by a number beside the id, and null ids come first.
    """
    links = stored(jaccard.linked(docs), "linked")
    if not links.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count():
        dropped = stored(links.filter(F.col("component_id") != F.col("doc_id")).select("doc_id"), "dropped")
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    names = docs.columns
    plain = docs.toDF(*[f"doc_{i}" for i in range(len(names))]).withColumn("row", F.monotonically_increasing_id())
    numbered = stored(plain.withColumn("place", F.struct(f"doc_{names.index('doc_id')}", "row")), "numbered")
    links = stored(jaccard.linked(numbered, "place", f"doc_{names.index('text')}"), "linked")
    dropped = stored(links.filter(F.col("component_id") != F.col("place")).select(F.col("place.row").alias("row")), "dropped")
    kept = numbered.join(dropped, "row", "left_anti")
    return kept.select(*[F.col(f"doc_{i}").alias(n) for i, n in enumerate(names)])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one (or place) has; n_chars follows, if there is one.

    Null and empty texts stay as they are; rows of one id and text count as one document and are cut alike.
    Other columns pass through under any name; an empty table stays empty.
    """
    cut = substring.without_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids.

    A null or empty text is one token, the end mark; repeated rows are packed twice; other columns are
    left behind; an empty table gives no rows.
    """
    return packing.packed(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]

#: No SQL expresses the classifier; tests/llm/test_pipeline.py compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
