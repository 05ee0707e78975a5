"""The memory model on top of the given tables.

Every mapping is a narrow projection (one join with the small labels table for memories), so
filters and column pruning reach the Parquet scans. Times are TIMESTAMP_NTZ and "now" is a
parameter everywhere; nothing depends on the session's time zone or on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Closed value lists of the model (fixed values).
TYPES = ["observation", "fact", "decision", "context", "preference"]
SECTORS = ["episodic", "semantic", "procedural", "autobiographical", "working"]
VISIBILITY = ["private", "project", "team", "global"]
STATUSES = ["pending", "approved", "rejected", "expired"]
TIERS = ["hot", "warm", "cold"]

EPOCH = "2024-01-01 00:00:00"
NOW = "2024-02-12 00:00:00"


def at(text: str) -> Column:
    """A time literal without zone."""
    return F.lit(text).cast("timestamp_ntz")


def shifted(base: str, unit: str, n: Column | str) -> Column:
    return F.timestamp_add(unit, F.col(n) if isinstance(n, str) else n, at(base))


def seconds_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("SECOND", a, b)


def pick(values: list[str], index: Column) -> Column:
    """The element of a closed list at index modulo its length."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def shown(column: str) -> Column:
    """A time as text, for results."""
    return F.col(column).cast("string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    every = lambda n: F.pmod(i, F.lit(n)) == 0
    return d.join(labels, "doc_id", "left").select(
        i.alias("id"), F.col("text").alias("content"), pick(TYPES, i).alias("type"), pick(SECTORS, F.floor(i / 5)).alias("sector"),
        F.array("lang", "source").alias("tags"), F.col("source").alias("project_id"), F.pmod(i, F.lit(7)).alias("user_id"),
        pick(VISIBILITY, F.floor(i / 3)).alias("visibility"), F.concat(F.lit("agent"), F.pmod(i, F.lit(4))).alias("agent_id"),
        shifted(EPOCH, "HOUR", "doc_id").alias("created_at"),
        F.coalesce(50 + 30 * F.col("quality") - 40 * F.col("toxic"), F.lit(50)).cast("int").alias("relevance"),
        (100 - F.pmod(i, F.lit(41))).cast("int").alias("confidence"), F.pmod(i, F.lit(15)).cast("int").alias("coactivation"),
        every(17).alias("is_private"), every(19).alias("has_secrets"), every(23).alias("is_protected"), every(29).alias("is_pinned"),
        (~every(11)).alias("is_mergeable"), every(13).alias("is_merged"), (~every(7)).alias("is_active"), every(37).alias("is_canonical"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the memories needs no labels: a narrow projection, so no text is moved for a join."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"), F.col("source").alias("project_id"))


#: The same mapping as SQL, for the oracles.
MEMORIES_SQL = """mem AS (SELECT d.doc_id AS id, d.text AS content,
 (['observation','fact','decision','context','preference'])[CAST(d.doc_id % 5 AS INT) + 1] AS type,
 (['episodic','semantic','procedural','autobiographical','working'])[CAST((d.doc_id // 5) % 5 AS INT) + 1] AS sector,
 [d.lang, d.source] AS tags, d.source AS project_id, d.doc_id % 7 AS user_id,
 (['private','project','team','global'])[CAST((d.doc_id // 3) % 4 AS INT) + 1] AS visibility,
 'agent' || (d.doc_id % 4) AS agent_id, TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS created_at,
 CAST(coalesce(50 + 30 * l.quality - 40 * l.toxic, 50) AS INT) AS relevance, CAST(100 - d.doc_id % 41 AS INT) AS confidence,
 CAST(d.doc_id % 15 AS INT) AS coactivation, d.doc_id % 17 = 0 AS is_private, d.doc_id % 19 = 0 AS has_secrets,
 d.doc_id % 23 = 0 AS is_protected, d.doc_id % 29 = 0 AS is_pinned, d.doc_id % 11 <> 0 AS is_mergeable,
 d.doc_id % 13 = 0 AS is_merged, d.doc_id % 7 <> 0 AS is_active, d.doc_id % 37 = 0 AS is_canonical
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns; every third assistant turn uses a tool."""
    c = table(spark, sf_dir, "conversations")
    tool = F.when((F.col("role") == "assistant") & (F.pmod("turn", F.lit(3)) == 1), pick(["search", "read_file", "write_file"], F.col("conv_id") + F.col("turn")))
    return c.select("conv_id", "turn", "role", F.col("text").alias("content"), tool.alias("tool"), F.timestamp_add("MINUTE", F.col("turn"), shifted(EPOCH, "DAY", "conv_id")).alias("created_at"))


MESSAGES_SQL = """msg AS (SELECT conv_id, turn, role, text AS content,
 CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN (['search','read_file','write_file'])[CAST((conv_id + turn) % 3 AS INT) + 1] END AS tool,
 TIMESTAMP '2024-01-01' + to_days(CAST(conv_id AS INT)) + to_minutes(turn) AS created_at FROM conversations)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), F.col("event_type").alias("type"), "value", F.col("props").alias("details"), F.col("ts").cast("timestamp_ntz").alias("created_at"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as versions of one fact, valid until the next one."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_totalprice").alias("value"), (100 - F.pmod("o_orderkey", F.lit(41))).cast("int").alias("confidence"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from"), F.lead(F.col("o_orderdate").cast("timestamp_ntz")).over(w).alias("valid_to"),
        F.lead("o_orderkey").over(w).alias("superseded_by"), F.row_number().over(w).alias("version"),
    )


FACTS_SQL = """fact AS (SELECT o_orderkey AS id, o_custkey AS subject, o_totalprice AS value, CAST(100 - o_orderkey % 41 AS INT) AS confidence,
 o_orderdate AS valid_from, lead(o_orderdate) OVER w AS valid_to, lead(o_orderkey) OVER w AS superseded_by, row_number() OVER w AS version
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge proposals on neighbouring ids, with a status and a similarity."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    k = F.floor(F.col("doc_id") / 2)
    pairs = d.groupBy(k.alias("id")).agg(F.sort_array(F.collect_list("doc_id")).alias("sources")).filter(F.size("sources") == 2)
    return pairs.select("id", "sources", ((50 + F.pmod("id", F.lit(50))) / 100).alias("similarity"), pick(STATUSES, F.col("id")).alias("status"), shifted(EPOCH, "HOUR", F.col("id") * 2).alias("created_at"))


PROPOSALS_SQL = """prop AS (SELECT id, sources, (50 + id % 50) / 100.0 AS similarity, (['pending','approved','rejected','expired'])[CAST(id % 4 AS INT) + 1] AS status,
 TIMESTAMP '2024-01-01' + to_hours(id * 2) AS created_at
 FROM (SELECT doc_id // 2 AS id, list(doc_id ORDER BY doc_id) AS sources FROM documents GROUP BY 1 HAVING count(*) = 2))"""
