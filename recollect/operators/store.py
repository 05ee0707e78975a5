"""Writing to the stores: normalised rows, access scopes, lookups, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.scoring import read_scope
from recollect.sources.model import TYPES, VISIBILITY


def normalised(new: DataFrame, now: Column) -> DataFrame:
    """Rows as they are stored: defaults filled, tags trimmed, times set; unknown types are an error."""
    have = set(new.columns)
    value = lambda name, default: F.coalesce(name, default) if name in have else default
    kind = value("type", F.lit("observation"))
    scope = value("visibility", F.lit("private"))
    known = lambda x, values: F.when(x.isin(values), x).otherwise(F.raise_error(F.concat(F.lit("unknown value: "), x)))
    tags = value("tags", F.array().cast("array<string>"))
    return new.withColumns({
        "type": known(kind, TYPES), "visibility": known(scope, VISIBILITY), "source": value("source", F.lit("api")), "relevance": value("relevance", F.lit(50)), "confidence": value("confidence", F.lit(100)),
        "tags": F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""), "created_at": value("created_at", now),
    })


def scoped(memories: DataFrame) -> DataFrame:
    """Agent memories with the principals that may read and write them."""
    return memories.withColumns({"read_scope": read_scope(F.col("visibility"), F.col("agent_id"), F.col("project_id")), "write_scope": F.array(F.concat(F.lit("agent:"), "agent_id"))})


def appended(store: DataFrame, new: DataFrame) -> DataFrame:
    return store.unionByName(new, allowMissingColumns=True)


def by_id(store: DataFrame, ident: int) -> DataFrame:
    return store.filter(F.col("id") == ident).limit(1)


def healthy(store: DataFrame) -> bool:
    """Whether the store can be read at all."""
    try:
        store.limit(1).collect()
    except Exception:  # any failure to read means unhealthy
        return False
    return True


def set_up(spark, names_and_schemas: dict[str, str]) -> None:
    """Create tables that are missing; existing ones stay."""
    for name, schema in names_and_schemas.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def immutable_changes(before: DataFrame, after: DataFrame, flag: str = "is_protected") -> DataFrame:
    """Ids of flagged rows whose content differs or which are gone: must be empty."""
    new = after.select("id", F.col("content").alias("now"))
    return before.filter(flag).join(new, "id", "left").filter(~F.col("content").eqNullSafe(F.col("now"))).select("id")
