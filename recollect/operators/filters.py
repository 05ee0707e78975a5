"""Criteria, assertions, scopes and limits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.scoring import age_days


@dataclass
class Criteria:
    """All given criteria must hold. Ages are in days before `now`."""

    type: str | None = None
    types: Sequence[str] = ()
    sector: str | None = None
    min_confidence: int | None = None
    min_relevance: int | None = None
    project_id: str | None = None
    agent_id: str | None = None
    tag: str | None = None
    min_age: float | None = None
    max_age: float | None = None
    visibility: str | None = None

    def conditions(self, now: Column) -> list[Column]:
        c, age = F.col, age_days(F.col("created_at"), now)
        given = [
            (self.type, lambda v: c("type") == v), (self.types or None, lambda v: c("type").isin(list(v))), (self.sector, lambda v: c("sector") == v),
            (self.min_confidence, lambda v: c("confidence") >= v), (self.min_relevance, lambda v: c("relevance") >= v), (self.project_id, lambda v: c("project_id") == v),
            (self.agent_id, lambda v: c("agent_id") == v), (self.tag, lambda v: F.array_contains("tags", v)), (self.min_age, lambda v: age >= v),
            (self.max_age, lambda v: age <= v), (self.visibility, lambda v: c("visibility") == v),
        ]
        return [make(v) for v, make in given if v is not None]


def matching(df: DataFrame, criteria: Criteria, now: Column) -> DataFrame:
    """Rows for which all criteria hold, as one conjunction that reaches the scan."""
    conditions = criteria.conditions(now)
    return df.filter(reduce(and_, conditions)) if conditions else df


def clamped(value: int | None, default: int, low: int, high: int) -> int:
    return min(max(default if value is None else value, low), high)


def assertion(df: DataFrame, name: str, criteria: Criteria, expected: int, now: Column) -> DataFrame:
    """One row: expected 0 means none may match; otherwise at least so many must."""
    found = matching(df, criteria, now).agg(F.count("*").alias("found"))
    return found.select(F.lit(name).alias("name"), F.lit(expected).cast("long").alias("expected"), "found", (F.col("found") == 0 if expected == 0 else F.col("found") >= expected).alias("passed"))


def asserted(df: DataFrame, name: str, criteria: Criteria, expected: int, now: Column) -> None:
    """Raise AssertionError unless the assertion holds; reads no more rows than needed."""
    found = matching(df, criteria, now).limit(max(1, expected)).count()
    if (found > 0) if expected == 0 else (found < expected):
        raise AssertionError(f"{name}: expected {expected or 'none'}, found {found}")


def require(df: DataFrame, name: str, criteria: Criteria, now: Column, least: int = 1) -> DataFrame:
    """The matching rows, if there are at least so many; else AssertionError."""
    asserted(df, name, criteria, least, now)
    return matching(df, criteria, now)


def assert_present(df: DataFrame, name: str, criteria: Criteria, now: Column) -> None:
    asserted(df, name, criteria, 1, now)


def assert_absent(df: DataFrame, name: str, criteria: Criteria, now: Column) -> None:
    asserted(df, name, criteria, 0, now)


def confident(df: DataFrame, criteria: Criteria, now: Column, least: int = 80) -> DataFrame:
    """Matching rows of at least that confidence."""
    return matching(df, replace(criteria, min_confidence=least), now)


def recent(df: DataFrame, criteria: Criteria, now: Column, days: float = 7) -> DataFrame:
    """Matching rows of the last days."""
    return matching(df, replace(criteria, max_age=days), now)


def of_path(df: DataFrame, projects: DataFrame, path: str) -> DataFrame:
    """Rows of the project with that path; none if there is no such project."""
    return df.join(F.broadcast(project_by_path(projects, path).select("project_id")), "project_id", "left_semi")  # one row at most


def project_by_path(projects: DataFrame, path: str) -> DataFrame:
    return projects.filter(F.col("path") == path).limit(1)


def readable(df: DataFrame, principals: Sequence[str], scope: str = "read_scope") -> DataFrame:
    """Rows whose scope names one of the principals, or everyone."""
    return df.filter(F.arrays_overlap(scope, F.array(*[F.lit(p) for p in [*principals, "*"]])))


def ensured(known: DataFrame, wanted: DataFrame, key: str = "path") -> DataFrame:
    """Rows of wanted whose key is not known yet, each once, with name = last part of the path."""
    new = wanted.select(key).filter(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")
    return new.withColumn("name", F.element_at(F.split(key, "/"), -1))
