"""The one output relation: findings with a fixed severity order, and its roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ERROR says that something could not be checked; it outranks a defect.
SEVERITY = {"OK": 0, "WARN": 1, "BAD": 2, "ERROR": 3}
STATUSES = tuple(SEVERITY)
COLUMNS = ("check", "rule", "target", "status", "value")


def finding(df: DataFrame, check: str, rule: str | Column, target: Column, status: str | Column, value: Column | None = None) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.lit(check).alias("check"),
        as_column(rule).alias("rule"),
        target.cast("string").alias("target"),
        as_column(status).alias("status"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
    )


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def severity(status: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), status)


def worst_first(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity(F.col("status")).desc(), "check", "target", "rule")


def summary(findings: DataFrame) -> DataFrame:
    """Count per check and status."""
    return findings.groupBy("check", "status").agg(F.count("*").alias("n"))


def worst(findings: DataFrame) -> DataFrame:
    """One row: the worst status; OK where there is no finding."""
    return findings.agg(F.coalesce(F.max_by("status", severity(F.col("status"))), F.lit("OK")).alias("worst"))


def exit_code(worst_status: str, exit_on: str | None) -> int:
    """1 if a threshold is set and the worst status reaches it."""
    return int(exit_on is not None and SEVERITY[worst_status] >= SEVERITY[exit_on])
