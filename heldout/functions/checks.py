"""Guards shared by the operators.

Required columns are checked on the driver from the schema alone.  Row-level
constraints are checked either by a small action that stops at the first
offending row (``guard_*``) or inside the plan (``raise_when``) where the
operator aggregates on the same key anyway.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EvaluationError(ValueError):
    """Input does not satisfy the contract of an operator."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise EvaluationError(f"missing columns: {', '.join(missing)}")


def blank(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | (F.trim(c.cast("string")) == "")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def guard_none(df: DataFrame, message: str) -> None:
    row = df.head(1)
    if row:
        raise EvaluationError(f"{message}: {row[0].asDict()}")


def guard_unique(df: DataFrame, keys: Sequence[str]) -> None:
    guard_none(repeated_keys(df, keys), f"duplicate key {tuple(keys)}")


def guard_complete(df: DataFrame, columns: Sequence[str]) -> None:
    cond = F.lit(False)
    for c in columns:
        cond = cond | blank(c)
    guard_none(df.filter(cond).select(*columns), "blank or missing identity")


def raise_when(condition: Column, message: str, value: Column) -> Column:
    """``value``, or a task failure with ``message`` on rows where ``condition`` holds."""
    return F.when(condition, F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def finite(column: str | Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def nan_to_null(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)
