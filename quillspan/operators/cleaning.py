"""Rows to leave out before work begins: marked channels, missing and infinite values, all but every n-th row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def without_value(df: DataFrame, column: str | int, value: float = -1.0) -> DataFrame:
    """Without the rows that have a value in a column, given by name or by its place from 0; rows with a null there stay."""
    name = df.columns[column] if isinstance(column, int) else column
    return df.where(~F.col(name).try_cast("double").eqNullSafe(F.lit(float(value))))


def missing(column: str | Column) -> Column:
    """Whether a number is null or NaN."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | F.isnan(c)


def finite(column: str | Column) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    c = F.col(column) if isinstance(column, str) else column
    return ~missing(c) & (F.abs(c) < float("inf"))


def without_missing(df: DataFrame, columns: list[str], how: str = "any") -> DataFrame:
    """Without the rows in which any or all of the columns are null or NaN."""
    bad = F.lit(how == "all")
    for c in columns:
        bad = (bad & missing(c)) if how == "all" else (bad | missing(c))
    return df.where(~bad)


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first and then every n-th row of each key in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("__n", place).where(F.col("__n") % n == 0).drop("__n")
