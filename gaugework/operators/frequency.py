"""Exact distinct counts and most frequent values, all columns in one shuffle.

Rows become (column, value) pairs that are combined before the shuffle, so a
value shared by a third of the rows costs one pair per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions import scalars as S
from gaugework.operators.summary import long_form
from gaugework.session import col

LONG_TEXT = 64


def compact_text(text: Column) -> Column:
    """The text itself, or its SHA-256 when long: documents are not shuffled whole."""
    return F.when(F.length(text) <= LONG_TEXT, text).otherwise(
        F.concat(F.lit("sha256:"), F.sha2(text, 256))
    )


def distinct_counts(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Exact number of distinct non-null values per entry of ``values``, which are
    all of one type."""
    if not values:
        return {}
    cells = long_form(df, values).filter(F.col("value").isNotNull())
    counted = cells.distinct().groupBy("column").count().collect()
    return {name: 0 for name in values} | {r["column"]: r["count"] for r in counted}


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (as text), count: the value-frequency table."""
    cells = long_form(df, {c: col(c).cast("string") for c in columns}).filter(F.col("value").isNotNull())
    return cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """column, rank, value, count of the k most frequent values; ties by value.

    The rank filter is pushed below the exchange, so each task sends at most
    k rows per column to the ranking.
    """
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return (
        value_counts(df, columns)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("column", "rank", "value", "count")
    )


def normal_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values per text column after trimming and lower case."""
    return distinct_counts(df, {c: compact_text(S.normal_label(col(c))) for c in columns})


def raw_and_normal(df: DataFrame, columns: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """Distinct values per text column as stored, and after trimming and lower case."""
    values = {}
    for i, name in enumerate(columns):
        values[f"{i} raw"] = compact_text(col(name))
        values[f"{i} normal"] = compact_text(S.normal_label(col(name)))
    counts = distinct_counts(df, values)
    raw = {name: counts[f"{i} raw"] for i, name in enumerate(columns)}
    normal = {name: counts[f"{i} normal"] for i, name in enumerate(columns)}
    return raw, normal
