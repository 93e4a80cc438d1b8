"""Descriptive statistics per semantic type, one row per column."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions import scalars as S
from gaugework.operators import frequency
from gaugework.operators.quantiles import exact_quantiles
from gaugework.operators.summary import kinds, number_view, summarise
from gaugework.session import chunks, col, small_frame

NUMERIC_SCHEMA = (
    "column string, mean double, median double, std double, min double, max double, skewness double, "
    "kurtosis double, zeros bigint, unique_count bigint, infinite_count bigint"
)
CATEGORY_SCHEMA = "column string, unique_count bigint, cardinality_ratio double"
DATETIME_SCHEMA = "column string, min_date timestamp, max_date timestamp, range_days bigint"
TEXT_SCHEMA = "column string, unique_count bigint, avg_length double, max_length int, min_length int"
QUARTILES = (0.25, 0.5, 0.75)


def rounded(value: float | None, digits: int) -> float | None:
    return None if value is None or math.isnan(value) else round(float(value), digits)


def quartiles(df: DataFrame, columns: list[str], summary: dict[str, dict]) -> dict[str, list]:
    """[Q1, median, Q3] of the finite numbers per column."""
    numbers = {c: S.finite(number_view(df, c)) for c in columns}
    return exact_quantiles(df, numbers, QUARTILES, {c: summary[c]["finite"] for c in columns})


def distinct_numbers(df: DataFrame, columns: list[str]) -> dict[str, int]:
    values = {c: S.finite(number_view(df, c)) for c in columns}
    return frequency.distinct_counts(df, values)


def numeric_row(column: str, facts: dict, median: float | None, distinct: int) -> dict:
    shaped = {k: rounded(facts[k], 4) for k in ("mean", "std", "min", "max", "skewness", "kurtosis")}
    return {
        "column": column,
        **shaped,
        "median": rounded(median, 4),
        "zeros": facts["zeros"],
        "unique_count": distinct,
        "infinite_count": facts["infinite"],
    }


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments, exact median, extremes and counts over the finite numbers."""
    summary = summarise(df, columns)
    middle = quartiles(df, columns, summary)
    distinct = distinct_numbers(df, columns)
    rows = [numeric_row(c, summary[c], middle[c][1], distinct[c]) for c in columns]
    return small_frame(df.sparkSession, rows, NUMERIC_SCHEMA)


def shape_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, skewness, kurtosis and their labels, all from one scan."""
    summary = summarise(df, columns)
    rows = [{"column": c} | {k: rounded(summary[c][k], 4) for k in ("skewness", "kurtosis")} for c in columns]
    frame = small_frame(df.sparkSession, rows, "column string, skewness double, kurtosis double")
    return frame.withColumns(
        {
            "skew_label": S.skew_label(F.col("skewness")),
            "kurtosis_label": S.kurtosis_label(F.col("kurtosis")),
        }
    )


def finite_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, number_count (values that are numbers), finite_count, infinite_count."""
    summary = summarise(df, columns)
    rows = [
        {"column": c, "number_count": f["numbers"], "finite_count": f["finite"], "infinite_count": f["infinite"]}
        for c, f in summary.items()
    ]
    schema = "column string, number_count bigint, finite_count bigint, infinite_count bigint"
    return small_frame(df.sparkSession, rows, schema)


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table with the columns as numbers; text that is none becomes NULL."""
    return df.withColumns({c: number_view(df, c) for c in columns})


def present_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    found = {}
    for part in chunks(list(columns), 50):
        found |= dict(zip(part, df.agg(*[F.count(col(c)) for c in part]).first()))
    return found


def category_row(column: str, distinct: int, present: int) -> dict:
    ratio = distinct / present if present else 0.0
    return {"column": column, "unique_count": distinct, "cardinality_ratio": rounded(ratio, 4)}


def distinct_texts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    values = {c: frequency.compact_text(col(c).cast("string")) for c in columns}
    return frequency.distinct_counts(df, values)


def categorical_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    present = present_counts(df, columns)
    distinct = distinct_texts(df, columns)
    rows = [category_row(c, distinct[c], present[c]) for c in columns]
    return small_frame(df.sparkSession, rows, CATEGORY_SCHEMA)


def datetime_row(column: str, facts: dict) -> dict:
    low, high = facts["date_low"], facts["date_high"]
    days = None if low is None else (high - low).days
    return {"column": column, "min_date": low, "max_date": high, "range_days": days}


def datetime_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """First and last instant and the whole days between them."""
    of_kind = kinds(df)
    views = {c: S.as_timestamp(col(c), of_kind[c]) for c in columns}
    entries = [F.struct(F.lit(c).alias("column"), v.alias("t")) for c, v in views.items()]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    low, high = F.min("t"), F.max("t")
    days = F.floor((F.unix_micros(high) - F.unix_micros(low)) / F.lit(86_400_000_000))
    return long.groupBy("column").agg(
        low.alias("min_date"), high.alias("max_date"), days.cast("bigint").alias("range_days")
    )


def text_row(column: str, facts: dict, distinct: int) -> dict:
    return {
        "column": column,
        "unique_count": distinct,
        "avg_length": rounded(facts["length_mean"] or 0.0, 2),
        "max_length": facts["length_max"] or 0,
        "min_length": facts["length_min"] or 0,
    }


def text_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    distinct = distinct_texts(df, columns)
    metrics = []
    for i, c in enumerate(columns):
        length = F.length(col(c))
        metrics += [
            F.avg(length).alias(f"{i}.length_mean"),
            F.max(length).alias(f"{i}.length_max"),
            F.min(length).alias(f"{i}.length_min"),
        ]
    found = df.agg(*metrics).first().asDict()
    rows = []
    for i, c in enumerate(columns):
        facts = {k: found[f"{i}.{k}"] for k in ("length_mean", "length_max", "length_min")}
        rows.append(text_row(c, facts, distinct[c]))
    return small_frame(df.sparkSession, rows, TEXT_SCHEMA)
