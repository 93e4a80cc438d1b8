"""Outliers by quartile fences and by z-score, as predicates over the table.

Fences, mean and deviation are a few numbers per column, so they enter the scan
as literals.  Flagged rows stay a DataFrame; only their counts are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.config import DEFAULTS, Thresholds
from gaugework.functions import scalars as S
from gaugework.operators.stats import quartiles, rounded
from gaugework.operators.summary import number_view, summarise
from gaugework.session import chunks, col, small_frame

FENCE_SCHEMA = "column string, q1 double, q3 double, lower double, upper double"
SUMMARY_SCHEMA = "column string, iqr_count bigint, iqr_pct double, zscore_count bigint, zscore_pct double"
METHODS = ("iqr", "zscore")


def fences(q1: float, q3: float, thresholds: Thresholds = DEFAULTS) -> tuple[float, float]:
    reach = thresholds.iqr_multiplier * (q3 - q1)
    return q1 - reach, q3 + reach


def outlier_rules(
    df: DataFrame,
    columns: list[str],
    summary: dict[str, dict],
    quarters: dict[str, list],
    thresholds: Thresholds = DEFAULTS,
) -> dict[str, dict[str, Column]]:
    """Per column the IQR and z-score predicates.  Infinite values always match;
    nothing else does below four finite values or without spread."""
    rules = {}
    for c in columns:
        x = number_view(df, c)
        infinite = S.is_infinite(x)
        iqr = zscore = infinite
        facts = summary[c]
        if facts["finite"] >= thresholds.min_rows_for_fences:
            q1, _, q3 = quarters[c]
            if q1 != q3:
                low, high = fences(q1, q3, thresholds)
                iqr = (x < F.lit(low)) | (x > F.lit(high))
            if facts["std"]:
                distance = F.abs((x - F.lit(facts["mean"])) / F.lit(facts["std"]))
                zscore = infinite | (distance > F.lit(thresholds.zscore_limit))
        rules[c] = {"iqr": iqr, "zscore": zscore}
    return rules


def _rules(df: DataFrame, columns: list[str], thresholds: Thresholds):
    summary = summarise(df, columns)
    quarters = quartiles(df, columns, summary)
    return summary, quarters, outlier_rules(df, columns, summary, quarters, thresholds)


def iqr_fences(df: DataFrame, columns: list[str], thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """column, q1, q3, lower, upper over the finite numbers."""
    quarters = quartiles(df, columns, summarise(df, columns))
    rows = []
    for c in columns:
        q1, _, q3 = quarters[c]
        low, high = (None, None) if q1 is None else fences(q1, q3, thresholds)
        rows.append({"column": c, "q1": q1, "q3": q3, "lower": low, "upper": high})
    return small_frame(df.sparkSession, rows, FENCE_SCHEMA)


def rows_matching(df: DataFrame, row_id: str, rules: dict[str, dict[str, Column]], methods=METHODS) -> DataFrame:
    """column, method, row id, value of every flagged cell: one scan, no shuffle."""
    entries = [
        F.when(
            rules[c][m],
            F.struct(
                F.lit(c).alias("column"),
                F.lit(m).alias("method"),
                col(row_id).alias(row_id),
                number_view(df, c).alias("value"),
            ),
        )
        for c in rules
        for m in methods
    ]
    return df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")


def outlier_rows(
    df: DataFrame, columns: list[str], row_id: str, methods=METHODS, thresholds: Thresholds = DEFAULTS
) -> DataFrame:
    _, _, rules = _rules(df, columns, thresholds)
    return rows_matching(df, row_id, rules, methods)


def outlier_counts(df: DataFrame, rules: dict[str, dict[str, Column]], rows: int) -> dict[str, dict]:
    """Counts and share of all rows per column, one scan."""
    result = {}
    for part in chunks(list(rules), 20):
        metrics = [F.count_if(rules[c][m]).alias(f"{i}.{m}") for i, c in enumerate(part) for m in METHODS]
        found = df.agg(*metrics).first().asDict()
        for i, c in enumerate(part):
            result[c] = {}
            for m in METHODS:
                n = found[f"{i}.{m}"]
                result[c] |= {f"{m}_count": n, f"{m}_pct": rounded(n / rows * 100, 2) if rows else 0.0}
    return result


def outlier_summary(df: DataFrame, columns: list[str], thresholds: Thresholds = DEFAULTS) -> DataFrame:
    summary, _, rules = _rules(df, columns, thresholds)
    counts = outlier_counts(df, rules, summary[columns[0]]["rows"] if columns else 0)
    return small_frame(df.sparkSession, [{"column": c, **counts[c]} for c in columns], SUMMARY_SCHEMA)
