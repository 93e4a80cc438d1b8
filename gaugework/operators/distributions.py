"""Normality, cardinality flags and time gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.config import DEFAULTS, Thresholds
from gaugework.functions import scalars as S
from gaugework.operators.ordered import day_gaps
from gaugework.operators.stats import distinct_texts, present_counts, rounded
from gaugework.operators.summary import kinds, summarise
from gaugework.session import col, small_frame

NORMALITY_SCHEMA = "column string, n bigint, test string, p_value double, is_normal boolean"
GAP_SCHEMA = "column string, max_gap_days bigint, gap_count bigint, median_gap_days double"


def normality_facts(
    df: DataFrame, columns: list[str], summary: dict[str, dict], thresholds: Thresholds = DEFAULTS
) -> dict[str, dict]:
    """{column: test, p_value, is_normal} of the moment test; none where it is undefined: below
    ``normality_rows`` values or without spread."""
    testable = [c for c in columns if summary[c]["finite"] >= thresholds.normality_rows and summary[c]["std"]]
    p_values = _omnibus(df, testable, summary)
    result = {}
    for c in columns:
        p = p_values.get(c)
        result[c] = {
            "test": "k2" if c in testable else None,
            "p_value": None if p is None else round(p, 6),
            "is_normal": None if p is None else p >= thresholds.normality_alpha,
        }
    return result


def _omnibus(df: DataFrame, columns: list[str], summary: dict[str, dict]) -> dict[str, float]:
    if not columns:
        return {}
    rows = [{"column": c, "n": summary[c]["finite"], "g1": summary[c]["g1"], "g2": summary[c]["g2"]} for c in columns]
    moments = small_frame(df.sparkSession, rows, "column string, n bigint, g1 double, g2 double")
    tested = moments.select("column", S.omnibus_p(F.col("n"), F.col("g1"), F.col("g2")).alias("p"))
    return {r["column"]: r["p"] for r in tested.collect()}


def normality(df: DataFrame, columns: list[str], thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """The K-squared moment test, from one aggregation however long the columns are."""
    summary = summarise(df, columns)
    facts = normality_facts(df, columns, summary, thresholds)
    rows = [{"column": c, "n": summary[c]["finite"], **facts[c]} for c in columns]
    return small_frame(df.sparkSession, rows, NORMALITY_SCHEMA)


def gap_facts(df: DataFrame, timestamp: Column, buckets: int | None = None) -> dict:
    """Largest and median gap, and how many exceed max(1, 3 x median) days.

    Distinct day gaps add up to the covered range, so there are under 2,800 of
    them for any calendar range; that histogram is all that is collected.
    """
    histogram = sorted((r["gap_days"], r["count"]) for r in day_gaps(df, timestamp, buckets).collect())
    if not histogram:
        return {"max_gap_days": None, "gap_count": 0, "median_gap_days": None}
    total = sum(n for _, n in histogram)

    def at(position: int) -> int:
        for days, n in histogram:
            position -= n
            if position < 0:
                return days
        raise AssertionError

    median = (at((total - 1) // 2) + at(total // 2)) / 2
    limit = max(1.0, 3 * median)
    return {
        "max_gap_days": histogram[-1][0],
        "gap_count": sum(n for days, n in histogram if days > limit),
        "median_gap_days": round(median, 1),
    }


def datetime_gaps(df: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    of_kind = kinds(df)
    rows = [{"column": c, **gap_facts(df, S.as_timestamp(col(c), of_kind[c]), buckets)} for c in columns]
    return small_frame(df.sparkSession, rows, GAP_SCHEMA)


def high_cardinality(df: DataFrame, columns: list[str], thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """column, cardinality_ratio, high_cardinality."""
    present, distinct = present_counts(df, columns), distinct_texts(df, columns)
    rows = []
    for c in columns:
        ratio = distinct[c] / present[c] if present[c] else 0.0
        rows.append({"column": c, "cardinality_ratio": rounded(ratio, 4), "high_cardinality": ratio > thresholds.high_cardinality})
    return small_frame(df.sparkSession, rows, "column string, cardinality_ratio double, high_cardinality boolean")
