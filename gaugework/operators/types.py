"""Semantic types: what a column holds, whatever it is stored as.

Shares of rows and distinct counts come from the summary, which reads each
distinct text once.  Only the columns of labels need another scan, for labels
that differ in case or blanks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from gaugework.config import DEFAULTS, Thresholds
from gaugework.operators.frequency import normal_counts, raw_and_normal
from gaugework.operators.stats import present_counts
from gaugework.operators.summary import summarise
from gaugework.session import small_frame

TYPES_SCHEMA = "column string, storage_type string, inferred_type string, type_mismatch boolean"
NUMERIC_TYPES = ("numeric", "mixed")
CATEGORY_TYPES = ("categorical", "boolean")


def _from_shares(facts: dict, iso_dates_typed: bool, t: Thresholds) -> tuple[str, bool] | None:
    """Type and mismatch when storage or row shares settle it, else None."""
    kind = facts["kind"]
    if kind in ("boolean", "datetime"):
        return kind, False
    if kind == "number":
        return "numeric", False
    present = facts["rows"] - facts["nulls"]
    if present == 0:
        return "categorical", False
    if kind != "string":
        return None
    if facts["words"] == present and facts["word_low"] != facts["word_high"]:
        return "boolean", True
    share = facts["numbers"] / present
    if share == 1.0:
        return "numeric", True
    if share >= t.numeric_share:
        return "mixed", True
    if share < t.datetime_skip_share and facts["dates"] / present >= t.datetime_share:
        iso = facts["iso"] == present and facts["zoned"] in (0, present)
        return "datetime", not (iso_dates_typed and iso)
    return None


def infer_types(
    df: DataFrame,
    summary: dict[str, dict],
    iso_dates_typed: bool = False,
    thresholds: Thresholds = DEFAULTS,
) -> dict[str, dict]:
    """{column: storage_type, inferred_type, type_mismatch, distinct when counted}."""
    found = {c: _from_shares(f, iso_dates_typed, thresholds) for c, f in summary.items()}
    few = {
        c: f["distinct"] / f["present"] <= thresholds.high_cardinality
        for c, f in summary.items() if found[c] is None and f["kind"] == "string"
    }
    normal = normal_counts(df, [c for c, labels in few.items() if labels])
    result = {}
    for name, facts in summary.items():
        own = {"storage_type": df.schema[name].dataType.simpleString()}
        if name in normal:
            own["distinct_normal"] = normal[name]
            kind = ("categorical", normal[name] < facts["distinct"])
        else:
            kind = found[name] or ("text", False)
        own |= {"distinct": facts["distinct"]} if "distinct" in facts else {}
        result[name] = own | dict(zip(("inferred_type", "type_mismatch"), kind))
    return result


def detect_types(
    df: DataFrame,
    columns: list[str] | None = None,
    iso_dates_typed: bool = False,
    thresholds: Thresholds = DEFAULTS,
) -> DataFrame:
    """One row per column: column, storage_type, inferred_type, type_mismatch.

    ``iso_dates_typed`` says the table came from CSV, which has no date type, so
    all-ISO date text is not a mismatch.
    """
    summary = summarise(df, columns)
    types = infer_types(df, summary, iso_dates_typed, thresholds)
    rows = [
        {"column": c} | {k: v for k, v in types[c].items() if not k.startswith("distinct")} for c in summary
    ]
    return small_frame(df.sparkSession, rows, TYPES_SCHEMA)


def parse_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """What the rules look at, per text column: the share of present values that
    parse as number or date, whether all are yes/no words, whether all are ISO
    dates in one zone convention."""
    rows = []
    for c, f in summarise(df, columns).items():
        present = f["rows"] - f["nulls"]
        rows.append(
            {
                "column": c,
                "present": present,
                "is_boolean": bool(present) and f["words"] == present and f["word_low"] != f["word_high"],
                "numeric_share": f["numbers"] / present if present else None,
                "datetime_share": f["dates"] / present if present else None,
                "all_iso": bool(present) and f["iso"] == present and f["zoned"] in (0, present),
            }
        )
    schema = (
        "column string, present bigint, is_boolean boolean, numeric_share double, "
        "datetime_share double, all_iso boolean"
    )
    return small_frame(df.sparkSession, rows, schema)


def label_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, present, distinct_raw, distinct_normal, cardinality_ratio, case_inconsistent."""
    raw, normal = raw_and_normal(df, columns)
    rows = []
    for c, present in present_counts(df, columns).items():
        rows.append(
            {
                "column": c,
                "present": present,
                "distinct_raw": raw[c],
                "distinct_normal": normal[c],
                "cardinality_ratio": raw[c] / present if present else 0.0,
                "case_inconsistent": normal[c] < raw[c],
            }
        )
    schema = (
        "column string, present bigint, distinct_raw bigint, distinct_normal bigint, "
        "cardinality_ratio double, case_inconsistent boolean"
    )
    return small_frame(df.sparkSession, rows, schema)
