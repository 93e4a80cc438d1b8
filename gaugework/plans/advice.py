"""From a profile to cleaning steps, and from before to after."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.operators.cleaning import MISSING_STRATEGIES, OUTLIER_STRATEGIES, TYPE_TARGETS
from gaugework.plans.pipeline import step_priority
from gaugework.plans.profile import Profile
from gaugework.session import small_frame

# The order in which strategies are offered.
_ANY_COLUMN = ("drop_rows", "drop_column", "fill_mode", "fill_constant", "ffill", "bfill")


def strategy_options(table: DataFrame) -> DataFrame:
    """column, missing_options, type_options, outlier_options.

    Mean and median need a column with numbers; lower case is for categories;
    options are empty where there is nothing to fix.
    """
    numeric = F.col("inferred_type").isin("numeric", "mixed")
    nothing = F.array().cast("array<string>")

    def options(names) -> Column:
        return F.array(*map(F.lit, names))

    filled = F.when(numeric & F.col("mean").isNotNull(), options(MISSING_STRATEGIES)).otherwise(options(_ANY_COLUMN))
    typed = F.when(F.col("inferred_type") == "categorical", options(TYPE_TARGETS)).otherwise(
        options([t for t in TYPE_TARGETS if t != "lowercase"])
    )
    return table.select(
        "column",
        F.when(F.col("missing_count") > 0, filled).otherwise(nothing).alias("missing_options"),
        F.when(F.col("type_mismatch"), typed).otherwise(nothing).alias("type_options"),
        F.when(numeric & (F.col("iqr_count") > 0), options(OUTLIER_STRATEGIES)).otherwise(nothing).alias("outlier_options"),
    )


def suggest_plan(profile: Profile, choices: Mapping, table: DataFrame | None = None) -> list[dict]:
    """Cleaning steps for what the profile found, in the order they should run.

    ``choices`` says what to do: ``missing``, ``types`` and ``outliers`` map a
    column (or ``*`` for every column having the problem) to a strategy;
    ``constants`` holds fill values, ``duplicates`` is first, last or none, and
    ``method`` picks iqr or zscore outliers.  Columns without the problem, and
    strategies that do not suit the column, are left out.
    """
    table = profile.column_table(with_patterns=False, with_distributions=False) if table is None else table
    offered = strategy_options(table).collect()
    method = choices.get("method", "iqr")
    steps: list[dict] = []

    def chosen(group: str, column: str, options: list[str]) -> str | None:
        wanted = choices.get(group, {})
        strategy = wanted.get(column, wanted.get("*"))
        return strategy if strategy in options else None

    for row in offered:
        strategy = chosen("missing", row["column"], row["missing_options"])
        step = {"action": "handle_missing", "column": row["column"], "strategy": strategy}
        if strategy == "fill_constant":
            value = choices.get("constants", {}).get(row["column"])
            if value is None or not str(value).strip():
                continue
            step["value"] = value
        if strategy:
            steps.append(step)
    if choices.get("duplicates") and profile.exact_duplicates["exact_count"]:
        steps.append({"action": "remove_duplicates", "keep": choices["duplicates"]})
    for row in offered:
        target = chosen("types", row["column"], row["type_options"])
        if target:
            steps.append({"action": "fix_type", "column": row["column"], "target_type": target})
    for row in offered:
        strategy = chosen("outliers", row["column"], row["outlier_options"])
        if strategy:
            ids = profile.outlier_rows(method, [row["column"]]).select(profile.row_id)
            steps.append(
                {"action": "handle_outliers", "column": row["column"], "strategy": strategy, "ids": ids}
            )
    return sorted(steps, key=step_priority)


def before_after(before: Profile, after: Profile) -> DataFrame:
    """metric, before, after (as text), delta for rows, columns, gaps, copies, score and grade."""
    old, new = before.dataset_summary().first(), after.dataset_summary().first()
    old_copies, new_copies = before.exact_duplicates["exact_count"], after.exact_duplicates["exact_count"]
    metrics = [
        ("rows", old["rows"], new["rows"]),
        ("columns", old["columns"], new["columns"]),
        ("missing_cells", old["total_missing_cells"], new["total_missing_cells"]),
        ("exact_duplicates", old_copies, new_copies),
        ("quality_score", old["quality_score"], new["quality_score"]),
    ]
    rows = [{"metric": m, "before": str(a), "after": str(b), "delta": int(b) - int(a)} for m, a, b in metrics]
    rows.append({"metric": "quality_grade", "before": old["quality_grade"], "after": new["quality_grade"], "delta": None})
    return small_frame(before.spark, rows, "metric string, before string, after string, delta bigint")
