"""Cleaning steps that need nothing but the row itself, for streaming tables.

Type fixes, constant fills and capping at given fences keep no state, so they
are the batch expressions unchanged; everything else needs the whole table and
is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.functions.scalars import as_number, storage_kind
from gaugework.operators import cleaning
from gaugework.session import col


def cap_at(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Clip to known fences."""
    x = as_number(col(column), storage_kind(df.schema[column].dataType))
    return df.withColumn(column, F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high))))


def clean_stream(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Apply stateless steps to a streaming (or batch) DataFrame."""
    for step in steps:
        action, strategy = step["action"], step.get("strategy")
        if action == "handle_missing" and strategy in ("fill_constant", "drop_rows", "drop_column"):
            df = cleaning.handle_missing(df, strategy, step["column"], step.get("value"))
        elif action == "fix_type" and step["target_type"] != "datetime":
            df = cleaning.fix_types(df, step["column"], step["target_type"])
        elif action == "fix_type":  # the zone check needs all rows, so it is left out here
            df = df.withColumn(step["column"], cleaning.converted(df, step["column"], "datetime"))
        elif action == "handle_outliers" and strategy == "cap_iqr" and "fences" in step:
            df = cap_at(df, step["column"], *step["fences"])
        else:
            raise ValueError(f"step needs the whole table and cannot run on a stream: {step}")
    return df
