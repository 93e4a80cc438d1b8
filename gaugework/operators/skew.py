"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.session import col, cut_lineage

ROWS_PER_TASK = 2_000_000

_SALT, _PARTS = "_salt", "_parts"


def join_on_counted_keys(
    rows: DataFrame,
    keys: DataFrame,
    on: list[str],
    weight: str,
    how: str,
    spread_by: list[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ``rows`` to ``keys`` (one row per key, ``weight`` = rows having it).

    A key with more than ``rows_per_task`` rows is cut into as many sub-keys as
    its weight asks for, and repeated once for each.  There are at most (rows /
    ``rows_per_task``) such keys, which bounds the broadcast of their list.
    ``keys`` are written once, since three branches read them.  ``how`` may be
    left_semi, left_anti, inner or left.
    """
    keys = cut_lineage(keys)
    heavy = keys.filter(F.col(weight) > rows_per_task)
    parts = F.ceil(F.col(weight) / F.lit(rows_per_task)).cast("int")
    hot = heavy.select(*map(col, on), parts.alias(_PARTS))
    scatter = F.pmod(F.xxhash64(*[col(c) for c in spread_by]), F.col(_PARTS)).cast("int")
    salted_rows = rows.join(F.broadcast(hot), on, "left").withColumn(_SALT, F.coalesce(scatter, F.lit(0))).drop(_PARTS)
    kept = [c for c in keys.columns if c != weight or how in ("inner", "left")]
    salts = F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)
    salted_keys = keys.withColumn(_SALT, F.explode(salts)).select(*map(col, kept), _SALT)
    return salted_rows.join(salted_keys, [*on, _SALT], how).drop(_SALT)
