"""Pearson and bias-corrected Cramér's V over all column pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.config import DEFAULTS, Thresholds
from gaugework.functions import scalars as S
from gaugework.operators.contingency import coded_cells
from gaugework.operators.skew import join_on_counted_keys
from gaugework.operators.summary import finite_view, summarise
from gaugework.session import col, cut_lineage, round_small, small_frame

PEARSON_SCHEMA = "col_a string, col_b string, n bigint, value double"
STRIP = 256  # columns whose sums with one column travel in one row
V_SCHEMA = "col_a string, col_b string, n bigint, chi2 double, rows_a bigint, rows_b bigint, value double"


def pearson_pairs(
    df: DataFrame, columns: list[str], summary: dict[str, dict] | None = None, thresholds: Thresholds = DEFAULTS
) -> DataFrame:
    """col_a, col_b (a before b), n shared rows, unrounded r; NULL below the
    shared-row minimum or when a side is constant on the shared rows."""
    if len(columns) < 2:
        return small_frame(df.sparkSession, [], PEARSON_SCHEMA)
    both = _sums(df, columns, summary or summarise(df, columns))
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)
    varied = (F.col("low_x") < F.col("high_x")) & (F.col("low_y") < F.col("high_y")) & (spread > 0)
    r = F.when((n >= thresholds.min_shared_rows) & varied, cov / F.sqrt(spread))
    inside = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    return cut_lineage(both.select(*_pair_names(columns), n.cast("bigint").alias("n"), inside.alias("value")))


_MERGED = {
    "n": F.sum, "sxy": F.sum, "sx": F.sum, "sxx": F.sum, "sy": F.sum, "syy": F.sum,
    "low_x": F.min, "high_x": F.max, "low_y": F.min, "high_y": F.max,
}


def _sums(df: DataFrame, columns: list[str], summary: dict[str, dict], strip: int = STRIP) -> DataFrame:
    """i, j and sums over the rows where both columns have a number, for each pair of columns i < j.

    One scan for any number of columns: each task reduces its rows to k x k
    sums of centred numbers (NumPy matrix products).  It sends them in strips:
    one row holds a column's sums with up to ``strip`` following columns, as
    arrays.  Strips are dealt out whole and added up where they arrive, so there
    is one shuffle, of k * k / ``strip`` rows a task, and no join of the two sides.
    """
    k = len(columns)
    centre = np.array([summary[c]["mean"] or 0.0 for c in columns])
    numbers = df.select(*[finite_view(df, c).alias(f"x{i}") for i, c in enumerate(columns)])

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sx, sxx, sxy = np.zeros((4, k, k))  # [a, b]: of column a, where b is present
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        seen = False
        for batch in batches:
            if not batch.num_rows:
                continue
            seen = True
            raw = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            mask = ~np.isnan(raw)
            x = np.where(mask, raw - centre, 0.0)
            present = mask.astype(float)
            n += present.T @ present
            sx += x.T @ present
            sxx += (x * x).T @ present
            sxy += x.T @ x
            least, most = np.where(mask, raw, np.inf), np.where(mask, raw, -np.inf)
            whole = mask.all(axis=0)
            if whole.any():  # columns without a gap leave the range of the others as it is
                low[:, whole] = np.minimum(low[:, whole], least.min(axis=0)[:, None])
                high[:, whole] = np.maximum(high[:, whole], most.max(axis=0)[:, None])
            for j in np.flatnonzero(~whole & mask.any(axis=0)):
                rows = mask[:, j]
                low[:, j] = np.minimum(low[:, j], least[rows].min(axis=0))
                high[:, j] = np.maximum(high[:, j], most[rows].max(axis=0))
        if seen:
            sides = [n, sxy, sx, sxx, sx.T, sxx.T, low, high, low.T, high.T]
            for a in range(k - 1):
                first = np.arange(a + 1, k, strip, dtype=np.int32)
                ends = pa.array(np.append(first, k) - a - 1, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(m[a, a + 1 :])) for m in sides]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), a, np.int32)), pa.array(first), *lists], names=["i", "first", *_MERGED])

    schema = "i int, first int, " + ", ".join(f"{name} array<double>" for name in _MERGED)
    strips = numbers.mapInArrow(reduce_rows, schema).repartition("i", "first")
    cells = strips.select("i", "first", F.posexplode(F.arrays_zip(*_MERGED)).alias("at", "s")).select("i", "first", "at", "s.*")
    merged = cells.groupBy("i", "first", "at").agg(*[merge(name).alias(name) for name, merge in _MERGED.items()])
    return merged.select("i", (F.col("first") + F.col("at")).alias("j"), *_MERGED)


def pearson(pairs: DataFrame, columns: list[str], diagonal: dict[str, bool]) -> DataFrame:
    """Both triangles and the diagonal, 4 decimals: col_a, col_b, value."""
    spark = pairs.sparkSession
    itself = [{"col_a": c, "col_b": c, "n": None, "value": 1.0 if diagonal[c] else None} for c in columns]
    mirrored = pairs.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "n", "value")
    everything = pairs.unionByName(mirrored).unionByName(small_frame(spark, itself, PEARSON_SCHEMA))
    return round_small(everything.select("col_a", "col_b", "value"), 4, "value")


def diagonal_of(columns: list[str], summary: dict[str, dict], thresholds: Thresholds = DEFAULTS) -> dict[str, bool]:
    """Whether a column correlates with itself: enough rows and some spread."""
    return {
        c: summary[c]["finite"] >= thresholds.min_shared_rows and summary[c]["min"] < summary[c]["max"]
        for c in columns
    }


def pearson_matrix(long: DataFrame, columns: list[str]) -> DataFrame:
    """Wide form: one row per column, 3 decimals as charts show them."""
    return (
        round_small(long, 3, "value")
        .groupBy("col_a")
        .pivot("col_b", list(columns))
        .agg(F.first("value"))
        .withColumnRenamed("col_a", "column")
    )


def contingency(df: DataFrame, columns: list[str]) -> DataFrame:
    """col_a, col_b, value_a, value_b, count over the rows holding both values."""
    cells, labels = coded_cells(df, columns)
    for side, place in (("a", "i"), ("b", "j")):
        named = labels.select(F.col("i").alias(place), F.col("code").alias(f"code_{side}"), F.col("label").alias(f"value_{side}"))
        cells = cells.join(named, [place, f"code_{side}"])
    return cells.select(*_pair_names(columns), "value_a", "value_b", "count")


def _pair_names(columns: list[str]) -> list[Column]:
    names = F.array(*map(F.lit, columns))
    return [F.element_at(names, F.col("i") + 1).alias("col_a"), F.element_at(names, F.col("j") + 1).alias("col_b")]


def cramers_pairs(df: DataFrame, columns: list[str], thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """col_a, col_b, n, chi2, rows_a, rows_b (levels), unrounded V.

    Works on the codes of the labels, whose texts it never needs.  The sum of
    count² / (row total x column total) needs one join, to the column
    totals; the row total is the sum over the very group being summed.  NULL
    below the shared-row minimum; 0 when a side has fewer than two levels.
    """
    if len(columns) < 2:
        return small_frame(df.sparkSession, [], V_SCHEMA)
    pair = ["i", "j"]
    cells, _ = coded_cells(df, columns)
    totals = cells.groupBy(*pair, "code_b").agg(F.sum("count").alias("total_b"), F.count(F.lit(1)).alias("_cells"))
    weighted = join_on_counted_keys(cells, totals, [*pair, "code_b"], "_cells", "inner", ["code_a"])
    share = F.col("count").cast("double") * F.col("count") / F.col("total_b")
    by_a = weighted.groupBy(*pair, "code_a").agg(F.sum(share).alias("share"), F.sum("count").alias("total_a"))
    sides = by_a.groupBy(*pair).agg(
        F.sum(F.col("share") / F.col("total_a")).alias("t"),
        F.sum("total_a").alias("n"),
        F.count(F.lit(1)).alias("rows_a"),
    )
    other = totals.groupBy(*pair).agg(F.count(F.lit(1)).alias("rows_b"))
    chi2 = F.greatest(F.col("n") * (F.col("t") - 1), F.lit(0.0))
    scored = sides.join(other, pair).withColumn("chi2", chi2)
    flat = (F.col("rows_a") < 2) | (F.col("rows_b") < 2)
    v = F.when(flat, 0.0).otherwise(S.corrected_v(F.col("chi2"), F.col("n"), F.col("rows_a"), F.col("rows_b")))
    found = scored.select(
        *pair, "n", "chi2", "rows_a", "rows_b",
        F.when(F.col("n") >= thresholds.min_shared_rows, v).alias("value"),
    )
    k = len(columns)
    places = df.sparkSession.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j"))
    every = places.filter("i < j").join(found, pair, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.select(*_pair_names(columns), "n", "chi2", "rows_a", "rows_b", "value")


def high_pairs(
    pearson_found: DataFrame, cramers_found: DataFrame, thresholds: Thresholds = DEFAULTS, columns: list[str] = ()
) -> DataFrame:
    """col_a, col_b, method, value (4 decimals) of |value| >= 0.9, strongest first; equal ones in
    the order of ``columns``."""
    def strong(frame: DataFrame, method: str) -> DataFrame:
        return frame.filter(F.abs("value") >= thresholds.high_correlation).select(
            "col_a", "col_b", F.lit(method).alias("method"), F.bround("value", 4).alias("value")
        )

    both = strong(pearson_found, "pearson").unionByName(strong(cramers_found, "cramers_v"))
    order = F.array(*map(F.lit, columns)) if columns else F.array().cast("array<string>")
    places = [F.array_position(order, F.col(c)) for c in ("col_a", "col_b")]
    return both.orderBy(F.desc(F.abs("value")), F.desc("method"), *places, "col_a", "col_b")


def align_inner(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_column: str, right_column: str
) -> DataFrame:
    """Pair two columns of different tables by row key: row_id, left, right."""
    a = left.select(col(left_key).alias("row_id"), col(left_column).alias("left"))
    b = right.select(col(right_key).alias("row_id"), col(right_column).alias("right"))
    return a.join(b, "row_id")
