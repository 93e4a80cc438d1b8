"""Cleaning steps: DataFrame in, DataFrame out; the input is never changed.

Statistics a step needs (a mean, fences) are one aggregate over the current
table.  Row ids of outliers come as a DataFrame and are matched by a join.

Each step comes in two forms.  ``plan_*`` works out the statistics and returns
the transform, to be given to ``DataFrame.transform``; the others apply it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.config import DEFAULTS, ROW_ID, Thresholds
from gaugework.functions import scalars as S
from gaugework.operators.ordered import fill_in_order, order_borders
from gaugework.operators.outliers import fences
from gaugework.operators.quantiles import exact_quantiles
from gaugework.operators.summary import finite_view, number_view
from gaugework.session import col

MISSING_STRATEGIES = (
    "drop_rows", "drop_column", "fill_mean", "fill_median", "fill_mode", "fill_constant", "ffill", "bfill",
)
TYPE_TARGETS = ("numeric", "datetime", "categorical", "string", "boolean", "lowercase")
OUTLIER_STRATEGIES = ("remove", "cap_iqr", "replace_nan")
Transform = Callable[[DataFrame], DataFrame]


# -- missing values ----------------------------------------------------------


def handle_missing(
    df: DataFrame, strategy: str, column: str, value=None, order_by: str = ROW_ID
) -> DataFrame:
    """Drop or fill the missing values of one column.

    ``order_by`` gives ffill and bfill their row order.
    """
    return df.transform(plan_missing(df, strategy, column, value, order_by))


def plan_missing(df: DataFrame, strategy: str, column: str, value=None, order_by: str = ROW_ID) -> Transform:
    if strategy == "drop_rows":
        return lambda t: t.filter(_nan_free(t, column).isNotNull())
    if strategy == "drop_column":
        return lambda t: t.drop(column)
    if strategy in ("fill_mean", "fill_median"):
        return _plan_fill(df, column, center(df, column, strategy))
    if strategy == "fill_mode":
        return _plan_fill(df, column, mode_of(df, column))
    if strategy == "fill_constant":
        return _plan_fill(df, column, value)
    if strategy in ("ffill", "bfill"):
        borders = order_borders(df, order_by)
        return lambda t: fill_in_order(t, column, order_by, strategy == "bfill", borders)
    raise ValueError(f"Unknown strategy '{strategy}'")


def _plan_fill(df: DataFrame, column: str, value) -> Transform:
    """NULL (or NaN) cells get ``value``, written in the column's own type where
    that keeps it; a fraction put into a whole-number column makes it double."""
    if value is None:
        return lambda t: t
    stored = df.schema[column].dataType
    kind = stored.simpleString()
    if S.storage_kind(stored) == "number":
        value = _as_fill_number(value, column)
    filler = F.lit(value)
    if stored.typeName() in ("byte", "short", "integer", "long") and float(value) != int(float(value)):
        kind = "double"
    if stored.typeName() == "string":
        filler = _number_text(filler)
    return lambda t: t.withColumn(column, F.coalesce(_nan_free(t, column).cast(kind), filler.cast(kind)))


def _as_fill_number(value, column: str):
    """The fill value of a number column; a text must hold a number."""
    if not isinstance(value, str):
        return value
    try:
        return float(value.strip())
    except ValueError:
        raise ValueError(f"'{column}' holds numbers, so '{value}' cannot fill it; convert the column to text first") from None


def _number_text(value: Column) -> Column:
    """Text of a fill value; whole numbers lose the trailing ``.0``."""
    return F.regexp_replace(value.cast("string"), r"^(-?\d+)\.0$", "$1")


def _nan_free(df: DataFrame, column: str) -> Column:
    floating = df.schema[column].dataType.typeName() in ("float", "double")
    return S.nan_to_null(col(column)) if floating else col(column)


def center(df: DataFrame, column: str, strategy: str) -> float:
    """Mean or median of the finite numbers, rounded half to even when all of
    them are whole."""
    numbers, finite = number_view(df, column), finite_view(df, column)
    seen, count, mean, whole = df.agg(
        F.count(numbers), F.count(finite), F.avg(finite), F.bool_and(finite % 1 == 0)
    ).first()
    if not seen:
        raise ValueError(f"no cell of '{column}' reads as a number, so {strategy} has nothing to work from; pick another strategy")
    if not count:
        raise ValueError(f"all numbers of '{column}' are infinite, so {strategy} has nothing to work from; treat them as outliers first")
    if strategy == "fill_median":
        mean = exact_quantiles(df, {column: finite}, (0.5,), {column: count})[column][0]
    return float(round(mean)) if whole else mean


def mode_of(df: DataFrame, column: str):
    """Most frequent value, the smallest among equals; None when there is none."""
    counted = df.select(_nan_free(df, column).alias("v")).filter(F.col("v").isNotNull())
    top = counted.groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("v")).first()
    return None if top is None else top["v"]


# -- duplicates --------------------------------------------------------------


def remove_duplicates(df: DataFrame, keep: str = "first", row_id: str = ROW_ID) -> DataFrame:
    """Keep the first or last row of each group of exact copies, or none of it.

    One aggregation keyed by the row itself: copies are merged before the
    shuffle, however many there are, and the kept row is the group's key.
    Without a row-id column the rows themselves are all that can be kept.
    """
    if row_id not in df.columns:
        if keep in ("first", "last"):
            return df.dropDuplicates()
        counted = df.groupBy(*map(col, df.columns)).agg(F.count(F.lit(1)).alias("_copies"))
        return counted.filter(F.col("_copies") == 1).drop("_copies")
    data = [c for c in df.columns if c != row_id]
    pick = F.max if keep == "last" else F.min
    grouped = df.groupBy(*map(col, data)).agg(pick(col(row_id)).alias(row_id), F.count(F.lit(1)).alias("_copies"))
    if keep not in ("first", "last"):
        grouped = grouped.filter(F.col("_copies") == 1)
    return grouped.select(*map(col, df.columns))


# -- types -------------------------------------------------------------------


def fix_types(df: DataFrame, column: str, target_type: str) -> DataFrame:
    """Convert one column; cells that do not convert become NULL."""
    return df.transform(plan_type(df, column, target_type))


def plan_type(df: DataFrame, column: str, target_type: str) -> Transform:
    if target_type not in TYPE_TARGETS:
        raise ValueError(f"Unknown target_type '{target_type}'")
    if target_type == "datetime" and S.storage_kind(df.schema[column].dataType) == "string":
        _one_zone_convention(df, column)
    return lambda t: t.withColumn(column, converted(t, column, target_type))


def converted(df: DataFrame, column: str, target_type: str) -> Column:
    c = col(column)
    kind = S.storage_kind(df.schema[column].dataType)
    if target_type == "numeric":
        if kind == "number":
            return S.as_number(c, kind)
        # other storage goes through its text: a boolean or a timestamp reads as no number
        return S.text_to_number(F.regexp_replace(c.cast("string"), f"[,$%€£\\s{S.BLANKS}]", ""))
    if target_type == "datetime":
        if kind == "number":  # nanoseconds since 1970
            return F.timestamp_micros(F.floor(S.finite(S.as_number(c, kind)) / 1000).cast("bigint"))
        return S.as_timestamp(c, kind)
    if target_type in ("categorical", "string"):
        return c.cast("string")
    if target_type == "boolean":
        return c if kind == "boolean" else S.text_to_boolean(c.cast("string"))
    return S.normal_label(c.cast("string"))


def _one_zone_convention(df: DataFrame, column: str) -> None:
    c = col(column)
    parsed = S.text_to_timestamp(c).isNotNull()
    zoned, plain = df.agg(
        F.count_if(parsed & S.has_zone(c)), F.count_if(parsed & ~S.has_zone(c))
    ).first()
    if zoned and plain:
        raise ValueError(f"some timestamps of '{column}' name their offset from UTC and others do not; make them agree before converting")


# -- outliers ----------------------------------------------------------------


def id_frame(df: DataFrame, ids: DataFrame | Iterable, row_id: str = ROW_ID) -> DataFrame:
    """Row ids as a one-column DataFrame; a short list of ids is accepted too."""
    if isinstance(ids, DataFrame):
        return ids.select(col(row_id)).distinct()
    kind = df.schema[row_id].dataType
    return df.sparkSession.createDataFrame([(i,) for i in ids], f"`{row_id}` {kind.simpleString()}").distinct()


def handle_outliers(
    df: DataFrame,
    column: str,
    ids: DataFrame | Iterable,
    strategy: str,
    row_id: str = ROW_ID,
    thresholds: Thresholds = DEFAULTS,
) -> DataFrame:
    """remove the rows, cap the column at its fences, or null the cells.

    Ids that are not in the table are ignored.  Capping clips every value of the
    column, infinite ones too; text that is no number becomes NULL.
    """
    return df.transform(plan_outliers(df, column, ids, strategy, row_id, thresholds))


def plan_outliers(
    df: DataFrame,
    column: str,
    ids: DataFrame | Iterable,
    strategy: str,
    row_id: str = ROW_ID,
    thresholds: Thresholds = DEFAULTS,
) -> Transform:
    if strategy == "cap_iqr":
        q1, q3 = exact_quantiles(df, {column: finite_view(df, column)}, (0.25, 0.75))[column]
        if q1 is None:
            return lambda t: t.withColumn(column, number_view(t, column))
        low, high = fences(q1, q3, thresholds)

        def cap(t: DataFrame) -> DataFrame:
            x = number_view(t, column)
            return t.withColumn(column, F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high))))

        return cap
    hits = id_frame(df, ids, row_id)
    if strategy == "remove":
        return lambda t: t.join(hits, row_id, "left_anti").select(*map(col, t.columns))
    if strategy == "replace_nan":

        def clear(t: DataFrame) -> DataFrame:
            marked = t.join(hits.withColumn("_hit", F.lit(True)), row_id, "left")
            kept = F.when(F.col("_hit").isNull(), col(column))
            return marked.withColumn(column, kept).select(*map(col, t.columns))

        return clear
    raise ValueError(f"Unknown strategy '{strategy}'")
