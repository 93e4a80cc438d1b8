"""Running operators over one global order, without one task seeing all rows.

The order is cut into consecutive buckets of similar size.  A window runs inside
each bucket; what has to cross a bucket border (the last known value, the last
timestamp) is one row per bucket, carried over in a table of one row per
``ROWS_PER_BUCKET`` rows.  Bucket borders come from a sample that grows with the
number of buckets and are a sorted array sent with the plan, so every task and
every retry cuts alike; they only steer balance, never the result.  A row finds
its bucket by binary search, and what belongs to the bucket by its number.  Where many rows have equal order keys, or none, buckets are
cut among them too: by a hash of the whole row.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugework.functions.scalars import storage_kind
from gaugework.session import col, cut_lineage

ROWS_PER_BUCKET = 1_000_000
MIN_ROWS_PER_BUCKET = 5_000
SAMPLE_ROWS = 100_000
SAMPLE_PER_BUCKET = 50

_BUCKET, _KEY, _TIE, _CARRY = "_bucket", "_bucket_key", "_bucket_tie", "_carry"
_MOST_PARTS = 1 << 32


def order_number(df: DataFrame, order_by: str) -> Column:
    """Order-preserving double view of a numeric, date or timestamp column."""
    kind = storage_kind(df.schema[order_by].dataType)
    if kind == "datetime":
        return F.unix_micros(col(order_by).cast("timestamp")).cast("double")
    if kind == "number":
        return col(order_by).cast("double")
    raise ValueError(f"order column '{order_by}' must be a number, date or timestamp")


@dataclass(frozen=True)
class Borders:
    """Values that cut the order into buckets of similar size.

    A value listed several times has that many buckets of its own; rows without
    a key come first, in ``null_parts`` buckets.
    """

    values: list[float]
    null_parts: int = 1


def order_borders(df: DataFrame, order_by: str, buckets: int | None = None) -> Borders:
    """Borders for so many buckets, by default for ``ROWS_PER_BUCKET`` rows in each."""
    keys = df.select(order_number(df, order_by).alias("k"))
    rows, nulls = keys.agg(F.count("k"), F.count_if(F.col("k").isNull())).first()
    if buckets is None:
        parallel = 2 * df.sparkSession.sparkContext.defaultParallelism
        buckets = max(-(-rows // ROWS_PER_BUCKET), min(parallel, rows // MIN_ROWS_PER_BUCKET))
    buckets = int(max(1, buckets))
    null_parts = max(1, -(-nulls // ROWS_PER_BUCKET))
    if buckets == 1:
        return Borders([], null_parts)
    share = min(1.0, max(SAMPLE_ROWS, SAMPLE_PER_BUCKET * buckets) / max(rows, 1))
    sampled = keys.sample(share, seed=17) if share < 1.0 else keys
    cuts = [i / buckets for i in range(1, buckets)]
    found = sampled.agg(F.approx_percentile("k", cuts, 10 * buckets)).first()[0]
    return Borders(sorted(found or []), null_parts)


def _tie(df: DataFrame) -> Column:
    """What orders rows with equal keys: a hash of the whole row."""
    return F.xxhash64(*map(col, df.columns))


def cut_in_order(df: DataFrame, order_by: str, borders: Borders | list[float]) -> DataFrame:
    """Adds ``_bucket``, rising with ``order_by`` and, among equal keys, with ``_tie``."""
    borders = borders if isinstance(borders, Borders) else Borders(list(borders))
    parts = {v: n for v, n in Counter(borders.values).items() if n > 1}
    # a value with buckets of its own is cut off on both sides
    edges = sorted({*borders.values, *(math.nextafter(v, math.inf) for v in parts)})
    tied = df.withColumns({_KEY: order_number(df, order_by), _TIE: _tie(df)})
    if edges:
        splits = [-math.inf, *edges, math.inf]
        cutter = Bucketizer(splits=splits, inputCol=_KEY, outputCol=_BUCKET, handleInvalid="keep")
        tied = cutter.transform(tied).withColumn(_BUCKET, F.col(_BUCKET).cast("bigint") + 1)
    else:
        tied = tied.withColumn(_BUCKET, F.lit(1).cast("bigint"))
    own = F.lit(1)
    if parts:
        # such a value begins the bucket that ends at the next number, so it is alone in it
        counts = np.array([1, *(parts.get(v, 1) for v in edges)], dtype=np.int32)
        own = F.coalesce(F.get(F.lit(counts), (F.col(_BUCKET) - 1).cast("int")), own)
    own = F.when(F.col(_KEY).isNull(), F.lit(borders.null_parts)).otherwise(own)
    place = F.when(F.col(_KEY).isNull(), F.lit(0).cast("bigint")).otherwise(F.col(_BUCKET))
    share = F.col(_TIE) / F.lit(2.0**64) + 0.5
    inner = F.least(F.floor(share * own), own - 1)
    return tied.withColumn(_BUCKET, place * _MOST_PARTS + inner).drop(_KEY)


def fill_in_order(
    df: DataFrame, column: str, order_by: str, backward: bool = False, borders: Borders | list[float] | None = None
) -> DataFrame:
    """Give each NULL the nearest earlier (or, ``backward``, later) known value.

    Rows without an order key come first; rows with equal keys are ordered by a
    hash of their values.
    """
    cut = cut_in_order(df, order_by, order_borders(df, order_by) if borders is None else borders)
    value, order = col(column), F.struct(col(order_by), F.col(_TIE))
    known_at = F.when(value.isNotNull(), order)
    edge = F.min_by(value, known_at) if backward else F.max_by(value, known_at)
    # Backwards it is the same running value over the opposite order: a frame that ends at the last row
    # would be added up anew for each row.
    turn = F.desc_nulls_last if backward else F.asc_nulls_first
    inside = Window.partitionBy(_BUCKET).orderBy(turn(col(order_by)), turn(_TIE))
    near = F.last(value, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    reach = Window.orderBy(turn(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last("_edge", ignorenulls=True).over(reach)
    carried = cut.groupBy(_BUCKET).agg(edge.alias("_edge")).select(_BUCKET, carry.alias(_CARRY))
    filled = cut.withColumn(column, near).join(F.broadcast(carried), _BUCKET, "left")
    return filled.withColumn(column, F.coalesce(value, F.col(_CARRY))).select(*map(col, df.columns))


def day_gaps(df: DataFrame, timestamp: Column, buckets: int | None = None) -> DataFrame:
    """gap_days, count: whole days between consecutive timestamps.

    Equal timestamps are merged first, each repeat being a gap of zero days.
    """
    # NULL is dropped only after the table is written: a filter here would be
    # pushed down and read every timestamp twice.
    counted = df.select(timestamp.alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    times = cut_lineage(counted).filter(F.col("t").isNotNull())
    cut = cut_in_order(times, "t", order_borders(times, "t", buckets))
    inside = Window.partitionBy(_BUCKET).orderBy("t")
    ends = cut.groupBy(_BUCKET).agg(F.max("t").alias("_last"))
    carried = ends.select(_BUCKET, F.lag("_last").over(Window.orderBy(_BUCKET)).alias(_CARRY))
    stepped = cut.withColumn("_before", F.lag("t").over(inside)).join(F.broadcast(carried), _BUCKET, "left")
    before = F.coalesce(F.col("_before"), F.col(_CARRY))
    days = F.floor((F.unix_micros("t") - F.unix_micros(before)) / F.lit(86_400_000_000)).cast("bigint")
    pieces = F.array(
        F.struct(days.alias("gap_days"), F.lit(1).cast("bigint").alias("n")),
        F.struct(F.lit(0).cast("bigint").alias("gap_days"), (F.col("n") - 1).alias("n")),
    )
    return (
        stepped.select(F.explode(pieces).alias("g"))
        .select("g.*")
        .filter(F.col("gap_days").isNotNull() & (F.col("n") > 0))
        .groupBy("gap_days")
        .agg(F.sum("n").alias("count"))
    )
