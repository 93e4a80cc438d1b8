"""Contiguous shards of nearly equal bytes, from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gaugework.session import cut_lineage

SHARDS = 8
PART = 100_000  # rows of a part, about


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, size: str = "size") -> DataFrame:
    """``docs`` with shard (0 to ``shards`` - 1) and slot, its place in the shard, gapless from 0.

    Rows are in order of doc_id (nulls first, rows of one doc_id in the order they are read).  The order is cut into
    parts; the parts' totals, summed up, give each row the bytes and rows before it.  A row belongs to the shard in whose
    share of all bytes its middle lies, so shards differ by less than a row's size.  Negative and null sizes
    count as 0; if all sizes are 0, rows are shared by number.  An empty table gives an empty result.  Columns named shard
    or slot are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot", "_order", "_part", "_bytes", "_rows", "_lead")
    weight = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    dealt = docs.withColumns({"_order": F.monotonically_increasing_id(), "_bytes": weight})
    rows = dealt.count()
    dealt = dealt.repartitionByRange(max(1, -(-rows // PART), 2 * spark.sparkContext.defaultParallelism), "doc_id", "_order")
    parts = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(F.sum("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_rows")).collect()
    before, bytes_before, rows_before = [], 0, 0
    for part, held, n in sorted(map(tuple, totals)):
        before.append((part, bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + held, rows_before + n
    leads = F.broadcast(spark.createDataFrame(before, "_part int, _lead long, _rows long"))
    inside = Window.partitionBy("_part").orderBy("doc_id", "_order").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_bytes").over(inside), F.lit(0)) + F.col("_lead")
    middle = (2 * ahead + F.col("_bytes")) / (2 * max(1, bytes_before))
    if not bytes_before:
        middle = (F.col("slot") + 0.5) / max(1, rows_before)
    numbered = parts.join(leads, "_part").withColumn("slot", F.count(F.lit(1)).over(inside) + F.col("_rows"))
    placed = cut_lineage(numbered.withColumn("shard", F.least(F.floor(middle * shards), F.lit(shards - 1)).cast("int")))
    first = F.broadcast(placed.groupBy("shard").agg(F.min("slot").alias("_lead")))  # one row per shard
    return placed.drop("_lead").join(first, "shard").select(
        *docs.columns, "shard", (F.col("slot") - F.col("_lead")).alias("slot")
    )
