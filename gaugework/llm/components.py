"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugework.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node that can be reached; nodes without an edge do not appear.

    Each round takes the smallest label among the neighbours, hands it to the node's label
    too, then follows labels of labels, so chains shrink by halves.  Sums over a hub's edges are combined before
    the shuffle; joins have the labels, unique by node, on one side.  Each round is written to
    the shared folder.  Null ends are ignored; an empty table gives an empty result.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = cut_lineage(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    state = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")))
    while True:
        of = state.select(F.col("node").alias("v"), F.col("label").alias("near"))
        near = both.join(of, "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        hooked = state.join(near, "node")
        # the label's own node learns of the smaller label as well
        offers = hooked.select("node", F.least("label", "near").alias("label")).unionByName(
            hooked.select(F.col("label").alias("node"), F.least("label", "near").alias("label"))
        )
        merged = cut_lineage(offers.groupBy("node").agg(F.min("label").alias("label")))
        jump = merged.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = cut_lineage(merged.join(jump, "label").select("node", F.col("further").alias("label")))
        changed = after.join(state.withColumnRenamed("label", "old"), "node").where("label != old")
        if changed.isEmpty():
            return after
        state = after
