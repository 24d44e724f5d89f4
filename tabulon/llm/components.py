"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs: every node with the least node that it can reach, as (node, root).

    Each round, a root takes the least root among its members' neighbours, then every label jumps to its label's label;
    the number of rounds grows with the logarithm of a component's width. A node is one row, so a hub costs a sum in
    the map tasks and no group is collected. Every round is written to the shared folder."""
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                         .select("node", F.least("node", "low").alias("root")))
    while True:
        # The least label next to each tree, seen by its root.
        near = both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("near")), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooks = labels.join(near, "node").filter("near < root").groupBy(F.col("root").alias("old")).agg(F.min("near").alias("new"))
        hooks = cut_lineage(hooks)
        if hooks.isEmpty():
            return labels
        hooked = labels.join(hooks, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
        labels = cut_lineage(hooked)
        while True:
            up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
            jumped = labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("next"), "root")
            jumped = cut_lineage(jumped)
            labels = jumped.select("node", F.col("next").alias("root"))
            if jumped.filter(F.col("next") != F.col("root")).isEmpty():
                break
