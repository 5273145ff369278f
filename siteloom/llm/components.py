"""Connected components of a link table, by least labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of `links` (a, b); comp is the least node of its component.

    A round gives each node the least label among itself and its neighbours and then the label of that label, so chains
    shorten by more than half each time and stars settle at once. Labels are written each round; nothing is collected but
    the number of changes. Self-links and repeated links are allowed; an empty table has no nodes.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both, "edges")
    labels = saved(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("_near"))
        near = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("comp").alias("_old"), F.least("comp", "_near").alias("_new")
        )
        jump = labels.select(F.col("node").alias("_new"), F.col("comp").alias("_jump"))
        after = near.join(jump, "_new").select("node", "_old", F.least("_new", "_jump").alias("comp"))
        after = saved(after, "labels")
        if after.where("comp <> _old").isEmpty():
            return after.select("node", "comp")
        labels = after.select("node", "comp")
