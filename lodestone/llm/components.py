"""Connected components of undirected links, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable from each node of `links` (a long, b long).

    Every round takes the smallest label among a node and its neighbours, then the label of that label, so
    long chains take about log rounds. Each round is cut; nothing but a count comes to the driver. Loops
    and repeated links do no harm, links with a null end are left out, and no links give no rows.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        nxt = cut(lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        if nxt.where(F.col("was") != F.col("label")).isEmpty():
            return nxt.select("node", F.col("label").alias("component"))
        labels = nxt.select("node", "label")
