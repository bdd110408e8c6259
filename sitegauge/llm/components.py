"""Connected components of a graph given as edges, with joins and combinable minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitegauge.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable from each node of ``edges`` (``a, b``, both directions implied).

    Each round takes the smallest label of the neighbours and then the label of that label, so long chains shorten
    quickly; a round's labels are a stored table. Hub nodes only meet minima that are combined before the shuffle and
    joins against one row per node. Loops and repeated edges change nothing; no edges give no rows.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        seen = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        step = labels.select(F.col("node").alias("via"), F.col("component").alias("next"))
        fresh = stored(seen.join(step, "via").select("node", F.least("via", "next").alias("component"), (F.least("via", "next") < F.col("old")).alias("moved")), "labels")
        labels = fresh.drop("moved")
        if fresh.filter("moved").isEmpty():
            return labels
