"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import written


def connected_components(links: DataFrame) -> DataFrame:
    """(v, label) for each vertex of links(a, b): label is the smallest vertex that it is linked to, over any path.

    Each round takes the smallest label among neighbours, then the label's own label twice (pointer jumping), so rounds
    follow the logarithm of the longest path. Labels are written every round; the driver sees only how many changed. Joins
    are shuffles however small the tables are: a broadcast of a few rows takes megabytes of the driver, and each round has four.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "v"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("v", "b").hint("merge"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        lower = labels.join(near.hint("merge"), "v").select("v", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        for _ in range(2):
            top = lower.select(F.col("v").alias("label"), F.col("label").alias("top"))
            lower = lower.join(top.hint("merge"), "label").select("v", "before", F.col("top").alias("label"))
        found = written(lower, "labels")
        labels = found.select("v", "label")
        if found.filter("before <> label").isEmpty():
            return labels
