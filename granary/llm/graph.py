"""Connected components without collecting the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpoint


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): the smallest node that it is linked to, however far.

    Alternates the large-star and small-star steps: every node's neighbours are hung on its smallest
    neighbour, first the larger ones, then the smaller ones.  A node with many links is summed where its
    links are read, and its rows are dealt out by Spark's skew join.  Ends once nothing changes.
    """
    links = checkpoint(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # Large star: larger neighbours hang on the smallest node around.
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the node and its smaller neighbours hang on the smallest of them.
        floor = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(floor, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpoint(small.unionByName(floor.select(F.col("k").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
