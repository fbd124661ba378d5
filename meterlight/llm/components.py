"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlight.llm.stored import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node that is no root.

    ``edges`` has two columns of longs in any direction, repeats and loops included. Every round
    first links each node's larger neighbours to its smallest one, then each node's smaller
    neighbours; the number of rounds grows with the logarithm of the largest component. Minima
    combine on the map side and are stored before they are joined, so that a node with very many
    neighbours is a skewed join that Spark can split. Nothing but a count reaches the driver.
    """
    a, b = edges.columns
    pairs = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    now, seen = stored(pairs.distinct(), "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = stored(least.select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "edges")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
