"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (u, v); component is the smallest node reachable.

    Alternating large-star and small-star steps, each a grouped minimum
    (combined before its shuffle) that is joined back; the number of rounds
    grows with the logarithm of the node count. Nodes without links do not
    occur. An empty table gives an empty table.
    """
    links = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        before, mark = mark, _mark(links)
        if before == mark:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return written(links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots))
