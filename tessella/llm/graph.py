"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, comp) of every node of edges (a, b): comp is the smallest id it reaches.

    Alternates large-star and small-star steps on written tables until nothing
    changes; the number of rounds grows with the logarithm of the graph. A node with
    many links is pre-aggregated in its minimum and, in joins, split by Spark.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    links = scratch.save(edges.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), f"{name}-0")
    mark, step = None, 0
    while True:
        now = links.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if now == mark:
            break
        mark, step = now, step + 1
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        least = scratch.save(least, f"{name}-large-min")
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"{name}-large")
        least = scratch.save(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), f"{name}-small-min")
        found = large.join(least, F.col("u") == F.col("w"))
        small = found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        links = scratch.save(small.distinct(), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-large", f"{name}-large-min", f"{name}-small-min")
    nodes = links.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return nodes.unionByName(nodes.select(F.col("comp").alias("id"), "comp").distinct())
