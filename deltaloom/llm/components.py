"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltaloom.llm.common import cut_at, remove


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38,0)))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), integers: root is the smallest node it reaches.

    Each round rewires every node's larger neighbours to the smallest node near it, then its smaller
    ones, until nothing changes: O(log^2 n) rounds, each a few joins of the edge list with per-node
    minima. Each round is written to the shared folder; self-loops and repeated edges are harmless, rows
    with a null end are left out. No edge list reaches the driver.
    """
    spark = edges.sparkSession
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL")
    loops = pairs.where("a = b").select(F.col("a").alias("node")).distinct()
    now, path = cut_at(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after, after_path = cut_at(small, "small-star")
        remove(spark, path)
        now, path, last, mark = after, after_path, mark, _mark(after)
        if mark == last:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = now.select(F.col("v").alias("node")).distinct()
    alone = roots.unionByName(loops).join(stars.select("node"), "node", "left_anti").distinct()
    return stars.unionByName(alone.select("node", F.col("node").alias("root")))
