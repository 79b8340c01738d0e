"""Connected components over a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..cluster import scratch_path


def connected(links: DataFrame) -> DataFrame:
    """node, component (smallest node) for every node of ``links`` (a, b: long); self links are left out.

    Each round points nodes at the smallest neighbour; links of a node with many
    neighbours are rewritten one by one and never gathered. Rounds are few (they
    grow with the logarithm of the longest path) and end when nothing changes.
    Every round is written to the shared folder.
    """
    spark = links.sparkSession
    folder = scratch_path(spark, "components")
    step = 0

    def stored(df: DataFrame) -> DataFrame:
        nonlocal step
        path = f"{folder}/{step}"
        step += 1
        df.write.parquet(path)
        return spark.read.parquet(path)

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """edges: u > v. Large: larger neighbours to the smallest one; small: the smaller ones and the node itself."""
        seen = edges.select(F.col("u").alias("c"), F.col("v").alias("o"))
        if large:
            seen = seen.union(edges.select(F.col("v").alias("c"), F.col("u").alias("o")))
        least = seen.groupBy("c").agg(F.min("o").alias("m")).withColumn("m", F.least("c", "m"))
        joined = seen.join(least, "c")
        if large:
            moved = joined.where("o > c").select(F.col("o").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("o").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first())

    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, now = None, mark(edges)
    while now != before:
        edges = stored(star(star(edges, True), False))
        before, now = now, mark(edges)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
