"""Graph operators: reachability, shortest paths, site graph, ego graph."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..cluster import cut_lineage, scratch_path
from ..functions import urls


class _Hops:
    """A table that grows by one folder per hop; earlier hops are read, never written again."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path, self.schema = spark, scratch_path(spark, label), None

    def add(self, rows: DataFrame, hop: int) -> DataFrame:
        self.schema = self.schema or rows.schema
        rows.write.parquet(f"{self.path}/hop={hop}")
        return self.at(hop)

    def at(self, hop: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/hop={hop}")

    def all(self) -> DataFrame:
        hop = T.StructField("hop", T.IntegerType())
        return self.spark.read.schema(T.StructType([*self.schema.fields, hop])).option("basePath", self.path).parquet(self.path)


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """Nodes reachable from ``start`` along ``edges`` (src, dst), with the number of hops.

    One keyed join per round, which writes the nodes it finds new and nothing
    else; the loop ends when a round finds none.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    visited = _Hops(edges.sparkSession, "reachable")
    frontier = visited.add(links.where(F.col("src") == start).select(F.col("dst").alias("node")).distinct(), 1)
    for hop in itertools.count(2):
        step = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = visited.add(step.join(visited.all().select("node"), "node", "left_anti"), hop)
        if frontier.isEmpty():
            return visited.all().select("node", F.col("hop").alias("hops"))


def shortest_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """Edges of the shortest path, in order; empty when there is none.

    ``edges``: src, dst, seq. Among paths of equal length the one with the
    earliest edges wins, compared edge by edge from the start.

    Forward, each hop writes the nodes it reaches first. Backward from the goal,
    only nodes on shortest paths are kept. Then the path is walked from the
    start: of the edges that stay on shortest paths the earliest is taken.
    """
    spark = edges.sparkSession
    links = cut_lineage(edges.groupBy("src", "dst").agg(F.min("seq").alias("seq")))
    schema = T.StructType([T.StructField("step", T.IntegerType()), *links.select("src", "dst", "seq").schema.fields])
    if start == goal:
        return spark.createDataFrame([], schema)
    visited = _Hops(spark, "paths")
    frontier, length = visited.add(spark.createDataFrame([(start,)], "node string"), 0), None
    for hop in itertools.count(1):
        step = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        frontier = visited.add(step.join(visited.all().select("node"), "node", "left_anti"), hop)
        if not frontier.where(F.col("node") == goal).isEmpty():
            length = hop
            break
        if frontier.isEmpty():
            return spark.createDataFrame([], schema)
    # edges between neighbouring hops that lead on to the goal
    useful = _Hops(spark, "useful")
    ahead = spark.createDataFrame([(goal,)], "dst string")
    for hop in range(length, 0, -1):
        here = visited.at(hop - 1).select(F.col("node").alias("src"))
        kept = useful.add(links.join(ahead, "dst", "left_semi").join(here, "src", "left_semi").select("src", "dst", "seq"), hop)
        ahead = kept.select(F.col("src").alias("dst")).distinct()
    rows, at = [], start
    for hop in range(1, length + 1):
        first = useful.at(hop).where(F.col("src") == at).orderBy("seq", "src", "dst").first()
        rows.append((hop, first["src"], first["dst"], first["seq"]))
        at = first["dst"]
    return spark.createDataFrame(rows, schema)


def site_graph(endpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of URL paths and their parent paths.

    ``endpoints``: url, method, status_code, param_count, seq.
    """
    path = F.coalesce(F.nullif(urls.path(F.col("url")), F.lit("")), F.lit("/"))
    rows = endpoints.withColumn("path", path)
    nodes = rows.groupBy("path").agg(
        F.min_by(F.struct("method", "status_code"), "seq").alias("f"), F.max("param_count").alias("params")
    ).select("path", "f.method", "f.status_code", "params")
    edges = nodes.where(F.col("path") != "/").select(urls.parent_path(F.col("path")).alias("source"), F.col("path").alias("target"))
    missing = edges.select(F.col("source").alias("path")).distinct().join(nodes, "path", "left_anti")
    extra = missing.select("path", F.lit("").alias("method"), F.lit(None).cast("int").alias("status_code"), F.lit(0).cast("long").alias("params"))
    every = nodes.unionByName(extra)
    depth = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    return every.withColumn("depth", depth), edges


def ego_graph(endpoints: DataFrame, focus: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a path, its parent, children and siblings."""
    path = F.coalesce(F.nullif(urls.path(F.col("url")), F.lit("")), F.lit("/"))
    known = endpoints.select(path.alias("path")).distinct()
    up = focus.rstrip("/").rsplit("/", 1)[0] or "/" if focus != "/" else ""
    parent = F.when(F.col("path") == "/", "").otherwise(urls.parent_path(F.col("path")))
    near = (parent == focus) | (parent == up if up else F.lit(False))
    fixed = [focus] + ([up] if up else [])
    anchors = endpoints.sparkSession.createDataFrame([(p,) for p in fixed], "path string")
    nodes = known.where(near & ~F.col("path").isin(fixed)).union(anchors).distinct()
    rows = nodes.where(F.col("path") != "/").select(parent.alias("source"), F.col("path").alias("target"))
    edges = rows.join(nodes.select(F.col("path").alias("source")), "source", "left_semi")
    return nodes.withColumn("is_focus", F.col("path") == focus), edges
