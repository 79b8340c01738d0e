"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from . import sqlkit as q, views
from .registry import query
from .surface import counted


def edges(spark, sf):
    return views.table(spark, sf, "state_edge")


@query("grf_01_reachable_states", """
WITH RECURSIVE r AS (SELECT dst AS node FROM state_edge WHERE src = 'n7' UNION SELECT e.dst FROM r JOIN state_edge e ON e.src = r.node) SELECT node FROM r""")
def grf_01(spark, sf):
    return graph.reachable(edges(spark, sf), "n7").select("node")


@query("grf_02_shortest_path", """
WITH RECURSIVE p AS (SELECT dst AS node, [seq] AS seqs, 1 AS n FROM state_edge WHERE src = 'n7'
  UNION ALL SELECT node, seqs, n FROM (SELECT e.dst AS node, list_append(p.seqs, e.seq) AS seqs, p.n + 1 AS n FROM p JOIN state_edge e ON e.src = p.node WHERE p.n < 12
    QUALIFY row_number() OVER (PARTITION BY e.dst ORDER BY list_append(p.seqs, e.seq)) = 1) s),
b AS (SELECT seqs FROM p WHERE node = 'n100' ORDER BY n, seqs LIMIT 1)
SELECT i AS step, e.src, e.dst, e.seq FROM (SELECT unnest(seqs) AS seq, unnest(range(1, len(seqs) + 1)) AS i FROM b) s JOIN state_edge e USING (seq)""")
def grf_02(spark, sf):
    return graph.shortest_path(edges(spark, sf), "n7", "n100")


DUCK = views.DUCK
DUCK["node_v"] = f"""SELECT {q.path('url')} AS path, arg_min(method, seq) AS method, arg_min(status_code, seq) AS status_code, max(param_count) AS params FROM counted_v GROUP BY 1"""
DUCK["site_edge_v"] = f"SELECT {q.parent('path')} AS source, path AS target FROM node_v WHERE path <> '/'"


@query("grf_03_site_graph", """
SELECT 'node' AS kind, path AS a, coalesce(method, '') || ' ' || coalesce(cast(status_code AS varchar), '') AS b, params AS n FROM node_v
UNION ALL SELECT 'node', source, ' ', 0 FROM (SELECT DISTINCT source FROM site_edge_v WHERE source NOT IN (SELECT path FROM node_v)) m
UNION ALL SELECT 'edge', source, target, 0 FROM site_edge_v""")
def grf_03(spark, sf):
    nodes, links = graph.site_graph(counted(spark, sf))
    text = F.concat("method", F.lit(" "), F.coalesce(F.col("status_code").cast("string"), F.lit("")))
    out = nodes.select(F.lit("node").alias("kind"), F.col("path").alias("a"), text.alias("b"), F.col("params").alias("n"))
    return out.union(links.select(F.lit("edge"), "source", "target", F.lit(0).cast("long")))


@query("grf_04_ego_graph", f"""
WITH k AS (SELECT path, CASE WHEN path = '/' THEN '' ELSE {q.parent('path')} END AS up FROM node_v),
n AS (SELECT path FROM k WHERE up IN ('/admin/config1', '/admin') UNION SELECT '/admin/config1' UNION SELECT '/admin')
SELECT 'node' AS kind, path AS a, CASE WHEN path = '/admin/config1' THEN 'focus' ELSE '' END AS b FROM n
UNION ALL SELECT 'edge', {q.parent('path')}, path FROM n WHERE path <> '/' AND {q.parent('path')} IN (SELECT path FROM n)""")
def grf_04(spark, sf):
    nodes, links = graph.ego_graph(counted(spark, sf), "/admin/config1")
    out = nodes.select(F.lit("node").alias("kind"), F.col("path").alias("a"), F.when(F.col("is_focus"), "focus").otherwise("").alias("b"))
    return out.union(links.select(F.lit("edge"), "source", "target"))
