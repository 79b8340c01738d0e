"""Passive URL collapse and sitemap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import passive
from . import sqlkit as q, views
from .filters import USEFUL_SQL
from .registry import query
from .surface import endpoints

DUCK = views.DUCK
_KEY = f"array_to_string(list_transform({q.segs('url')}, lambda s: {q.slot('s', '{hex}', False)}), '/')"
DUCK["entry_v"] = f"""
SELECT {q.host('url')} AS host, {_KEY} AS key, min(seq) AS seq, arg_min(url, seq) AS url, arg_min(tag, seq) AS tag, coalesce(arg_min(status, seq) FILTER (WHERE status <> ''), '') AS status,
  coalesce(arg_min(mime, seq) FILTER (WHERE mime <> ''), '') AS mime FROM passive_url WHERE {USEFUL_SQL} AND ends_with({q.host('url')}, '.example.com') GROUP BY 1, 2"""
DUCK["seg_v"] = "SELECT host, key, seq, CASE WHEN key = '' THEN [] ELSE string_split(key, '/') END AS s FROM entry_v"
DUCK["pref_v"] = "SELECT host, key, seq, d, array_to_string(list_slice(s, 1, d), '/') AS prefix, s[d + 1] AS child FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seg_v) x"
DUCK["kids_v"] = "SELECT host, prefix, count(DISTINCT child) AS n FROM pref_v WHERE child IS NOT NULL GROUP BY 1, 2"
DUCK["top_v"] = "SELECT p.host, p.key, p.seq, arg_min(p.prefix, p.d) AS node, min(p.d) AS nd FROM pref_v p JOIN kids_v k ON k.host = p.host AND k.prefix = p.prefix AND k.n > 5 GROUP BY 1, 2, 3"
DUCK["kept_v"] = """
SELECT host, key FROM (SELECT l.host, l.node, e.key FROM (SELECT host, node, nd, key FROM top_v QUALIFY row_number() OVER (PARTITION BY host, node ORDER BY seq) = 1) l
    JOIN pref_v p ON p.host = l.host AND p.key = l.key AND p.d >= l.nd JOIN entry_v e ON e.host = l.host AND e.key = p.prefix
    QUALIFY row_number() OVER (PARTITION BY l.host, l.node ORDER BY p.d) = 1) a
UNION ALL SELECT e.host, e.key FROM entry_v e WHERE NOT EXISTS (SELECT 1 FROM top_v t WHERE t.host = e.host AND t.key = e.key) AND NOT EXISTS (SELECT 1 FROM kids_v k WHERE k.host = e.host AND k.prefix = e.key)"""


def feeds(spark, sf):
    return views.table(spark, sf, "passive_url")


@query("agg_30_path_collapse", "SELECT e.host, e.key, e.url, e.tag, e.status, e.mime FROM entry_v e JOIN kept_v k ON k.host = e.host AND k.key = e.key")
def agg_30(spark, sf):
    kept, _ = passive.collapsed_endpoints(feeds(spark, sf), "example.com")
    return kept.select("host", "key", "url", "tag", "status", "mime")


@query("agg_30_passive_parameters", f"""
WITH p AS (SELECT DISTINCT {q.host('url')} AS host, {_KEY} AS key, split_part(pair, '=', 1) AS name, split_part(pair, '=', 2) AS value FROM (SELECT url, unnest(string_split({q.qs('url')}, '&')) AS pair FROM passive_url WHERE {USEFUL_SQL} AND {q.qs('url')} <> '' AND ends_with({q.host('url')}, '.example.com')) a)
SELECT p.host, p.key, name, CASE WHEN bool_and(regexp_matches(value, '^[0-9]+$')) THEN 'integer' WHEN bool_and(regexp_matches(value, '(?i)^(true|false|0|1)$')) THEN 'boolean' ELSE 'string' END AS param_type,
  array_to_string(list_slice(list_sort(list(value)), 1, 3), '|') AS samples FROM p JOIN kept_v k ON k.host = p.host AND k.key = p.key GROUP BY 1, 2, 3""")
def agg_30_params(spark, sf):
    _, params = passive.collapsed_endpoints(feeds(spark, sf), "example.com")
    return params.select("host", "key", "name", "param_type", F.array_join("sample_values", "|").alias("samples"))


@query("agg_31_sitemap", f"""
WITH e AS (SELECT {q.host('url')} AS host, {q.segs('url')} AS s FROM endpoint_v), p AS (SELECT host, len(s) AS len, unnest(range(0, len(s) + 1)) AS depth, s FROM e)
SELECT host, array_to_string(list_slice(s, 1, depth), '/') AS prefix, depth, count(*) FILTER (WHERE depth = len) AS own, count(*) AS subtree FROM p GROUP BY 1, 2, 3""")
def agg_31(spark, sf):
    return passive.sitemap(endpoints(spark, sf))
