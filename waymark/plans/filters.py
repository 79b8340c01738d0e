"""Filters over the request log and URL tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters
from . import sqlkit as q, views
from .registry import query
from .scalar import ANY_URL, any_url

_WHERE = "request_url LIKE '%app1%' AND source_module = 's_passive' AND page_type = 'real_content' AND response_content_type LIKE '%html%' AND response_status BETWEEN 200 AND 299"


def _filtered(spark, sf):
    return filters.transactions_where(
        views.transactions(spark, sf), url_contains="app1", source_module="s_passive", page_type="real_content",
        content_type_contains="html", status_range=(200, 299),
    )


@query("flt_01_transaction_filter", f"SELECT id, request_url, response_status FROM txn WHERE {_WHERE} ORDER BY ts, id LIMIT 50 OFFSET 20")
def flt_01(spark, sf):
    return filters.page_of(_filtered(spark, sf), ["ts", "id"], 20, 50).select("id", "request_url", "response_status")


@query("flt_02_filtered_count", f"SELECT count(*) AS n FROM txn WHERE {_WHERE}")
def flt_02(spark, sf):
    return _filtered(spark, sf).agg(F.count("*").alias("n"))


@query("flt_03_body_by_id", "SELECT response_body FROM txn WHERE id = 77")
def flt_03(spark, sf):
    return views.transactions(spark, sf).where("id = 77").select("response_body")


@query("flt_04_distinct_urls", "SELECT DISTINCT request_url FROM txn")
def flt_04(spark, sf):
    return views.transactions(spark, sf).select("request_url").distinct()


@query("flt_05_transaction_details", """SELECT t.id, request_method, request_url, response_status, depth, page_type, strlen(request_body) AS request_body_size, strlen(response_body) AS response_body_size,
  string_agg(h.name, ',' ORDER BY h.pos) AS header_names FROM txn t JOIN hdr h USING (id) GROUP BY ALL""")
def flt_05(spark, sf):
    txn = views.transactions(spark, sf)
    head = filters.transaction_summaries(txn).select("id", "depth", "page_type")
    body = filters.transaction_details(txn)
    return head.join(body, "id").select(
        "id", "request_method", "request_url", "response_status", "depth", "page_type", "request_body_size", "response_body_size",
        F.array_join(F.map_keys("response_headers"), ",").alias("header_names"),
    )


@query("flt_12_scope", f"""WITH {ANY_URL} SELECT url, ({q.host('url')} = 'example.com' OR ends_with({q.host('url')}, '.example.com'))
  AND NOT regexp_matches(url, '(?:/admin)|(?:[.]bak$)') AND regexp_matches(url, '(?:/products/)|(?:/[0-9]+)') AS in_scope FROM any_url""")
def flt_12(spark, sf):
    flag = filters.in_scope(F.col("url"), "example.com", include=["/products/", "/[0-9]+"], exclude=["/admin", r"\.bak$"])
    return any_url(spark, sf).select("url", flag.alias("in_scope"))


@query("flt_13_noise", f"WITH {ANY_URL} SELECT url, {q.any_of('url', [*filters.NOISE_PATTERNS, '.*/register.*'])} AS noise FROM any_url")
def flt_13(spark, sf):
    return any_url(spark, sf).select("url", filters.is_noise(F.col("url"), [".*/register.*"]).alias("noise"))


_EXT = "|".join(e.replace(".", "[.]") for e in filters.STATIC_EXTENSIONS)
_PCT = "(length(url) - length(replace(url, '%', '')))"
USEFUL_SQL = f"""(length(url) <= 250 AND NOT ({_PCT} > 3 AND {_PCT} * 1.0 / length(url) > 0.15) AND NOT regexp_matches({q.path('url')}, '(?i)(?:{_EXT})/*$')
  AND (url_decode({q.path('url')}) IN ('', '/') OR NOT (regexp_matches(url_decode({q.path('url')}), '[\\x00-\\x1f]') OR contains(url_decode({q.path('url')}), '  '))))"""


@query("flt_14_junk_urls", f"SELECT seq, {USEFUL_SQL} AS useful FROM passive_url")
def flt_14(spark, sf):
    return views.table(spark, sf, "passive_url").select("seq", filters.is_useful(F.col("url")).alias("useful"))


@query("flt_17_unsafe_requests", """SELECT seq, CASE WHEN source_module = 's_auth' THEN 'auth' ELSE 'unsafe_method' END AS approval FROM queue WHERE method NOT IN ('GET', 'HEAD', 'OPTIONS')""")
def flt_17(spark, sf):
    rows = views.table(spark, sf, "queue").withColumn(
        "source_module", F.when(F.col("source_module") == "s_auth", "s7_auth").otherwise(F.col("source_module"))
    )
    return filters.unsafe_requests(rows).select("seq", "approval")
