"""Sources and sinks, written to and read back from the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema, sinks, sources
from ..cluster import scratch_path
from ..functions import urls as U
from ..operators import filters, surface, telemetry
from . import sqlkit as q, views
from .registry import query
from .surface import boundaries, endpoints, params, secrets, secured


def _stored(spark, sf):
    """Transactions written by the sink, in the declared schema."""
    path = scratch_path(spark, "transactions")
    rows = to_schema(views.transactions(spark, sf))
    sinks.append_transactions(rows, path)
    return path


def to_schema(txn):
    c = F.col
    return txn.select(
        c("id").cast("string").alias("id"), c("ts").alias("timestamp"), "request_method", "request_url",
        F.create_map().cast("map<string,string>").alias("request_headers"), c("request_body").cast("binary").alias("request_body"),
        F.lit("").alias("request_content_type"), "response_status", "response_headers", c("response_body").cast("binary").alias("response_body"),
        "response_content_type", "response_url_final", "source_module", "depth", "page_type", "content_hash",
    )


@query("src_01_transaction_scan", "SELECT cast(id AS varchar) AS id, request_url, response_status, sha256(response_body) AS body_hash, depth FROM txn")
def src_01(spark, sf):
    path = _stored(spark, sf)
    return sources.read_transactions(spark, path).select("id", "request_url", "response_status", F.sha2("response_body", 256).alias("body_hash"), "depth")


@query("src_02_script_scan", "SELECT id, request_url, response_body FROM txn WHERE response_content_type LIKE '%javascript%'")
def src_02(spark, sf):
    return sources.js_responses(views.transactions(spark, sf)).select("id", "request_url", "response_body")


@query("src_03_html_scan", "SELECT id, request_url, response_body FROM txn WHERE response_content_type LIKE '%html%' AND page_type = 'real_content'")
def src_03(spark, sf):
    return sources.html_responses(views.transactions(spark, sf)).select("id", "request_url", "response_body")


LIST_ROWS = 500


def feed(spark, sf, tag):
    return views.table(spark, sf, "passive_url").where(F.col("tag") == tag)


def read_feeds(spark, sf):
    """The three saved feed formats, written and then read by their sources."""
    index, lines, lists = (scratch_path(spark, n) for n in ("text-index", "crawl-index", "url-list"))
    dash = lambda c: F.when(F.col(c) == "", "-").otherwise(F.col(c))
    feed(spark, sf, "wayback").select(F.concat_ws(" ", "url", dash("status"), dash("mime")).alias("value")).write.text(index)
    good = feed(spark, sf, "commoncrawl").select(F.to_json(F.struct("url", "status", "mime")).alias("value"))
    good.union(feed(spark, sf, "otx").select(F.lit("{broken").alias("value"))).write.text(lines)
    # documents of about LIST_ROWS urls each, however many there are
    listed = feed(spark, sf, "otx")
    shard = F.pmod(F.xxhash64("url", "status", F.monotonically_increasing_id()), F.lit(listed.count() // LIST_ROWS + 1)).alias("shard")
    entry = F.struct("url", F.col("status").alias("httpcode"))
    docs = listed.groupBy(shard).agg(F.collect_list(entry).alias("url_list")).drop("shard")
    docs.repartition(8).write.option("maxRecordsPerFile", 1).json(lists)
    return (
        sources.read_text_index(spark, index), sources.read_crawl_index(spark, lines), sources.read_url_list(spark, lists),
    )


@query("src_04_text_index", "SELECT url, status, mime FROM passive_url WHERE tag = 'wayback'")
def src_04(spark, sf):
    return read_feeds(spark, sf)[0]


@query("src_05_crawl_index", "SELECT url, status, mime FROM passive_url WHERE tag = 'commoncrawl'")
def src_05(spark, sf):
    return read_feeds(spark, sf)[1]


@query("src_06_url_list", "SELECT url, status, '' AS mime FROM passive_url WHERE tag = 'otx'")
def src_06(spark, sf):
    return read_feeds(spark, sf)[2]


@query("src_07_feed_union", "SELECT url, tag, status, CASE WHEN tag = 'otx' THEN '' ELSE mime END AS mime FROM passive_url")
def src_07(spark, sf):
    a, b, c = read_feeds(spark, sf)
    return sources.union_feeds(wayback=a, commoncrawl=b, otx=c)


@query("src_08_telemetry_scan", """
SELECT id, json_extract_string(metrics_json, '$.request_url') AS request_url, cast(json_extract(metrics_json, '$.total_requests') AS int) AS total_requests,
  json_array_length(metrics_json, '$.api_calls') AS api_calls, json_array_length(metrics_json, '$.js_errors') AS js_errors,
  json_extract_string(metrics_json, '$.security_headers.csp') AS csp FROM telemetry_doc""")
def src_08(spark, sf):
    m = sources.parse_telemetry(views.table(spark, sf, "telemetry_doc"))
    return m.select("id", "request_url", "total_requests", F.size("api_calls").alias("api_calls"), F.size("js_errors").alias("js_errors"), F.col("security_headers.csp").alias("csp"))


REPORTS_PER_FILE = 100


def report_doc(spark, sf):
    """One saved report per page: a small document with its own entities."""
    pages = views.base(spark, sf, "pages")
    ep = F.struct(F.col("url"), F.lit("GET").alias("method"), F.array(F.lit("wayback")).alias("tags"))
    sec = F.struct(F.lit("token").alias("kind"), F.concat(F.lit("value-"), "page_id").alias("value"), F.col("url").alias("source_url"))
    return pages.select(
        "page_id", F.col("url").alias("target"), F.array(ep, ep).alias("endpoints"), F.array(sec).alias("secrets"),
        F.struct(F.lit(2).alias("total_endpoints"), F.lit(5.0).alias("score")).alias("risk_summary"),
    )


@query("src_09_saved_report", """SELECT 'endpoint' AS entity, 'GET ' || url AS key FROM pages UNION ALL SELECT 'endpoint', 'GET ' || url FROM pages
UNION ALL SELECT 'secret', 'value-' || page_id FROM pages UNION ALL SELECT 'score', url || ' 5.0' FROM pages""")
def src_09(spark, sf):
    path = scratch_path(spark, "reports")
    # files that hold a list of reports each, since a file per report costs more to create than to write
    docs = report_doc(spark, sf)
    lists = docs.groupBy((F.col("page_id") / REPORTS_PER_FILE).cast("long")).agg(F.to_json(F.collect_list(F.struct(*docs.columns))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(path)
    t = sources.read_report_documents(spark, path)
    out = t["endpoints"].select(F.lit("endpoint").alias("entity"), F.concat_ws(" ", "method", "url").alias("key"))
    out = out.union(t["secrets"].select(F.lit("secret"), "value"))
    return out.union(t["risk_summary"].select(F.lit("score"), F.concat_ws(" ", "target", F.col("score").cast("string"))))


@query("src_10_wordlist", "SELECT DISTINCT regexp_extract(url, '([a-z]+)[.]example', 1) || page_id AS word FROM pages")
def src_10(spark, sf):
    path = scratch_path(spark, "words")
    pages = views.base(spark, sf, "pages")
    word = F.concat(F.lit("  "), F.regexp_extract("url", r"([a-z]+)\.example", 1), "page_id", F.lit(" "))
    lines = pages.select(F.explode(F.array(word, F.lit(""), F.concat(F.lit("# note "), "page_id"))).alias("value"))
    lines.write.text(path)
    return sources.read_wordlist(spark, path)


# ---- Sinks -------------------------------------------------------------


@query("snk_01_append_transactions", """SELECT cast(id AS varchar) AS id, regexp_extract(request_url, '//([^/]+)', 1) AS host, request_method, request_url, response_status, response_content_type,
  sha256(response_body) AS body_hash, source_module, depth, page_type, sha256(response_body) AS content_hash, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM txn""")
def snk_01(spark, sf):
    path, rows = scratch_path(spark, "appended"), to_schema(views.transactions(spark, sf))
    for _ in range(2):  # the first batch twice, as after a lost driver
        sinks.append_transactions(rows.where("source_module = 's_js'"), path, 0)
    sinks.append_transactions(rows.union(rows), path)  # the rest, twice
    return sources.read_transactions(spark, path).select(
        "id", "host", "request_method", "request_url", "response_status", "response_content_type", F.sha2("response_body", 256).alias("body_hash"),
        "source_module", "depth", "page_type", "content_hash", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("snk_02_entity_json_lines", "SELECT 'endpoint' AS entity, method || ' ' || url AS key FROM endpoint_v UNION ALL SELECT 'secret', value FROM secret_v")
def snk_02(spark, sf):
    e, s = scratch_path(spark, "endpoints"), scratch_path(spark, "secrets")
    sinks.write_entities(endpoints(spark, sf).drop("seq"), e)
    sinks.write_entities(secrets(spark, sf), s)
    out = spark.read.schema("method string, url string").json(e).select(F.lit("endpoint").alias("entity"), F.concat_ws(" ", "method", "url").alias("key"))
    return out.union(spark.read.schema("value string").json(s).select(F.lit("secret"), "value"))


def operations(spark, sf):
    eps = secured(spark, sf).withColumn("path_template", F.substring_index(U.template(F.col("url")), "?", 1))
    p = params(spark, sf).withColumns({
        "path_template": F.substring_index(U.template(F.col("url")), "?", 1), "param_type": F.lit("integer"),
        "required": F.lit(False), "example": F.get("sample_values", F.lit(0)),
    })
    return sinks.openapi_operations(eps, p)


_TPL = f"split_part({q.template('url')}, '?', 1)"
OPENAPI_SQL = f"""
WITH e AS (SELECT *, {_TPL} AS path FROM secured_v), p AS (SELECT *, {_TPL} AS path FROM param_v),
r AS (SELECT path, lower(method) AS method, string_agg(DISTINCT cast(coalesce(status_code, 200) AS varchar), ',' ORDER BY cast(coalesce(status_code, 200) AS varchar)) AS codes, arg_min(requires_auth, seq) AS secured FROM e GROUP BY 1, 2),
m AS (SELECT path, lower(method) AS method, string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE location <> 'body') AS names,
  string_agg(DISTINCT name, ',' ORDER BY name) FILTER (WHERE location = 'body' AND method IN ('POST', 'PUT', 'PATCH')) AS body_names FROM p GROUP BY 1, 2)
SELECT r.path, r.method, upper(r.method) || ' ' || r.path AS summary, list_filter(string_split(r.path, '/'), lambda s: s <> '' AND NOT starts_with(s, '{{'))[1] AS tag,
  codes, secured, coalesce(names, '') AS names, coalesce(body_names, '') AS body_names FROM r LEFT JOIN m USING (path, method)"""


@query("snk_04_openapi_operations", OPENAPI_SQL)
def snk_04(spark, sf):
    names = lambda c: F.coalesce(F.array_join(F.array_sort(F.transform(c, lambda p: p["name"])), ","), F.lit(""))
    return operations(spark, sf).select(
        "path", "method", "summary", "tag", F.array_join(F.transform("responses", lambda r: r["code"].cast("string")), ",").alias("codes"),
        "secured", names("parameters").alias("names"), names("body_params").alias("body_names"),
    )


def full_endpoints(spark, sf):
    return surface.attach_parameters(endpoints(spark, sf), params(spark, sf))


@query("snk_05_postman_items", """
SELECT '/' || split_part(regexp_replace(url, '^https?://[^/]*/', ''), '/', 1) AS folder0, method || ' ' || regexp_extract(url, '^https?://[^/]*([^?]*)', 1) AS name, count(*) AS n FROM endpoint_v GROUP BY 1, 2""".replace(
    "'/' || split_part(regexp_replace(url, '^https?://[^/]*/', ''), '/', 1) AS folder0", "'/' || regexp_extract(url, '^https?://[^/]*/([^/?]*)', 1) AS folder"))
def snk_05(spark, sf):
    path = scratch_path(spark, "collection")
    sinks.write_postman(full_endpoints(spark, sf), path)
    rows = spark.read.text(path)
    return rows.groupBy("folder", F.get_json_object("value", "$.name").alias("name")).agg(F.count("*").alias("n"))


@query("snk_06_proxy_xml", """
SELECT url, 443 AS port, method || ' ' || regexp_extract(url, '^https?://[^/]*(.*)', 1) || ' HTTP/1.1' AS request_line FROM endpoint_v""")
def snk_06(spark, sf):
    path = scratch_path(spark, "proxy-items")
    sinks.write_proxy_xml(full_endpoints(spark, sf), path)
    back = spark.read.format("xml").option("rowTag", "item").schema("url string, port int, request string").load(path)
    text = F.decode(F.unbase64("request"), "utf-8")
    return back.select("url", "port", F.substring_index(text, "\r\n", 1).alias("request_line"))


@query("snk_07_telemetry_files", "SELECT (SELECT count(*) FROM telemetry_doc) AS pages, (SELECT cast(sum(cast(json_extract(metrics_json, '$.total_requests') AS int)) AS bigint) FROM telemetry_doc) AS sub_requests")
def snk_07(spark, sf):
    path = scratch_path(spark, "telemetry")
    m = sources.parse_telemetry(views.table(spark, sf, "telemetry_doc"))
    sinks.write_telemetry(m, telemetry.totals(m), path)
    summary = spark.read.schema("total_pages_profiled long, total_sub_requests long").json(f"{path}/summary")
    return summary.select(F.col("total_pages_profiled").alias("pages"), F.col("total_sub_requests").alias("sub_requests"))
