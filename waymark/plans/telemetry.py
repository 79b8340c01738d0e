"""Browser telemetry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..operators import telemetry
from . import sqlkit as q, views
from .registry import query
from .surface import endpoints

DUCK = views.DUCK
_J = "json_extract_string(metrics_json, '$.{}')"
DUCK["tele_v"] = f"""SELECT id, request_url, cast(json_extract(metrics_json, '$.total_requests') AS int) AS total_requests, {_J.format('api_calls[0].url')} AS api_url, {_J.format('websocket_sessions[0].url')} AS ws_url,
  {_J.format('discovered_requests[0].url')} AS foreign_url, {_J.format('redirect_chain[0]')} AS redirect, {_J.format('console_messages[0].text')} AS msg, {_J.format('js_errors[0].text')} AS err,
  {_J.format('security_headers.csp')} AS csp, {_J.format('security_headers.cors_allow_origin')} AS cors, {_J.format('security_headers.cors_allow_credentials')} AS cred,
  {_J.format('security_headers.x_frame_options')} AS xfo, {_J.format('security_headers.strict_transport_security')} AS hsts, {_J.format('security_headers.x_content_type_options')} AS xcto FROM telemetry_doc"""


def parsed(spark, sf):
    return sources.parse_telemetry(views.table(spark, sf, "telemetry_doc"))


@query("agg_27_telemetry_summary", f"""
SELECT 'api_call' AS kind, 'GET|' || api_url AS key, count(*) AS seen FROM tele_v GROUP BY 2 UNION ALL SELECT 'websocket', ws_url, count(*) FROM tele_v WHERE ws_url IS NOT NULL GROUP BY 2
UNION ALL SELECT 'third_party', {q.authority('foreign_url')}, count(*) FROM tele_v GROUP BY 2 UNION ALL SELECT 'redirect_target', redirect, count(*) FROM tele_v WHERE redirect IS NOT NULL GROUP BY 2""")
def agg_27(spark, sf):
    return telemetry.discovered(parsed(spark, sf))


@query("agg_27_telemetry_totals", """SELECT count(*) AS total_pages_profiled, cast(sum(total_requests) AS bigint) AS total_sub_requests, count(api_url) AS total_api_calls, count(err) AS total_js_errors,
  count(*) FILTER (WHERE csp = '') AS pages_without_csp, count(*) FILTER (WHERE hsts = '') AS pages_without_hsts, count(*) FILTER (WHERE cors = '*') AS pages_with_permissive_cors FROM tele_v""")
def agg_27_totals(spark, sf):
    return telemetry.totals(parsed(spark, sf))


_LEAK = q.first_label("text", [(p, i) for i, p in enumerate(telemetry.LEAK_PATTERNS)])


@query("agg_28_console_leaks", f"""SELECT found_on, text, {_LEAK} AS pattern_no FROM (SELECT request_url AS found_on, msg AS text FROM tele_v UNION ALL SELECT request_url, err FROM tele_v WHERE err IS NOT NULL) m WHERE {_LEAK} IS NOT NULL""")
def agg_28(spark, sf):
    return telemetry.console_leaks(parsed(spark, sf)).select("found_on", "text", "pattern_no")


@query("agg_29_header_audit", """
SELECT request_url AS url, 'medium' AS severity, 'CORS wildcard: Access-Control-Allow-Origin: *' AS issue FROM tele_v WHERE cors = '*'
UNION ALL SELECT request_url, 'high', 'CORS wildcard with credentials (browser ignores, but server misconfigured)' FROM tele_v WHERE cors = '*' AND lower(cred) = 'true'
UNION ALL SELECT request_url, 'low', 'No clickjacking protection (X-Frame-Options or CSP frame-ancestors)' FROM tele_v WHERE xfo = '' AND NOT contains(csp, 'frame-ancestors')
UNION ALL SELECT request_url, 'low', 'Missing X-Content-Type-Options: nosniff' FROM tele_v WHERE xcto = ''""")
def agg_29(spark, sf):
    return telemetry.header_issues(parsed(spark, sf))


@query("jn_21_hidden_endpoints", """
SELECT DISTINCT 'GET' AS method, api_url AS url, 'type:XHR' AS tag FROM tele_v WHERE ('GET', api_url) NOT IN (SELECT (method, url) FROM endpoint_v)
UNION SELECT 'WEBSOCKET', ws_url, 'websocket' FROM tele_v WHERE ws_url IS NOT NULL""")
def jn_21(spark, sf):
    return telemetry.hidden_endpoints(parsed(spark, sf), endpoints(spark, sf), "example.com")
