"""Per-page browser telemetry: summary tables and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls
from . import filters

# Console text that may leak something, in test order.
LEAK_PATTERNS = [
    r"(?i)(?:api[_-]?key|apikey)\s*[:=]\s*\S+",
    r"(?i)(?:token|bearer)\s*[:=]\s*\S+",
    r"(?i)(?:secret|password|passwd)\s*[:=]\s*\S+",
    r"(?i)https?://[^\s\"'<>]+/api/",
    r"(?i)https?://[^\s\"'<>]+/graphql",
    r"(?i)https?://[^\s\"'<>]+/v[0-9]+/",
    r"(?i)wss?://[^\s\"'<>]+",
    r"(?i)(?:internal|staging|dev)\.[A-Za-z0-9_]+\.[A-Za-z0-9_]+",
]


def totals(pages: DataFrame) -> DataFrame:
    """One row of page, request and header totals."""
    h = "security_headers."
    return pages.agg(
        F.count("*").alias("total_pages_profiled"), F.sum("total_requests").alias("total_sub_requests"),
        F.sum(F.size("api_calls")).alias("total_api_calls"), F.sum(F.size("js_errors")).alias("total_js_errors"),
        F.count_if((_text(h + "csp") == "") & (_text(h + "csp_report_only") == "")).alias("pages_without_csp"),
        F.count_if(_text(h + "strict_transport_security") == "").alias("pages_without_hsts"),
        F.count_if(_text(h + "cors_allow_origin") == "*").alias("pages_with_permissive_cors"),
    )


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def discovered(pages: DataFrame) -> DataFrame:
    """Distinct API calls, WebSocket URLs, third-party hosts, redirect targets with counts."""
    def rows(kind: str, items: Column, key) -> DataFrame:
        e = pages.select(F.explode(items).alias("e"))
        return e.select(F.lit(kind).alias("kind"), key(F.col("e")).alias("key")).where("key <> ''")

    foreign = F.filter("discovered_requests", lambda r: F.coalesce(r["is_third_party"], F.lit(False)))
    out = rows("api_call", F.col("api_calls"), lambda e: F.concat_ws("|", e["method"], e["url"]))
    out = out.unionByName(rows("websocket", F.col("websocket_sessions"), lambda e: e["url"]))
    out = out.unionByName(rows("third_party", foreign, lambda e: urls.authority(e["url"])))
    out = out.unionByName(rows("redirect_target", F.col("redirect_chain"), lambda e: e))
    return out.groupBy("kind", "key").agg(F.count("*").alias("seen"))


def console_leaks(pages: DataFrame, patterns=LEAK_PATTERNS) -> DataFrame:
    """Console messages and script errors with the first leak pattern found."""
    msgs = F.concat(F.coalesce("console_messages", F.array().cast("array<struct<level:string,text:string,url:string,line:int>>")), "js_errors")
    rows = pages.select(F.col("request_url").alias("found_on"), F.explode(msgs).alias("m"))
    first = F.coalesce(*[F.when(F.col("m.text").rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    return rows.select("found_on", "m.level", "m.text", "m.url", "m.line", first.alias("pattern_no")).where("pattern_no IS NOT NULL")


def header_issues(pages: DataFrame) -> DataFrame:
    """Misconfigured security headers with severity."""
    h = {c: _text(f"security_headers.{c}") for c in ("csp", "cors_allow_origin", "cors_allow_credentials", "x_frame_options", "x_content_type_options")}
    wild = h["cors_allow_origin"] == "*"

    def issue(when: Column, severity: str, text: str) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(text).alias("issue")))

    found = F.array_compact(F.array(
        issue(wild, "medium", "CORS wildcard: Access-Control-Allow-Origin: *"),
        issue(wild & (F.lower(h["cors_allow_credentials"]) == "true"), "high", "CORS wildcard with credentials (browser ignores, but server misconfigured)"),
        issue((h["x_frame_options"] == "") & ~h["csp"].contains("frame-ancestors"), "low", "No clickjacking protection (X-Frame-Options or CSP frame-ancestors)"),
        issue(h["x_content_type_options"] == "", "low", "Missing X-Content-Type-Options: nosniff"),
    ))
    return pages.select(F.col("request_url").alias("url"), F.explode(found).alias("i")).select("url", "i.*")


def hidden_endpoints(pages: DataFrame, known: DataFrame, target_host: str) -> DataFrame:
    """API and WebSocket URLs in scope that the registry does not hold."""
    api = pages.select(F.explode("api_calls").alias("a")).select(
        F.upper("a.method").alias("method"), F.col("a.url").alias("url"), F.concat(F.lit("type:"), F.coalesce("a.resource_type", F.lit(""))).alias("tag")
    )
    ws = pages.select(F.explode("websocket_sessions").alias("w")).select(F.lit("WEBSOCKET").alias("method"), F.col("w.url").alias("url"), F.lit("websocket").alias("tag"))
    rows = api.unionByName(ws).where((F.col("url") != "") & filters.in_scope(F.col("url"), target_host)).distinct()
    return rows.join(known.select("method", "url"), ["method", "url"], "left_anti")
