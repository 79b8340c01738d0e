"""Merged entities and the queries over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import stored
from ..functions import classify as C, urls as U
from ..operators import access, filters, scripts, surface
from . import fingerprint as fpq, sqlkit as q, views
from .extract import logged_scripts
from .registry import query
from .scalar import RISK_ROWS, _HINT, _RISK

DUCK = views.DUCK
DUCK["endpoint_v"] = f"""
SELECT upper(method) AS method, {q.normalize('url')} AS url, min(seq) AS seq, arg_min(source_module, seq) AS source_module, arg_min(content_type, seq) AS content_type,
  arg_min(depth, seq) AS depth, coalesce(arg_min(page_type, seq) FILTER (WHERE page_type <> ''), '') AS page_type,
  arg_min(status_code, seq) FILTER (WHERE status_code <> 0) AS status_code,
  list_filter([CASE WHEN bool_or(tag2 = 'api') THEN 'api' END, CASE WHEN bool_or(tag1 = 'auth:user') THEN 'auth:user' END, CASE WHEN bool_or(tag2 = 'debug') THEN 'debug' END,
    CASE WHEN bool_or(tag1 = 'js_ast') THEN 'js_ast' END, CASE WHEN bool_or(tag1 = 'wayback') THEN 'wayback' END], lambda t: t IS NOT NULL) AS tags
FROM obs GROUP BY 1, 2"""
DUCK["param_v"] = """
SELECT method, url, name, location, arg_min(value, seq) AS sample, min(seq) AS seq FROM (
  SELECT request_method AS method, request_url AS url, split_part(pair, '=', 1) AS name, 'query' AS location, split_part(pair, '=', 2) AS value, id AS seq
  FROM (SELECT *, unnest(string_split(split_part(request_url, '?', 2), '&')) AS pair FROM txn WHERE contains(request_url, '?'))
  UNION ALL
  SELECT request_method, request_url, split_part(pair, '=', 1), 'body', split_part(pair, '=', 2), id
  FROM (SELECT *, unnest(string_split(request_body, '&')) AS pair FROM txn WHERE request_body <> '')) p GROUP BY 1, 2, 3, 4"""
DUCK["reflected_v"] = """
SELECT DISTINCT p.url, p.name, p.location FROM param_v p JOIN txn t ON t.request_url = p.url
WHERE length(p.sample) >= 4 AND NOT (regexp_matches(p.sample, '^[0-9]+$') AND length(p.sample) < 6) AND contains(t.response_body, p.sample)"""
_TR = [(t, p, tag) for t, p, tag in surface.TECH_RISKS]
DUCK["tech_risk_v"] = f"""
SELECT DISTINCT n.name, r.risk FROM (SELECT DISTINCT name FROM param_v UNION SELECT 'page_file' UNION SELECT 'cmd') n
JOIN {q.values(_TR, "r(tech, pattern, risk)")} ON regexp_matches(n.name, r.pattern) JOIN tech_v t ON t.name = r.tech"""
DUCK["typed_v"] = f"""
SELECT *, coalesce({_HINT}, {q.first_label('sample', C.VALUE_TYPES)}, 'string') AS input_type FROM (SELECT p.*, r.url IS NOT NULL AS is_reflected
FROM param_v p LEFT JOIN reflected_v r ON r.url = p.url AND r.name = p.name AND r.location = p.location) j"""
DUCK["vector_risk"] = f"""
SELECT url AS endpoint_url, name, location, risk FROM (
  SELECT url, name, location, unnest(string_split({_RISK}, ',')) AS risk FROM typed_v
  UNION ALL SELECT url, name, location, 'reflected_xss_candidate' FROM typed_v WHERE is_reflected
  UNION ALL SELECT url, name, location, CASE input_type WHEN 'url' THEN 'ssrf_candidate' WHEN 'path' THEN 'lfi_candidate' ELSE 'injection_candidate' END FROM typed_v WHERE input_type IN ('url', 'path', 'json')
  UNION ALL SELECT url, name, location, 'state_changing_method' FROM typed_v WHERE method IN ('PUT', 'DELETE', 'PATCH')
  UNION ALL SELECT p.url, p.name, p.location, t.risk FROM typed_v p JOIN tech_risk_v t USING (name)
  UNION ALL SELECT p.url, p.name, p.location, t.tag FROM typed_v p JOIN {q.values(RISK_ROWS, "t(tag, word)")} ON lower(p.name) = word) x WHERE risk <> ''"""
DUCK["vector_v"] = """
SELECT t.url AS endpoint_url, t.name, t.location, bool_or(t.is_reflected) AS is_reflected, arg_min(t.input_type, t.seq) AS input_type, arg_min(t.sample, t.seq) AS sample,
  coalesce(max(r.risks), []) AS risks
FROM typed_v t LEFT JOIN (SELECT endpoint_url, name, location, list_sort(list(DISTINCT risk)) AS risks FROM vector_risk GROUP BY 1, 2, 3) r
  ON r.endpoint_url = t.url AND r.name = t.name AND r.location = t.location GROUP BY 1, 2, 3"""
DUCK["sighting_v"] = f"""
SELECT request_url AS url, request_method AS method, CASE response_status WHEN 403 THEN 'forbidden' WHEN 401 THEN 'unauthorized' ELSE 'redirect_to_login' END AS boundary_type,
  response_status AS status, row_number() OVER (ORDER BY ts, id) AS seq
FROM txn WHERE response_status IN (401, 403) OR (response_status IN (301, 302, 303, 307, 308) AND regexp_matches(lower({q.path('location')}), 'login|signin|sign-in|auth|sso|cas|oauth|saml'))"""
DUCK["boundary_v"] = """
SELECT url, method, arg_min(boundary_type, seq) AS boundary_type, arg_min(status, seq) AS unauth_status, 0 AS auth_status, 'anonymous=' || arg_max(status, seq) AS matrix FROM sighting_v GROUP BY 1, 2"""
DUCK["secured_v"] = "SELECT e.*, e.url IN (SELECT url FROM boundary_v) AS requires_auth FROM endpoint_v e"
DUCK["secret_v"] = """
SELECT value, arg_min(kind, (source_url, kind)) AS kind, min(source_url) AS source_url FROM script_secret_v GROUP BY 1"""


# ---- Shared tables -----------------------------------------------------


def entity(build):
    """An entity table: built once per input, then read from the shared folder."""
    return lambda spark, sf: stored(spark, sf, build.__name__, lambda: build(spark, sf))


@entity
def endpoints(spark, sf):
    return surface.merge_endpoints(views.observations(spark, sf))


def _observed_with_body(spark, sf):
    t = views.table(spark, sf, "txn")
    return t.select(
        F.col("request_method").alias("method"), F.col("request_url").alias("url"), F.col("request_body").alias("body"), F.col("id").alias("seq")
    )


@entity
def params(spark, sf):
    return surface.endpoint_parameters(_observed_with_body(spark, sf), body="body")


@entity
def vectors(spark, sf):
    found = surface.classify_vectors(params(spark, sf), views.transactions(spark, sf), fpq.tech_table(spark, sf))
    return surface.merge_vectors(found)


@entity
def boundaries(spark, sf):
    return surface.merge_boundaries(access.boundary_sightings(views.transactions(spark, sf)))


def secured(spark, sf):
    return surface.require_auth(endpoints(spark, sf), boundaries(spark, sf))


@entity
def script_secrets(spark, sf):
    found = scripts.secrets(logged_scripts(spark, sf))
    return found.withColumn("seq", F.struct("source_url", "kind"))


@entity
def secrets(spark, sf):
    return surface.distinct_secrets(script_secrets(spark, sf))


# ---- Merges ------------------------------------------------------------


@query("agg_02_vector_merge", "SELECT endpoint_url, name, location, is_reflected, input_type, array_to_string(risks, ',') AS risks FROM vector_v")
def agg_02(spark, sf):
    return vectors(spark, sf).select(
        "endpoint_url", "name", "location", "is_reflected", "input_type", F.array_join("risk_indicators", ",").alias("risks")
    )


@query("agg_05_secret_and_schema_dedup", """
SELECT 'secret' AS entity, kind || ' ' || value AS detail, source_url AS url FROM secret_v
UNION ALL SELECT 'schema', 'openapi', url FROM (SELECT DISTINCT url FROM spec UNION ALL SELECT DISTINCT url FROM spec) GROUP BY url""")
def agg_05(spark, sf):
    s = secrets(spark, sf).select(F.lit("secret").alias("entity"), F.concat_ws(" ", "kind", "value").alias("detail"), F.col("source_url").alias("url"))
    spec = views.table(spark, sf, "spec").select("url", F.lit("openapi").alias("schema_type"), F.col("page_id").alias("seq"))
    schemas = surface.distinct_schemas(spec.union(spec))
    return s.unionByName(schemas.select(F.lit("schema").alias("entity"), F.col("schema_type").alias("detail"), "url"))


@query("agg_25_surface_stats", """
SELECT 'endpoints' AS entity, count(*) AS n FROM endpoint_v UNION ALL SELECT 'input_vectors', count(*) FROM vector_v UNION ALL SELECT 'auth_boundaries', count(*) FROM boundary_v
UNION ALL SELECT 'tech_detected', count(*) FROM tech_v UNION ALL SELECT 'secrets', count(*) FROM secret_v UNION ALL SELECT 'api_schemas', count(DISTINCT url) FROM spec""")
def agg_25(spark, sf):
    schemas = surface.distinct_schemas(views.table(spark, sf, "spec").select("url", F.lit("openapi").alias("schema_type"), F.col("page_id").alias("seq")))
    return surface.entity_counts(
        endpoints=endpoints(spark, sf), input_vectors=vectors(spark, sf), auth_boundaries=boundaries(spark, sf),
        tech_detected=fpq.tech_table(spark, sf), secrets=secrets(spark, sf), api_schemas=schemas,
    )


@query("agg_26_high_risk_findings", """
SELECT 'input_vector' AS kind, endpoint_url AS url, name || ' @ ' || location AS detail FROM vector_v WHERE len(risks) > 0
UNION ALL SELECT 'open_admin', url, method FROM secured_v WHERE page_type = 'admin' AND NOT requires_auth
UNION ALL SELECT 'exposed_debug', url, method FROM secured_v WHERE list_contains(tags, 'debug')
UNION ALL SELECT 'secret', source_url, kind FROM secret_v""")
def agg_26(spark, sf):
    return surface.high_risk_findings(secured(spark, sf), vectors(spark, sf), secrets(spark, sf))


@query("agg_32_known_parameters", f"""
SELECT DISTINCT regexp_extract(request_url, '^([^?#]*)', 1) AS base_url, split_part(pair, '=', 1) AS name
FROM (SELECT request_url, unnest(string_split(split_part(request_url, '?', 2), '&')) AS pair FROM txn WHERE contains(request_url, '?'))
UNION SELECT url, name FROM param_v""")
def agg_32(spark, sf):
    return surface.known_parameters(views.table(spark, sf, "txn"), params(spark, sf)).select("base_url", "name")


@query("agg_39_endpoints_by_module", "SELECT source_module, count(*) AS n FROM endpoint_v GROUP BY 1 ORDER BY 2 DESC")
def agg_39(spark, sf):
    return endpoints(spark, sf).groupBy("source_module").agg(F.count("*").alias("n")).orderBy(F.col("n").desc())


# ---- Vector joins ------------------------------------------------------


@query("jn_13_reflection", "SELECT * FROM reflected_v")
def jn_13(spark, sf):
    return surface.reflected_parameters(params(spark, sf), views.transactions(spark, sf))


@query("jn_14_tech_risks", "SELECT name, risk FROM tech_risk_v")
def jn_14(spark, sf):
    p = params(spark, sf).select("name")
    more = views.base(spark, sf, "nation").select(F.explode(F.array(F.lit("page_file"), F.lit("cmd"))).alias("name"))
    return surface.tech_risks(p.union(more), fpq.tech_table(spark, sf))


@query("jn_16_unspidered", """SELECT method, url FROM endpoint_v e WHERE url NOT IN (SELECT request_url FROM txn WHERE source_module = 's_crawl')
QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1""")
def jn_16(spark, sf):
    done = views.table(spark, sf, "txn").where("source_module = 's_crawl'").select(F.col("request_url").alias("url"))
    return surface.unspidered(endpoints(spark, sf), done).select("method", "url")


# ---- Entity filters ----------------------------------------------------


def counted(spark, sf):
    rows = surface.with_param_count(secured(spark, sf), params(spark, sf))
    return rows.withColumn("fingerprint", U.endpoint_fingerprint(F.col("method"), F.col("url")))


DUCK["counted_v"] = """SELECT s.*, coalesce(p.n, 0) AS param_count FROM secured_v s LEFT JOIN (SELECT method, url, count(DISTINCT name) AS n FROM param_v GROUP BY 1, 2) p USING (method, url)"""


@query("flt_06_endpoint_filter", """SELECT method, url, param_count FROM counted_v WHERE list_contains(tags, 'wayback') AND page_type = 'real_content' AND method = 'GET'
  AND NOT requires_auth AND param_count > 0 AND source_module = 's_passive' AND contains(lower(url), 'app1')""")
def flt_06(spark, sf):
    return filters.endpoints_where(
        counted(spark, sf), tag="wayback", page_type="real_content", method="get", requires_auth=False, has_params=True,
        source_module="s_passive", url_contains="APP1",
    ).select("method", "url", "param_count")


_FP = q.digest("'GET|https://app0.example.com/admin/config1'")


@query("flt_07_endpoint_by_fingerprint", f"SELECT method, url FROM endpoint_v WHERE {q.digest(chr(39) * 2 + ' || method || ' + chr(39) + '|' + chr(39) + ' || url')} = {_FP}")
def flt_07(spark, sf):
    wanted = U.endpoint_fingerprint(F.lit("GET"), F.lit("https://app0.example.com/admin/config1"))
    return counted(spark, sf).where(F.col("fingerprint") == wanted).select("method", "url")


@query("flt_08_vector_filter", """SELECT endpoint_url, name FROM vector_v WHERE list_contains(risks, 'reflected_xss_candidate') AND location = 'query' AND is_reflected AND contains(lower(endpoint_url), 'products')""")
def flt_08(spark, sf):
    return filters.vectors_where(
        vectors(spark, sf), risk="reflected_xss_candidate", location="query", reflected=True, url_contains="Products", source_module="classifier"
    ).select("endpoint_url", "name")


@query("flt_10_secret_and_boundary_filter", """
SELECT * FROM (SELECT 'secret' AS entity, value AS key FROM secret_v WHERE kind = 'credential' ORDER BY value LIMIT 100) a
UNION ALL SELECT * FROM (SELECT 'boundary', url FROM boundary_v WHERE boundary_type = 'forbidden' ORDER BY url, method LIMIT 100) b""")
def flt_10(spark, sf):
    s = filters.page_of(secrets(spark, sf).where("kind = 'credential'"), ["value"], 0, 100)
    b = filters.page_of(boundaries(spark, sf).where("boundary_type = 'forbidden'"), ["url", "method"], 0, 100)
    return s.select(F.lit("secret").alias("entity"), F.col("value").alias("key")).union(b.select(F.lit("boundary"), "url"))


@query("flt_11_entity_selectors", """
SELECT 'tag' AS selector, method || ' ' || url AS key FROM secured_v WHERE list_contains(tags, 'debug') UNION ALL SELECT 'page_type', method || ' ' || url FROM secured_v WHERE page_type = 'admin'
UNION ALL SELECT 'auth', method || ' ' || url FROM secured_v WHERE requires_auth UNION ALL SELECT 'risky', endpoint_url || ' ' || name FROM vector_v WHERE len(risks) > 0""")
def flt_11(spark, sf):
    e = secured(spark, sf)
    key = F.concat_ws(" ", "method", "url").alias("key")
    out = filters.endpoints_where(e, tag="debug").select(F.lit("tag").alias("selector"), key)
    out = out.union(filters.endpoints_where(e, page_type="admin").select(F.lit("page_type"), key))
    out = out.union(filters.endpoints_where(e, requires_auth=True).select(F.lit("auth"), key))
    return out.union(filters.with_any_risk(vectors(spark, sf)).select(F.lit("risky"), F.concat_ws(" ", "endpoint_url", "name")))


@query("flt_15_endpoint_search", """SELECT method, url, param_count FROM counted_v WHERE (contains(lower(url), 'auth') OR len(list_filter(tags, lambda t: contains(lower(t), 'auth'))) > 0) AND method = 'POST'
ORDER BY param_count DESC, url""")
def flt_15(spark, sf):
    return filters.search_endpoints(counted(spark, sf), "AUTH", "POST", sort="params").select("method", "url", "param_count")


@query("flt_16_vector_search", """SELECT endpoint_url, name, len(risks) AS risk_count FROM vector_v WHERE (contains(lower(name), 'xss') OR contains(lower(endpoint_url), 'xss')
  OR len(list_filter(risks, lambda r: contains(lower(r), 'xss'))) > 0) AND is_reflected AND location = 'query'""")
def flt_16(spark, sf):
    rows = filters.search_vectors(vectors(spark, sf), "XSS", reflected_only=True, location="query")
    return rows.select("endpoint_url", "name", F.size("risk_indicators").cast("long").alias("risk_count"))
