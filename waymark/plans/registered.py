"""The registry fed by all producers, and the report made of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks, sources
from ..cluster import scratch_path, stored
from ..operators import access, extract, registry as R, surface
from . import extract as E, fingerprint as fpq, sqlkit as q, views
from .access import _ROLE
from .registry import query
from .surface import secrets, vectors
from .telemetry import parsed

DUCK = views.DUCK
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
DUCK["sighted_v"] = f"""
SELECT 0 AS stage, seq AS nth, method, url, status_code, content_type, source_module, depth, page_type, [tag1, tag2] AS tags, false AS requires_auth, '' AS names FROM obs
UNION ALL SELECT 1, 0, 'GET', url, 0, '', 's_links', 0, '', ['link'], false, '' FROM link_v
UNION ALL SELECT 2, 0, method, full_url, 0, '', 's_js', 0, '', [tag], false, split_part(parameters, '@', 1) FROM analysis_v
UNION ALL SELECT 3, 0, 'GET', {_ORIGIN} || '/items' || page_id, 0, '', 's_api', 0, '', ['openapi', 'auth:key'], true, 'X-T,id' FROM spec
UNION ALL SELECT 3, 0, 'POST', {_ORIGIN} || '/items' || page_id, 0, '', 's_api', 0, '', ['openapi', 'json_body'], false, 'name,owner.mail,size' FROM spec
UNION ALL SELECT 3, 0, 'GET', {_ORIGIN} || '/ping', 0, '', 's_api', 0, '', ['openapi', 'auth:key'], true, '' FROM spec
UNION ALL SELECT 4, 0, 'GET', url, coalesce(try_cast(status AS int), 0), '', 's_feeds', 0, '', [tag], false, '' FROM passive_url
UNION ALL SELECT 5, 0, 'GET', api_url, 200, 'application/json', 's_browser', 0, '', ['browser'], false, '' FROM tele_v"""
DUCK["registry_v"] = f"""
SELECT upper(method) AS method, {q.normalize('url')} AS url, arg_min(source_module, (stage, nth)) AS source_module, arg_min(content_type, (stage, nth)) AS content_type,
  arg_min(depth, (stage, nth)) AS depth, coalesce(arg_min(page_type, (stage, nth)) FILTER (WHERE page_type <> ''), '') AS page_type,
  coalesce(arg_min(status_code, (stage, nth)) FILTER (WHERE status_code <> 0), 0) AS status_code, arg_min(requires_auth, (stage, nth)) AS asks,
  list_sort(list_filter(list_distinct(flatten(list(tags))), lambda t: t <> '')) AS tags,
  array_to_string(list_sort(list_filter(list_distinct(flatten(list(string_split(names, ',')))), lambda n: n <> '')), ',') AS names
FROM sighted_v GROUP BY 1, 2"""
DUCK["mixed_v"] = f"""
SELECT path AS url, arg_min(request_method, (ts, id)) FILTER (WHERE response_status IN (401, 403)) AS method, arg_min(response_status, (ts, id)) FILTER (WHERE response_status IN (401, 403)) AS unauth_status
FROM (SELECT request_method, ts, id, CASE WHEN id % 3 = 1 AND kind = 'error' THEN 200 ELSE response_status END AS response_status, {q.path('request_url')} AS path FROM txn) a
GROUP BY 1 HAVING bool_or(response_status IN (401, 403)) AND bool_or(response_status = 200)"""
DUCK["bound_rows"] = f"""
SELECT 0 AS stage, seq AS nth, url, method, boundary_type, status AS unauth_status, 0 AS auth_status, 'anonymous' AS role, status FROM sighting_v
UNION ALL SELECT 1, 0, url, method, 'idor_candidate', unauth_status, 200, NULL, NULL FROM mixed_v
UNION ALL SELECT 2, 0, url, method, 'role_difference', coalesce(max(status) FILTER (WHERE role = 'anonymous') OVER w, 0), coalesce(max(status) FILTER (WHERE role <> 'anonymous') OVER w, 0), role, status
  FROM (SELECT request_url AS url, request_method AS method, {_ROLE} AS role, arg_max(response_status, (ts, id)) AS status FROM txn GROUP BY 1, 2, 3) r
  WINDOW w AS (PARTITION BY url, method) QUALIFY min(status) OVER w <> max(status) OVER w"""
DUCK["bound_v"] = """
SELECT f.*, coalesce(m.matrix, '') AS matrix FROM (SELECT url, method, arg_min(boundary_type, (stage, nth)) AS boundary_type, arg_min(unauth_status, (stage, nth)) AS unauth_status,
  arg_min(auth_status, (stage, nth)) AS auth_status FROM bound_rows GROUP BY 1, 2) f LEFT JOIN (
  SELECT url, method, string_agg(role || '=' || status, ',' ORDER BY role) AS matrix FROM (
    SELECT url, method, role, arg_max(status, (stage, nth)) AS status FROM bound_rows WHERE role IS NOT NULL GROUP BY 1, 2, 3) l GROUP BY 1, 2) m USING (url, method)"""
DUCK["flagged_v"] = f"""
SELECT r.*, asks OR url IN (SELECT url FROM bound_v) OR {q.path('url')} IN (SELECT url FROM bound_v WHERE starts_with(url, '/')) AS requires_auth FROM registry_v r"""


def producers(spark, sf):
    """The sightings of every producer."""
    return (
        R.recorded(views.observations(spark, sf)), R.linked(extract.links(E.pages(spark, sf))), R.called(E.analysed(spark, sf)),
        R.documented(views.table(spark, sf, "spec"), key=["page_id"]), R.listed(views.table(spark, sf, "passive_url")), R.profiled(parsed(spark, sf)),
    )


def registered(spark, sf):
    """The merged registry, taken in producer by producer as batches of a stored table."""
    def build():
        path = scratch_path(spark, "registry")
        first, *others = producers(spark, sf)
        R.update(spark, path, first, 0)
        rest = others[0]
        for more in others[1:]:
            rest = rest.unionByName(more)
        return R.update(spark, path, rest, 1).read()

    return stored(spark, sf, "registered", build)


def bounded(spark, sf):
    """Boundaries of every kind: sightings, mixed paths, role differences."""
    def build():
        txn = views.transactions(spark, sf)
        # one denied request in three is answered here, so that paths mix
        opened = F.when((F.col("id") % 3 == 1) & F.col("request_url").contains("/admin/"), 200).otherwise(F.col("response_status"))
        role = F.when(F.lower("source_module").contains("auth"), F.col("source_module")).otherwise("anonymous")
        rows = R.boundary_rows(access.boundary_sightings(txn), access.mixed_status_paths(txn.withColumn("response_status", opened)), access.role_matrix(txn, role))
        return R.first_boundaries(rows)

    return stored(spark, sf, "bounded", build)


def flagged(spark, sf):
    return surface.require_auth(registered(spark, sf), bounded(spark, sf))


def _matrix(column="access_matrix"):
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


@query("agg_01_endpoint_merge", "SELECT method, url, source_module, content_type, depth, page_type, status_code, asks AS requires_auth, array_to_string(tags, ',') AS tags, names FROM registry_v")
def agg_01(spark, sf):
    return registered(spark, sf).select(
        "method", "url", "source_module", "content_type", "depth", "page_type", "status_code", "requires_auth", F.array_join("tags", ",").alias("tags"),
        F.array_join(F.transform("parameters", lambda p: p["name"]), ",").alias("names"))


@query("agg_03_boundary_merge", "SELECT url, method, boundary_type, unauth_status, auth_status, matrix FROM bound_v")
def agg_03(spark, sf):
    return bounded(spark, sf).select("url", "method", "boundary_type", "unauth_status", "auth_status", _matrix().alias("matrix"))


@query("jn_18_auth_flags", "SELECT method, url, requires_auth FROM flagged_v")
def jn_18(spark, sf):
    return flagged(spark, sf).select("method", "url", "requires_auth")


@query("jn_19_unbounded_auth", "SELECT method, url FROM flagged_v WHERE requires_auth AND url NOT IN (SELECT url FROM bound_v)")
def jn_19(spark, sf):
    return surface.unbounded_auth_endpoints(flagged(spark, sf), bounded(spark, sf)).select("method", "url")


DUCK["summary_v"] = """
WITH c AS (SELECT (SELECT count(*) FROM flagged_v) AS total_endpoints, (SELECT count(*) FROM vector_v) AS total_input_vectors,
  (SELECT count(*) FROM vector_v WHERE len(risks) > 0) AS high_risk_vectors, (SELECT count(*) FROM bound_v) AS auth_boundaries_found,
  (SELECT count(*) FROM flagged_v WHERE page_type = 'admin' AND NOT requires_auth) AS unprotected_admin_paths,
  (SELECT count(*) FROM flagged_v WHERE list_has_any(tags, ['debug', 'actuator', 'phpinfo'])) AS exposed_debug_endpoints, (SELECT count(*) FROM secret_v) AS secrets_found,
  (SELECT count(*) FROM flagged_v WHERE requires_auth AND url NOT IN (SELECT url FROM bound_v)) AS unbounded)
SELECT * EXCLUDE (unbounded), least(100.0, least(40.0, high_risk_vectors * 2.0) + least(20.0, secrets_found * 5.0) + least(15.0, unprotected_admin_paths * 5.0)
  + least(15.0, exposed_debug_endpoints * 5.0) + least(10.0, unbounded * 2.0))::double AS score, least(10.0, unbounded * 2.0)::double AS unbounded_points FROM c"""


def summary(spark, sf):
    return surface.risk_summary(flagged(spark, sf), vectors(spark, sf), bounded(spark, sf), secrets(spark, sf))


@query("agg_24_risk_summary", "SELECT * FROM summary_v")
def agg_24(spark, sf):
    return summary(spark, sf)


# ---- The report --------------------------------------------------------


def report_tables(spark, sf):
    """The seven tables of a report in their declared shape."""
    c = F.col
    endpoints = flagged(spark, sf).select("method", "url", "status_code", "content_type", "source_module", "depth", "tags", "page_type", "requires_auth",
                                          F.transform("parameters", lambda p: F.struct(p["name"].alias("name"), p["location"].alias("location"), p["param_type"].alias("param_type"), p["required"].alias("required"))).alias("parameters"))
    return {
        "endpoints": endpoints,
        "input_vectors": vectors(spark, sf).select("endpoint_url", "name", "location", "input_type", "is_reflected", "sample_values", "risk_indicators", "source_module"),
        "auth_boundaries": bounded(spark, sf).select("url", "method", "unauth_status", "auth_status", "boundary_type", "access_matrix"),
        "tech_stack": fpq.tech_table(spark, sf).select("name", "version", "category", F.round("confidence", 9).alias("confidence"), "evidence_count"),
        "api_schemas": surface.distinct_schemas(views.table(spark, sf, "spec").select("url", F.lit("openapi").alias("schema_type"), c("page_id").alias("seq"))).select("url", "schema_type"),
        "secrets": secrets(spark, sf).select("kind", "value", "source_url"),
        "risk_summary": summary(spark, sf).drop("unbounded_points"),
    }


REPORT_SQL = """
SELECT 'endpoints' AS entity, concat_ws('|', method, url, status_code, content_type, source_module, depth, array_to_string(tags, ','), page_type, requires_auth, names) AS row FROM flagged_v
UNION ALL SELECT 'input_vectors', concat_ws('|', endpoint_url, name, location, input_type, is_reflected, sample, array_to_string(risks, ',')) FROM vector_v
UNION ALL SELECT 'auth_boundaries', concat_ws('|', url, method, unauth_status, auth_status, boundary_type, matrix) FROM bound_v
UNION ALL SELECT 'tech_stack', concat_ws('|', name, version, category, cast(round(confidence * 1000000) AS bigint), evidence_count) FROM tech_v
UNION ALL SELECT 'api_schemas', concat_ws('|', url, 'openapi') FROM (SELECT DISTINCT url FROM spec) s
UNION ALL SELECT 'secrets', concat_ws('|', kind, value, source_url) FROM secret_v
UNION ALL SELECT 'risk_summary', concat_ws('|', total_endpoints, total_input_vectors, high_risk_vectors, auth_boundaries_found, unprotected_admin_paths, exposed_debug_endpoints, secrets_found, cast(score * 10 AS bigint)) FROM summary_v"""


def _as_text(tables):
    """entity, row: every column of the seven tables as text."""
    c = F.col
    columns = {
        "endpoints": ["method", "url", "status_code", "content_type", "source_module", "depth", F.array_join("tags", ","), "page_type", "requires_auth",
                      F.array_join(F.transform("parameters", lambda p: p["name"]), ",")],
        "input_vectors": ["endpoint_url", "name", "location", "input_type", "is_reflected", F.coalesce(F.get("sample_values", F.lit(0)), F.lit("")), F.array_join("risk_indicators", ",")],
        "auth_boundaries": ["url", "method", "unauth_status", "auth_status", "boundary_type", _matrix()],
        "tech_stack": ["name", "version", "category", F.round(c("confidence") * 1_000_000).cast("long"), "evidence_count"],
        "api_schemas": ["url", "schema_type"], "secrets": ["kind", "value", "source_url"],
        "risk_summary": ["total_endpoints", "total_input_vectors", "high_risk_vectors", "auth_boundaries_found", "unprotected_admin_paths", "exposed_debug_endpoints", "secrets_found", (c("score") * 10).cast("long")],
    }
    out = None
    for entity, cells in columns.items():
        rows = tables[entity].select(F.lit(entity).alias("entity"), F.concat_ws("|", *[(c(x) if isinstance(x, str) else x).cast("string") for x in cells]).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def written(spark, sf):
    path = scratch_path(spark, "report")
    sinks.write_report(report_tables(spark, sf), path)
    return path


@query("snk_03_report", REPORT_SQL)
def snk_03(spark, sf):
    return _as_text(sources.read_report(spark, written(spark, sf)))


@query("snk_03_manifest", """SELECT entity, count(*) AS n FROM (SELECT entity FROM (""" + REPORT_SQL + """) r) x GROUP BY 1""")
def snk_03_manifest(spark, sf):
    manifest = sources.checked_manifest(spark, written(spark, sf))
    return manifest.select("entity", "n")
