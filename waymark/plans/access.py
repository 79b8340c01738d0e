"""Baselines, boundaries, roles, states, differentials, exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..functions import classify as C, structure as S, urls as U
from ..operators import access
from . import sqlkit as q, views
from .ordered import state_pairs
from .registry import query
from .scalar import PAGE_TYPE_CTES, page_type_sql
from .surface import boundaries

DUCK = views.DUCK
DUCK["resp_v"] = f"SELECT id, {q.host('request_url')} AS host, response_status AS status, strlen(response_body) AS length, sha256(response_body) AS hash, source_module FROM txn"
# the passive stage plays the part of the baseline probes; app2 has none of its own
DUCK["probe_v"] = "SELECT host, status, length, hash FROM resp_v WHERE source_module = 's_passive' AND host <> 'app2.example.com'"
DUCK["c404_v"] = """
WITH r AS (SELECT *, CASE WHEN host IN (SELECT host FROM probe_v) THEN host ELSE 'app0.example.com' END AS b FROM resp_v), p AS (SELECT DISTINCT host, hash FROM probe_v), l AS (SELECT DISTINCT host, status, length FROM probe_v WHERE length > 0)
SELECT id FROM r WHERE EXISTS (SELECT 1 FROM p WHERE p.host = r.b AND p.hash = r.hash)
  OR EXISTS (SELECT 1 FROM l WHERE l.host = r.b AND l.status = r.status AND abs(r.length - l.length) * 1.0 / l.length <= 0.10)"""


def responses(spark, sf):
    c = F.col
    return views.transactions(spark, sf).select(
        "id", U.host(c("request_url")).alias("host"), c("response_status").alias("status"),
        F.octet_length("response_body").alias("length"), c("content_hash").alias("hash"), "source_module",
    )


def probes(spark, sf):
    return responses(spark, sf).where("source_module = 's_passive' AND host <> 'app2.example.com'").select("host", "status", "length", "hash")


def custom_404(spark, sf):
    return access.custom_404_ids(responses(spark, sf), probes(spark, sf), "app0.example.com")


@query("jn_01_custom_404", "SELECT id FROM c404_v")
def jn_01(spark, sf):
    return custom_404(spark, sf)


@query("jn_01_page_type_with_baseline", f"WITH {PAGE_TYPE_CTES} SELECT id, {page_type_sql('id IN (SELECT id FROM c404_v)')} AS page_type FROM flags")
def jn_01_types(spark, sf):
    c = F.col
    hit = custom_404(spark, sf).withColumn("is_404", F.lit(True))
    rows = views.transactions(spark, sf).join(hit, "id", "left")
    flag = F.coalesce("is_404", F.lit(False))
    return rows.select("id", C.page_type(c("response_status"), c("response_body"), c("response_headers"), flag).alias("page_type"))


@query("agg_14_baseline_learning", """
WITH p AS (SELECT host, status, length, hash FROM resp_v UNION ALL SELECT 'stub' || page_id % 3, 200, 500 + page_id % 3, 'same' FROM pages)
SELECT host, count(*) AS probes, round(avg(length), 6) AS mean_length, count(*) >= 2 AND bool_and(status = 200) AND count(DISTINCT hash) = 1 AND max(abs(length - m)) <= 0.1 * any_value(m) AS has_custom_404
FROM (SELECT *, avg(length) OVER (PARTITION BY host) AS m FROM p) x GROUP BY host""")
def agg_14(spark, sf):
    k = F.col("page_id") % 3
    stub = views.base(spark, sf, "pages").select(F.concat(F.lit("stub"), k.cast("string")).alias("host"), F.lit(200).alias("status"), (F.lit(500) + k).alias("length"), F.lit("same").alias("hash"))
    rows = responses(spark, sf).select("host", "status", "length", "hash").union(stub)
    return access.learn_baselines(rows).withColumn("mean_length", F.round("mean_length", 6))


DUCK["stub_v"] = "SELECT 'stub' || page_id % 3 AS host, 200 AS status, 400 + page_id % 3 * 100 AS length FROM pages"


@query("agg_15_catch_all_hosts", """
WITH h AS (SELECT host, cast(floor(avg(length)) AS bigint) AS m FROM stub_v GROUP BY 1 HAVING count(*) >= 3 AND bool_and(status = 200)),
r AS (SELECT 'stub' || doc_id % 4 AS host, CASE WHEN doc_id % 5 = 0 THEN 404 ELSE 200 END AS status, n_chars AS length, doc_id FROM documents)
SELECT doc_id, r.host, length FROM r LEFT JOIN h ON h.host = r.host WHERE NOT (status = 200 AND coalesce(m, 0) > 0 AND abs(length - coalesce(m, 0)) < coalesce(m, 0) * 0.2)""")
def agg_15(spark, sf):
    k = F.col("page_id") % 3
    stub = views.base(spark, sf, "pages").select(F.concat(F.lit("stub"), k.cast("string")).alias("host"), F.lit(200).alias("status"), (F.lit(400) + k * 100).alias("length"))
    docs = views.base(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("stub"), (F.col("doc_id") % 4).cast("string")).alias("host"),
        F.when(F.col("doc_id") % 5 == 0, 404).otherwise(200).alias("status"), F.col("n_chars").alias("length"),
    )
    return access.without_catch_all(docs, access.catch_all_hosts(stub)).select("doc_id", "host", "length")


@query("agg_33_auth_boundaries", "SELECT url, method, boundary_type, status FROM sighting_v")
def agg_33(spark, sf):
    return access.boundary_sightings(views.transactions(spark, sf)).select("url", "method", "boundary_type", "status")


@query("agg_34_mixed_status_paths", f"""
SELECT path AS url, arg_min(request_method, (ts, id)) FILTER (WHERE response_status IN (401, 403)) AS method, arg_min(response_status, (ts, id)) FILTER (WHERE response_status IN (401, 403)) AS unauth_status, 200 AS auth_status
FROM (SELECT request_method, ts, id, CASE WHEN id % 3 = 1 AND kind = 'error' THEN 200 ELSE response_status END AS response_status, {q.path('request_url')} AS path FROM txn) a
GROUP BY 1 HAVING bool_or(response_status IN (401, 403)) AND bool_or(response_status = 200)""")
def agg_34(spark, sf):
    # one denied request in three is answered here, so that paths mix
    opened = F.when((F.col("id") % 3 == 1) & F.col("request_url").contains("/admin/"), 200).otherwise(F.col("response_status"))
    txn = views.transactions(spark, sf).withColumn("response_status", opened)
    return access.mixed_status_paths(txn).select("url", "method", "unauth_status", "auth_status")


_ROLE = "CASE WHEN contains(source_module, 'auth') THEN source_module ELSE 'anonymous' END"


@query("agg_35_role_matrix", f"""
WITH r AS (SELECT request_url AS url, request_method AS method, {_ROLE} AS role, arg_max(response_status, (ts, id)) AS status FROM txn GROUP BY 1, 2, 3)
SELECT url, method, coalesce(max(status) FILTER (WHERE role = 'anonymous'), 0) AS unauth_status, coalesce(max(status) FILTER (WHERE role <> 'anonymous'), 0) AS auth_status,
  string_agg(role || '=' || status, ',' ORDER BY role) AS matrix FROM r GROUP BY 1, 2 HAVING count(DISTINCT status) > 1""")
def agg_35(spark, sf):
    role = F.when(F.lower("source_module").contains("auth"), F.col("source_module")).otherwise("anonymous")
    rows = access.role_matrix(views.transactions(spark, sf), role)
    shown = F.array_join(F.transform(F.map_entries("access_matrix"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rows.select("url", "method", "unauth_status", "auth_status", shown.alias("matrix"))


@query("agg_36_observed_profile", """
SELECT request_url AS url, coalesce(string_agg(DISTINCT request_method, ',' ORDER BY request_method) FILTER (WHERE response_status NOT IN (405, 0)), '') AS methods,
  coalesce(string_agg(DISTINCT 'application/x-www-form-urlencoded', ',') FILTER (WHERE request_method = 'POST'), '') AS types, max(h_allow) AS allow_header FROM txn GROUP BY 1""")
def agg_36(spark, sf):
    form = F.when(F.col("request_body") != "", "application/x-www-form-urlencoded").otherwise("")
    txn = views.transactions(spark, sf).withColumn("request_content_type", form)
    return access.observed_profile(txn).select(
        "url", F.array_join("accepted_methods", ",").alias("methods"), F.array_join("accepted_content_types", ",").alias("types"), "allow_header"
    )


@query("agg_37_rate_limits", f"SELECT {q.authority('request_url')} AS domain, count(*) FILTER (WHERE response_status = 429) AS backoffs, count(*) AS requests FROM txn GROUP BY 1")
def agg_37(spark, sf):
    return access.rate_limits(views.transactions(spark, sf))


_ONLY = "SELECT state, url FROM state_url WHERE state <> 'anonymous' AND url NOT IN (SELECT url FROM state_url WHERE state = 'anonymous')"


@query("agg_38_state_endpoint_counts", f"SELECT state, count(*) AS endpoints FROM (SELECT state, url FROM state_url WHERE state = 'anonymous' UNION ALL {_ONLY}) a GROUP BY 1")
def agg_38(spark, sf):
    return access.state_sizes(state_pairs(spark, sf))


_CTX = q.digest("auth_role || '|' || request_method || '|[]'", 12)


@query("agg_40_state_merge", f"""SELECT {_CTX} AS context_id, sha256(response_body) AS structure_hash, min(id) AS state_id, count(*) AS members FROM txn GROUP BY 1, 2""")
def agg_40(spark, sf):
    ctx = S.context_identity(F.col("auth_role"), F.col("request_method"), F.array().cast("array<string>"))
    return access.merge_states(views.transactions(spark, sf).select("id", ctx.alias("context_id"), F.col("content_hash").alias("structure_hash")))


@query("jn_20_state_only_endpoints", f"SELECT 'only' AS kind, state, url FROM ({_ONLY}) a UNION ALL SELECT 'exclusive', min(state), url FROM state_url GROUP BY url HAVING count(*) = 1")
def jn_20(spark, sf):
    pairs = state_pairs(spark, sf)
    out = access.state_only(pairs).select(F.lit("only").alias("kind"), "state", "url")
    return out.union(access.exclusive_to_state(pairs).select(F.lit("exclusive"), "state", "url"))


@query("jn_25_role_only_content", """
SELECT id, auth_role, request_method, request_url, 'auth:' || auth_role AS tag FROM (SELECT * FROM txn QUALIFY row_number() OVER (PARTITION BY sha256(response_body) ORDER BY ts, id) = 1) a
WHERE auth_role <> 'anonymous' AND response_status BETWEEN 200 AND 399""")
def jn_25(spark, sf):
    return access.role_only_content(views.transactions(spark, sf))


# ---- Differentials and exposure ----------------------------------------

_WORDS = "len(list_filter(regexp_split_to_array(trim(response_body), '\\s+'), lambda w: w <> ''))"
DUCK["probe_rows"] = f"""SELECT t.id, request_url AS endpoint, response_status AS status, strlen(response_body) AS length, sha256(response_body) AS hash, {_WORDS} AS words,
  list_filter(['server', 'date', 'content-type', CASE WHEN h_cf_ray IS NOT NULL THEN 'cf-ray' END, CASE WHEN location <> '' THEN 'location' END, CASE WHEN h_cookie IS NOT NULL THEN 'set-cookie' END, CASE WHEN h_via IS NOT NULL THEN 'via' END,
    CASE WHEN h_x_cache IS NOT NULL THEN 'x-cache' END, CASE WHEN h_age IS NOT NULL THEN 'age' END, CASE WHEN h_allow IS NOT NULL THEN 'allow' END, CASE WHEN h_powered IS NOT NULL THEN 'x-powered-by' END, CASE WHEN h_amz IS NOT NULL THEN 'x-amz-request-id' END], lambda h: h IS NOT NULL) AS headers, ts FROM txn t"""


@query("jn_17_baseline_differential", f"""
WITH b AS (SELECT * FROM probe_rows QUALIFY row_number() OVER (PARTITION BY endpoint ORDER BY ts, id) = 1),
r AS (SELECT p.id, p.endpoint, CASE WHEN p.status // 100 <> b.status // 100 THEN 'status_' || b.status || '_to_' || p.status WHEN p.hash = b.hash THEN ''
  WHEN abs(p.length - b.length) > greatest(b.length * 0.05, 50) THEN 'length_diff_' || abs(p.length - b.length) WHEN abs(p.words - b.words) > 3 THEN 'word_diff_' || abs(p.words - b.words)
  WHEN len(list_filter(p.headers, lambda h: NOT list_contains(b.headers, h) AND h NOT IN ('date', 'age', 'x-request-id', 'x-trace-id', 'cf-ray'))) > 0
    THEN 'new_headers_' || array_to_string(list_sort(list_filter(p.headers, lambda h: NOT list_contains(b.headers, h) AND h NOT IN ('date', 'age', 'x-request-id', 'x-trace-id', 'cf-ray'))), ',') ELSE '' END AS reason
  FROM probe_rows p JOIN b USING (endpoint))
SELECT id, endpoint, reason, reason <> '' AS is_different FROM r""")
def jn_17(spark, sf):
    c = F.col
    words = F.size(F.filter(F.split(F.trim("response_body"), r"\s+"), lambda w: w != ""))
    rows = views.transactions(spark, sf).select(
        "id", "ts", c("request_url").alias("endpoint"), c("response_status").alias("status"), F.octet_length("response_body").alias("length"),
        c("content_hash").alias("hash"), words.alias("words"), F.transform(F.map_keys("response_headers"), F.lower).alias("headers"),
    )
    cols = ["status", "length", "hash", "words", "headers"]
    base = rows.groupBy("endpoint").agg(F.min_by(F.struct(*cols), F.struct("ts", "id")).alias("b")).select("endpoint", "b.*")
    return access.baseline_difference(rows, base)


@query("jn_22_sensitive_paths", f"""
WITH w AS (SELECT 'config' || n_nationkey AS word FROM nation UNION SELECT 'admin/config' || n_nationkey FROM nation UNION SELECT 'register'),
e AS (SELECT word || x AS entry FROM w, (VALUES (''), ('.bak'), ('.php')) t(x))
SELECT DISTINCT request_url, response_status, entry FROM txn JOIN e ON regexp_replace({q.path('request_url')}, '^/|/$', '', 'g') = e.entry WHERE page_type IN ('real_content', 'auth_required')""")
def jn_22(spark, sf):
    n = F.col("n_nationkey").cast("string")
    words = views.base(spark, sf, "nation").select(F.explode(F.array(F.concat(F.lit("config"), n), F.concat(F.lit("admin/config"), n), F.lit("register"))).alias("word")).distinct()
    return access.exposed_paths(views.transactions(spark, sf), words, [".bak", ".php"])


@query("jn_23_backup_copies", f"""
WITH p AS (SELECT DISTINCT {q.host('request_url')} AS host, {q.path('request_url')} AS path FROM txn)
SELECT a.host, b.path AS original, a.path AS copy FROM p a JOIN p b ON a.host = b.host AND a.path IN (b.path || '.bak', b.path || '.old', b.path || '.orig', b.path || '.save', b.path || '.swp', b.path || '~', b.path || '.backup', b.path || '.copy')""")
def jn_23(spark, sf):
    return access.backup_copies(views.transactions(spark, sf))
