"""Data-quality plays and the extension surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqlfuncs
from ..operators import coverage, fingerprint as fp, quality
from ..signatures import infra
from . import fingerprint as fpq, sqlkit as q, views
from .ordered import flags
from .registry import query
from .surface import counted, endpoints, secrets, vectors


def shown(findings):
    facts = F.array_join(F.array_sort(F.transform(F.map_entries("evidence"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return findings.select("play", "severity", "title", facts.alias("facts"))


def txn(spark, sf):
    return views.transactions(spark, sf)


@query("dq_01_completeness", "SELECT 'P1_completeness' AS play, 'info' AS severity, 'Completeness check passed' AS title, 'endpoints_found=' || (SELECT count(*) FROM endpoint_v) || ';requests_total=' || (SELECT count(*) FROM txn) AS facts")
def dq_01(spark, sf):
    return shown(quality.completeness({"transactions": txn(spark, sf), "endpoints": endpoints(spark, sf)}))


@query("dq_01_completeness_of_failing_log", """
WITH c AS (SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'view' OR kind = 'signup' OR kind = 'purchase') AS failed, count(*) FILTER (WHERE kind IN ('click', 'script') OR response_status = 500) AS errors FROM txn)
SELECT 'P1_completeness' AS play, 'fail' AS severity, 'Very few endpoints discovered' AS title, 'endpoints_found=0;requests_total=' || total AS facts FROM c
UNION ALL SELECT 'P1_completeness', 'warn', 'High error rate', 'failed=' || failed || ';rate=' || round(failed / total, 3) || ';total=' || total FROM c WHERE failed / total > 0.5
UNION ALL SELECT 'P1_completeness', 'warn', 'High server error rate', 'count_5xx=' || errors || ';rate=' || round(errors / total, 3) || ';total=' || total FROM c WHERE errors / total > 0.2""")
def dq_01_failing(spark, sf):
    url = F.col("request_url")
    status = F.when(url.contains("/products/") | url.contains("/static/"), 503).when(url.contains("/admin/"), F.col("response_status")).otherwise(0)
    none = endpoints(spark, sf).where("method = 'NONE'")
    return shown(quality.completeness({"transactions": txn(spark, sf).withColumn("response_status", status), "endpoints": none}))


@query("dq_02_login_verification", """
WITH p AS (SELECT *, CASE WHEN regexp_matches(lower(location), 'login') AND response_status = 302 THEN 'Login redirect loop detected' WHEN h_cookie IS NULL AND response_status = 200 THEN 'Login returned 200 but no Set-Cookie' WHEN h_cookie IS NOT NULL THEN 'Login appears successful' END AS title,
  row_number() OVER (ORDER BY ts, id) AS rn FROM txn WHERE request_url LIKE '%register%' AND request_method = 'POST')
SELECT 'P2_auth' AS play, CASE title WHEN 'Login redirect loop detected' THEN 'fail' WHEN 'Login appears successful' THEN 'info' ELSE 'warn' END AS severity, title, 'status=' || response_status || ';url=' || request_url AS facts
FROM p WHERE title IS NOT NULL AND rn <= (SELECT min(rn) FROM p WHERE title <> 'Login returned 200 but no Set-Cookie')""")
def dq_02(spark, sf):
    return shown(quality.login_verification({"transactions": txn(spark, sf)}, "register"))


_ERR = quality.ERROR_TEXT[0]


@query("dq_03_response_semantics", f"""
WITH h AS (SELECT * FROM txn WHERE response_status = 200 AND response_content_type LIKE '%html%'), g AS (SELECT count(*) AS n FROM h GROUP BY sha256(response_body) HAVING count(*) >= 5),
c AS (SELECT (SELECT count(*) FROM g) AS groups, (SELECT cast(sum(n) AS bigint) FROM g) AS affected, (SELECT count(*) FROM h WHERE regexp_matches(response_body, {q.quote(_ERR)})) AS errors, (SELECT count(*) FROM h WHERE strlen(response_body) < 100) AS tiny)
SELECT 'P3_semantics' AS play, 'warn' AS severity, 'Soft-404 detected: ' || groups || ' duplicate response patterns' AS title, 'duplicate_groups=' || groups || ';total_affected_urls=' || affected AS facts FROM c
UNION ALL SELECT 'P3_semantics', 'warn', errors || ' potential false positive endpoints', 'count=' || errors FROM c WHERE errors > 3
UNION ALL SELECT 'P3_semantics', 'info', tiny || ' responses with near-empty bodies', 'count=' || tiny FROM c WHERE tiny > 5""")
def dq_03(spark, sf):
    return shown(quality.response_semantics({"transactions": txn(spark, sf)}))


@query("dq_04_input_vectors", """
WITH c AS (SELECT (SELECT count(*) FROM counted_v) AS n, (SELECT count(*) FROM counted_v WHERE param_count > 0) AS filled, (SELECT count(*) FROM vector_v) AS v, (SELECT count(*) FROM vector_v WHERE len(risks) > 0) AS risky, (SELECT count(*) FROM vector_v WHERE is_reflected) AS refl,
  (SELECT string_agg(risk || '=' || k, ',' ORDER BY risk) FROM (SELECT risk, count(*) AS k FROM (SELECT unnest(risks) AS risk FROM vector_v) r GROUP BY 1) d) AS dist)
SELECT 'P4_input_vectors' AS play, 'warn' AS severity, 'Low parameter coverage' AS title, 'endpoints_total=' || n || ';endpoints_with_params=' || filled || ';paramless_ratio=' || round(1 - filled / n, 3) AS facts FROM c WHERE 1 - filled / n > 0.7 AND n > 10
UNION ALL SELECT 'P4_input_vectors', 'info', 'Input vector summary', 'high_risk=' || risky || ';reflected=' || refl || ';risk_distribution=' || dist || ';total_vectors=' || v FROM c""")
def dq_04(spark, sf):
    return shown(quality.vector_quality({"endpoints": counted(spark, sf), "vectors": vectors(spark, sf)}))


@query("dq_06_scope_efficiency", """
WITH t AS (SELECT regexp_replace(split_part(request_url, '?', 1), '/[0-9]+', '/{id}', 'g') AS template, count(*) AS n FROM txn GROUP BY 1), o AS (SELECT * FROM t WHERE n > 20),
c AS (SELECT (SELECT count(*) FROM endpoint_v) AS eps, (SELECT count(*) FROM txn) AS total, (SELECT count(*) FROM o) AS k, (SELECT string_agg(template || '=' || n, ',' ORDER BY n DESC, template) FROM o) AS list)
SELECT 'P6_scope' AS play, 'warn' AS severity, k || ' over-sampled URL templates' AS title, 'oversampled=' || list AS facts FROM c WHERE k > 0
UNION ALL SELECT 'P6_scope', 'info', printf('Scope efficiency: %.1f%%', eps * 100.0 / total), 'efficiency=' || round(eps / total, 4) || ';total_requests=' || total || ';unique_endpoints=' || eps FROM c""")
def dq_06(spark, sf):
    return shown(quality.scope_efficiency({"transactions": txn(spark, sf), "endpoints": endpoints(spark, sf)}))


@query("dq_07_secret_plausibility", """
WITH s AS (SELECT value, CASE WHEN value LIKE 'live-1%' THEN 'token' ELSE kind END AS kind FROM secret_v UNION ALL SELECT 'test-' || page_id, 'credential' FROM pages UNION ALL SELECT 'k' || page_id, 'api_key' FROM pages),
c AS (SELECT count(*) AS total, count(*) FILTER (WHERE regexp_matches(lower(value), 'test|example|placeholder|xxx|dummy|sample|demo|todo')) AS fake, count(*) FILTER (WHERE length(value) < 10 AND kind IN ('api_key', 'token')) AS short FROM s)
SELECT 'P7_secrets' AS play, 'warn' AS severity, fake || ' likely false positive secrets' AS title, 'count=' || fake AS facts FROM c UNION ALL SELECT 'P7_secrets', 'warn', short || ' suspiciously short tokens', 'count=' || short FROM c
UNION ALL SELECT 'P7_secrets', 'info', (total - fake - short) || ' potentially valid secrets found', 'filtered_valid=' || (total - fake - short) || ';total=' || total FROM c WHERE total - fake - short > 0""")
def dq_07(spark, sf):
    pages = views.base(spark, sf, "pages")
    more = pages.select(F.concat(F.lit("test-"), "page_id").alias("value"), F.lit("credential").alias("kind"))
    more = more.union(pages.select(F.concat(F.lit("k"), "page_id"), F.lit("api_key")))
    return shown(quality.secret_plausibility({"secrets": secrets(spark, sf).select("value", "kind").union(more)}))


@query("dq_08_discovery_momentum", """
WITH p AS (SELECT source_module AS phase, count(*) AS requests, count(*) FILTER (WHERE is_new) AS new FROM flag_v GROUP BY 1 UNION ALL SELECT 'idle', 60, 0)
SELECT 'P8_momentum' AS play, CASE WHEN (SELECT bool_and(saturated) FROM sat_last) THEN 'info' WHEN requests > 50 AND new = 0 THEN 'warn' ELSE 'info' END AS severity,
  CASE WHEN (SELECT bool_and(saturated) FROM sat_last) THEN 'Coverage saturated' WHEN requests > 50 AND new = 0 THEN 'No new coverage from this phase' ELSE printf('Discovery momentum: %.1f%%', new * 100.0 / requests) END AS title,
  CASE WHEN (SELECT bool_and(saturated) FROM sat_last) THEN 'phase=' || phase WHEN requests > 50 AND new = 0 THEN 'phase=' || phase || ';phase_requests=' || requests
    ELSE 'new_coverage=' || new || ';phase=' || phase || ';phase_discovery_rate=' || round(new / requests, 4) || ';phase_requests=' || requests END AS facts FROM p""")
def dq_08(spark, sf):
    f = flags(spark, sf)
    phases = coverage.discovery_by(f, "source_module").select(F.col("source_module").alias("phase"), "requests", "new_coverage")
    idle = f.agg(F.lit("idle").alias("phase"), F.lit(60).cast("long").alias("requests"), F.lit(0).cast("long").alias("new_coverage"))
    return shown(quality.discovery_momentum({"coverage": coverage.coverage_stats(f), "phases": phases.union(idle)}))


def all_findings(spark, sf):
    tables = {"transactions": txn(spark, sf), "endpoints": endpoints(spark, sf), "tech": fpq.tech_table(spark, sf)}
    out = quality.completeness(tables).unionByName(quality.response_semantics(tables)).unionByName(quality.scope_efficiency(tables))
    out = out.unionByName(quality.login_verification(tables, "register"))
    return out.unionByName(quality.tech_coverage(tables, ["s1_spider", "s5_api"]))


@query("dq_09_hints_and_severity", """
WITH l AS (SELECT location, row_number() OVER (ORDER BY ts, id) AS rn FROM txn WHERE kind = 'signup'), f AS (SELECT 'info' AS severity UNION ALL SELECT 'warn' UNION ALL SELECT 'warn' WHERE (SELECT count(*) FROM txn WHERE response_status = 200 AND response_content_type LIKE '%html%' AND regexp_matches(response_body, '(?i)not\\s+found|forbidden|unauthorized|access\\s+denied')) > 3
  UNION ALL SELECT 'info' UNION ALL SELECT 'warn' UNION ALL SELECT 'info' UNION ALL SELECT CASE WHEN location = '/login' THEN 'fail' ELSE 'info' END FROM l WHERE rn = 1
  UNION ALL SELECT 'warn' FROM (SELECT DISTINCT 1 FROM tech_v WHERE name IN ('php', 'wordpress', 'drupal', 'joomla', 'laravel')) x UNION ALL SELECT 'warn' FROM (SELECT DISTINCT 1 FROM tech_v WHERE name IN ('react', 'vue', 'angular', 'next.js', 'nuxt')) y)
SELECT 'severity' AS kind, severity AS key, count(*) AS n FROM f GROUP BY 2
UNION ALL SELECT 'hint', 'focus_area', 1 UNION ALL SELECT 'hint', 'fix_auth', 1 FROM l WHERE rn = 1 AND location = '/login'
UNION ALL SELECT 'hint', 'enable_module', (SELECT count(DISTINCT CASE WHEN name IN ('react', 'vue', 'angular', 'next.js', 'nuxt') THEN 'a' ELSE 'b' END) FROM tech_v WHERE name IN ('php', 'wordpress', 'drupal', 'joomla', 'laravel', 'react', 'vue', 'angular', 'next.js', 'nuxt'))""")
def dq_09(spark, sf):
    found = all_findings(spark, sf)
    counts = quality.severity_counts(found).select(F.lit("severity").alias("kind"), F.col("severity").alias("key"), "n")
    return counts.union(quality.hints(found).groupBy("action").agg(F.count("*").alias("n")).select(F.lit("hint"), "action", "n"))


# ---- Extension surface -------------------------------------------------


@query("udf_01_custom_signatures", """SELECT 'shop_engine' AS component, 'cms' AS category, 'location: ' || location AS detail, count(*) AS hits FROM txn WHERE location LIKE '/checkout%' GROUP BY 3
UNION ALL SELECT component, category, detail, hits FROM ev_header""")
def udf_01(spark, sf):
    mine = [*infra.HEADERS, ("shop_engine", "cms", "location", "^/checkout", 0.7, 0)]
    return fp.header_matches(txn(spark, sf), mine).select("component", "category", "detail", "hits")


def redirect_share(tables):
    """A user's own play: share of redirects."""
    s = tables["transactions"].agg(F.count_if(F.col("response_status") == 302).alias("n"), F.count("*").alias("total"))
    return s.select(quality.finding("redirects", "info", "Redirect share", count=F.col("n"), total=F.col("total")).alias("f")).select("f.*")


@query("udf_02_custom_play", "SELECT 'redirects' AS play, 'audit' AS phase, 'count=' || count(*) FILTER (WHERE response_status = 302) || ';total=' || count(*) AS facts FROM txn")
def udf_02(spark, sf):
    plays = {**quality.PLAYS, "audit": [redirect_share]}
    rows = quality.run_plays({"transactions": txn(spark, sf)}, "audit", plays)
    facts = F.array_join(F.array_sort(F.transform(F.map_entries("evidence"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return rows.select("play", "phase", facts.alias("facts"))


@query("udf_03_sql_functions", f"""SELECT id, {q.template('request_url')} AS template, {q.normalize('request_url')} AS normalized, {q.text_hash('response_body')} AS structure,
  CASE WHEN response_status BETWEEN 300 AND 399 THEN CASE WHEN location LIKE '%login%' THEN 'auth_required' ELSE 'redirect' END WHEN response_status IN (401, 403) THEN 'auth_required' WHEN response_status >= 500 THEN 'error' WHEN response_status = 404 THEN 'custom_404' ELSE 'real_content' END AS page_type FROM txn""")
def udf_03(spark, sf):
    sqlfuncs.register(spark)
    return views.table(spark, sf, "txn").selectExpr(
        "id", "url_template(request_url) AS template", "normalize_url(request_url) AS normalized", "html_structure(response_body) AS structure",
        "status_page_type(response_status, location) AS page_type",
    )
