"""Frontier queries: priorities, pages, merges, splits, gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import coverage, frontier, surface
from . import sqlkit as q, views
from .ordered import flags
from .registry import query
from .surface import boundaries, counted, endpoints, params, vectors

DUCK = views.DUCK
DUCK["queue_t"] = f"SELECT *, {q.template('url')} AS template FROM queue"


def queue(spark, sf):
    return views.table(spark, sf, "queue")


def post(spark, sf):
    return coverage.posterior(flags(spark, sf))


@query("jn_15_focus_boost", """SELECT seq, CASE WHEN contains(url, '/admin') OR contains(url, '/checkout') THEN priority + 15 ELSE priority END AS boosted,
  CASE WHEN contains(url, '/api/') THEN 30 WHEN contains(url, 'app1') THEN 2 ELSE priority END AS assigned FROM queue""")
def jn_15(spark, sf):
    rows = queue(spark, sf).withColumn("given", F.col("priority"))
    boosted = frontier.boost(rows, ["/admin", "/checkout"], 15).withColumnRenamed("priority", "boosted")
    assigned = frontier.reprioritise(boosted.withColumnRenamed("given", "priority"), [("/api/", 30), ("app1", 2)])
    return assigned.select("seq", "boosted", F.col("priority").alias("assigned"))


@query("top_01_priority_score", f"""
WITH m AS (SELECT source_module, round(avg(is_new::int), 4) AS rate FROM flag_v GROUP BY 1),
s AS (SELECT k.seq, 10.0 + CASE WHEN coalesce(p.hits, 0) = 0 THEN 8 WHEN p.hits < 3 THEN 4 ELSE -least(p.hits, 10) END + coalesce({q.first_label('k.url', C.SECURITY_WEIGHTS)}, 0.0) - k.depth * 0.5
  + CASE WHEN coalesce(m.rate, 0) > 0.3 THEN 3 ELSE 0 END + coalesce(p.alpha, 1)::double / (coalesce(p.alpha, 1) + coalesce(p.beta, 1)) * 10 AS score
  FROM queue_t k LEFT JOIN posterior_v p USING (template) LEFT JOIN m USING (source_module))
SELECT seq, greatest(1, cast(trunc(score) AS int)) AS priority FROM s""")
def top_01(spark, sf):
    rates = coverage.discovery_by(flags(spark, sf), "source_module")
    return frontier.priorities(queue(spark, sf), post(spark, sf), rates).select("seq", "priority")


@query("top_01_priority_sampled", "SELECT seq, true AS in_bounds FROM queue")
def top_01_sampled(spark, sf):
    """Draws are random: every sampled priority lies between those at draws 0 and 1."""
    rates = coverage.discovery_by(flags(spark, sf), "source_module")
    low, drawn, high = (
        frontier.priorities(queue(spark, sf), post(spark, sf), rates, mode=m, seed=7).select("seq", F.col("priority").alias(m)) for m in ("low", "sample", "high")
    )
    return drawn.join(low, "seq").join(high, "seq").select("seq", F.col("sample").between(F.col("low"), F.col("high")).alias("in_bounds"))


@query("top_02_frontier_order", f"SELECT seq, url, priority FROM queue WHERE {q.host('url')} = 'app1.example.com' AND depth <= 4 ORDER BY priority DESC, seq LIMIT 200")
def top_02(spark, sf):
    return frontier.next_requests(queue(spark, sf), "app1.example.com", 4, 200).select("seq", "url", "priority")


@query("top_03_queue_page", "SELECT seq, url, method, priority, depth FROM queue ORDER BY priority DESC, seq LIMIT 50 OFFSET 100")
def top_03(spark, sf):
    return frontier.queue_page(queue(spark, sf), 100, 50).select("seq", "url", "method", "priority", "depth")


def template_lists_sql(k=20):
    rate = "round(alpha * 1.0 / (alpha + beta), 3)::double AS hit_rate"
    return f"""SELECT * FROM (SELECT 'productive' AS list, template, alpha, beta, {rate} FROM posterior_v ORDER BY alpha DESC, template LIMIT {k}) a
UNION ALL SELECT * FROM (SELECT 'under_explored', template, alpha, beta, {rate} FROM posterior_v ORDER BY beta / alpha DESC, template LIMIT {k}) b"""


@query("top_04_template_lists", template_lists_sql())
def top_04(spark, sf):
    return coverage.template_lists(post(spark, sf))


@query("top_05_recrawl_targets", f"""
SELECT method, url, round(CASE WHEN url IN (SELECT request_url FROM insight_v WHERE insight_type IN ('auth_boundary', 'redirect_boundary')) THEN 10 ELSE 0 END
  + CASE WHEN coalesce(p.hits, 0) = 0 THEN 5 WHEN p.hits < 3 THEN 2 ELSE 0 END - depth * 0.3, 6)::double AS score
FROM (SELECT *, {q.template('url')} AS template FROM endpoint_v) e LEFT JOIN posterior_v p USING (template) ORDER BY 3 DESC, seq LIMIT 100""")
def top_05(spark, sf):
    bounds = coverage.auth_insights(coverage.insights(views.transactions(spark, sf))).select(F.col("request_url").alias("url"))
    return frontier.recrawl_targets(endpoints(spark, sf), bounds, post(spark, sf), 100).select("method", "url", "score")


@query("top_06_report_tables", """
SELECT * FROM (SELECT 'crawled' AS section, method || ' ' || url AS key FROM endpoint_v WHERE NOT list_has_any(tags, ['wayback', 'commoncrawl', 'otx'])) a
UNION ALL SELECT * FROM (SELECT 'passive', method || ' ' || url FROM endpoint_v WHERE list_has_any(tags, ['wayback', 'commoncrawl', 'otx'])) b
UNION ALL SELECT * FROM (SELECT 'risky', endpoint_url || ' ' || name || ' ' || location FROM vector_v WHERE len(risks) > 0) c""")
def top_06(spark, sf):
    return surface.report_tables(endpoints(spark, sf), vectors(spark, sf))


@query("top_07_path_search", f"""
SELECT {q.path('url')} AS path, method, url, param_count FROM counted_v WHERE contains(lower({q.path('url')}), 'admin')
QUALIFY row_number() OVER (PARTITION BY {q.path('url')} ORDER BY param_count DESC, seq) = 1""")
def top_07(spark, sf):
    return surface.path_search(counted(spark, sf), "ADMIN").select("path", "method", "url", "param_count")


# ---- Statistics --------------------------------------------------------


@query("agg_21_endpoint_clusters", f"""
WITH e AS (SELECT *, {q.template('url')} AS template FROM endpoint_v), b AS (SELECT DISTINCT {q.template('url')} AS template FROM boundary_v),
n AS (SELECT {q.template('url')} AS template, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM param_v GROUP BY 1),
s AS (SELECT template, string_agg(url, ' ' ORDER BY seq) AS samples FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY template ORDER BY seq) <= 5) x GROUP BY 1)
SELECT template, count(*) AS count, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, coalesce(any_value(n.names), '') AS param_names, any_value(s.samples) AS samples,
  template IN (SELECT template FROM b) AS has_auth_boundary, coalesce(any_value(p.alpha), 1) AS alpha, coalesce(any_value(p.beta), 1) AS beta
FROM e LEFT JOIN n USING (template) LEFT JOIN s USING (template) LEFT JOIN posterior_v p USING (template) GROUP BY template""")
def agg_21(spark, sf):
    rows = frontier.endpoint_clusters(endpoints(spark, sf), params(spark, sf), boundaries(spark, sf), post(spark, sf))
    return rows.select(
        "template", "count", F.array_join("methods", ",").alias("methods"), F.array_join("param_names", ",").alias("param_names"),
        F.array_join("sample_urls", " ").alias("samples"), "has_auth_boundary", "alpha", "beta",
    )


@query("agg_22_queue_stats", """SELECT 'source' AS kind, source_module AS key, count(*) AS n FROM queue GROUP BY 2
UNION ALL SELECT 'priority', CASE WHEN priority >= 20 THEN 'high (20+)' WHEN priority >= 10 THEN 'medium (10-19)' ELSE 'low (0-9)' END, count(*) FROM queue GROUP BY 2""")
def agg_22(spark, sf):
    return frontier.queue_stats(queue(spark, sf))


DUCK["preview_v"] = """SELECT template, n, CASE WHEN n < 2 THEN 1 ELSE m END AS combined, CASE WHEN n < 2 THEN 1 ELSE least(n, 3) END AS sampled
  FROM (SELECT template, count(*) AS n, count(DISTINCT method) AS m FROM queue_t GROUP BY 1) a"""


@query("agg_23_merge_preview", """
SELECT 'combine_params' AS strategy, cast(sum(n) AS bigint) AS total_before, cast(sum(combined) AS bigint) AS total_after, round((sum(n) - sum(combined)) * 100.0 / sum(n), 1)::double AS reduction_pct FROM preview_v
UNION ALL SELECT 'sample_template', cast(sum(n) AS bigint), cast(sum(sampled) AS bigint), round((sum(n) - sum(sampled)) * 100.0 / sum(n), 1)::double FROM preview_v
UNION ALL SELECT 'batch_endpoints', cast(sum(n) AS bigint), count(*), round((sum(n) - count(*)) * 100.0 / sum(n), 1)::double FROM preview_v""")
def agg_23(spark, sf):
    out = None
    for s in ("combine_params", "sample_template", "batch_endpoints"):
        one = frontier.merge_reduction(frontier.merge_preview(queue(spark, sf), s)).withColumn("strategy", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return out


# ---- Sets --------------------------------------------------------------


@query("set_01_coverage_gaps", """
WITH g AS (SELECT 1 AS rank, 'untested_method' AS gap_type, request_url AS url, detail FROM insight_v WHERE insight_type = 'method_hint'
  UNION ALL SELECT * FROM (SELECT 2, 'unspidered', url, method || ' ' || url || ' discovered by ' || source_module || ' but never spidered' AS detail FROM (SELECT * FROM endpoint_v WHERE url NOT IN (SELECT request_url FROM txn WHERE source_module = 's_crawl')
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1) u) u2
  UNION ALL SELECT 3, 'auth_boundary', url, 'Auth boundary (' || boundary_type || ') not re-tested with credentials' FROM boundary_v WHERE auth_status = 0
  UNION ALL SELECT 4, 'low_coverage', template, 'Template tried ' || (alpha + beta - 2) || ' times but only ' || (alpha - 1) || ' new coverage hits' FROM posterior_v WHERE beta > 5 AND alpha <= 1)
SELECT gap_type, url, detail FROM g""")
def set_01(spark, sf):
    txn = views.transactions(spark, sf)
    hints = coverage.method_hints(coverage.insights(txn))
    done = txn.where("source_module = 's_crawl'").select(F.col("request_url").alias("url"))
    open_ = surface.unspidered(endpoints(spark, sf), done)
    return frontier.coverage_gaps(hints, open_, boundaries(spark, sf), post(spark, sf), ["user"]).select("gap_type", "url", "detail")


@query("set_02_queue_merge", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY priority DESC, seq) AS rn, count(*) OVER (PARTITION BY template) AS n FROM queue_t)
SELECT 'batch_endpoints' AS strategy, template, url, method, priority FROM r WHERE rn = 1
UNION ALL SELECT 'sample_template', template, url, method, priority FROM r WHERE rn <= 3
UNION ALL SELECT 'combine_params', template, arg_min(url, rn), method, max(priority) FROM r GROUP BY template, method""")
def set_02(spark, sf):
    out = None
    for s in ("batch_endpoints", "sample_template", "combine_params"):
        one = frontier.merge_queue(queue(spark, sf), s).select(F.lit(s).alias("strategy"), "template", "url", "method", "priority")
        out = one if out is None else out.unionByName(one)
    return out


@query("set_03_queue_split", "SELECT seq, CASE WHEN contains(url, '.bak') OR contains(url, '/static/') THEN 'removed' ELSE 'kept' END AS part FROM queue")
def set_03(spark, sf):
    removed, kept = frontier.split(queue(spark, sf), [".bak", "/static/"])
    return removed.select("seq", F.lit("removed").alias("part")).union(kept.select("seq", F.lit("kept")))


@query("set_04_injection_audit", f"""
WITH w AS (SELECT seq, url, depth, {q.normalize('url')} AS norm, CASE WHEN depth > 4 THEN 'rejected_depth' WHEN {q.host('url')} <> 'app1.example.com' THEN 'rejected_scope' END AS early FROM queue),
o AS (SELECT seq, coalesce(early, CASE WHEN norm IN (SELECT request_url FROM txn WHERE source_module = 's_crawl') OR row_number() OVER (PARTITION BY norm, early IS NULL ORDER BY seq) > 1 THEN 'rejected_duplicate' ELSE 'accepted' END) AS outcome FROM w)
SELECT outcome, count(*) AS n, min(seq) AS first_seq FROM o GROUP BY 1""")
def set_04(spark, sf):
    seen = views.table(spark, sf, "txn").where("source_module = 's_crawl'").select(F.col("request_url").alias("url"))
    audit = frontier.injection_audit(queue(spark, sf).select("url", "depth", "seq"), seen, "app1.example.com", 4)
    return audit.groupBy("outcome").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
