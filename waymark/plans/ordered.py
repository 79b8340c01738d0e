"""Coverage windows, flows, transitions and streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, coverage, flows, frontier, surface
from ..functions import classify as C, urls as U
from . import sqlkit as q, views
from .registry import query
from .scalar import AUTH_LEVEL, FLOW_NAME_SQL
from .surface import endpoints

DUCK = views.DUCK
_STRUCT = f"""CASE WHEN response_body = '' THEN 'empty' WHEN response_content_type LIKE '%json%' THEN cast(json_structure(response_body) AS varchar)
  WHEN response_content_type LIKE '%html%' THEN {q.text_hash('response_body')} ELSE cast(strlen(response_body) // 1024 AS varchar) END"""
DUCK["cov_rows"] = f"""SELECT id, ts, crawl_id, source_module, request_url, {q.template('request_url')} AS template, request_method AS method, response_status // 100 AS sc, {_STRUCT} AS st, auth_role AS role FROM txn"""
DUCK["flag_v"] = "SELECT *, row_number() OVER (PARTITION BY crawl_id, template, method, sc, st, role ORDER BY ts, id) = 1 AS is_new FROM cov_rows"
DUCK["posterior_v"] = "SELECT template, count(*) AS hits, count(*) FILTER (WHERE is_new) + 1 AS alpha, count(*) FILTER (WHERE NOT is_new) + 1 AS beta FROM flag_v GROUP BY 1"
DUCK["sat_v"] = """SELECT crawl_id, id, ts, row_number() OVER w AS pos, avg(is_new::int) OVER (PARTITION BY crawl_id ORDER BY ts, id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS rate
  FROM flag_v WINDOW w AS (PARTITION BY crawl_id ORDER BY ts, id)"""
DUCK["sat_last"] = "SELECT crawl_id, pos, rate, pos >= 200 AND rate < 0.02 AS saturated FROM sat_v QUALIFY row_number() OVER (PARTITION BY crawl_id ORDER BY pos DESC) = 1"


def flags(spark, sf):
    return coverage.new_coverage(views.transactions(spark, sf))


@query("win_01_new_coverage", "SELECT id, is_new FROM flag_v")
def win_01(spark, sf):
    return flags(spark, sf).select("id", "is_new")


@query("win_02_saturation", "SELECT id, pos, round(rate, 6) AS discovery_rate, pos >= 200 AND rate < 0.02 AS saturated FROM sat_v")
def win_02(spark, sf):
    return coverage.saturation(flags(spark, sf)).select("id", "pos", F.round("discovery_rate", 6).alias("discovery_rate"), "saturated")


_FPRINT = f"upper(request_method) || '|' || {q.normalize('request_url')} || '|' || request_body || '|' || auth_role"


@query("win_03_arrival_dedup", f"""SELECT id, 'request' AS kind FROM txn QUALIFY row_number() OVER (PARTITION BY {_FPRINT} ORDER BY ts, id) = 1
UNION ALL SELECT id, 'content' FROM txn QUALIFY row_number() OVER (PARTITION BY sha256(response_body) ORDER BY ts, id) = 1""")
def win_03(spark, sf):
    c = F.col
    txn = views.transactions(spark, sf)
    key = U.request_key(c("request_url"), c("request_method"), c("request_body"), c("auth_role"))
    by_request = frontier.first_arrivals(txn.select("id", "ts", key.alias("key")), "key")
    by_content = frontier.first_arrivals(txn.select("id", "ts", c("content_hash").alias("key")), "key")
    return by_request.select("id", F.lit("request").alias("kind")).union(by_content.select("id", F.lit("content")))


CAPS = [("/checkout/confirm?order=", 5), ("/api/*", 7), ("/admin", 3)]


@query("win_04_template_cap", f"""
WITH k AS (SELECT seq, {q.template('url')} AS template FROM queue),
c AS (SELECT *, CASE WHEN contains(template, '/checkout/confirm?order=') THEN 5 WHEN starts_with(template, '/api/') THEN 7 WHEN contains(template, '/admin') THEN 3 END AS cap,
  row_number() OVER (PARTITION BY template ORDER BY seq) AS rn FROM k)
SELECT seq, template FROM c WHERE cap IS NULL OR rn <= cap""")
def win_04(spark, sf):
    return frontier.template_cap(views.table(spark, sf, "queue"), CAPS).select("seq", "template")


LINK_SQL = """
click_link AS (SELECT id AS page, depth + 1 AS depth, 'https://app0.example.com/' || sec || '/item' || n AS url, '/' || sec AS prefix, ts, id, i AS n
  FROM (SELECT id, ts, depth, i, CASE WHEN i < 7 THEN 'sec' || id % 3 ELSE 'misc' || i END AS sec, i * 2 AS n FROM txn, range(0, 9) r(i) WHERE kind = 'click')),
cnt AS (SELECT *, count(*) OVER (PARTITION BY page, prefix) AS c FROM click_link),
rnk AS (SELECT *, row_number() OVER (PARTITION BY depth, prefix ORDER BY ts, id, n) AS r FROM cnt WHERE c > 5)"""


@query("win_05_partial_order_reduction", f"""WITH {LINK_SQL}
SELECT page, n AS link_no, CASE WHEN r = 1 THEN 'scored' ELSE 'lowest' END AS priority_class FROM rnk UNION ALL SELECT page, n, 'by_depth' FROM cnt WHERE c <= 5""")
def win_05(spark, sf):
    txn = views.table(spark, sf, "txn").where("kind = 'click'")
    rows = txn.select("id", F.col("ts").cast("timestamp").alias("ts"), (F.col("depth") + 1).alias("depth"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("link_no"))
    sec = F.when(F.col("link_no") < 7, F.concat(F.lit("sec"), (F.col("id") % 3).cast("string"))).otherwise(F.concat(F.lit("misc"), F.col("link_no").cast("string")))
    links = rows.select(
        F.col("id").alias("page"), "depth", F.concat(F.lit("https://app0.example.com/"), sec, F.lit("/item"), (F.col("link_no") * 2).cast("string")).alias("url"),
        F.struct("ts", "id", "link_no").alias("seq"), F.col("link_no").cast("long").alias("link_no"),
    )
    return frontier.partial_order_reduction(links).select("page", "link_no", "priority_class")


_TARGET = "CASE WHEN response_status IN (301, 302, 303, 307, 308) THEN CASE WHEN location <> '' THEN regexp_extract(request_url, '^(https?://[^/]+)', 1) || location ELSE '' END ELSE request_url END"
DUCK["flow_rows"] = f"""
SELECT *, sum(start) OVER (PARTITION BY crawl_id, auth_role ORDER BY ts, id) AS grp, row_number() OVER (PARTITION BY crawl_id, auth_role ORDER BY ts, id) AS pos FROM (
  SELECT *, CASE WHEN p IS NULL THEN 1 WHEN response_status IN (301, 302, 303, 307, 308) OR (request_method = 'POST' AND response_status IN (200, 302)) OR (p <> '' AND request_url = p) THEN 0 ELSE 1 END AS start
  FROM (SELECT *, lag({_TARGET}) OVER (PARTITION BY crawl_id, auth_role ORDER BY ts, id) AS p FROM txn) a) b"""
DUCK["flow_v"] = f"""
SELECT crawl_id, auth_role, min(pos) AS flow, count(*) AS steps, {FLOW_NAME_SQL.replace('(x,', "(lower(string_agg(request_url, ' ')),")} ELSE 'flow_' || count(*) || '_steps' END AS name,
  bool_or(contains(lower(request_url), 'login')) AS requires_credentials, bool_or(request_method = 'POST' AND regexp_matches(lower(request_url), '{'|'.join(C.SIDE_EFFECT_WORDS)}')) AS has_side_effects
FROM flow_rows GROUP BY crawl_id, auth_role, grp HAVING count(*) >= 2"""


@query("win_06_flows", "SELECT * FROM flow_v")
def win_06(spark, sf):
    return flows.flows(flows.flow_steps(views.transactions(spark, sf)))


@query("win_06_flow_steps", "SELECT id, min(pos) OVER (PARTITION BY crawl_id, auth_role, grp) AS flow, pos - min(pos) OVER (PARTITION BY crawl_id, auth_role, grp) + 1 AS step FROM flow_rows")
def win_06_steps(spark, sf):
    return flows.flow_steps(views.transactions(spark, sf)).select("id", "flow", "step")


DUCK["move_v"] = f"""
SELECT crawl_id, id, p AS from_state, s AS to_state, request_url AS trigger_url, response_status AS trigger_status FROM (
  SELECT *, lag(s) OVER (PARTITION BY crawl_id ORDER BY ts, id) AS p FROM (SELECT *, {AUTH_LEVEL} AS s FROM txn) a) b WHERE p IS NOT NULL AND p <> s"""
DUCK["state_url"] = f"SELECT DISTINCT {AUTH_LEVEL} AS state, request_url AS url FROM txn WHERE response_status BETWEEN 200 AND 399"


def state_pairs(spark, sf):
    return access.state_endpoints(views.transactions(spark, sf), C.auth_level(F.col("response_body")))


@query("win_07_state_transitions", """
WITH g AS (SELECT m.from_state, m.to_state, count(*) AS n FROM (SELECT DISTINCT from_state, to_state FROM move_v) m JOIN state_url s ON s.state = m.to_state
  WHERE s.url NOT IN (SELECT b.url FROM state_url b WHERE b.state = m.from_state) GROUP BY 1, 2)
SELECT crawl_id, id, v.from_state, v.to_state, trigger_url, trigger_status, coalesce(g.n, 0) AS new_endpoints FROM move_v v LEFT JOIN g USING (from_state, to_state)""")
def win_07(spark, sf):
    moves = flows.state_transitions(views.transactions(spark, sf))
    gained = flows.gained_endpoints(state_pairs(spark, sf), moves)
    return moves.join(gained, ["from_state", "to_state"]).select(
        "crawl_id", "id", "from_state", "to_state", "trigger_url", "trigger_status", "new_endpoints"
    )


@query("win_08_template_representatives", f"""
SELECT template, method, url FROM (SELECT {q.template('url')} AS template, method, url, seq FROM endpoint_v WHERE status_code > 0 AND status_code < 400
  QUALIFY row_number() OVER (PARTITION BY {q.template('url')} ORDER BY seq) = 1) a ORDER BY seq LIMIT 100""")
def win_08(spark, sf):
    return coverage.template_representatives(endpoints(spark, sf), 100).select("template", "method", "url")


def _islands(rows: str, key: str, value: str) -> str:
    return (f"SELECT {key}, {value}, count(*) AS length FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, id) - row_number() OVER (PARTITION BY {key}, {value} ORDER BY ts, id) AS g "
            f"FROM {rows}) x GROUP BY {key}, {value}, g")


_URL_ANS = "(SELECT request_url AS url, response_status || '|' || sha256(response_body) AS answer, ts, id FROM txn)"
_HOST_MISS = f"(SELECT {q.host('request_url')} AS host, page_type NOT IN ('real_content', 'auth_required') AS miss, ts, id FROM txn)"
_DOM_OK = f"(SELECT {q.authority('request_url')} AS domain, response_status <> 429 AS ok, ts, id FROM txn)"


@query("win_09_stale_streaks", f"""SELECT 'endpoint' AS kind, url AS key, length FROM ({_islands(_URL_ANS, 'url', 'answer')}) a WHERE length >= 3
UNION ALL SELECT 'host', host, length FROM ({_islands(_HOST_MISS, 'host', 'miss')}) b WHERE miss AND length >= 4""")
def win_09(spark, sf):
    txn = views.transactions(spark, sf)
    same = flows.unchanged_streaks(txn, least=3).select(F.lit("endpoint").alias("kind"), F.col("url").alias("key"), "length")
    return same.union(flows.miss_streaks(txn, least=4).select(F.lit("host"), "host", "length"))


@query("win_10_ok_streaks", f"SELECT domain, length FROM ({_islands(_DOM_OK, 'domain', 'ok')}) a WHERE ok")
def win_10(spark, sf):
    return flows.ok_streaks(views.transactions(spark, sf)).select("domain", "length")


# ---- Coverage statistics -----------------------------------------------


@query("agg_16_coverage_stats", """SELECT crawl_id, count(*) FILTER (WHERE is_new) AS unique_coverage, count(*) AS total_checked, round(any_value(s.rate), 4) AS discovery_rate, any_value(s.saturated) AS saturated
FROM flag_v JOIN sat_last s USING (crawl_id) GROUP BY 1""")
def agg_16(spark, sf):
    return coverage.coverage_stats(flags(spark, sf))


@query("agg_17_template_posterior", "SELECT template, hits, alpha, beta FROM posterior_v")
def agg_17(spark, sf):
    return coverage.posterior(flags(spark, sf))


DUCK["energy_v"] = "SELECT *, greatest(1, least(cast(floor(pow(3, least(alpha, 5)) / greatest(alpha / (SELECT sum(alpha) FROM posterior_v), 0.01)) AS bigint), 30)) AS energy FROM posterior_v"


def energy(spark, sf):
    return coverage.mutation_energy(coverage.posterior(flags(spark, sf)))


@query("agg_18_mutation_energy", "SELECT template, alpha, energy FROM energy_v")
def agg_18(spark, sf):
    return energy(spark, sf).select("template", "alpha", "energy")


@query("agg_19_phase_discovery", """
WITH t AS (SELECT m, count(*) AS n FROM (SELECT template, arg_min(source_module, (ts, id)) AS m FROM flag_v GROUP BY 1) a GROUP BY 1),
i AS (SELECT source_module AS m, count(*) AS n FROM insight_v JOIN txn USING (id) GROUP BY 1)
SELECT source_module, count(*) AS requests, count(*) FILTER (WHERE is_new) AS new_coverage, round(avg(is_new::int), 4) AS discovery_rate, coalesce(any_value(t.n), 0) AS new_templates, coalesce(any_value(i.n), 0) AS new_insights
FROM flag_v f LEFT JOIN t ON t.m = f.source_module LEFT JOIN i ON i.m = f.source_module GROUP BY 1""")
def agg_19(spark, sf):
    txn = views.transactions(spark, sf)
    found = coverage.insights(txn).select("id").join(txn.select("id", "source_module"), "id")
    return coverage.phase_discovery(flags(spark, sf), found)


@query("agg_20_insight_stats", "SELECT insight_type AS measure, count(*) AS n FROM insight_v GROUP BY 1 UNION ALL SELECT 'all_boundaries', count(*) FROM insight_v WHERE insight_type IN ('auth_boundary', 'redirect_boundary')")
def agg_20(spark, sf):
    found = coverage.insights(views.transactions(spark, sf))
    auth = coverage.auth_insights(found).agg(F.count("*").alias("n")).select(F.lit("all_boundaries"), "n")
    return coverage.insight_stats(found).withColumnRenamed("insight_type", "measure").union(auth)


@query("ext_16_candidate_urls", f"""
WITH f AS (SELECT {q.template('url')} AS template, arg_min(url, seq) AS first_url FROM obs GROUP BY 1),
v AS (SELECT f.template, replace(f.template, '{{id}}', x) AS url, r FROM f JOIN energy_v e USING (template), (VALUES ('0', 0), ('1', 1), ('2', 2), ('-1', 3), ('999999', 4), ('2147483647', 5), ('me', 6), ('self', 7), ('current', 8), ('admin', 9)) t(x, r)
    WHERE f.template LIKE '%/{{id}}' AND r < e.energy
  UNION ALL SELECT f.template, replace(f.first_url, '/v1/', '/v' || (n + 2) || '/'), 10 + n FROM f JOIN energy_v e USING (template), range(0, 2) t(n) WHERE f.template LIKE '%/{{id}}' AND contains(f.first_url, '/v1/') AND 10 + n < e.energy)
SELECT template, url FROM v WHERE url NOT IN (SELECT url FROM obs)""")
def ext_16(spark, sf):
    from ..operators import extract

    obs = views.observations(spark, sf)
    slots = coverage.template_slots(obs, order="seq")
    return extract.candidate_urls(slots, energy(spark, sf), obs.select("url").distinct()).select("template", "url")
