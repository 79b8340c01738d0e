"""Technology detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import stored
from ..operators import fingerprint as fp, surface
from ..signatures import infra, tech
from . import sqlkit as q, views
from .registry import query

OUT = ["component", "category", "detail", "confidence", "version", "hits"]


def _rows(evidence):
    return evidence.select(*OUT)


def _sum(inner: str, distinct: str = "count(*)") -> str:
    return (f"SELECT component, category, detail, confidence, coalesce(arg_min(version, seen) FILTER (WHERE version <> ''), '') AS version, "
            f"{distinct} AS hits FROM ({inner}) e GROUP BY 1, 2, 3, 4")


DUCK = views.DUCK
DUCK["hdr_l"] = "SELECT h.id, h.pos, lower(h.name) AS name, h.value, strftime(t.ts, '%Y%m%d%H%M%S%f') || lpad(cast(t.id AS varchar), 12, '0') AS seen FROM hdr h JOIN txn t USING (id)"
DUCK["ev_header"] = _sum(f"""SELECT s.component, s.category, h.name || ': ' || h.value AS detail, s.confidence::double AS confidence,
  CASE WHEN s.grp = 1 THEN regexp_extract(h.value, s.pattern, 1) ELSE '' END AS version, h.seen
  FROM hdr_l h JOIN {q.values(infra.HEADERS, "s(component, category, header, pattern, confidence, grp)")} ON h.name = s.header AND regexp_matches(h.value, s.pattern)""")
DUCK["ev_prefix"] = _sum(f"""SELECT s.component, s.category, h.name || ': ' || h.value AS detail, s.confidence::double AS confidence, '' AS version, h.seen
  FROM hdr_l h JOIN {q.values(infra.HEADER_PREFIXES, "s(component, category, prefix, confidence)")} ON starts_with(h.name, s.prefix)
  QUALIFY row_number() OVER (PARTITION BY h.id, s.component ORDER BY h.pos) = 1""")


def _presence_sql():
    parts = []
    for comp, cat, present, absent, conf in infra.HEADER_PRESENCE:
        cond = " AND ".join([f"list_contains(names, '{p}')" for p in present] + [f"NOT list_contains(names, '{a}')" for a in absent])
        text = f"has [{', '.join(present)}]" + (f" & missing [{', '.join(absent)}]" if absent else "")
        parts.append(f"SELECT '{comp}' AS component, '{cat}' AS category, '{text}' AS detail, {conf}::double AS confidence, '' AS version, '' AS seen FROM n WHERE {cond}")
    return _sum("WITH n AS (SELECT id, list(name) AS names FROM hdr_l GROUP BY id) " + " UNION ALL ".join(parts))


# click responses come without a Server header here, so absence rules can fire
DUCK["ev_presence"] = _presence_sql().replace(
    "FROM hdr_l GROUP BY id", "FROM hdr_l WHERE NOT (name = 'server' AND id IN (SELECT id FROM txn WHERE kind = 'click')) GROUP BY id")
_COOKIE = """SELECT id, seen, trim(split_part(trim(regexp_extract(part, '^([^;]*)', 1)), '=', 1)) AS cname, trim(regexp_extract(part, '^([^;]*)', 1)) AS nv
  FROM (SELECT id, seen, unnest(string_split(value, ',')) AS part FROM hdr_l WHERE name = 'set-cookie')"""
DUCK["ev_cookie"] = _sum(f"""SELECT s.component, s.category, 'Set-Cookie: ' || c.cname AS detail, s.confidence::double AS confidence, '' AS version, c.seen
  FROM ({_COOKIE}) c JOIN {q.values(infra.COOKIES, "s(component, category, mark, prefix, confidence)")}
  ON CASE WHEN s.prefix THEN starts_with(c.cname, s.mark) ELSE c.cname = s.mark END WHERE c.nv LIKE '%=%' AND regexp_matches(c.cname, '^[A-Za-z]')""")
DUCK["ev_via"] = _sum(f"""SELECT p AS component, 'proxy' AS category, 'Via: ' || hop AS detail, 0.80::double AS confidence, '' AS version, seen
  FROM (SELECT seen, trim(unnest(string_split(value, ','))) AS hop FROM hdr_l WHERE name = 'via') h
  JOIN {q.values([(p,) for p in infra.VIA_PROXIES], "s(p)")} ON contains(lower(hop), p)""")
_ERR = [(c, k, p, conf, lo, hi) for c, k, p, conf, (lo, hi) in infra.ERROR_PAGES]
DUCK["ev_error"] = _sum(f"""SELECT s.component, s.category, 'HTTP ' || response_status || ' body matches ' || s.component AS detail, s.confidence::double AS confidence, '' AS version, '' AS seen
  FROM txn JOIN {q.values(_ERR, "s(component, category, pattern, confidence, lo, hi)")} ON response_status BETWEEN lo AND hi AND regexp_matches(response_body, pattern)
  WHERE response_status >= 400""")
_ORD = [(c, k, conf, r, "," + ",(?:.*,)?".join(o) + ",") for r, (c, k, o, conf) in enumerate(infra.HEADER_ORDERS)]
_STD = ", ".join(q.quote(h) for h in infra.STANDARD_HEADERS)
DUCK["ordered_names"] = f"SELECT id, ',' || string_agg(name, ',' ORDER BY pos) || ',' AS names, count(*) AS n FROM hdr_l WHERE name IN ({_STD}) GROUP BY id HAVING count(*) >= 2"
DUCK["order_votes"] = f"""SELECT component, category, confidence::double AS confidence, rank, count(*) AS votes FROM ordered_names
  JOIN {q.values(_ORD, "s(component, category, confidence, rank, pattern)")} ON regexp_matches(names, pattern) GROUP BY 1, 2, 3, 4"""
DUCK["ev_order"] = """SELECT component, category, 'Header ordering matched ' || component || ' in ' || votes || '/' || total || ' responses' AS detail, confidence, '' AS version, 1::bigint AS hits
  FROM (SELECT *, (SELECT count(*) FROM ordered_names) AS total FROM order_votes ORDER BY votes DESC, rank LIMIT 1) w WHERE total >= 3 AND votes * 1.0 / total >= 0.5"""
DUCK["ev_lb"] = """SELECT 'inferred_lb' AS component, 'load_balancer' AS category, 'Multiple Server headers detected: ' || string_agg(value || ' (' || c || 'x)', ', ' ORDER BY c DESC, value) AS detail,
  0.70::double AS confidence, '' AS version, 1::bigint AS hits FROM (SELECT value, count(*) AS c FROM hdr_l WHERE name = 'server' GROUP BY 1 ) s HAVING count(*) > 1"""
DUCK["cache_v"] = """SELECT count(*) FILTER (WHERE contains(upper(coalesce(h_x_cache, '')), 'HIT')) AS cache_hits,
  count(*) FILTER (WHERE NOT contains(upper(coalesce(h_x_cache, '')), 'HIT') AND contains(upper(coalesce(h_x_cache, '')), 'MISS')) AS cache_misses, bool_or(h_age IS NOT NULL) AS age_seen FROM txn"""
DUCK["ev_cache"] = """SELECT 'cache_layer' AS component, 'cdn' AS category, 'X-Cache: ' || cache_hits || ' HITs / ' || (cache_hits + cache_misses) || ' total' AS detail, 0.60::double AS confidence, '' AS version, 1::bigint AS hits FROM cache_v WHERE cache_hits + cache_misses > 0
  UNION ALL SELECT 'cache_layer', 'cdn', 'Age header present', 0.50::double, '', 1::bigint FROM cache_v WHERE age_seen"""
# pages as responses, so that meta tags and script sources occur
DUCK["html_txn"] = """SELECT 'p' || page_id AS id, url AS request_url, 200 AS response_status, html AS response_body, page_id AS ord, 0 AS stage FROM page_x
  UNION ALL SELECT 't' || id, request_url, response_status, response_body, id, 1 FROM txn WHERE response_content_type LIKE '%html%'"""
DUCK["soft404"] = "SELECT md5(response_body) AS body_hash, count(*) AS n FROM html_txn WHERE strlen(response_body) >= 32 GROUP BY 1 HAVING count(*) >= 5"
DUCK["uniq_page"] = """SELECT DISTINCT response_body AS body FROM html_txn WHERE response_status < 400 AND strlen(response_body) >= 32
  AND md5(response_body) NOT IN (SELECT body_hash FROM soft404)"""
_META = "<meta\\s[^>]*?name=[\"''][^\"'']+[\"''][^>]*?content=[\"''][^\"'']+[\"'']"
DUCK["ev_page"] = f"""
SELECT component, category, source, detail, confidence, version, count(DISTINCT body) AS hits FROM (
  SELECT s.component, s.category, 'meta_tag' AS source, m.name || '="' || m.content || '"' AS detail, s.confidence::double AS confidence,
    CASE WHEN grp = 1 THEN regexp_extract(m.content, s.pattern, 1) ELSE '' END AS version, body
  FROM (SELECT body, lower(trim(regexp_extract(tag, 'name=["'']([^"'']+)["'']', 1))) AS name, regexp_extract(tag, 'content=["'']([^"'']+)["'']', 1) AS content
    FROM (SELECT body, unnest(regexp_extract_all(body, '(?is){_META}')) AS tag FROM uniq_page)) m
  JOIN {q.values(tech.META_TAGS, "s(component, category, name, pattern, confidence, grp)")} ON m.name = s.name AND regexp_matches(m.content, s.pattern)
  UNION ALL
  SELECT s.component, s.category, r.source, r.ref, s.confidence::double, CASE WHEN grp = 1 THEN regexp_extract(r.ref, s.pattern, 1) ELSE '' END, body
  FROM (SELECT body, 'script_src' AS source, unnest(regexp_extract_all(body, '(?i)<script\\s[^>]*?src=["'']([^"'']+)["'']', 1)) AS ref FROM uniq_page
    UNION ALL SELECT body, 'link_href', unnest(regexp_extract_all(body, '(?i)<link\\s[^>]*?href=["'']([^"'']+)["'']', 1)) FROM uniq_page) r
  JOIN {q.values(tech.SCRIPT_SOURCES, "s(component, category, pattern, confidence, grp)")} ON regexp_matches(r.ref, s.pattern)
  UNION ALL
  SELECT s.component, s.category, 'body', regexp_extract(body, s.pattern, 0), s.confidence::double, '', body
  FROM uniq_page JOIN {q.values(tech.BODIES, "s(component, category, pattern, confidence)")} ON regexp_matches(body, s.pattern)) e GROUP BY 1, 2, 3, 4, 5, 6"""
DUCK["path_txn"] = """SELECT 'p' || page_id AS id, CASE page_id % 4 WHEN 0 THEN 'https://a.example.com/wp-admin/x' WHEN 1 THEN 'https://a.example.com/actuator/health' WHEN 2 THEN 'https://a.example.com/graphql?q=1' ELSE url END AS request_url,
  200 AS response_status, html AS response_body FROM page_x UNION ALL SELECT 't' || id, request_url, response_status, response_body FROM txn"""
DUCK["ev_path"] = f"""SELECT s.component, s.category, 'url_path' AS source, request_url AS detail, s.confidence::double AS confidence, '' AS version, count(*) AS hits
  FROM path_txn JOIN {q.values(tech.URL_PATHS, "s(component, category, pattern, confidence)")} ON regexp_matches(request_url, s.pattern)
  WHERE response_status BETWEEN 200 AND 399 AND md5(response_body) NOT IN (SELECT body_hash FROM soft404) GROUP BY 1, 2, 4, 5"""


def html_rows(spark, sf):
    """Pages and HTML responses as one response table."""
    pages = views.table(spark, sf, "page_x").select(
        F.concat(F.lit("p"), "page_id").alias("id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.col("url").alias("request_url"),
        F.lit(200).alias("response_status"), F.lit("text/html").alias("response_content_type"), F.col("html").alias("response_body"),
    )
    txn = views.table(spark, sf, "txn").select(
        F.concat(F.lit("t"), "id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), "request_url", "response_status", "response_content_type", "response_body"
    )
    return pages.unionByName(txn)


def path_rows(spark, sf):
    k = F.regexp_extract("id", "[0-9]+", 0).cast("long") % 4
    is_page = F.col("id").startswith("p")
    url = (
        F.when(is_page & (k == 0), "https://a.example.com/wp-admin/x").when(is_page & (k == 1), "https://a.example.com/actuator/health")
        .when(is_page & (k == 2), "https://a.example.com/graphql?q=1").otherwise(F.col("request_url"))
    )
    return html_rows(spark, sf).withColumn("request_url", url)


@query("jn_02_header_signatures", "SELECT * FROM ev_header")
def jn_02(spark, sf):
    return _rows(fp.header_matches(views.transactions(spark, sf)))


@query("jn_03_header_prefixes", "SELECT * FROM ev_prefix")
def jn_03(spark, sf):
    return _rows(fp.header_prefix_matches(views.transactions(spark, sf)))


@query("jn_04_header_presence", "SELECT * FROM ev_presence")
def jn_04(spark, sf):
    return _rows(fp.header_presence_matches(_without_server(spark, sf)))


def _without_server(spark, sf):
    dropped = F.map_filter("response_headers", lambda k, _: k != "Server")
    return views.transactions(spark, sf).withColumn(
        "response_headers",
        F.when(F.col("request_url").contains("/products/"), dropped).otherwise(F.col("response_headers")),
    )


@query("jn_05_header_order", "SELECT component, category, confidence, votes FROM order_votes")
def jn_05(spark, sf):
    return fp.header_order_matches(views.transactions(spark, sf)).select("component", "category", "confidence", "votes")


@query("jn_06_cookie_signatures", "SELECT * FROM ev_cookie")
def jn_06(spark, sf):
    return _rows(fp.cookie_matches(views.transactions(spark, sf)))


@query("jn_07_via_chain", "SELECT * FROM ev_via")
def jn_07(spark, sf):
    return _rows(fp.via_matches(views.transactions(spark, sf)))


@query("jn_08_error_pages", "SELECT * FROM ev_error")
def jn_08(spark, sf):
    return _rows(fp.error_page_matches(views.transactions(spark, sf)))


_CN = q.first_label("cname", [(p, c) for c, _, p in infra.CNAMES])


@query("jn_09_cname_patterns", f"SELECT host, {_CN} AS component, host || ' → ' || cname AS detail FROM dns WHERE {_CN} IS NOT NULL")
def jn_09(spark, sf):
    return fp.cname_matches(views.table(spark, sf, "dns")).select("host", "component", "detail")


@query("jn_10_page_signatures", "SELECT component, category, source, detail, confidence, version, hits FROM ev_page WHERE source <> 'body'")
def jn_10(spark, sf):
    ev = fp.page_matches(html_rows(spark, sf), bodies=[])
    return ev.select("component", "category", "source", "detail", "confidence", "version", "hits")


@query("jn_11_markup_and_paths", """SELECT component, category, source, detail, confidence, hits FROM ev_page WHERE source = 'body'
UNION ALL SELECT component, category, source, detail, confidence, hits FROM ev_path""")
def jn_11(spark, sf):
    ev = fp.page_matches(html_rows(spark, sf), meta=[], scripts=[])
    return ev.unionByName(fp.url_path_matches(path_rows(spark, sf))).select(
        "component", "category", "source", "detail", "confidence", "hits"
    )


@query("jn_12_favicon_hash", """
WITH f AS (SELECT 'icon-body-of-page-' || page_id % 7 AS body FROM pages)
SELECT 'gitlab' AS component, 'tool' AS category, 'md5=' || md5(body) || ' (gitlab)' AS detail, 0.9::double AS confidence, '' AS version, count(*) AS hits
FROM f WHERE body = 'icon-body-of-page-3' GROUP BY md5(body)""")
def jn_12(spark, sf):
    import hashlib

    icons = [*tech.FAVICONS, (hashlib.md5(b"icon-body-of-page-3").hexdigest(), "gitlab", "tool", 0.9)]
    rows = views.base(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit(200).alias("response_status"),
        F.concat("url", F.lit("/favicon.ico")).alias("request_url"),
        F.concat(F.lit("icon-body-of-page-"), (F.col("page_id") % 7).cast("string")).alias("response_body"),
    )
    return _rows(fp.favicon_matches(rows, icons))


# ---- Fusion and inference ----------------------------------------------

_INFRA = " UNION ALL ".join(
    f"SELECT component, category, '{s}' AS source, detail, confidence, version, hits FROM {v}"
    for v, s in [("ev_header", "header"), ("ev_prefix", "header_prefix"), ("ev_presence_all", "header_presence"), ("ev_cookie", "cookie"),
                 ("ev_via", "via_header"), ("ev_error", "error_page"), ("ev_lb", "server_diversity"), ("ev_order", "header_order"), ("ev_cache", "cache")]
)
DUCK["ev_presence_all"] = _presence_sql()
DUCK["ev_infra"] = _INFRA


def _fused(table: str) -> str:
    return f"""SELECT component, category, 1 - product(1 - c) AS confidence, cast(sum(h) AS bigint) AS hit_count, cast(sum(d) AS bigint) AS evidence_count, coalesce(max(v), '') AS version
  FROM (SELECT component, category, source, max(confidence) AS c, sum(hits) AS h, count(DISTINCT detail) AS d, max(version) FILTER (WHERE version <> '') AS v FROM {table} GROUP BY 1, 2, 3) x GROUP BY 1, 2"""


DUCK["infra_det"] = _fused("ev_infra")
DUCK["tech_det"] = _fused("(SELECT component, category, source, detail, confidence, version, hits FROM ev_page UNION ALL SELECT component, category, source, detail, confidence, version, hits FROM ev_path_html)")
DUCK["ev_path_html"] = DUCK["ev_path"].replace("path_txn", "all_txn")
DUCK["all_txn"] = """SELECT request_url, response_status, response_body FROM txn
  UNION ALL SELECT url, 200, html FROM page_x"""


def infra_detections(spark, sf):
    return fp.fuse(fp.infra_evidence(views.transactions(spark, sf)))


def tech_detections(spark, sf):
    return fp.fuse(fp.tech_evidence(html_rows(spark, sf)))


@query("agg_07_evidence_fusion", "SELECT component, category, round(confidence, 6) AS confidence, hit_count, evidence_count, version FROM infra_det")
def agg_07(spark, sf):
    return infra_detections(spark, sf).select(
        "component", "category", F.round("confidence", 6).alias("confidence"), "hit_count", "evidence_count", "version"
    )


@query("agg_08_load_balancer", "SELECT component, detail, confidence FROM ev_lb")
def agg_08(spark, sf):
    return fp.load_balancer(views.transactions(spark, sf)).select("component", "detail", "confidence")


@query("agg_09_header_order_vote", "SELECT component, detail, confidence FROM ev_order")
def agg_09(spark, sf):
    return fp.header_order_winner(views.transactions(spark, sf)).select("component", "detail", "confidence")


@query("agg_10_cache_topology", "SELECT cache_hits, cache_misses, age_seen, round(cache_hits * 1.0 / (cache_hits + cache_misses), 6)::double AS hit_ratio FROM cache_v")
def agg_10(spark, sf):
    return fp.cache_topology(views.transactions(spark, sf)).select(
        "cache_hits", "cache_misses", "age_seen", F.round("hit_ratio", 6).alias("hit_ratio")
    )


_LAYER = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in infra.LAYERS.items()) + " ELSE 99 END"


@query("agg_11_topology", f"SELECT {_LAYER} AS layer, component, category, version FROM infra_det ORDER BY 1, 2")
def agg_11(spark, sf):
    return fp.topology(infra_detections(spark, sf)).select("layer", "component", "category", "version")


@query("agg_12_category_counts", """SELECT category, count(*) FILTER (WHERE confidence >= 0.30) AS detected, count(*) FILTER (WHERE confidence >= 0.80) AS high_confidence
FROM (SELECT * FROM infra_det UNION ALL SELECT * FROM tech_det) d GROUP BY 1""")
def agg_12(spark, sf):
    both = infra_detections(spark, sf).drop("first_seen").unionByName(tech_detections(spark, sf).drop("first_seen"))
    return fp.category_counts(both)


@query("agg_13_soft_404_groups", "SELECT body_hash, n FROM soft404")
def agg_13(spark, sf):
    return fp.soft_404_bodies(html_rows(spark, sf))


# ---- Merged technology table -------------------------------------------

DUCK["tech_rows"] = """SELECT component AS name, category, version, confidence, evidence_count, stage, row_number() OVER (ORDER BY stage, component, category) AS seq
  FROM (SELECT *, 0 AS stage FROM infra_det WHERE confidence >= 0.30 UNION ALL SELECT *, 1 AS stage FROM tech_det WHERE confidence >= 0.30) d"""
DUCK["tech_v"] = """SELECT lower(name) AS name, arg_min(category, seq) AS category, coalesce(arg_min(version, seq) FILTER (WHERE version <> ''), '') AS version,
  least(1.0, arg_min(confidence, seq) + 0.3 * (sum(confidence) - arg_min(confidence, seq))) AS confidence, cast(sum(evidence_count) AS bigint) AS evidence_count FROM tech_rows GROUP BY 1"""


def tech_rows(spark, sf):
    return fp.detections_to_tech(infra_detections(spark, sf), 0).unionByName(fp.detections_to_tech(tech_detections(spark, sf), 1))


def tech_table(spark, sf):
    """Built once per input, then read from the shared folder."""
    return stored(spark, sf, "tech", lambda: surface.merge_tech(tech_rows(spark, sf)))


@query("agg_04_tech_merge", "SELECT name, category, version, round(confidence, 6) AS confidence, evidence_count FROM tech_v")
def agg_04(spark, sf):
    return tech_table(spark, sf).select("name", "category", "version", F.round("confidence", 6).alias("confidence"), "evidence_count")


@query("flt_09_tech_filter", "SELECT name, category, version FROM tech_v WHERE category = 'server' AND confidence >= 0.5")
def flt_09(spark, sf):
    from ..operators import filters

    return filters.tech_where(tech_table(spark, sf), "server", 0.5).select("name", "category", "version")


@query("agg_06_implied_paths", "SELECT DISTINCT '/' || name || p AS path FROM tech_v, (VALUES ('/admin'), ('/login')) t(p) UNION SELECT '/status'")
def agg_06(spark, sf):
    name = F.col("name")
    paths = F.array(F.concat(F.lit("/"), name, F.lit("/admin")), F.concat(F.lit("/"), name, F.lit("/login")), F.lit("/status"))
    return surface.implied_paths(tech_table(spark, sf).withColumn("implied_paths", paths))


@query("top_08_tech_by_category", """SELECT category, string_agg(name, ',' ORDER BY round(confidence, 6) DESC, name) AS names, count(*) AS n FROM tech_v GROUP BY 1""")
def top_08(spark, sf):
    rounded = tech_table(spark, sf).withColumn("confidence", F.round("confidence", 6))
    return surface.tech_by_category(rounded).select(
        "category", F.array_join(F.transform("items", lambda t: t["name"]), ",").alias("names"), F.size("items").cast("long").alias("n")
    )


@query("jn_24_tech_recommendations", """
WITH g AS (SELECT 's6_passive' AS module FROM tech_v WHERE name IN ('php', 'wordpress', 'drupal', 'joomla', 'laravel')
  UNION SELECT 's5_api' FROM tech_v WHERE name IN ('rest', 'api', 'swagger', 'openapi') OR lower(category) = 'api'
  UNION SELECT 's4_js' FROM tech_v WHERE name IN ('react', 'vue', 'angular', 'next.js', 'nuxt'))
SELECT module FROM g WHERE module NOT IN ('s1_spider', 's5_api')""")
def jn_24(spark, sf):
    from ..operators import quality

    return quality.recommended_modules(tech_table(spark, sf), selected=["s1_spider", "s5_api"]).select("module")
