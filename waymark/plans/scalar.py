"""Scalar expressions over the request log and the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as C, html as H, structure as S, urls as U
from . import sqlkit as q, views
from .registry import query

ANY_URL = "any_url AS (SELECT DISTINCT request_url AS url FROM txn UNION SELECT url FROM pages)"


def any_url(spark, sf):
    txn = views.table(spark, sf, "txn").select(F.col("request_url").alias("url"))
    return txn.union(views.base(spark, sf, "pages").select("url")).distinct()


@query("scl_01_normalize_url", f"SELECT page_id, {q.normalize('url')} AS normalized, {q.normalize(chr(34) + 'noisy' + chr(34))} AS noisy_normalized "
       "FROM (SELECT page_id, url, split_part(url, '#', 1) || '?&&#f' AS noisy FROM pages)")
def scl_01(spark, sf):
    noisy = F.concat(F.substring_index("url", "#", 1), F.lit("?&&#f"))
    return views.base(spark, sf, "pages").select(
        "page_id", U.normalize(F.col("url")).alias("normalized"), U.normalize(noisy).alias("noisy_normalized")
    )


@query("scl_02_url_template", f"WITH {ANY_URL} SELECT url, {q.template('url')} AS template FROM any_url")
def scl_02(spark, sf):
    return any_url(spark, sf).select("url", U.template(F.col("url")).alias("template"))


@query("scl_03_passive_segments",
       f"SELECT seq, array_to_string(list_transform({q.segs('url')}, lambda s: {q.slot('s', '{hex}', False)}), '/') AS key FROM passive_url")
def scl_03(spark, sf):
    return views.table(spark, sf, "passive_url").select(
        "seq", F.array_join(U.passive_segments(F.col("url")), "/").alias("key")
    )


_FIRST = f"SELECT {q.template('url')} AS template, arg_min(url, seq) AS url FROM obs GROUP BY 1"
_TSEG = f"list_transform({q.segs('url')}, lambda s: {q.slot('s')})"


@query("scl_04_slot_types", f"""
WITH first_url AS ({_FIRST}),
parts AS (SELECT template, url, {q.segs('url')} AS s, {_TSEG} AS t, len({q.names('url')}) > 0 AS has_query FROM first_url)
SELECT template, array_to_string(list_sort(list_distinct(list_transform(list_filter(range(1, len(s) + 1),
  lambda i: t[i] LIKE '{{%}}' AND NOT (has_query AND i = len(s))),
  lambda i: trim(t[i], '{{}}') || '=' || CASE WHEN regexp_matches(s[i], '^[0-9]+$') THEN 'integer'
    WHEN regexp_matches(s[i], '(?i)^[0-9a-f-]{{36}}$') THEN 'uuid' ELSE 'string' END))), ',') AS slots
FROM parts""")
def scl_04(spark, sf):
    from ..operators import coverage

    slots = coverage.template_slots(views.observations(spark, sf), order="seq")
    listed = F.transform(F.map_entries("slots"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return slots.select("template", F.array_join(F.array_sort(listed), ",").alias("slots"))


@query("scl_05_query_parameters", f"""
WITH u AS (SELECT DISTINCT request_url || '&ref=a&ref=b&blank=&plus=a+b%20c' AS url FROM txn WHERE request_url LIKE '%?%'),
p AS (SELECT url, unnest(list_filter(string_split({q.qs('url')}, '&'), lambda p: regexp_matches(p, '(?s)^[^=]*=.'))) AS pair,
  unnest(range(1, len(list_filter(string_split({q.qs('url')}, '&'), lambda p: regexp_matches(p, '(?s)^[^=]*=.'))) + 1)) AS i FROM u)
SELECT url, url_decode(replace(split_part(pair, '=', 1), '+', ' ')) AS name,
  array_to_string(list(url_decode(replace(regexp_extract(pair, '(?s)^[^=]*=(.*)', 1), '+', ' ')) ORDER BY i), '|') AS samples
FROM p GROUP BY 1, 2""")
def scl_05(spark, sf):
    from ..operators import surface

    urls = views.table(spark, sf, "txn").select("request_url").where(F.col("request_url").contains("?")).distinct()
    urls = urls.select(F.concat("request_url", F.lit("&ref=a&ref=b&blank=&plus=a+b%20c")).alias("url"))
    return surface.query_parameters(urls).select("url", "name", F.array_join("sample_values", "|").alias("samples"))


_FP = (f"upper(request_method) || '|' || {q.normalize('request_url')} || CASE WHEN request_method IN ('POST','PUT','PATCH') AND request_body <> '' "
       f"THEN '|' || {q.digest('request_body', 8)} ELSE '' END || '|@' || auth_role")


@query("scl_06_request_fingerprint", f"SELECT id, {q.digest(_FP)} AS fingerprint FROM txn")
def scl_06(spark, sf):
    c = F.col
    return views.table(spark, sf, "txn").select(
        "id", U.request_fingerprint(c("request_url"), c("request_method"), c("request_body"), c("auth_role")).alias("fingerprint")
    )


@query("scl_07_entity_fingerprints", f"""
SELECT id, {q.digest("request_method || '|' || request_url")} AS endpoint_fp, {q.digest("request_url || '|q|query'")} AS vector_fp,
  {q.digest("request_method || '|' || request_url || '|' || CASE WHEN request_body <> '' THEN " + q.digest('request_body', 8) + " ELSE '' END || '|' || id")} AS transaction_fp
FROM txn""")
def scl_07(spark, sf):
    c = F.col
    return views.table(spark, sf, "txn").select(
        "id",
        U.endpoint_fingerprint(c("request_method"), c("request_url")).alias("endpoint_fp"),
        U.vector_fingerprint(c("request_url"), F.lit("q"), F.lit("query")).alias("vector_fp"),
        U.transaction_fingerprint(c("request_method"), c("request_url"), c("request_body"), c("id")).alias("transaction_fp"),
    )


@query("scl_08_content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def scl_08(spark, sf):
    return views.base(spark, sf, "documents").select("doc_id", S.content_hash(F.col("text")).alias("content_hash"))


_SIG = ", ".join(q.quote(h) for h in S.SIGNATURE_HEADERS)


@query("scl_09_header_signature", f"""
SELECT t.id, {q.digest("coalesce(string_agg(lower(name) || '=' || value, '|' ORDER BY lower(name) || '=' || value) FILTER (WHERE lower(name) IN (" + _SIG + ")), '')", 12)} AS signature
FROM txn t LEFT JOIN hdr h ON h.id = t.id GROUP BY t.id""")
def scl_09(spark, sf):
    return views.transactions(spark, sf).select("id", S.header_signature(F.col("response_headers")).alias("signature"))


@query("scl_10_html_structure", f"SELECT page_id, {q.text_hash('html')} AS structure FROM page_x")
def scl_10(spark, sf):
    return views.table(spark, sf, "page_x").select("page_id", S.html_hash(F.col("html")).alias("structure"))


@query("scl_11_json_structure", """
WITH b AS (SELECT response_body AS body FROM txn WHERE kind = 'view' UNION ALL SELECT concat('{"id":', page_id, ',"tags":["a"],"ok":true}') FROM pages
  UNION ALL SELECT concat('broken {', page_id % 3) FROM pages)
SELECT CASE WHEN json_valid(body) THEN 'json' ELSE 'text' END AS kind, count(*) AS n_rows, count(DISTINCT body) AS n_bodies FROM b
GROUP BY CASE WHEN json_valid(body) THEN 'json' ELSE 'text' END, CASE WHEN json_valid(body) THEN cast(json_structure(body) AS varchar) ELSE body END""")
def scl_11(spark, sf):
    pages = views.base(spark, sf, "pages")
    body = views.table(spark, sf, "txn").where("kind = 'view'").select(F.col("response_body").alias("body"))
    body = body.union(pages.select(F.format_string('{"id":%d,"tags":["a"],"ok":true}', "page_id")))
    body = body.union(pages.select(F.concat(F.lit("broken {"), (F.col("page_id") % 3).cast("string"))))
    shape = S.json_skeleton(F.col("body"))
    return (
        body.groupBy(F.when(shape.isNull(), "text").otherwise("json").alias("kind"), S.json_hash(F.col("body")).alias("h"))
        .agg(F.count("*").alias("n_rows"), F.countDistinct("body").alias("n_bodies"))
        .drop("h")
    )


@query("scl_12_size_bucket", f"SELECT doc_id, {q.digest(chr(39) + 'bin:' + chr(39) + ' || cast(strlen(text) // 1024 AS varchar)', 12)} AS size_hash FROM documents")
def scl_12(spark, sf):
    return views.base(spark, sf, "documents").select("doc_id", S.size_hash(F.col("text")).alias("size_hash"))


AUTH_LEVEL = (f"CASE WHEN {q.any_of('response_body', C.ADMIN_MARKERS)} THEN 'admin' "
              f"WHEN {q.any_of('response_body', C.USER_MARKERS)} THEN 'authenticated' ELSE 'anonymous' END")


@query("scl_13_auth_level", f"SELECT id, {AUTH_LEVEL} AS auth_level FROM txn")
def scl_13(spark, sf):
    return views.table(spark, sf, "txn").select("id", C.auth_level(F.col("response_body")).alias("auth_level"))


_FIELD_SETS = [(0, "Username,password"), (1, "q"), (2, "card,cvv"), (3, "email,new-password,reset"), (4, "from,to"),
               (5, "csrf,note"), (6, "comment"), (7, "username,email,password,confirm"), (8, "query,keyword,sort")]
_FIELDS_SQL = "string_split(CASE page_id % 9 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in _FIELD_SETS) + " END, ',')"


def field_sets(spark, sf):
    pick = None
    for i, names in _FIELD_SETS:
        hit = F.col("page_id") % 9 == i
        pick = F.when(hit, names) if pick is None else pick.when(hit, names)
    return views.base(spark, sf, "pages").select("page_id", F.split(pick, ",").alias("names"))


def _list(words):
    return "[" + ", ".join(q.quote(w) for w in words) + "]"


_LOW = "list_transform(names, lambda n: replace(lower(n), '-', '_'))"
_SCORES = ", ".join(f"len(list_intersect({_LOW}, {_list(w)}))" for _, w in C.FORM_TYPES)


@query("scl_14_form_type", f"""
WITH f AS (SELECT page_id, {_FIELDS_SQL} AS names FROM pages), s AS (SELECT page_id, [{_SCORES}] AS sc FROM f)
SELECT page_id, CASE WHEN list_max(sc) >= 2 THEN {_list([k for k, _ in C.FORM_TYPES])}[list_position(sc, list_max(sc))] END AS form_type FROM s""")
def scl_14(spark, sf):
    return field_sets(spark, sf).select("page_id", C.form_type(F.col("names")).alias("form_type"))


@query("scl_15_form_safety", f"""
WITH f AS (SELECT page_id, list_transform({_FIELDS_SQL}, lambda n: lower(n)) AS n, CASE WHEN page_id % 2 = 0 THEN 'GET' ELSE 'POST' END AS method FROM pages)
SELECT page_id, CASE WHEN list_has_any(n, {_list(C.UNSAFE_FIELDS)}) THEN CASE WHEN list_has_any(n, ['password', 'passwd']) THEN 'login' ELSE 'unsafe' END
  WHEN list_has_any(n, {_list(C.SEARCH_FIELDS)}) THEN CASE WHEN list_has_any(n, {_list(C.SEARCH_NAMES)}) THEN 'search' ELSE 'filter' END
  WHEN method = 'GET' THEN 'filter' ELSE 'generic' END AS safety FROM f""")
def scl_15(spark, sf):
    method = F.when(F.col("page_id") % 2 == 0, "GET").otherwise("POST")
    return field_sets(spark, sf).select("page_id", C.form_safety(F.col("names"), method).alias("safety"))


_HINT = "CASE replace(lower(name), '-', '_') " + " ".join(f"WHEN {q.quote(k)} THEN {q.quote(v)}" for k, v in C.NAME_TYPES.items()) + " END"


@query("scl_16_infer_type", f"""
WITH v AS (SELECT id, name, 1 AS i, v1 AS v FROM sample_v UNION ALL SELECT id, name, 2, v2 FROM sample_v UNION ALL SELECT id, name, 3, v3 FROM sample_v),
k AS (SELECT id, name, i, {q.first_label('v', C.VALUE_TYPES)} AS kind FROM v),
n AS (SELECT id, name, kind, count(*) AS c, min(i) AS f FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT id, kind FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, f) = 1)
SELECT s.id, coalesce({_HINT}, b.kind, 'string') AS input_type FROM sample_v s LEFT JOIN b USING (id)""")
def scl_16(spark, sf):
    return views.table(spark, sf, "sample_v").select(
        "id", C.infer_type(F.col("name"), F.array("v1", "v2", "v3")).alias("input_type")
    )


@query("scl_17_passive_type", """
WITH v AS (SELECT name, v1 AS v FROM sample_v UNION ALL SELECT name, v3 FROM sample_v UNION ALL SELECT 'flag', CASE WHEN id % 2 = 0 THEN 'True' ELSE '0' END FROM sample_v
  UNION ALL SELECT 'num', cast(id AS varchar) FROM sample_v)
SELECT name, CASE WHEN bool_and(regexp_matches(v, '^[0-9]+$')) THEN 'integer' WHEN bool_and(regexp_matches(v, '(?i)^(true|false|0|1)$')) THEN 'boolean' ELSE 'string' END AS param_type
FROM v GROUP BY 1""")
def scl_17(spark, sf):
    from ..operators import passive

    s = views.table(spark, sf, "sample_v")
    flag = F.when(F.col("id") % 2 == 0, "True").otherwise("0")
    v = s.select("name", F.col("v1").alias("value")).union(s.select("name", "v3"))
    v = v.union(s.select(F.lit("flag"), flag)).union(s.select(F.lit("num"), F.col("id").cast("string")))
    return passive.parameter_types(v, ["name"])


_RISK = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(url, {q.quote(p)}) THEN '{t}' END" for t, p in C.ENDPOINT_RISKS) + "], lambda x: x IS NOT NULL), ',')"


@query("scl_18_endpoint_risks", f"WITH {ANY_URL} SELECT url, {_RISK} AS risks FROM any_url")
def scl_18(spark, sf):
    return any_url(spark, sf).select("url", F.array_join(C.endpoint_risks(F.col("url")), ",").alias("risks"))


RISK_ROWS = [(t, n) for t, ns in C.RISK_NAMES.items() for n in ns]


@query("scl_19_name_risks", f"""
WITH p AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Redirect' WHEN 1 THEN 'search' WHEN 2 THEN 'template' WHEN 3 THEN 'cmd' ELSE 'other' END AS name FROM txn),
r AS (SELECT * FROM {q.values(RISK_ROWS, "t(tag, word)")})
SELECT id, name, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS risks FROM p LEFT JOIN r ON lower(name) = word GROUP BY 1, 2""")
def scl_19(spark, sf):
    k = F.col("id") % 5
    name = F.when(k == 0, "Redirect").when(k == 1, "search").when(k == 2, "template").when(k == 3, "cmd").otherwise("other")
    return views.table(spark, sf, "txn").select("id", name.alias("name")).withColumn(
        "risks", F.array_join(F.array_sort(C.name_risks(F.col("name"))), ",")
    )


_WAF_H = " OR ".join(f"(lower(name) = '{h}' AND regexp_matches(value, {q.quote(p)}))" for h, p in C.WAF_HEADERS)
PAGE_TYPE_CTES = f"""
waf AS (SELECT DISTINCT id FROM hdr WHERE {_WAF_H}),
flags AS (SELECT t.*, (response_status IN (403, 406, 429, 503) AND (w.id IS NOT NULL OR {q.any_of('response_body', C.WAF_BODY)}))
  OR (response_status = 403 AND length(response_body) > 1000 AND lower(response_body) LIKE '%<html%') AS is_waf
  FROM txn t LEFT JOIN waf w ON w.id = t.id)"""


def page_type_sql(custom="false"):
    return f"""CASE WHEN strlen(response_body) < 64 AND response_status NOT IN (301, 302, 303, 307, 308) THEN 'empty'
  WHEN response_status BETWEEN 300 AND 399 THEN CASE WHEN {q.any_of('location', C.AUTH_REDIRECT)} THEN 'auth_required' ELSE 'redirect' END
  WHEN response_status IN (401, 403) THEN CASE WHEN is_waf THEN 'waf_block' ELSE 'auth_required' END
  WHEN {q.any_of('response_body', C.AUTH_BODY)} THEN 'auth_required' WHEN is_waf THEN 'waf_block'
  WHEN response_status >= 500 OR {q.any_of('response_body', C.ERROR_BODY)} THEN 'error'
  WHEN {custom} OR response_status = 404 THEN 'custom_404' ELSE 'real_content' END"""


@query("scl_20_page_type", f"WITH {PAGE_TYPE_CTES} SELECT id, {page_type_sql()} AS page_type FROM flags")
def scl_20(spark, sf):
    c = F.col
    return views.transactions(spark, sf).select(
        "id", C.page_type(c("response_status"), c("response_body"), c("response_headers"), F.lit(False)).alias("page_type")
    )


INSIGHT_SQL = """
SELECT id, ts, request_url, request_method, response_status, CASE WHEN response_status IN (401, 403) THEN 'auth_boundary' WHEN response_status = 405 THEN 'method_hint'
    WHEN response_status = 500 THEN 'server_processing' ELSE 'redirect_boundary' END AS insight_type,
  CASE response_status WHEN 403 THEN 'Path exists but requires authorization' WHEN 401 THEN 'Explicit authentication required'
    WHEN 405 THEN CASE WHEN h_allow <> '' THEN 'Method not allowed. Accepted: ' || h_allow ELSE 'Method not allowed' END
    WHEN 500 THEN 'Input reached server-side processing (internal error)' ELSE 'Redirects to auth: ' || location END AS detail
FROM txn WHERE response_status IN (401, 403, 405, 500) OR (response_status IN (301, 302, 303, 307, 308) AND regexp_matches(lower(location), 'login|signin|auth|sso'))"""
views.DUCK["insight_v"] = INSIGHT_SQL


@query("scl_21_insights", "SELECT id, insight_type, detail FROM insight_v")
def scl_21(spark, sf):
    from ..operators import coverage

    return coverage.insights(views.transactions(spark, sf)).select("id", "insight_type", "detail")


@query("scl_22_api_calls", """
SELECT id, r IN ('XHR', 'Fetch') OR starts_with(response_content_type, 'application/json') AS is_api_call,
  request_url NOT LIKE 'https://app1.example.com%' AS is_third_party
FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'XHR' WHEN 1 THEN 'Document' ELSE 'Image' END AS r FROM txn)""")
def scl_22(spark, sf):
    k = F.col("id") % 3
    kind = F.when(k == 0, "XHR").when(k == 1, "Document").otherwise("Image")
    return views.table(spark, sf, "txn").select(
        "id",
        C.is_api_call(kind, F.col("response_content_type")).alias("is_api_call"),
        C.is_third_party(F.col("request_url"), "app1.example.com").alias("is_third_party"),
    )


_SPA = " OR ".join(f"contains(lower(body), {q.quote(m)})" for m in C.SPA_MARKERS)


@query("scl_23_needs_rendering", f"""
WITH b AS (SELECT 'p' || page_id AS key, 200 AS status, 'text/html' AS ct, CASE WHEN page_id % 3 = 0 THEN '<div id="root"></div>' || html ELSE html END AS body FROM pages
  UNION ALL SELECT 't' || id, response_status, response_content_type, response_body FROM txn)
SELECT key, status BETWEEN 200 AND 399 AND ((ct LIKE '%html%' AND length(trim(lower(body))) < 200) OR (({_SPA})
  AND len(regexp_extract_all(lower(body), '<a ')) < 3 AND len(regexp_extract_all(lower(body), 'href=')) < 5)) AS needs_rendering FROM b""")
def scl_23(spark, sf):
    pages = views.base(spark, sf, "pages").select(
        F.concat(F.lit("p"), "page_id").alias("key"), F.lit(200).alias("status"), F.lit("text/html").alias("ct"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<div id="root"></div>'), "html")).otherwise(F.col("html")).alias("body"),
    )
    txn = views.table(spark, sf, "txn").select(
        F.concat(F.lit("t"), "id").alias("key"), "response_status", "response_content_type", "response_body"
    )
    return pages.union(txn).select("key", C.needs_rendering(F.col("status"), F.col("ct"), F.col("body")).alias("needs_rendering"))


@query("scl_24_cookies", """
WITH c AS (SELECT id, trim(regexp_extract(part, '^([^;]*)', 1)) AS nv FROM (SELECT id, unnest(string_split(h_cookie, ',')) AS part FROM txn WHERE h_cookie IS NOT NULL))
SELECT id, trim(split_part(nv, '=', 1)) AS name, trim(regexp_extract(nv, '^[^=]*=(.*)', 1)) AS value FROM c
WHERE nv LIKE '%=%' AND regexp_matches(trim(split_part(nv, '=', 1)), '^[A-Za-z]')""")
def scl_24(spark, sf):
    cookie = S.header(F.col("response_headers"), "set-cookie")
    return views.transactions(spark, sf).select("id", F.explode(C.cookie_pairs(cookie)).alias("c")).select("id", "c.name", "c.value")


_FLOW = "CASE " + " ".join(f"WHEN regexp_matches(x, '{'|'.join(w)}') THEN '{n}'" for n, w in C.FLOW_NAMES)
FLOW_NAME_SQL = _FLOW


@query("scl_25_flow_name", f"WITH f AS (SELECT id, lower(request_url || ' ' || location) AS x FROM txn) SELECT id, {_FLOW} ELSE 'flow_2_steps' END AS flow_name FROM f")
def scl_25(spark, sf):
    from ..functions.text import contains_any

    text = F.lower(F.concat_ws(" ", "request_url", "location"))
    return views.table(spark, sf, "txn").select(
        "id", C.flow_name(lambda words: contains_any(text, words), F.lit(2)).alias("flow_name")
    )


@query("scl_26_security_weight", f"WITH {ANY_URL} SELECT url, coalesce({q.first_label('url', C.SECURITY_WEIGHTS)}, 0.0)::double AS weight FROM any_url")
def scl_26(spark, sf):
    return any_url(spark, sf).select("url", C.security_weight(F.col("url")).alias("weight"))


_CTX = q.digest("auth_role || '|' || content_hash || '|[''' || source_module || ''', ''zz'']'", 12)


@query("scl_27_state_identity", f"""
WITH t AS (SELECT *, sha256(response_body) AS content_hash FROM txn)
SELECT id, {_CTX} AS context_id, {q.digest(_CTX + " || '|None|' || request_method", 12)} AS functional_id FROM t""")
def scl_27(spark, sf):
    ctx = S.context_identity(F.col("auth_role"), F.col("content_hash"), F.array(F.lit("zz"), "source_module", F.lit("zz")))
    return views.transactions(spark, sf).select("id", ctx.alias("context_id"), F.col("request_method")).select(
        "id", "context_id",
        S.functional_identity(F.col("context_id"), F.lit(None).cast("string"), F.col("request_method")).alias("functional_id"),
    )


@query("scl_28_login_fields", """
SELECT page_id, 'username' AS user_field, 'password' AS pass_field, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/login' AS action,
  'csrf=tok' || page_id AS hidden FROM page_x WHERE html LIKE '%type="password"%'""")
def scl_28(spark, sf):
    found = H.login_fields(H.forms(F.col("html"), F.col("url")))
    rows = views.table(spark, sf, "page_x").select("page_id", found.alias("f")).where("f IS NOT NULL")
    return rows.select(
        "page_id", "f.user_field", "f.pass_field", "f.action",
        F.array_join(F.transform("f.hidden", lambda h: F.concat_ws("=", h["name"], h["value"])), "&").alias("hidden"),
    )
