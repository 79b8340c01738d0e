"""Views derived from the driver tables.

Each text in COMMON is plain SQL that Spark and DuckDB read alike; ``@name``
marks a driver table. They turn events and pages into the request log, page
markup, API documents and browser telemetry that the operators work on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BASE = ["events", "pages", "supplier"]
TABLE_MARK = r"@(" + "|".join(BASE) + r")\b"


def _s(x: str) -> str:
    return f"cast({x} as varchar(20))"


COMMON: dict[str, str] = {}

COMMON["txn_a"] = f"""
SELECT event_id AS id, ts, user_id, props, event_type, user_id % 4 AS crawl_id, user_id % 3 AS u,
  CASE WHEN event_type = 'click' AND event_id % 13 = 0 THEN 'script' ELSE event_type END AS kind,
  concat('https://app', {_s('user_id % 3')}, '.example.com') AS origin
FROM @events"""

COMMON["txn_b"] = f"""
SELECT a.*,
  CASE u WHEN 0 THEN 'anonymous' WHEN 1 THEN 'user' ELSE 'admin' END AS auth_role,
  CASE WHEN kind IN ('signup', 'purchase') THEN 'POST' WHEN kind = 'error' AND id % 5 = 4 THEN 'PUT' ELSE 'GET' END AS request_method,
  concat(origin, CASE kind
    WHEN 'view' THEN concat('/api/v1/users/', {_s('user_id')})
    WHEN 'click' THEN concat('/products/', {_s('id % 50')}, '?ref=', {_s('id % 3')}, '&page=', {_s('id % 7')}, '&search=item-', {_s('id % 11')}, 'xyz')
    WHEN 'script' THEN concat('/static/js/app', {_s('id % 5')}, '.js')
    WHEN 'signup' THEN '/register'
    WHEN 'purchase' THEN concat('/checkout/confirm?order=', {_s('id')})
    ELSE concat('/admin/config', {_s('id % 4')}, CASE WHEN id % 9 = 0 THEN '.bak' ELSE '' END) END) AS request_url,
  CASE kind WHEN 'signup' THEN concat('user=u', {_s('user_id')}, '&plan=', {_s('id % 3')})
    WHEN 'purchase' THEN concat('order=', {_s('id')}) ELSE '' END AS request_body,
  CASE WHEN kind = 'error' THEN CASE id % 5 WHEN 0 THEN 500 WHEN 1 THEN 403 WHEN 2 THEN 401 WHEN 3 THEN 404 ELSE 405 END
    WHEN kind = 'signup' THEN 302
    WHEN kind = 'purchase' THEN CASE WHEN id % 4 = 0 THEN 302 ELSE 200 END
    WHEN kind <> 'script' AND id % 50 = 0 THEN 429 ELSE 200 END AS response_status
FROM txn_a a"""

COMMON["txn_c"] = f"""
SELECT b.*,
  CASE WHEN kind = 'signup' THEN CASE WHEN id % 2 = 0 THEN '/login' ELSE '/dashboard' END
    WHEN response_status = 302 THEN '/checkout' ELSE '' END AS location,
  CASE kind WHEN 'view' THEN 'application/json' WHEN 'script' THEN 'application/javascript' ELSE 'text/html' END AS response_content_type,
  CASE kind WHEN 'view' THEN props
    WHEN 'script' THEN concat('const API_BASE = "https://app', {_s('u')}, '.example.com/api/v', {_s('id % 3 + 1')}, '";',
      ' fetch(API_BASE + "/orders/', {_s('id % 7')}, '"); fetch("/api/session", {{method: "POST"}});',
      ' axios.post("/api/cart/', {_s('id % 4')}, '", {{item: "a"}}); $.get("/legacy/list"); xhr.open("PUT", "/internal/item', {_s('id % 3')}, '");',
      ' router.push("/home"); const routes = [{{path: "/dash/', {_s('id % 2')}, '"}}]; const docs = "/auth/help";',
      ' const api_key = "live-', {_s('id % 6')}, '-abcdef123456";',
      ' const session = "eyJhbGciOiJIUzI1', {_s('id % 6')}, '.eyJzdWIiOiIxMjM0NTY3.c2lnbmF0dXJlLXZhbHVl"; const note = "AKIAABCDEFGHIJKLMNO', {_s('id % 3')}, '";')
    WHEN 'click' THEN concat('<html><head><title>Products</title></head><body><h1>click</h1><p>', {_s('id % 7')}, '</p><p>Results for ',
      CASE WHEN id % 2 = 0 THEN concat('item-', {_s('id % 11')}, 'xyz') ELSE 'everything' END,
      '</p><a href="/products/', {_s('id % 50')}, '">open</a></body></html>')
    WHEN 'signup' THEN '<html><body><h1>signup</h1><p>Create account or sign in to continue shopping</p></body></html>'
    WHEN 'purchase' THEN CASE id % 8
      WHEN 1 THEN '<html><body><p>Order confirmed. Welcome back, my account, sign out</p></body></html>'
      WHEN 3 THEN '<html><body><form method="post" action="/login"><input type="text" name="username"><input type="password" name="password"></form></body></html>'
      WHEN 5 THEN '<html>ok</html>'
      ELSE '<html><body><p>Order received. Thank you for shopping with us today</p></body></html>' END
    ELSE concat('<html><body><h1>error</h1>', CASE response_status
      WHEN 500 THEN '<p>Traceback (most recent call last): boom in handler</p><center>nginx/1.25</center>'
      WHEN 403 THEN '<p>Access to the admin panel is forbidden for this role</p>'
      WHEN 401 THEN '<p>Please log in to view this configuration page</p>'
      WHEN 404 THEN '<p>Page not found on this server, sorry about that</p>'
      ELSE '<p>Method not allowed for this resource on this server</p>' END, '</body></html>') END AS response_body
FROM txn_b b"""

COMMON["txn"] = f"""
SELECT id, ts, crawl_id, auth_role, request_method, request_url, request_body, response_status, location,
  response_content_type, response_body, kind,
  CASE id % 4 WHEN 0 THEN 's_crawl' WHEN 1 THEN 's_js' WHEN 2 THEN 's_passive' ELSE 's_auth' END AS source_module,
  cast(id % 6 as int) AS depth,
  CASE WHEN response_status >= 500 THEN 'error' WHEN response_status IN (401, 403) THEN 'auth_required'
    WHEN response_status = 302 THEN 'redirect' WHEN response_status = 404 THEN 'custom_404' ELSE 'real_content' END AS page_type,
  CASE u WHEN 0 THEN 'nginx/1.25' WHEN 1 THEN 'Apache/2.4' ELSE 'cloudflare' END AS h_server,
  'Mon, 01 Jan 2024 00:00:00 GMT' AS h_date,
  CASE WHEN u = 2 THEN concat(lpad({_s('id % 97')}, 8, '0'), '-FRA') END AS h_cf_ray,
  CASE kind WHEN 'signup' THEN concat('PHPSESSID=a', {_s('id % 5')}, '; Path=/; Expires=Thu, 01 Dec 2025 00:00:00 GMT, AWSALB=z', {_s('id % 3')}, '; Path=/')
    WHEN 'purchase' THEN concat('connect.sid=s', {_s('id % 4')}) END AS h_cookie,
  CASE WHEN kind = 'click' AND id % 10 = 0 THEN '1.1 varnish, 1.1 nginx' END AS h_via,
  CASE WHEN kind = 'view' THEN CASE id % 3 WHEN 0 THEN 'HIT' WHEN 1 THEN 'Miss from edge' END END AS h_x_cache,
  CASE WHEN id % 20 = 0 THEN '12' END AS h_age,
  CASE WHEN response_status = 405 THEN 'GET, POST' END AS h_allow,
  CASE WHEN kind = 'click' AND u = 0 THEN 'Express' WHEN u = 1 THEN 'PHP/8.2' END AS h_powered,
  CASE WHEN kind = 'purchase' AND u = 2 THEN concat('req-', {_s('id % 9')}) END AS h_amz
FROM txn_c"""

# (position, header name, source column); the date comes first on app1 only
HEADER_COLUMNS = [
    ("Server", "h_server"), ("Date", "h_date"), ("Content-Type", "response_content_type"),
    ("CF-RAY", "h_cf_ray"), ("Location", "location"), ("Set-Cookie", "h_cookie"),
    ("Via", "h_via"), ("X-Cache", "h_x_cache"), ("Age", "h_age"), ("Allow", "h_allow"),
    ("X-Powered-By", "h_powered"), ("X-Amz-Request-Id", "h_amz"),
]

COMMON["page_x"] = f"""
SELECT page_id, url, concat(html, CASE page_id % 4
  WHEN 0 THEN '<form method="get" action="/search"><input type="text" name="q" value=""><input type="number" name="page" value="1"></form>'
  WHEN 1 THEN concat('<form method="post" action="/login"><input type="hidden" name="csrf" value="tok', {_s('page_id')}, '"><input type="text" name="username"><input type="password" name="password" required></form>')
  WHEN 2 THEN concat('<script src="/js/jquery-3.6.0.min.js"></script><img src="/img/a', {_s('page_id % 5')}, '.png"><iframe src="frame.html"></iframe><a href="#top">top</a><link href="/css/bulma.min.css">')
  ELSE concat('<meta name="generator" content="WordPress 6.4"><script>const API_URL = "https://api.example.com/v2"; fetch(API_URL + "/users"); axios.post("/api/orders", {{item: 1}}); const token = "live-token-', {_s('page_id % 9')}, '-xyz"; // inline</script>') END) AS html
FROM @pages"""

COMMON["spec"] = f"""
SELECT page_id, url, concat(
  '{{"openapi":"3.0.0","security":[{{"key":[]}}],"paths":{{"/items', {_s('page_id')}, '":{{"get":{{"parameters":[{{"name":"id","in":"query","required":true,"schema":{{"type":"integer"}}}},{{"name":"X-T","in":"header","schema":{{"$ref":"#/components/schemas/Code"}}}}]}},"post":{{"security":[],"requestBody":{{"content":{{"application/json":{{"schema":{{"$ref":"#/components/schemas/Item"}}}}}}}}}}}},"/ping":{{"get":{{}},"summary":{{}}}}}},',
  '"components":{{"schemas":{{"Code":{{"type":"string"}},"Owner":{{"type":"object","required":["mail"],"properties":{{"mail":{{"type":"string"}},"parent":{{"$ref":"#/components/schemas/Item"}}}}}},',
  '"Item":{{"type":"object","required":["name"],"properties":{{"name":{{"type":"string"}},"size":{{"type":"integer"}},"owner":{{"$ref":"#/components/schemas/Owner"}}}}}}}},',
  '"securitySchemes":{{"key":{{"type":"apiKey"}}', CASE WHEN page_id % 2 = 0 THEN ',"oauth":{{"type":"oauth2"}}' ELSE '' END, '}}}}}}') AS body
FROM @pages"""

COMMON["gql"] = f"""
SELECT page_id, url, concat(
  '{{"data":{{"__schema":{{"queryType":{{"name":"Query"}},"mutationType":{{"name":"Mutation"}},"subscriptionType":null,"types":[',
  '{{"name":"Query","kind":"OBJECT","fields":[{{"name":"item', {_s('page_id')}, '","args":[{{"name":"id","type":{{"kind":"NON_NULL","name":null,"ofType":{{"kind":"SCALAR","name":"ID","ofType":null}}}}}}]}},{{"name":"__type","args":[]}}]}},',
  '{{"name":"Mutation","kind":"OBJECT","fields":[{{"name":"save","args":[{{"name":"input","type":{{"kind":"NON_NULL","name":null,"ofType":{{"kind":"INPUT_OBJECT","name":"ItemInput","ofType":null}}}}}},{{"name":"tags","type":{{"kind":"LIST","name":null,"ofType":{{"kind":"NON_NULL","name":null,"ofType":{{"kind":"SCALAR","name":"String"}}}}}}}}]}}]}},',
  '{{"name":"ItemInput","kind":"INPUT_OBJECT","inputFields":[{{"name":"title","type":{{"kind":"NON_NULL","name":null,"ofType":{{"kind":"SCALAR","name":"String"}}}}}},{{"name":"size","type":{{"kind":"SCALAR","name":"Int"}}}}]}}]}}}}}}') AS body
FROM @pages"""

COMMON["telemetry_doc"] = f"""
SELECT id, request_url, concat(
  '{{"request_url":"', request_url, '","final_url":"', request_url, '","total_requests":', {_s('id % 9')},
  ',"api_calls":[{{"url":"https://app0.example.com/api/data', {_s('id % 12')}, '","method":"GET","resource_type":"XHR","mime_type":"application/json","status_code":200}}],',
  '"discovered_requests":[{{"url":"https://cdn', {_s('id % 4')}, '.tracker.net/t.js","is_third_party":true}},{{"url":"https://app0.example.com/self","is_third_party":false}}],',
  '"websocket_sessions":[', CASE WHEN id % 3 = 0 THEN concat('{{"url":"wss://app1.example.com/live', {_s('id % 2')}, '"}}') ELSE '' END, '],',
  '"console_messages":[{{"level":"log","text":"', CASE id % 4 WHEN 0 THEN 'api_key=abc123' WHEN 1 THEN 'loaded fine' WHEN 2 THEN 'see https://x.example.com/v2/things' ELSE 'socket wss://rt.example.com' END, '","url":"/main.js","line":', {_s('id % 100')}, '}}],',
  '"js_errors":[', CASE WHEN id % 6 = 0 THEN '{{"level":"error","text":"password: hunter2","url":"/err.js","line":7}}' ELSE '' END, '],',
  '"security_headers":{{"csp":"', CASE id % 3 WHEN 0 THEN 'default-src; frame-ancestors none' WHEN 1 THEN 'default-src' ELSE '' END,
  '","csp_report_only":"","cors_allow_origin":"', CASE WHEN id % 5 < 2 THEN '*' ELSE '' END,
  '","cors_allow_credentials":"', CASE WHEN id % 5 = 0 THEN 'TRUE' ELSE '' END,
  '","x_frame_options":"', CASE WHEN id % 7 = 0 THEN 'DENY' ELSE '' END,
  '","strict_transport_security":"', CASE WHEN id % 2 = 0 THEN 'max-age=1' ELSE '' END,
  '","x_content_type_options":"', CASE WHEN id % 11 = 0 THEN 'nosniff' ELSE '' END, '"}},',
  '"redirect_chain":[', CASE WHEN response_status = 302 THEN concat('"', location, '"') ELSE '' END, ']}}') AS metrics_json
FROM txn"""

COMMON["passive_url"] = f"""
SELECT page_id AS seq, url, CASE page_id % 3 WHEN 0 THEN 'wayback' WHEN 1 THEN 'commoncrawl' ELSE 'otx' END AS tag,
  CASE WHEN page_id % 5 = 0 THEN '' ELSE '200' END AS status, CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE '' END AS mime
FROM @pages
UNION ALL
SELECT event_id + 1000000000 AS seq, concat('https://shop', {_s('user_id % 3')}, '.example.com', CASE event_id % 10
    WHEN 0 THEN concat('/u/name', {_s('user_id')}) WHEN 1 THEN concat('/u/name', {_s('user_id')}, '/posts/', {_s('event_id')})
    WHEN 2 THEN concat('/cat/', {_s('event_id % 4')}, '?sort=', {_s('event_id % 3')}, '&active=true') WHEN 3 THEN '/about'
    WHEN 4 THEN concat('/img/', {_s('event_id % 30')}, '.PNG') WHEN 5 THEN concat('/x%20%20y/', {_s('event_id % 6')})
    WHEN 6 THEN concat('/a%41%42%43%44/', {_s('event_id % 3')}) WHEN 7 THEN concat('/docs/sec', {_s('event_id % 3')}, '/p', {_s('event_id % 20')}, '?v=', {_s('event_id % 5')})
    WHEN 8 THEN '/' ELSE concat('/docs/sec', {_s('event_id % 3')}, '/') END) AS url,
  CASE event_id % 3 WHEN 0 THEN 'wayback' WHEN 1 THEN 'commoncrawl' ELSE 'otx' END AS tag,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE '200' END AS status, CASE WHEN event_id % 2 = 0 THEN 'text/html' ELSE '' END AS mime
FROM @events"""

COMMON["dns"] = f"""
SELECT concat('s', {_s('s_suppkey')}, '.example.com') AS host, CASE s_suppkey % 5
  WHEN 0 THEN concat('e', {_s('s_suppkey')}, '.akamaiedge.net') WHEN 1 THEN concat('d', {_s('s_suppkey')}, '.cloudfront.net')
  WHEN 2 THEN concat('x', {_s('s_suppkey')}, '.herokuapp.com') WHEN 3 THEN 'plain.example.net' ELSE 'cdn.cloudflare.net.example' END AS cname
FROM @supplier"""

COMMON["obs"] = """
SELECT id AS seq, ts, request_url AS url, request_method AS method, response_status AS status_code,
  response_content_type AS content_type, source_module, depth,
  CASE WHEN kind = 'error' THEN 'admin' WHEN kind = 'view' THEN 'api_json' WHEN id % 3 = 0 THEN 'real_content' ELSE '' END AS page_type,
  CASE source_module WHEN 's_passive' THEN 'wayback' WHEN 's_js' THEN 'js_ast' WHEN 's_auth' THEN 'auth:user' ELSE '' END AS tag1,
  CASE WHEN kind = 'error' AND id % 9 = 0 THEN 'debug' WHEN kind = 'view' THEN 'api' ELSE '' END AS tag2
FROM txn"""

COMMON["queue"] = """
SELECT id AS seq, request_url AS url, request_method AS method, cast(id % 25 as int) AS priority, depth,
  source_module, auth_role, request_body AS body
FROM txn"""

COMMON["sample_v"] = f"""
SELECT id, CASE id % 7 WHEN 0 THEN 'user-id' WHEN 1 THEN 'callback' WHEN 2 THEN 'Payload' ELSE concat('field', {_s('id % 5')}) END AS name,
  v1, v2, v3 FROM (SELECT event_id AS id,
  {{v1}} AS v1, {{v2}} AS v2, {{v3}} AS v3 FROM @events) q"""
_VALUE = """CASE ({n}) % 14 WHEN 0 THEN '12' WHEN 1 THEN '-1.5' WHEN 2 THEN 'YES' WHEN 3 THEN 'a@b.co' WHEN 4 THEN '0a1b2c3d-0000-1111-2222-333344445555'
  WHEN 5 THEN 'https://x.y' WHEN 6 THEN '2024-01-02T00' WHEN 7 THEN 'eyJhbGci.eyJzdWIi.x' WHEN 8 THEN ' [1]' WHEN 9 THEN 'QUJDREVGR0hJSktMTU5P'
  WHEN 10 THEN 'deadbeef0' WHEN 11 THEN '../etc' WHEN 12 THEN 'plain text' ELSE '1' END"""
COMMON["sample_v"] = COMMON["sample_v"].format(
    v1=_VALUE.format(n="event_id"), v2=_VALUE.format(n="event_id * 3 + 1"), v3=_VALUE.format(n="event_id - event_id % 14"))

COMMON["state_edge"] = f"""
SELECT src, dst, min(event_id) AS seq FROM (SELECT event_id, concat('n', {_s('user_id')}) AS src, concat('n', {_s('(user_id * 5 + event_id % 3) % 150')}) AS dst FROM @events) e GROUP BY src, dst"""


def _plain(text: str) -> str:
    return re.sub(TABLE_MARK, r"\1", text)


DUCK: dict[str, str] = {name: _plain(text) for name, text in COMMON.items()}
DUCK["hdr"] = " UNION ALL ".join(
    f"SELECT id, CASE WHEN h_server = 'Apache/2.4' AND '{name}' = 'Date' THEN -1 ELSE {pos} END AS pos, "
    f"'{name}' AS name, {column} AS value FROM txn WHERE coalesce({column}, '') <> ''"
    for pos, (name, column) in enumerate(HEADER_COLUMNS)
)


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPREAD: dict[tuple, str] = {}


def spread(spark: SparkSession, sf_dir: str, name: str) -> str:
    """View name of a driver table, read by at least as many tasks as cores.

    A table of many files keeps its splits; one that fits a single split is
    dealt out once, since the views do real work per row.
    """
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    if key not in _SPREAD:
        rows = base(spark, sf_dir, name)
        cores = spark.sparkContext.defaultParallelism
        if rows.rdd.getNumPartitions() * 2 <= cores:
            rows = rows.repartition(cores)
        _SPREAD[key] = f"waymark_{name}_{len(_SPREAD)}"
        rows.createOrReplaceTempView(_SPREAD[key])
    return _SPREAD[key]


def table(spark: SparkSession, sf_dir: str, name: str, **replaced: str) -> DataFrame:
    """A COMMON view as a Spark DataFrame over the driver's files.

    ``replaced`` names temporary views that stand in for driver tables, which
    is how a stream gets the same view.
    """
    order: list[str] = []

    def visit(text: str) -> None:
        for other, body in COMMON.items():
            if other not in order and re.search(rf"\b{other}\b", text):
                visit(body)
                if other not in order:
                    order.append(other)

    visit(name)
    def real(text: str) -> str:
        def source(m: re.Match) -> str:
            return replaced.get(m.group(1)) or spread(spark, sf_dir, m.group(1))

        return re.sub(TABLE_MARK, source, text)
    ctes = ", ".join(f"{n} AS ({real(COMMON[n])})" for n in order)
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}")


def headers_map() -> Column:
    """Ordered header map built from the header columns."""
    date_first = F.col("h_server") == "Apache/2.4"
    def pair(name: str, column: str) -> Column:
        value = F.col(column)
        return F.when(F.coalesce(value, F.lit("")) != "", F.struct(F.lit(name).alias("key"), value.alias("value")))
    pairs = [F.when(date_first, pair("Date", "h_date"))]
    for name, column in HEADER_COLUMNS:
        pairs.append(F.when(~date_first, pair(name, column)) if name == "Date" else pair(name, column))
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def transactions(spark: SparkSession, sf_dir: str, **replaced: str) -> DataFrame:
    """The request log in the shape of ``schema.TRANSACTIONS``, bodies decoded."""
    df = table(spark, sf_dir, "txn", **replaced)
    return df.select(
        "id", F.col("ts").cast("timestamp").alias("ts"), "crawl_id", "auth_role", "request_method",
        "request_url", "request_body", "response_status", headers_map().alias("response_headers"),
        "response_body", "response_content_type", F.col("request_url").alias("response_url_final"),
        "source_module", "depth", "page_type", F.sha2("response_body", 256).alias("content_hash"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One endpoint sighting per transaction, tags as an array."""
    return table(spark, sf_dir, "obs").withColumn(
        "tags", F.filter(F.array("tag1", "tag2"), lambda t: t != "")
    ).drop("tag1", "tag2")


# Script files as mined by the script passes: one body per URL, the earliest
DUCK["script_v"] = "SELECT request_url AS source_url, 0 AS script_no, response_body AS source FROM txn WHERE kind = 'script' QUALIFY row_number() OVER (PARTITION BY request_url ORDER BY ts, id) = 1"
DUCK["script_secret_v"] = """
SELECT source_url, kind, value FROM (
  SELECT source_url, 'aws_access_key' AS kind, unnest(regexp_extract_all(source, '(AKIA[A-Z0-9]{16})', 1)) AS value FROM script_v
  UNION ALL SELECT source_url, 'jwt_token', unnest(regexp_extract_all(source, '(eyJ[a-zA-Z0-9_-]{10,}[.][a-zA-Z0-9_-]{10,}[.][a-zA-Z0-9_-]{10,})', 1)) FROM script_v
  UNION ALL SELECT source_url, 'credential', unnest(regexp_extract_all(source, '(?i)(?:api_key|token|secret|password) *[:=] *"([^"]{8,})"', 1)) FROM script_v) s"""
