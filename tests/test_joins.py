"""Joins that must hold for hot keys: baseline lengths, reflected values, guarded signatures."""

import random
import re

import pytest
from pyspark.sql import functions as F

from waymark.functions import classify, urls
from waymark.operators import access, fingerprint, surface
from waymark.signatures import tech


def test_lengths_meet_in_buckets_as_in_a_range_join(spark):
    r = random.Random(3)
    lengths = [0, 1, 9, 10, 11, 90, 99, 100, 101, 109, 110, 111, 121, 1000, 1100, 1101, 900, 899, *[r.randint(1, 20_000) for _ in range(300)]]
    rows = [(i, r.choice(["h", "g", "x"]), r.choice([200, 404]), n, f"r{i}") for i, n in enumerate(lengths)]
    probes = [(r.choice(["h", "g"]), r.choice([200, 404]), r.choice([0, 100, 1000, r.randint(1, 20_000)]), f"p{i}") for i in range(40)]
    got = access.custom_404_ids(spark.createDataFrame(rows, "id int, host string, status int, length int, hash string"),
                                spark.createDataFrame(probes, "host string, status int, length int, hash string"), "h")
    own = {p[0] for p in probes}
    want = {i for i, host, status, n, _ in rows for h, s, b, _ in probes if h == (host if host in own else "h") and s == status and b > 0 and abs(n - b) / b <= 0.1}
    assert {x["id"] for x in got.collect()} == want and 0 < len(want) < len(rows)


def test_a_hot_host_makes_few_rows(spark):
    """Five thousand lengths of one host against as many responses: at most five baseline rows meet a response."""
    probes = spark.createDataFrame([("h", 200, i * 7 + 50, "p") for i in range(5_000)], "host string, status int, length int, hash string")
    rows = spark.createDataFrame([(i, "h", 200, i * 13, "r") for i in range(5_000)], "id int, host string, status int, length int, hash string")
    found = access.custom_404_ids(rows, probes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.count() == sum(1 for i in range(5_000) if 45 <= i * 13 <= 1.1 * (7 * 4_999 + 50))


def reflected(spark, params, bodies, **kw):
    p = spark.createDataFrame(params, "url string, name string, location string, sample_values array<string>")
    t = spark.createDataFrame(bodies, "request_url string, response_body string")
    return p, t, surface.reflected_parameters(p, t, **kw)


def test_reflection_against_all_pairs(spark):
    r = random.Random(8)
    words = ["alpha", "beta77", "12345", "123456", "abc", "gamma delta", "éclair", "a.b*c", "beta7", "eta77"]
    params = [(f"/u{r.randint(0, 5)}", f"n{i}", r.choice(["query", "body"]), r.sample(words, r.randint(0, 4))) for i in range(40)]
    params += [("/many", f"m{i}", "query", [f"value{i}"]) for i in range(50)]
    bodies = [(f"/u{r.randint(0, 6)}", " ".join(r.sample(words, 3))) for _ in range(30)]
    bodies += [("/many", "value7 value49x xvalue12"), ("/many", None), ("/u1", ""), (None, "alpha")]
    fine = lambda v: len(v) >= 4 and not (v.isdigit() and len(v) < 6)
    want = {(u, n, p) for u, n, p, vs in params for x, b in bodies if x == u and b and any(fine(v) and v in b for v in vs)}
    for size in (32_000_000, 400):
        _, _, got = reflected(spark, params, bodies, block_bytes=size)
        assert {tuple(x) for x in got.collect()} == want
    assert {n for u, n, _ in want if u == "/many"} == {"m1", "m4", "m7", "m12", "m49"}
    assert reflected(spark, [], bodies)[2].count() == 0 and reflected(spark, params, [])[2].count() == 0


def test_no_body_is_shuffled_and_a_hot_url_stays_spread(spark):
    """A third of all bodies under one URL: they are searched in the tasks that read them."""
    txn = spark.range(30_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, "/hot").otherwise(F.concat(F.lit("/u"), F.col("id") % 500)).alias("request_url"),
                                                      F.concat(F.lit("page with item-"), F.col("id") % 1000).alias("response_body"))
    params = spark.range(600).select(F.when(F.col("id") < 300, "/hot").otherwise(F.concat(F.lit("/u"), F.col("id"))).alias("url"), F.concat(F.lit("p"), "id").alias("name"),
                                     F.lit("query").alias("location"), F.array(F.concat(F.lit("item-"), F.col("id"))).alias("sample_values"))
    out = surface.reflected_parameters(params, txn)
    plan = out._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):] if "MapInArrow" in plan else plan
    assert "Exchange" not in below and "response_body" not in plan.split("MapInArrow")[0]
    assert out.where("url = '/hot'").count() == 300


def test_many_asked_values_meet_the_bodies_in_one_join(spark):
    """Beyond the bytes that are sent, nothing goes through the driver and each body is read once, not once per block."""
    txn = spark.range(2_000).select(F.concat(F.lit("/u"), F.col("id") % 100).alias("request_url"), F.concat(F.lit("page with item-"), F.col("id"), F.lit(" end")).alias("response_body"))
    params = spark.range(3_000).select(F.concat(F.lit("/u"), F.when(F.col("id") < 2_500, 7).otherwise(F.col("id") % 100)).alias("url"), F.concat(F.lit("p"), "id").alias("name"),
                                       F.lit("query").alias("location"), F.array(F.concat(F.lit("item-"), F.col("id") % 2_000, F.lit(" "))).alias("sample_values"))
    out = surface.reflected_parameters(params, txn, block_bytes=1_000)
    want = {(f"/u{u}", f"p{i}", "query") for i in range(3_000) for u in [7 if i < 2_500 else i % 100] if i % 2_000 % 100 == u}
    assert {tuple(r) for r in out.collect()} == want and len(want) > 500
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 2000") == 2  # one exchange of the bodies serves both branches


def test_needed_literals_hold_for_every_match():
    patterns = [p for _, _, p, _ in tech.BODIES]
    assert sum(bool(fingerprint.needed_literals(p)) for p in patterns) >= len(patterns) - 3
    samples = ["jQuery.extend(Drupal.settings", "DRUPAL.ORG", "<div class='x bg-red-500'>", 'class="a navbar-toggler"', "data-v-a1", "fontawesome", "__VIEWSTATE", "/uploads/x/strapi",
               "Materialize.min.css", 'x-data= "{', "mage/cookies", "svelte-a", "name=\"_token\"", "wf-page", "WEBFLOW"]
    for p in patterns:
        literals = fingerprint.needed_literals(p)
        for s in samples:
            if re.search(p, s) and literals:
                assert any(t in s.lower() for t in literals), (p, s)


@pytest.mark.parametrize("pattern, texts", [
    ("(?i)abc|defg", ["abc", "defg"]), ("ab", []), ("abc?de", ["ab"][:0]), ("abcd?ef", ["abc"]), ("x[abc]+hello", ["hello"]), (r"a\.b\.c", ["a.b.c"]), (r"abc\d+", ["abc"]),
    ("(?:abc|def)ghij", ["ghij"]), ("abc(?:x|y)?", ["abc"]), ("(?:abcd|efgh)", ["abcd", "efgh"]), ("ab{2}cdef", ["cdef"]), ("abc+de", ["abc"]),
])
def test_needed_literals(pattern, texts):
    assert fingerprint.needed_literals(pattern) == texts


def test_a_page_served_often_is_searched_once(spark):
    """Page regexes run on one response per body, none of them a soft 404, and URL hits count every response that is none."""
    page = '<meta name="generator" content="WordPress 6.4"> page number '
    rows = [(f"r{i}", i, f"/wp-admin/{i % 2}" if i % 3 else "/x", 200 if i % 4 else 500, "text/html", page + "abc"[min(i // 4, 2)]) for i in range(20)]
    rows += [("short", 1, "/WP-ADMIN/", 200, "text/html", "<html>"), ("json", 2, "/node/7", 200, "application/json", page), ("none", 3, "/wp-json/", 200, "text/html", None)]
    txn = spark.createDataFrame(rows, "id string, t long, request_url string, response_status int, response_content_type string, response_body string")
    txn = txn.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    groups = fingerprint._body_groups(txn)
    assert sorted(r["id"] for r in fingerprint._pages(txn, groups).collect()) == ["r1", "r5"]  # a and b; c is served 12 times
    hits = {(r["component"], r["detail"]): (r["hits"], r["first_seen"]["id"]) for r in fingerprint.page_matches(txn, scripts=[], bodies=[]).collect()}
    assert hits == {("wordpress", 'generator="WordPress 6.4"'): (2, "r1")}
    found = fingerprint.url_path_matches(txn).collect()
    good = [r for r in rows if r[3] == 200 and not (r[5] or "").endswith("c")]
    assert {(r["detail"], r["hits"]) for r in found} == {("/node/7", 1), ("/WP-ADMIN/", 1), ("/wp-json/", 1)} | {(u, sum(r[2] == u for r in good)) for u in {r[2] for r in good if r[2].startswith("/wp-admin")}}


def test_urls_that_no_pattern_needs_are_left_out_before_their_body_is_hashed(spark):
    urls = ["/wp-admin/", "/NODE/12", "/Customer/Account", "/actuator", "/a/b?populate=1", "/api/x?populate=1", "/plain", "/pmaX", "", None]
    patterns = [s[2] for s in tech.URL_PATHS]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    kept = {r["u"] for r in df.where(fingerprint._may_match("u", patterns)).collect()}
    assert kept >= {u for u in urls if u and any(re.search(p, u) for p in patterns)} and not kept & {"/plain", "", None}
    assert df.where(fingerprint._may_match("u", [])).count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_header_lists_give_the_values_and_sequences_of_the_log(spark):
    heads = ["map('Server', 'nginx', 'Date', cast(id AS string), 'X-Px-A', '1')", "map('server', 'a', 'SERVER', 'a')", "map('Date', 'x')", "map('Server', '')"]
    log = spark.range(40).selectExpr("id", "timestamp_seconds(id % 7) AS ts", f"CASE id % 4 {' '.join(f'WHEN {i} THEN {h}' for i, h in enumerate(heads))} END AS response_headers")
    lists = fingerprint.header_lists(log, ["server"], ["x-px-"])
    assert lists.count() == 4  # the dates do not tell lists apart
    each = lists.select("hits", "first_seen", F.explode("entries").alias("e")).where("e.name = 'server' AND e.value <> ''")
    got = each.groupBy("e.value").agg(F.sum("hits").alias("hits"), F.min("first_seen").alias("first_seen"))
    want = fingerprint.header_values(log, ["server"]).select("value", "hits", "first_seen")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    names = lists.selectExpr("array_join(transform(entries, e -> e.name), ',') AS joined", "hits", "first_seen")
    assert sorted(map(tuple, names.collect())) == sorted(map(tuple, fingerprint.name_sequences(log).select("joined", "hits", "first_seen").collect()))


def test_requests_that_come_again_are_taken_apart_once(spark):
    rows = [(1, "get", "http://a/x?b=2&a=1#f", ""), (0, "get", "http://a/x?b=2&a=1#f", ""), (2, "post", "http://a/x", "u=1&v="), (3, "post", "http://a/x", None), (4, "get", "http://a/#q?z=1", "")]
    seen = spark.createDataFrame(rows, "seq long, method string, url string, body string")
    found = surface.endpoint_parameters(seen, body="body")
    assert sorted(map(tuple, found.collect())) == [
        ("GET", "http://a/x?b=2&a=1", "a", "query", ["1"], 0), ("GET", "http://a/x?b=2&a=1", "b", "query", ["2"], 0), ("POST", "http://a/x", "u", "body", ["1"], 2)]
    plan = _plan(surface.query_parameters(seen))
    assert plan.count("try_url_decode") + plan.count("tryurldecode") <= 2 and plan.count("split(") == 1
    assert _plan(found).count("Aggregate") == 3  # URLs, bodies, names


def test_the_location_is_looked_up_once_per_use_and_boundaries_read_once(spark):
    rows = [(1, 302, "/Login/x"), (2, 302, "/home"), (3, 403, ""), (4, 401, ""), (5, 200, "/login"), (6, 307, "/a/saml")]
    log = spark.createDataFrame(rows, "id long, response_status int, loc string").selectExpr(
        "id", "timestamp_seconds(id) AS ts", "'u' AS request_url", "'GET' AS request_method", "response_status", "map('Location', loc) AS response_headers")
    seen = access.boundary_sightings(log)
    assert {r["seq"]["id"]: r["boundary_type"] for r in seen.collect()} == {1: "redirect_to_login", 3: "forbidden", 4: "unauthorized", 6: "redirect_to_login"}
    assert _plan(seen).count("map_filter") <= 2
    merged = surface.merge_boundaries(seen)
    assert tuple(merged.select("boundary_type", "unauth_status", "access_matrix", "seq.id").first()) == ("redirect_to_login", 302, {"anonymous": 307}, 1)
    assert "Join" not in _plan(merged)


def test_plain_urls_are_those_that_normalising_leaves_alone(spark):
    ends = ["", "?", "?a=1", "?&", "?a&", "?a&&\n", "?a\n", "? a", "?a ", "?a#f", "#f", "#f?a", "?a?b", "?x&y=2", "/p?a "]
    texts = [s + e for s in ("http://h/p", "HTTP://H/p", "/p:q", "mailto:x", "", "a:b", "é:b") for e in ends]
    slow = lambda u: re.sub(r"^[^:/?#]+:", lambda m: m[0].lower(), re.match(r"[^?#]*", u)[0])
    for u, plain in spark.createDataFrame([(t,) for t in texts], "u string").select("u", F.col("u").rlike(urls.PLAIN_PATTERN)).collect():
        if plain:
            query = u.partition("?")[2]
            assert "#" not in u and slow(u) == u.partition("?")[0] and (query or not u.endswith("?")) and query == query.strip(" &\n ")
    assert [r[0] for r in spark.createDataFrame([("http://h/p?a&",), ("HTTP://H?b",), ("http://h?a=1",)], "u string").select(urls.normalize(F.col("u"))).collect()] == ["http://h/p?a", "http://H?b", "http://h?a=1"]


def test_samples_are_typed_once(spark):
    rows = spark.createDataFrame([("x", ["1", "a b", "2", "true"]), ("x", ["zz z", "1.5"]), ("x", [])], "name string, samples array<string>")
    typed = rows.select(classify.infer_type(F.col("name"), F.col("samples")).alias("t"))
    assert [r["t"] for r in typed.collect()][2] == "string" and [r["t"] for r in typed.collect()][0] == [r["t"] for r in rows.limit(1).select(classify.value_type(F.lit("1")).alias("t")).collect()][0]
    assert _plan(typed).count("UUID") + _plan(typed).count("uuid") <= 2
