"""Block-wise windows against plain windows, with blocks far smaller than a key."""

from pyspark.sql import Window, functions as F

from waymark.operators import flows, ordered


def skewed(spark, n=3000):
    # one key holds two thirds of all rows
    key = F.when(F.rand(3) < 0.66, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string")))
    rows = spark.range(n).select("id", (F.hash("id") % 500).alias("ts"), key.alias("k"), (F.rand(5) < 0.3).cast("int").alias("v"))
    return spark.createDataFrame(rows.toPandas())  # fixed, so that both plans see the same random rows


def test_positions_and_sliding(spark):
    rows = skewed(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = rows.select("id", F.row_number().over(w).alias("pos"), F.avg("v").over(w.rowsBetween(-49, 0)).alias("a"), F.lag("v").over(w).alias("p"))
    placed = ordered.with_position(rows, ["k"], ["ts", "id"])
    got = ordered.sliding(placed, ["k"], 50, 64, a=lambda x: F.avg("v").over(x))
    got = ordered.previous(got, ["k"], ["v"], 64)
    same = want.join(got.select("id", F.col("pos").alias("pos2"), F.col("a").alias("a2"), F.col("prev_v").alias("p2")), "id")
    bad = same.where((F.col("pos") != F.col("pos2")) | (F.abs(F.col("a") - F.col("a2")) > 1e-9) | ~F.col("p").eqNullSafe(F.col("p2")))
    assert same.count() == rows.count() and bad.count() == 0


def test_streaks_cross_blocks(spark):
    data = [("h", i, i, 1 if i < 200 else 0) for i in range(230)] + [("g", i, 1000 + i, i % 2) for i in range(9)]
    rows = spark.createDataFrame(data, "k string, ts long, id long, v int")
    got = ordered.streaks(ordered.with_position(rows, ["k"], ["ts", "id"]), ["k"], "v", 16)
    assert sorted((r.k, r.v, r.length) for r in got.collect() if r.k == "h") == [("h", 0, 30), ("h", 1, 200)]
    assert got.where("k = 'g'").count() == 9


def test_flow_example(spark):
    rows = [(1, "GET", "https://h/cart", 200, None), (2, "POST", "https://h/cart/add", 302, "/checkout"), (3, "GET", "https://h/checkout", 200, None), (4, "GET", "https://h/other", 200, None)]
    txn = spark.createDataFrame([(0, "u", i, i, m, u, s, {"Location": l} if l else {}, u) for i, m, u, s, l in rows],
        "crawl_id int, auth_role string, ts long, id long, request_method string, request_url string, response_status int, response_headers map<string,string>, response_url_final string")
    got = flows.flows(flows.flow_steps(txn, block_rows=2)).collect()
    assert [(r.steps, r.name, r.has_side_effects) for r in got] == [(3, "checkout_flow", False)]


def test_request_keys_tell_bodies_apart_that_share_a_short_digest(spark):
    """The first eight digits of the digests of the two bodies are equal."""
    import hashlib

    from waymark.functions import urls

    seen, i = {}, 0
    while (short := hashlib.sha256(f"user=u{i}".encode()).hexdigest()[:8]) not in seen:
        seen[short], i = i, i + 1
    rows = [("POST", "http://a/r?", f"user=u{n}", "user") for n in (seen[short], i, i)]
    t = spark.createDataFrame(rows, "method string, url string, body string, role string")
    columns = [F.col(c) for c in ("url", "method", "body", "role")]
    assert t.select(urls.request_fingerprint(*columns)).distinct().count() == 1
    assert t.select(urls.request_key(*columns)).distinct().count() == 2
