"""Keyed tables, appends and the coverage stream over several batches, replays and late rows."""

import random
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from waymark import sinks, sources
from waymark.operators import coverage
from waymark.plans import scans, streams, views
from waymark.sinks import keyed
from waymark.streaming import live

SF = "/root/testdata/sf0.001"


def test_bloom_has_no_false_negatives_and_few_false_positives():
    r = np.random.default_rng(1)
    own, other = r.integers(-(1 << 63), 1 << 63, (2, 20_000))
    held = keyed.bloom(own)
    assert keyed.may_hold(held, own).all() and keyed.may_hold(held, other).mean() < 5e-4
    assert not keyed.may_hold(keyed.bloom(own[:0]), other).any()


def upserts(spark, path, **kw):
    rows = spark.createDataFrame([], "k string, g int, v long")
    return keyed.KeyedTable(spark, path, ["k", "g"], rows.schema, **kw)


def test_table_keeps_the_newest_row_of_each_key(spark, tmp_path):
    table, want, r = upserts(spark, str(tmp_path / "t"), buckets=3, most=3), {}, random.Random(5)
    for batch in range(6):
        keys = {(r.choice([None, "a", "b", f"k{r.randint(0, 30)}"]), r.choice([None, 1, 2])) for _ in range(12)}
        rows = [(*k, batch * 100 + i) for i, k in enumerate(sorted(keys, key=str))]
        df = spark.createDataFrame(rows, "k string, g int, v long")
        expect = {k: want[k] for k in keys if k in want}
        assert {(x["k"], x["g"]): x["v"] for x in table.lookup(df, batch).collect()} == expect
        for _ in range(1 + (batch % 3 == 1)):  # some batches run twice
            table.put(df, batch)
        want.update({(k, g): v for k, g, v in rows})
        got = table.read().collect()
        assert {(x["k"], x["g"]): x["v"] for x in got} == want and len(got) == len(want)
        per_bucket = [x["bucket"] for x in table._live()]
        assert max(per_bucket.count(b) for b in set(per_bucket)) <= 3
    with pytest.raises(ValueError):
        table.put(df, 2)


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    table = upserts(spark, str(tmp_path / "t"))
    none = spark.createDataFrame([], "k string, g int, v long")
    table.put(none, 0)
    assert table.read().count() == 0 and table.lookup(none).count() == 0
    table.put(spark.createDataFrame([("a", 1, 7)], "k string, g int, v long"), 1)
    table.put(none, 2)
    assert [tuple(r) for r in table.read().collect()] == [("a", 1, 7)]


def test_lookups_open_only_files_that_may_hold_a_key(spark, tmp_path):
    table = upserts(spark, str(tmp_path / "t"), buckets=4, most=99)
    day = lambda d, n: spark.range(n).select(F.format_string("2024-%02d-%05d", F.lit(d), "id").alias("k"), F.lit(0).alias("g"), F.col("id").alias("v"))
    for d in range(10):
        table.put(day(d, 200), d)
    assert len(table._live()) == 40
    assert table.lookup(day(11, 200)).count() == 0 and not table.opened  # beyond every range
    assert table.lookup(day(4, 200)).count() == 200 and len(table.opened) == 4  # one batch
    one = day(4, 200).where("v = 17")
    assert table.lookup(one).count() == 1 and len(table.opened) == 1
    strange = one.withColumn("g", F.lit(5))  # inside the range, in no file
    assert table.lookup(strange).count() == 0 and not table.opened


def test_appends_ignore_stored_ids_and_replays(spark, tmp_path):
    path = str(tmp_path / "txn")
    rows = scans.to_schema(views.transactions(spark, SF)).cache()
    first, second = rows.where("id % 3 = 0"), rows.where("id % 3 <> 1")
    sinks.append_transactions(first, path, 0)
    before = sorted(r["id"] for r in sources.read_transactions(spark, path).collect())
    sinks.append_transactions(first.union(first), path, 0)
    assert sorted(r["id"] for r in sources.read_transactions(spark, path).collect()) == before
    for _ in range(2):
        sinks.append_transactions(second, path, 1)
    sinks.append_transactions(rows, path)
    stored = sources.read_transactions(spark, path).select(*[c for c in rows.columns if not c.endswith("_body")], F.sha2("response_body", 256).alias("b"), F.sha2("request_body", 256).alias("q"))
    same = rows.select(*stored.columns[:-2], F.sha2(sources.text_of(F.col("response_body")), 256).alias("b"), F.sha2(F.coalesce(sources.text_of(F.col("request_body")), F.lit("")), 256).alias("q"))
    as_text = lambda df: sorted(str(r) for r in df.withColumns({c: F.to_json(c) for c in ("request_headers", "response_headers")}).collect())
    assert as_text(stored) == as_text(same)


def test_coverage_over_batches_with_replays_and_late_rows(spark, tmp_path):
    state = str(tmp_path / "state")
    txn = views.transactions(spark, SF).cache()
    order = [2, 0, 4, 1, 3]  # arrival, so that most rows are late
    bound = [r["ts"] for r in txn.select("ts").orderBy("ts").collect()]
    cuts = [bound[len(bound) * k // 5] for k in range(1, 5)]
    part = sum(((F.col("ts") > c).cast("int") for c in cuts), F.lit(0))
    for batch, k in enumerate(order):
        for _ in range(1 + batch % 2):  # every other batch is replayed
            live.coverage_batch(txn.where(part == k), batch, state, frame=60)
    want = coverage.new_coverage(txn)
    assert sorted(live.coverage_flags(spark, state).select("id", "is_new").collect()) == sorted(want.select("id", "is_new").collect())
    post = coverage.posterior(want).select("template", "hits", "alpha", "beta")
    assert sorted(live.live_posterior(spark, state).collect()) == sorted(post.collect())
    sat = coverage.saturation_state(want, frame=60)
    assert sorted(live.live_saturation(spark, state, frame=60).collect()) == sorted(sat.collect())
    assert spark.read.parquet(f"{state}/undone").count() > 0
    exact = {r["crawl_id"]: r["n"] for r in want.where("is_new").groupBy("crawl_id").agg(F.count("*").alias("n")).collect()}
    rows = coverage.coverage_rows(txn)
    once = {r["crawl_id"]: r["coverage_estimate"] for r in coverage.sketch_estimate(coverage.coverage_sketches(rows, ["crawl_id"])).collect()}
    parts = coverage.coverage_sketches(rows.withColumn("p", F.col("id") % 7), ["crawl_id", "p"])
    assert {r["crawl_id"]: r["coverage_estimate"] for r in live.live_coverage(spark, state).collect()} == once
    assert {r["crawl_id"]: r["coverage_estimate"] for r in coverage.sketch_estimate(parts).collect()} == once
    assert all(abs(once[c] - n) <= max(1, 0.08 * n) for c, n in exact.items())


def test_sketch_error_bound(spark):
    rows = spark.range(60_000).select(F.lit("c").alias("crawl_id"), F.concat(F.lit("/t"), F.col("id") % 20_000).alias("template"), F.lit("GET").alias("method"), F.lit(2).alias("status_class"),
                                      F.lit(None).cast("string").alias("structure"), F.lit("").alias("role"))
    estimate = coverage.sketch_estimate(coverage.coverage_sketches(rows, ["crawl_id"])).first()["coverage_estimate"]
    assert abs(estimate - 20_000) <= 0.05 * 20_000


def test_filters_are_made_and_read_in_little_memory():
    import tracemalloc

    hashes = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, keyed.FILE_ROWS)
    tracemalloc.start()
    held = keyed.bloom(hashes)
    assert keyed.may_hold(held, np.tile(hashes, 4)).all()
    assert tracemalloc.get_traced_memory()[1] < 64_000_000
    tracemalloc.stop()


def test_a_bucket_of_many_files_is_merged_by_batches_not_by_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FILE_ROWS", 10)
    table = upserts(spark, str(tmp_path / "t"), buckets=1, most=3)
    for batch in range(4):
        table.put(spark.range(batch * 50, batch * 50 + 50).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("g"), F.col("id").alias("v")), batch)
        assert {r["batch"] for r in table._live()} == (set(range(batch + 1)) if batch < 3 else {3})
    assert table.read().count() == 200


def test_a_hot_host_gets_more_files(spark, tmp_path, monkeypatch):
    from waymark.sinks import writers

    monkeypatch.setattr(writers, "HOST_FILE_ROWS", 10)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    rows = spark.range(600).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds("id").alias("timestamp"),
                                   F.when(F.col("id") < 590, "https://hot.io/a").otherwise("https://cold.io/").alias("request_url"))
    writers.append_transactions(rows, str(tmp_path / "t"), 0)
    for k, v in before.items():
        spark.conf.set(k, v)
    files = spark.read.parquet(str(tmp_path / "t/batch=0")).groupBy("host", F.input_file_name().alias("f")).count().collect()
    tasks = {r["f"].split("part-")[1][:5] for r in files if r["host"] == "hot.io"}
    assert len(tasks) > writers.FILES_PER_HOST and sum(r["count"] for r in files) == 600


def test_producers_without_parameters_are_read_once(spark):
    """Only rows that may hold parameters take part in the second pass over the sightings of a batch."""
    from waymark.operators import registry

    asked = spark.createDataFrame([("https://a.example.com/x?y=1", "otx", "200")], "url string, tag string, status string")
    calls = spark.createDataFrame([("https://a.example.com/x?y=1", "POST", "fetch", [("b", "body")])],
                                  "full_url string, method string, tag string, parameters array<struct<name:string,location:string>>")
    telemetry = spark.createDataFrame([([("GET", "https://a.example.com/api", 200, "application/json"), None],), ([],), (None,)],
                                      "api_calls array<struct<method:string,url:string,status_code:int,mime_type:string>>")
    rows = registry.listed(asked).unionByName(registry.called(calls)).unionByName(registry.profiled(telemetry))
    out = registry.merged(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD [url#") == 1
    got = {(r["method"], r["url"]): (r["tags"], [p["name"] for p in r["parameters"]]) for r in out.collect()}
    assert got == {("GET", "https://a.example.com/x?y=1"): (["otx"], []), ("POST", "https://a.example.com/x?y=1"): (["fetch"], ["b"]),
                   ("GET", "https://a.example.com/api"): (["browser"], []), ("GET", None): (["browser"], [])}
    # the document is parsed for the list of calls alone, not once more for a filter on it
    text = spark.createDataFrame([('{"api_calls":[{"url":"u"}]}',)], "metrics_json string")
    from waymark import sources
    plan = registry.profiled(sources.parse_telemetry(text))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_files_of_a_stream_grow_in_number_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 50, raising=False)
    made, places = {}, live.places
    monkeypatch.setattr(live, "places", lambda session, label: made.setdefault(label, places(session, label)))
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    out = Path(streams._coverage(spark, SF).removeprefix("file:"))
    rows = [spark.read.parquet(str(f)).count() for f in sorted(out.glob("staged/batch=*"))]
    assert len(rows) == 3 and sum(rows) == n
    files = [pq.ParquetFile(f).metadata.num_rows for f in Path(made["arriving"][0].removeprefix("file:")).glob("*.parquet")]
    assert sum(files) == n and max(files) <= 60
