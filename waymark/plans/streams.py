"""Streaming queries, each run to the end of the available rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import sources
from ..streaming import live
from . import sqlkit as q, views
from .registry import query
from .scalar import _FP
from .scans import to_schema

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


#: Batches of a stream, and files per batch at least.
BATCHES, FILES = 3, 2
#: Rows of a file, about: a file is read by one task.
FILE_ROWS = 50_000


def arriving(spark, sf):
    """The events as a stream in the shape of the request log: a file source over slices of the table.

    The slices are in order of time, but the second arrives last, so that every
    stream sees several batches and late rows. All rows are written and read.
    The files of a slice grow in number with the table, so that its tasks do not
    grow.
    """
    events = spark.read.schema(EVENTS).parquet(f"{sf}/events.parquet")
    cuts, n = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.percentile_approx("t", [k / BATCHES for k in range(1, BATCHES)]), F.count(F.lit(1))).first()
    files = max(FILES, -(-n // (BATCHES * FILE_ROWS)))
    folder = f"{live.places(spark, 'arriving')[0]}"
    slice_no = sum(((F.unix_micros(F.col("ts").cast("timestamp")) > c).cast("int") for c in cuts or []), F.lit(0))
    for k in sorted(range(BATCHES), key=lambda k: (k == 1, k)):
        events.where(F.coalesce(slice_no, F.lit(0)) == k).repartition(files).write.mode("append").parquet(folder)
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)
    name = f"arriving_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(name)
    try:
        return views.transactions(spark, sf, events=name)
    finally:
        spark.catalog.dropTempView(name)


def finish(running):
    running.awaitTermination()


@query("str_01_ingest", """SELECT cast(id AS varchar) AS id, request_url, request_method, response_status, response_content_type, sha256(response_body) AS body_hash, source_module, depth, page_type,
  regexp_extract(request_url, '//([^/]+)', 1) AS host FROM txn""")
def str_01(spark, sf):
    out, checkpoint = live.places(spark, "ingest")
    finish(live.ingest(to_schema(arriving(spark, sf)), out, checkpoint))
    rows = sources.read_transactions(spark, out)
    return rows.select("id", "request_url", "request_method", "response_status", "response_content_type", F.sha2("response_body", 256).alias("body_hash"), "source_module", "depth", "page_type", "host")


@query("str_02_dedup", f"SELECT {q.digest(_FP)} AS fingerprint, 1 AS n FROM txn GROUP BY 1")
def str_02(spark, sf):
    out, checkpoint = live.places(spark, "dedup")
    finish(live.deduplicate(arriving(spark, sf), out, checkpoint, keep_for="90 days"))
    return spark.read.parquet(out).groupBy("fingerprint").agg(F.count("*").cast("int").alias("n"))


def _coverage(spark, sf):
    out, checkpoint = live.places(spark, "coverage")
    finish(live.coverage_stream(arriving(spark, sf), out, checkpoint))
    return out


@query("str_03_coverage", "SELECT id, is_new FROM flag_v")
def str_03(spark, sf):
    return live.coverage_flags(spark, _coverage(spark, sf)).select(F.col("id").cast("long").alias("id"), "is_new")


@query("str_03_saturation", "SELECT crawl_id, least(pos, 200) AS window_rows, round(rate, 6) AS discovery_rate, saturated FROM sat_last")
def str_03_saturation(spark, sf):
    state = live.live_saturation(spark, _coverage(spark, sf))
    return state.select(F.col("crawl_id").cast(views.transactions(spark, sf).schema["crawl_id"].dataType).alias("crawl_id"), "window_rows", F.round("discovery_rate", 6).alias("discovery_rate"), "saturated")


@query("str_04_posterior", "SELECT template, hits, alpha, beta FROM posterior_v")
def str_04(spark, sf):
    return live.live_posterior(spark, _coverage(spark, sf))


@query("str_05_insights", "SELECT id, insight_type, detail FROM insight_v")
def str_05(spark, sf):
    out, checkpoint = live.places(spark, "insights")
    finish(live.insights(arriving(spark, sf), out, checkpoint))
    return spark.read.parquet(out).select("id", "insight_type", "detail")


@query("str_06_crawl_stats", """SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start, crawl_id, count(*) AS completed, 0::bigint AS failed,
  count(*) FILTER (WHERE response_status >= 500) AS errors, count(*) FILTER (WHERE response_status = 429) AS rate_limited, count(DISTINCT request_url) AS endpoints_estimate FROM txn GROUP BY 1, 2""")
def str_06(spark, sf):
    rows = _stats(spark, sf)
    return live.merge_stats(rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")), ["window_start", "crawl_id"])


def _stats(spark, sf):
    out, checkpoint = live.places(spark, "crawl-stats")
    finish(live.crawl_stats(arriving(spark, sf), out, checkpoint, late="90 days"))
    return live.latest(spark, out, ["window_start", "crawl_id"])


#: Five standard errors of the sketches that coverage and statistics keep.
BOUND = 0.08


@query("str_06_crawl_totals", """SELECT crawl_id, count(*) AS completed, count(*) FILTER (WHERE response_status >= 500) AS errors, count(*) FILTER (WHERE response_status = 429) AS rate_limited,
  count(DISTINCT request_url) AS endpoints, true AS within_bound FROM txn GROUP BY 1""")
def str_06_totals(spark, sf):
    merged = live.merge_stats(_stats(spark, sf), ["crawl_id"])
    exact = views.transactions(spark, sf).groupBy("crawl_id").agg(F.countDistinct("request_url").alias("endpoints"))
    within = F.abs(F.col("endpoints_estimate") - F.col("endpoints")) <= BOUND * F.col("endpoints") + 0.5
    return merged.join(exact, "crawl_id").select("crawl_id", "completed", "errors", "rate_limited", "endpoints", within.alias("within_bound"))


@query("str_03_coverage_sketch", "SELECT crawl_id, count(*) FILTER (WHERE is_new) AS unique_coverage, true AS within_bound FROM flag_v GROUP BY 1")
def str_03_sketch(spark, sf):
    state = _coverage(spark, sf)
    exact = live.coverage_flags(spark, state).groupBy("crawl_id").agg(F.count_if("is_new").alias("unique_coverage"))
    within = F.abs(F.col("coverage_estimate") - F.col("unique_coverage")) <= BOUND * F.col("unique_coverage") + 0.5
    rows = exact.join(live.live_coverage(spark, state), "crawl_id").select("crawl_id", "unique_coverage", within.alias("within_bound"))
    return rows.withColumn("crawl_id", F.col("crawl_id").cast(views.transactions(spark, sf).schema["crawl_id"].dataType))


@query("str_07_domain_backoff", f"""SELECT strftime(date_trunc('minute', ts) - to_minutes(k), '%Y-%m-%d %H:%M:%S') AS window_start, {q.authority('request_url')} AS domain, count(*) AS backoffs
FROM txn, range(0, 5) r(k) WHERE response_status = 429 GROUP BY 1, 2""")
def str_07(spark, sf):
    out, checkpoint = live.places(spark, "backoff")
    finish(live.domain_backoff(arriving(spark, sf), out, checkpoint, late="90 days"))
    rows = live.latest(spark, out, ["window_start", "domain"])
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
