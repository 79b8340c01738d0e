"""Live counters on Structured Streaming.

Stateless and windowed counters use Spark's own state. The coverage stream
keeps what it has seen in keyed tables in the shared folder, since a keyed
Spark state would put one large crawl into one task. Every batch writes below
its own number, so a replayed batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..cluster import scratch_path
from ..functions import urls
from ..operators import coverage
from ..sinks import writers
from ..sinks.keyed import KeyedTable, batches, same_keys

#: What has arrived, then stop. Pass {"processingTime": "10 seconds"} to keep a query running.
ONCE = {"availableNow": True}


def _start(rows: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], mode: str = "append", trigger: dict = ONCE) -> StreamingQuery:
    return rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(**trigger).foreachBatch(batch).start()


def _start_files(rows: DataFrame, checkpoint: str, path: str, trigger: dict = ONCE) -> StreamingQuery:
    return rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).format("parquet").start(path)


def ingest(txn: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Insert-or-ignore of arriving transactions; a batch that is replayed writes the same rows to the same place."""
    return _start(txn, checkpoint, lambda rows, batch: writers.append_transactions(rows, path, batch), trigger=trigger)


def deduplicate(txn: DataFrame, path: str, checkpoint: str, keep_for: str = "1 day", trigger: dict = ONCE) -> StreamingQuery:
    """First request per fingerprint; a fingerprint is remembered for ``keep_for``."""
    c = F.col
    fp = urls.request_fingerprint(c("request_url"), c("request_method"), c("request_body"), c("auth_role"))
    rows = txn.select("id", "ts", fp.alias("fingerprint")).withWatermark("ts", keep_for)
    return _start_files(rows.dropDuplicatesWithinWatermark(["fingerprint"]), checkpoint, path, trigger=trigger)


def insights(txn: DataFrame, path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Insight rows as responses arrive; no state."""
    return _start_files(coverage.insights(txn), checkpoint, path, trigger=trigger)


# ---- Coverage ----------------------------------------------------------

SEEN_KEYS = ["crawl_id", *coverage.KEY]


def _stored(rows: DataFrame, path: str) -> DataFrame:
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _before(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """What the last finished batch before ``batch`` left below ``path``."""
    done = [b for b in batches(spark, path) if b < batch]
    return spark.read.parquet(f"{path}/batch={done[-1]}") if done else None


def coverage_batch(rows: DataFrame, batch: int, state: str, frame: int = coverage.SATURATION_WINDOW) -> None:
    """Takes one batch of responses into the coverage state; running it again for the same number changes nothing.

    A response is new when it is the first of its coverage key by (ts, id),
    whatever the order of arrival: a late one that comes before the stored first
    takes the flag over, and the earlier flag is taken back. The source is read
    once, into ``staged``; the rest works on that.
    """
    spark = rows.sparkSession
    staged = _stored(coverage.coverage_rows(rows, "request_url"), f"{state}/staged/batch={batch}")
    firsts = coverage.first_of_key(staged, ["crawl_id"]).drop("source_module")
    seen = KeyedTable(spark, f"{state}/seen", SEEN_KEYS, firsts.schema)
    stored = seen.lookup(firsts, batch).select(*SEEN_KEYS, F.struct("ts", "id").alias("was"))
    met = firsts.join(stored, same_keys(firsts, stored, SEEN_KEYS), "left").select(*[firsts[c] for c in firsts.columns], "was")
    won = _stored(met.where(F.col("was").isNull() | (F.struct("ts", "id") < F.col("was"))), f"{state}/won/batch={batch}")
    seen.put(won.drop("was"), batch)
    lost = _stored(won.where("was IS NOT NULL").select(F.col("was.id").alias("id"), "template"), f"{state}/undone/batch={batch}")

    fresh = won.select("id", F.lit(True).alias("is_new"))
    flags = staged.select("id", "ts", "crawl_id", "source_module", "request_url", "template").join(fresh, "id", "left")
    flags = _stored(flags.withColumn("is_new", F.coalesce("is_new", F.lit(False))), f"{state}/flags/batch={batch}")

    # one row per crawl: its sketch of coverage keys so far
    sketch, last = coverage.coverage_sketches(staged, ["crawl_id"]), _before(spark, f"{state}/sketches", batch)
    if last is not None:
        sketch = sketch.unionByName(last).groupBy("crawl_id").agg(F.hll_union_agg("keys").alias("keys"))
    _stored(sketch, f"{state}/sketches/batch={batch}")

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    change = flags.select("template", one.alias("hits"), F.col("is_new").cast("long").alias("new")).union(lost.select("template", zero, -one))
    change = change.groupBy("template").agg(F.sum("hits").alias("hits"), F.sum("new").alias("new"))
    posterior = KeyedTable(spark, f"{state}/posterior", ["template"], change.schema)
    held = posterior.lookup(change, batch)
    posterior.put(change.unionByName(held).groupBy("template").agg(F.sum("hits").alias("hits"), F.sum("new").alias("new")), batch)

    tail = flags.select("crawl_id", "ts", "id", "is_new")
    last = _before(spark, f"{state}/tail", batch)
    if last is not None:
        taken = lost.select("id", F.lit(True).alias("taken"))
        last = last.join(taken, "id", "left").withColumn("is_new", F.col("is_new") & F.col("taken").isNull())
        tail = tail.unionByName(last.select(*tail.columns))
    # row_number with a bound keeps at most ``frame`` rows per task and crawl
    w = Window.partitionBy("crawl_id").orderBy(F.col("ts").desc(), F.col("id").desc())
    _stored(tail.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= frame).drop("rn"), f"{state}/tail/batch={batch}")


def coverage_stream(txn: DataFrame, state: str, checkpoint: str, frame: int = coverage.SATURATION_WINDOW, trigger: dict = ONCE) -> StreamingQuery:
    """Flags every arriving response as new coverage or not.

    Below ``state``: ``seen`` (first response per coverage key), ``flags`` (one
    row per response), ``undone`` (flags taken back), ``posterior`` (counts per
    template), ``sketches`` (distinct keys per crawl) and ``tail`` (the last
    ``frame`` rows of each crawl).
    """
    return _start(txn, checkpoint, lambda rows, batch: coverage_batch(rows, batch, state, frame), trigger=trigger)


def coverage_flags(spark: SparkSession, state: str) -> DataFrame:
    """id, ts, crawl_id, source_module, request_url, template, is_new for every response so far."""
    undone = spark.read.parquet(f"{state}/undone").select("id", F.lit(True).alias("undone")).distinct()
    flags = spark.read.parquet(f"{state}/flags").drop("batch").join(undone, "id", "left")
    return flags.withColumn("is_new", F.col("is_new") & F.col("undone").isNull()).drop("undone")


def live_posterior(spark: SparkSession, state: str) -> DataFrame:
    """hits, alpha and beta per template as of the last batch."""
    rows = KeyedTable(spark, f"{state}/posterior", ["template"]).read()
    return rows.select("template", "hits", (F.col("new") + 1).alias("alpha"), (F.col("hits") - F.col("new") + 1).alias("beta"))


def live_coverage(spark: SparkSession, state: str) -> DataFrame:
    """Estimated number of distinct coverage keys per crawl, from the stored sketches."""
    return coverage.sketch_estimate(_before(spark, f"{state}/sketches", 1 << 31))


def live_saturation(spark: SparkSession, state: str, frame: int = coverage.SATURATION_WINDOW, rate: float = coverage.SATURATION_RATE) -> DataFrame:
    """Present discovery rate per crawl from the newest tail."""
    newest = spark.read.parquet(f"{state}/tail/batch={batches(spark, f'{state}/tail')[-1]}")
    rows = newest.groupBy("crawl_id").agg(F.count("*").alias("window_rows"), F.avg(F.col("is_new").cast("double")).alias("discovery_rate"))
    return rows.withColumn("saturated", (F.col("window_rows") >= frame) & (F.col("discovery_rate") < rate))


# ---- Running aggregates ------------------------------------------------


def _upserts(rows: DataFrame, keys: list[str], path: str, checkpoint: str, trigger: dict = ONCE) -> StreamingQuery:
    """Changed groups of each batch, stored under the batch number."""
    return _start(rows, checkpoint, lambda out, batch: out.write.mode("overwrite").parquet(f"{path}/batch={batch}"), "update", trigger=trigger)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of every group written by an update stream."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def crawl_stats(txn: DataFrame, path: str, checkpoint: str, width: str = "1 minute", late: str = "10 minutes", trigger: dict = ONCE) -> StreamingQuery:
    """Completed, failed, error and rate-limited counts per window and crawl, and a sketch of the URLs that ``merge_stats`` can add up."""
    status = F.col("response_status")
    rows = txn.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "crawl_id").agg(
        F.count_if(status > 0).alias("completed"), F.count_if(status == 0).alias("failed"),
        F.count_if(status >= 500).alias("errors"), F.count_if(status == 429).alias("rate_limited"),
        F.hll_sketch_agg("request_url", coverage.SKETCH_BITS).alias("endpoints"),
    )
    return _upserts(rows.select(F.col("w.start").alias("window_start"), "crawl_id", *STATS), ["window_start", "crawl_id"], path, checkpoint, trigger)


STATS = ["completed", "failed", "errors", "rate_limited", "endpoints"]


def merge_stats(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and estimated distinct URLs per ``keys`` (for example the crawl alone, or longer windows) from stored window rows."""
    sums = [F.sum(c).alias(c) for c in STATS[:-1]]
    return windows.groupBy(*keys).agg(*sums, F.hll_sketch_estimate(F.hll_union_agg("endpoints")).alias("endpoints_estimate"))


def domain_backoff(txn: DataFrame, path: str, checkpoint: str, width: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", trigger: dict = ONCE) -> StreamingQuery:
    """429 answers per domain in sliding windows."""
    hits = txn.where(F.col("response_status") == 429).withColumn("domain", urls.authority(F.col("request_url")))
    rows = hits.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), "domain").agg(F.count("*").alias("backoffs"))
    return _upserts(rows.select(F.col("w.start").alias("window_start"), "domain", "backoffs"), ["window_start", "domain"], path, checkpoint, trigger)


def places(spark: SparkSession, label: str) -> tuple[str, str]:
    """(output, checkpoint) paths in the shared folder."""
    root = scratch_path(spark, label)
    return f"{root}/out", f"{root}/checkpoint"
