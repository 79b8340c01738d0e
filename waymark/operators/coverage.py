"""Coverage keys, insights, template statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify, structure, urls
from ..functions.text import digest

SATURATION_WINDOW = 200
SATURATION_RATE = 0.02


def template_slots(observed: DataFrame, order: str, url: str = "url") -> DataFrame:
    """Slot types of each template, read off its first observed URL."""
    first = observed.groupBy(urls.template(F.col(url)).alias("template")).agg(F.min_by(url, order).alias("first_url"))
    return first.withColumn("slots", urls.slot_types(F.col("first_url")))


def insights(txn: DataFrame) -> DataFrame:
    """One row per response that reveals a boundary, hint or server error."""
    found = classify.insight(F.col("response_status"), F.col("response_headers"))
    rows = txn.select("id", "ts", "request_url", "request_method", "response_status", found.alias("i"))
    return rows.where("i IS NOT NULL").select(
        "id", "ts", "request_url", "request_method", "response_status", "i.insight_type", "i.detail"
    )


# ---- Coverage keys -----------------------------------------------------

KEY = ["template", "method", "status_class", "structure", "role"]


def coverage_rows(txn: DataFrame, *more: str) -> DataFrame:
    """id, crawl, arrival and the five-part coverage key of each response, with ``more`` columns as they are."""
    return txn.select(
        "id", "ts", "crawl_id", "source_module", *more, urls.template(F.col("request_url")).alias("template"),
        F.upper("request_method").alias("method"), F.floor(F.col("response_status") / 100).cast("int").alias("status_class"),
        structure.structural_hash(F.col("response_body"), F.col("response_content_type")).alias("structure"),
        F.coalesce("auth_role", F.lit("")).alias("role"),
    )


def first_of_key(rows: DataFrame, scope: list[str]) -> DataFrame:
    """The first row per coverage key: a combinable minimum, no window."""
    return rows.groupBy(*scope, *KEY).agg(F.min_by(F.struct("id", "ts", "source_module"), F.struct("ts", "id")).alias("f")).select(
        *scope, *KEY, "f.*"
    )


def new_coverage(txn: DataFrame, scope: list[str] = ["crawl_id"]) -> DataFrame:
    """Every response with ``is_new``: first of its coverage key in the scope.

    The flag comes back over the unique id, so hot keys do not meet in a task
    and the structure hash is computed once.
    """
    firsts = first_of_key(coverage_rows(txn), scope).select("id").withColumn("is_new", F.lit(True))
    rows = txn.select("id", "ts", "crawl_id", "source_module", "request_url")
    return rows.join(firsts, "id", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def saturation(flags: DataFrame, frame: int = SATURATION_WINDOW, rate: float = SATURATION_RATE, block_rows: int = 0) -> DataFrame:
    """Discovery rate over the last ``frame`` rows at each row of a crawl."""
    from . import ordered

    slim = flags.select("crawl_id", "ts", "id", F.col("is_new").cast("double").alias("new"))
    rows = ordered.with_position(slim, ["crawl_id"], ["ts", "id"])
    out = ordered.sliding(
        rows, ["crawl_id"], frame, block_rows or ordered.BLOCK_ROWS, discovery_rate=lambda w: F.avg("new").over(w)
    )
    return out.withColumn("saturated", (F.col("pos") >= frame) & (F.col("discovery_rate") < rate))


def saturation_state(flags: DataFrame, frame: int = SATURATION_WINDOW, rate: float = SATURATION_RATE) -> DataFrame:
    """Present state per crawl from its last ``frame`` rows only."""
    from pyspark.sql import Window

    w = Window.partitionBy("crawl_id").orderBy(F.col("ts").desc(), F.col("id").desc())
    tail = flags.select("crawl_id", "ts", "id", "is_new").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= frame)
    state = tail.groupBy("crawl_id").agg(F.count("*").alias("window_rows"), F.avg(F.col("is_new").cast("double")).alias("discovery_rate"))
    return state.withColumn("saturated", (F.col("window_rows") >= frame) & (F.col("discovery_rate") < rate))


def coverage_stats(flags: DataFrame) -> DataFrame:
    """Unique tuples, checks, discovery rate and saturation per crawl."""
    counts = flags.groupBy("crawl_id").agg(F.count_if("is_new").alias("unique_coverage"), F.count("*").alias("total_checked"))
    return counts.join(saturation_state(flags), "crawl_id").select(
        "crawl_id", "unique_coverage", "total_checked", F.round("discovery_rate", 4).alias("discovery_rate"), "saturated"
    )


#: Sketches of 2^12 registers: a standard error of 1.04 / sqrt(2^12), 1.6 percent; few keys are counted exactly.
SKETCH_BITS = 12


def key_sketch() -> Column:
    """Aggregate: a sketch of distinct coverage keys. Sketches of parts merge into the sketch of the whole."""
    return F.hll_sketch_agg(F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}), SKETCH_BITS)


def coverage_sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """One sketch of coverage keys per group of ``coverage_rows``."""
    return rows.groupBy(*by).agg(key_sketch().alias("keys"))


def sketch_estimate(sketches: DataFrame, by: list[str] = ["crawl_id"]) -> DataFrame:
    """Estimated number of distinct coverage keys per ``by``, over any number of stored sketches each."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("keys")).alias("coverage_estimate"))


# ---- Template statistics -----------------------------------------------


def posterior(flags: DataFrame) -> DataFrame:
    """hits, alpha and beta per template."""
    return flags.groupBy(urls.template(F.col("request_url")).alias("template")).agg(
        F.count("*").alias("hits"), (F.count_if("is_new") + 1).alias("alpha"), (F.count_if(~F.col("is_new")) + 1).alias("beta")
    )


def mutation_energy(post: DataFrame) -> DataFrame:
    """Candidate budget per template, 1 to 30.

    The share of a template only matters below one percent of all alphas; the
    total is a scalar subquery.
    """
    total = post.agg(F.sum("alpha").alias("total_alpha")).scalar()
    share = F.greatest(F.col("alpha") / total, F.lit(0.01))
    energy = F.floor(F.pow(F.lit(3.0), F.least("alpha", F.lit(5))) / share).cast("long")
    return post.withColumn("energy", F.greatest(F.lit(1), F.least(energy, F.lit(30))))


def template_lists(post: DataFrame, k: int = 20) -> DataFrame:
    """Top productive and top under-explored templates with hit rate."""
    def ranked(name: str, score: Column) -> DataFrame:
        return post.orderBy(score.desc(), "template").limit(k).select(
            F.lit(name).alias("list"), "template", "alpha", "beta",
            F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 3).alias("hit_rate"),
        )

    return ranked("productive", F.col("alpha")).unionByName(ranked("under_explored", F.col("beta") / F.col("alpha")))


def discovery_by(flags: DataFrame, column: str) -> DataFrame:
    """Requests, new coverage and rate per phase or module."""
    return flags.groupBy(column).agg(
        F.count("*").alias("requests"), F.count_if("is_new").alias("new_coverage"),
        F.round(F.avg(F.col("is_new").cast("double")), 4).alias("discovery_rate"),
    )


def phase_discovery(flags: DataFrame, found: DataFrame, phase: str = "source_module") -> DataFrame:
    """Adds the templates first seen in each phase and its insights."""
    first = flags.groupBy(urls.template(F.col("request_url")).alias("template")).agg(F.min_by(phase, F.struct("ts", "id")).alias(phase))
    templates = first.groupBy(phase).agg(F.count("*").alias("new_templates"))
    hints = found.groupBy(phase).agg(F.count("*").alias("new_insights"))
    zero = F.lit(0).cast("long")
    return (
        discovery_by(flags, phase).join(templates, phase, "left").join(hints, phase, "left")
        .withColumns({c: F.coalesce(c, zero) for c in ("new_templates", "new_insights")})
    )


def insight_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("insight_type").agg(F.count("*").alias("n"))


def auth_insights(found: DataFrame) -> DataFrame:
    return found.where(F.col("insight_type").isin("auth_boundary", "redirect_boundary"))


def method_hints(found: DataFrame) -> DataFrame:
    return found.where(F.col("insight_type") == "method_hint")


def template_representatives(endpoints: DataFrame, most: int) -> DataFrame:
    """First live endpoint of each template, at most ``most`` by arrival."""
    live = endpoints.where((F.col("status_code") > 0) & (F.col("status_code") < 400))
    first = live.groupBy(urls.template(F.col("url")).alias("template")).agg(F.min_by(F.struct("method", "url", "seq"), "seq").alias("f"))
    return first.select("template", "f.*").orderBy("seq").limit(most)
