"""Request flows and state transitions in arrival order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify, structure, urls
from ..functions.text import contains_any
from . import ordered

SESSION = ["crawl_id", "auth_role"]


def flow_steps(txn: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Each request with its flow number and step inside the session.

    A request continues the flow when it is a redirect, a POST answered 200
    or 302, or asks for the URL the previous response pointed to.
    """
    status = F.col("response_status")
    location = structure.header(F.col("response_headers"), "location")
    redirect = status.isin(classify.REDIRECTS)
    points_to = (
        F.when(redirect & (location != ""), urls.resolve(F.col("request_url"), location))
        .when(redirect, "").otherwise(F.coalesce(F.nullif("response_url_final", F.lit("")), F.col("request_url")))
    )
    slim = txn.select(
        *SESSION, "ts", "id", F.col("request_url").alias("url"), F.col("request_method").alias("method"), status.alias("status"),
        redirect.alias("redirect"), points_to.alias("target"),
    )
    rows = ordered.previous(ordered.with_position(slim, SESSION, ["ts", "id"]), SESSION, ["target"], block_rows)
    follows = F.col("redirect") | ((F.col("method") == "POST") & F.col("status").isin(200, 302)) | (
        (F.coalesce("prev_target", F.lit("")) != "") & (F.col("url") == F.col("prev_target"))
    )
    starts = (F.col("pos") == 1) | ~follows
    runs = ordered.run_start(rows, SESSION, starts, block_rows)
    return runs.withColumn("step", F.col("pos") - F.col("run") + 1).select(
        *SESSION, F.col("run").alias("flow"), "step", "id", "url", "method", "status"
    )


def flows(steps: DataFrame) -> DataFrame:
    """Flows of two or more steps with name and flags.

    The steps stay in the long table; one flow may be of any length, so only
    combinable flags are gathered here.
    """
    low = F.lower("url")
    words = sorted({w for _, ws in classify.FLOW_NAMES for w in ws})
    has = {w: F.bool_or(low.contains(w)).alias(f"_{w}") for w in words}
    posts = (F.col("method") == "POST") & contains_any(low, classify.SIDE_EFFECT_WORDS)
    rows = steps.groupBy(*SESSION, "flow").agg(
        F.count("*").alias("steps"), F.bool_or(posts).alias("has_side_effects"), *has.values()
    ).where("steps >= 2")

    def any_word(ws) -> Column:
        out = F.lit(False)
        for w in ws:
            out = out | F.col(f"_{w}")
        return out

    return rows.select(
        *SESSION, "flow", "steps", classify.flow_name(any_word, F.col("steps")).alias("name"),
        F.col("_login").alias("requires_credentials"), "has_side_effects",
    )


def state_transitions(txn: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Consecutive responses of a crawl whose auth level differs."""
    cookie = structure.header(F.col("response_headers"), "set-cookie")
    slim = txn.select(
        "crawl_id", "ts", "id", F.col("request_url").alias("trigger_url"), F.upper("request_method").alias("trigger_method"),
        F.col("response_status").alias("trigger_status"), classify.auth_level(F.col("response_body")).alias("state"),
        F.array_join(F.transform(classify.cookie_pairs(cookie), lambda c: c["name"]), ",").alias("set_cookies"),
    )
    rows = ordered.previous(ordered.with_position(slim, ["crawl_id"], ["ts", "id"]), ["crawl_id"], ["state"], block_rows)
    return rows.where(F.col("prev_state").isNotNull() & (F.col("prev_state") != F.col("state"))).select(
        "crawl_id", "id", F.col("prev_state").alias("from_state"), F.col("state").alias("to_state"),
        "trigger_url", "trigger_method", "trigger_status", "set_cookies",
    )


def gained_endpoints(pairs: DataFrame, transitions: DataFrame) -> DataFrame:
    """Endpoints the later state has and the earlier one lacks, per state pair.

    ``pairs``: distinct (state, url). Only the distinct state pairs are joined.
    """
    moves = transitions.select("from_state", "to_state").distinct()
    after = moves.join(pairs.withColumnRenamed("state", "to_state"), "to_state")
    before = pairs.withColumnRenamed("state", "from_state")
    gained = after.join(before, ["from_state", "url"], "left_anti").groupBy("from_state", "to_state").agg(F.count("*").alias("new_endpoints"))
    return moves.join(gained, ["from_state", "to_state"], "left").withColumn("new_endpoints", F.coalesce("new_endpoints", F.lit(0).cast("long")))


def unchanged_streaks(txn: DataFrame, least: int, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Runs of ``least`` or more equal responses in a row on one endpoint."""
    slim = txn.select(F.col("request_url").alias("url"), "ts", "id", F.concat_ws("|", "response_status", "content_hash").alias("answer"))
    rows = ordered.with_position(slim, ["url"], ["ts", "id"])
    return ordered.streaks(rows, ["url"], "answer", block_rows).where(F.col("length") >= least)


def miss_streaks(txn: DataFrame, least: int, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Runs of ``least`` or more uninteresting responses in a row on one host."""
    miss = ~F.col("page_type").isin("real_content", "auth_required")
    slim = txn.select(urls.host(F.col("request_url")).alias("host"), "ts", "id", miss.alias("miss"))
    rows = ordered.with_position(slim, ["host"], ["ts", "id"])
    return ordered.streaks(rows, ["host"], "miss", block_rows).where("miss").where(F.col("length") >= least)


def ok_streaks(txn: DataFrame, block_rows: int = ordered.BLOCK_ROWS) -> DataFrame:
    """Runs of consecutive answers other than 429 per domain."""
    ok = F.col("response_status") != 429
    slim = txn.select(urls.authority(F.col("request_url")).alias("domain"), "ts", "id", ok.alias("ok"))
    rows = ordered.with_position(slim, ["domain"], ["ts", "id"])
    return ordered.streaks(rows, ["domain"], "ok", block_rows).where("ok").select("domain", "run", "length")
