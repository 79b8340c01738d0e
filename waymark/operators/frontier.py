"""Request frontier: dedup, caps, priorities, merges, splits, audits."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions import classify, urls
from ..functions.text import contains_any
from . import filters

COLLAPSE_LINKS = 5


def first_arrivals(rows: DataFrame, key: str, order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Id of the first row per key; a combinable minimum."""
    return rows.groupBy(key).agg(F.min_by("id", F.struct(*order)).alias("id"))


def template_cap(queue: DataFrame, rules: Sequence[tuple[str, int]], order: str = "seq") -> DataFrame:
    """First ``cap`` requests per template for templates a rule matches.

    A rule is an exact template, a ``prefix*`` or a substring; the first rule
    wins. Only matched templates are ranked, and the rank is cut at the
    largest cap, so at most that many rows per task leave the map side.
    """
    rows = queue.withColumn("template", urls.template(F.col("url")))
    t = F.col("template")

    def matches(pattern: str) -> Column:
        if pattern.endswith("*") and len(pattern) > 1:
            return (t == pattern) | t.startswith(pattern[:-1])
        return t.contains(pattern)

    cap = F.coalesce(*[F.when(matches(p), F.lit(n)) for p, n in rules])
    rows = rows.withColumn("cap", cap)
    most = max(n for _, n in rules)
    w = Window.partitionBy("template").orderBy(order)
    capped = rows.where("cap IS NOT NULL").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    capped = capped.where(F.col("rn") <= F.col("cap")).drop("rn")
    return rows.where("cap IS NULL").unionByName(capped).drop("cap")


def partial_order_reduction(links: DataFrame, threshold: int = COLLAPSE_LINKS) -> DataFrame:
    """Marks links that share a prefix on a page more than ``threshold`` times.

    ``links``: page, depth, url, seq. The first such link per depth and prefix
    keeps its score, later ones get the lowest priority.
    """
    prefix = F.concat(F.lit("/"), F.coalesce(F.get(F.split(urls.path(F.col("url")), "/"), F.lit(1)), F.lit("")))
    rows = links.withColumn("prefix", prefix)
    crowded = rows.groupBy("page", "prefix").agg(F.count("*").alias("same_prefix"))
    crowded = crowded.where(F.col("same_prefix") > threshold).select("page", "prefix", F.lit(True).alias("crowded"))
    rows = rows.join(crowded, ["page", "prefix"], "left")
    leaders = rows.where("crowded").groupBy("depth", "prefix").agg(F.min("seq").alias("leader"))
    rows = rows.join(leaders, ["depth", "prefix"], "left")
    kind = F.when(F.col("crowded").isNull(), "by_depth").when(F.col("seq") == F.col("leader"), "scored").otherwise("lowest")
    return rows.withColumn("priority_class", kind).drop("crowded", "leader")


def boost(queue: DataFrame, patterns: Sequence[str], amount: int) -> DataFrame:
    """Adds ``amount`` to the priority where any focus pattern occurs."""
    hit = contains_any(F.col("url"), patterns)
    return queue.withColumn("priority", F.when(hit, F.col("priority") + amount).otherwise(F.col("priority")))


def reprioritise(queue: DataFrame, rules: Sequence[tuple[str, int]]) -> DataFrame:
    """Sets the priority of the first matching substring rule."""
    new = F.coalesce(*[F.when(F.col("url").contains(p), F.lit(v)) for p, v in rules], F.col("priority"))
    return queue.withColumn("priority", new)


@F.pandas_udf(T.DoubleType())
def beta_quantile(alpha: pd.Series, beta: pd.Series, share: pd.Series) -> pd.Series:
    """Inverse of the Beta distribution (parameters of at least 1), for a whole batch on one grid per row."""
    import numpy as np

    a, b, u = (x.to_numpy(dtype=float)[:, None] for x in (alpha, beta, share))
    mean = a / (a + b)
    width = 9 * np.sqrt(mean * (1 - mean) / (a + b + 1))
    low, high = np.maximum(mean - width, 0), np.minimum(mean + width, 1)
    x = low + (high - low) * (np.arange(400) + 0.5) / 400
    log = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
    density = np.exp(log - log.max(axis=1, keepdims=True))
    below = np.cumsum(density, axis=1) - density
    total = below[:, -1:] + density[:, -1:]
    at = np.maximum((below <= u * total).sum(axis=1) - 1, 0)[:, None]
    inside = (u * total - np.take_along_axis(below, at, 1)) / np.take_along_axis(density, at, 1)
    step = (high - low) / 400
    return pd.Series((low + step * (at + np.clip(inside, 0, 1)))[:, 0])


def priorities(
    queue: DataFrame, post: DataFrame, module_rates: DataFrame, mode: str = "mean", seed: int = 0
) -> DataFrame:
    """Heuristic score plus ten times the template posterior, at least 1.

    ``mode="mean"`` takes alpha / (alpha + beta), ``"low"`` and ``"high"`` the
    bounds 0 and 1; ``"sample"`` draws from the
    Beta distribution: its quantile at a share hashed from the row and the seed.
    """
    rows = queue.withColumn("template", urls.template(F.col("url"))).join(post, "template", "left")
    rates = module_rates.select("source_module", F.col("discovery_rate").alias("rate"))
    rows = rows.join(rates, "source_module", "left")
    hits = F.coalesce("hits", F.lit(0))
    alpha, beta = F.coalesce("alpha", F.lit(1)), F.coalesce("beta", F.lit(1))
    rarity = F.when(hits == 0, 8.0).when(hits < 3, 4.0).otherwise(-F.least(hits, F.lit(10)).cast("double"))
    fast = F.when(F.coalesce("rate", F.lit(0.0)) > 0.3, 3.0).otherwise(0.0)
    draw = {"low": F.lit(0.0), "high": F.lit(1.0)}.get(mode, alpha / (alpha + beta))
    if mode == "sample":
        share = F.xxhash64("seq", F.lit(seed)).bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
        draw = beta_quantile(alpha.cast("double"), beta.cast("double"), share)
    score = 10.0 + rarity + classify.security_weight(F.col("url")) - F.col("depth") * 0.5 + fast + draw * 10.0
    value = F.greatest(F.lit(1), F.when(score >= 0, F.floor(score)).otherwise(F.ceil(score)).cast("int"))
    return rows.withColumn("priority", value).select(*queue.columns, "template")


def next_requests(queue: DataFrame, target_host: str, max_depth: int, k: int) -> DataFrame:
    """In-scope requests within depth, highest priority first."""
    ok = filters.in_scope(F.col("url"), target_host) & (F.col("depth") <= max_depth)
    return queue.where(ok).orderBy(F.col("priority").desc(), "seq").limit(k)


def queue_page(queue: DataFrame, offset: int, limit: int) -> DataFrame:
    return queue.orderBy(F.col("priority").desc(), "seq").offset(offset).limit(limit)


def queue_stats(queue: DataFrame) -> DataFrame:
    """Counts by source module and by priority band."""
    band = F.when(F.col("priority") >= 20, "high (20+)").when(F.col("priority") >= 10, "medium (10-19)").otherwise("low (0-9)")
    source = F.coalesce(F.nullif("source_module", F.lit("")), F.lit("unknown"))
    cells = F.explode(F.array(F.struct(F.lit("source").alias("kind"), source.alias("key")), F.struct(F.lit("priority").alias("kind"), band.alias("key"))))
    return queue.select(cells.alias("c")).groupBy("c.kind", "c.key").agg(F.count("*").alias("n"))


# ---- Merge -------------------------------------------------------------


def merge_preview(queue: DataFrame, strategy: str, url_contains: str = "", sample_size: int = 3) -> DataFrame:
    """Per template: requests now and after the merge."""
    rows = queue.where(F.col("url").contains(url_contains)) if url_contains else queue
    groups = rows.groupBy(urls.template(F.col("url")).alias("template")).agg(
        F.count("*").alias("requests"), F.array_sort(F.collect_set(F.upper("method"))).alias("methods")
    )
    n = F.col("requests")
    after = {"combine_params": F.size("methods").cast("long"), "sample_template": F.least(n, F.lit(sample_size))}.get(strategy, F.lit(1).cast("long"))
    return groups.withColumn("after", F.when(n < 2, 1).otherwise(after))


def merge_reduction(preview: DataFrame) -> DataFrame:
    pct = F.coalesce(F.try_divide((F.sum("requests") - F.sum("after")) * 100.0, F.sum("requests")), F.lit(0.0))
    return preview.agg(F.sum("requests").alias("total_before"), F.sum("after").alias("total_after"), F.round(pct, 1).alias("reduction_pct"))


def merge_queue(queue: DataFrame, strategy: str, sample_size: int = 3) -> DataFrame:
    """The queue after a merge; templates with one request stay as they are."""
    rows = queue.withColumn("template", urls.template(F.col("url")))
    cols = ["template", "url", "method", "priority", "depth", "source_module", "auth_role"]
    if strategy == "batch_endpoints":
        best = rows.groupBy("template").agg(F.max_by(F.struct(*cols[1:]), F.struct("priority", -F.col("seq"))).alias("r"))
        return best.select("template", "r.*")
    if strategy == "sample_template":
        w = Window.partitionBy("template").orderBy(F.col("priority").desc(), "seq")
        return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= sample_size).select(*cols)
    rank = F.struct(-F.col("priority"), "seq")
    sizes = rows.groupBy("template").agg(F.count("*").alias("requests"))
    base = rows.groupBy("template", F.upper("method").alias("verb")).agg(
        F.min_by(F.struct("url", "auth_role", "method", "source_module"), rank).alias("b"), F.max("priority").alias("priority"), F.min("depth").alias("depth")
    )
    pairs = rows.select(
        "template", F.upper("method").alias("verb"), rank.alias("rank"), F.posexplode(urls.query_pairs(F.col("url"), keep_blank=True)).alias("i", "p")
    )
    pairs = pairs.groupBy("template", "verb", F.col("p.name").alias("name")).agg(F.min(F.struct("rank", "i", F.col("p.value").alias("value"))).alias("f"))
    # distinct names of one template: the names are part of the template itself
    item = F.struct(F.col("f.rank").alias("rank"), F.col("f.i").alias("i"), "name", F.col("f.value").alias("value"))
    queries = pairs.groupBy("template", "verb").agg(F.sort_array(F.collect_list(item)).alias("items"))
    text = F.array_join(F.transform("items", lambda x: F.concat(F.url_encode(x["name"]), F.lit("="), F.url_encode(x["value"]))), "&")
    out = base.join(sizes, "template").join(queries, ["template", "verb"], "left")
    bare = F.regexp_extract(F.col("b.url"), r"^([^?#]*)", 1)
    merged = F.concat(bare, F.when(F.size("items") > 0, F.concat(F.lit("?"), text)).otherwise(""))
    single = F.col("requests") < 2
    return out.select(
        "template", F.when(single, F.col("b.url")).otherwise(merged).alias("url"), F.col("verb").alias("method"), "priority", "depth",
        F.when(single, F.col("b.source_module")).otherwise("orchestration:merge").alias("source_module"), F.col("b.auth_role").alias("auth_role"),
    )


def split(queue: DataFrame, patterns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(removed, kept) by substring patterns."""
    hit = contains_any(F.col("url"), patterns)
    return queue.where(hit), queue.where(~hit)


def injection_audit(wanted: DataFrame, seen: DataFrame, target_host: str, max_depth: int) -> DataFrame:
    """Each URL with its outcome: rejected_depth, _scope, _duplicate or accepted.

    ``wanted``: url, depth, seq; ``seen``: url. The first of equal URLs counts.
    """
    norm = urls.normalize(F.col("url"))
    known = seen.select(norm.alias("norm")).distinct().withColumn("known", F.lit(True))
    early = F.when(F.col("depth") > max_depth, "rejected_depth").when(~filters.in_scope(F.col("url"), target_host), "rejected_scope")
    rows = wanted.withColumns({"norm": norm, "early": early}).join(known, "norm", "left")
    firsts = rows.where("early IS NULL").groupBy("norm").agg(F.min("seq").alias("first_seq"))
    rows = rows.join(firsts, "norm", "left")
    dup = F.coalesce("known", F.lit(False)) | (F.col("seq") > F.col("first_seq"))
    return rows.withColumn("outcome", F.coalesce("early", F.when(dup, "rejected_duplicate"), F.lit("accepted"))).select("seq", "url", "outcome")


# ---- Recrawl and gaps --------------------------------------------------


def recrawl_targets(endpoints: DataFrame, boundary_urls: DataFrame, post: DataFrame, k: int) -> DataFrame:
    """Top endpoints by boundary, rarity and depth score."""
    bounded = boundary_urls.select("url").distinct().withColumn("bounded", F.lit(10.0))
    rows = endpoints.withColumn("template", urls.template(F.col("url"))).join(bounded, "url", "left")
    rows = rows.join(post.select("template", "hits"), "template", "left")
    hits = F.coalesce("hits", F.lit(0))
    rarity = F.when(hits == 0, 5.0).when(hits < 3, 2.0).otherwise(0.0)
    score = F.coalesce("bounded", F.lit(0.0)) + rarity - F.coalesce("depth", F.lit(0)) * 0.3
    return rows.withColumn("score", F.round(score, 6)).orderBy(F.col("score").desc(), "seq").limit(k)


def endpoint_clusters(endpoints: DataFrame, params: DataFrame, boundaries: DataFrame, post: DataFrame, samples: int = 5) -> DataFrame:
    """Per template: count, methods, parameter names, samples, boundary, posterior."""
    template = urls.template(F.col("url")).alias("template")
    rows = endpoints.select(template, "method", "url", "seq")
    base = rows.groupBy("template").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("method")).alias("methods"))
    w = Window.partitionBy("template").orderBy("seq")
    picked = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= samples)
    picked = picked.groupBy("template").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "url"))), lambda s: s["url"]).alias("sample_urls"))
    names = params.select(template, "name").distinct().groupBy("template").agg(F.array_sort(F.collect_set("name")).alias("param_names"))
    bounded = boundaries.select(template).distinct().withColumn("has_auth_boundary", F.lit(True))
    out = base.join(picked, "template").join(names, "template", "left").join(bounded, "template", "left")
    out = out.join(post.select("template", "alpha", "beta"), "template", "left")
    one = F.lit(1).cast("long")
    return out.withColumns({
        "param_names": F.coalesce("param_names", F.array().cast("array<string>")),
        "has_auth_boundary": F.coalesce("has_auth_boundary", F.lit(False)),
        "alpha": F.coalesce("alpha", one), "beta": F.coalesce("beta", one),
    })


def coverage_gaps(hints: DataFrame, unspidered: DataFrame, boundaries: DataFrame, post: DataFrame, roles: Sequence[str], k: int | None = None) -> DataFrame:
    """Untested methods, unspidered endpoints, unretried boundaries, thin templates; the first ``k`` when given."""
    def gap(rows: DataFrame, rank: int, kind: str, url: Column, detail: Column) -> DataFrame:
        return rows.select(F.lit(rank).alias("rank"), F.lit(kind).alias("gap_type"), url.alias("url"), detail.alias("detail"))

    c = F.col
    out = gap(hints, 1, "untested_method", c("request_url"), c("detail"))
    out = out.unionByName(gap(unspidered, 2, "unspidered", c("url"), F.concat_ws(" ", "method", "url", F.lit("discovered by"), "source_module", F.lit("but never spidered"))))
    if roles:
        fresh = boundaries.where(F.coalesce("auth_status", F.lit(0)) == 0)
        out = out.unionByName(gap(fresh, 3, "auth_boundary", c("url"), F.concat(F.lit("Auth boundary ("), "boundary_type", F.lit(") not re-tested with credentials"))))
    thin = post.where((c("beta") > 5) & (c("alpha") <= 1))
    tried = F.format_string("Template tried %d times but only %d new coverage hits", c("alpha") + c("beta") - 2, c("alpha") - 1)
    out = out.unionByName(gap(thin, 4, "low_coverage", c("template"), tried))
    return out if k is None else out.orderBy("rank", "url", "detail").limit(k)
