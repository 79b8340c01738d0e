"""Passively collected URLs: filters, parameters and the path-tree collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import urls


def parameter_types(samples: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """integer, boolean or string from all non-empty samples of a parameter."""
    v = F.col(value)
    filled = v != ""
    return samples.groupBy(*keys).agg(
        F.when(F.coalesce(F.bool_and(F.when(filled, v.rlike("^[0-9]+$"))), F.lit(True)), "integer")
        .when(F.coalesce(F.bool_and(F.when(filled, v.rlike("(?i)^(true|false|0|1)$"))), F.lit(True)), "boolean")
        .otherwise("string")
        .alias("param_type")
    )


# ---- Path-tree collapse ------------------------------------------------

COLLAPSE_CHILDREN = 5


def path_entries(feeds: DataFrame, target_host: str) -> tuple[DataFrame, DataFrame]:
    """(entries, parameters) of the useful in-scope URLs.

    An entry is a distinct host and normalised path with its first URL, tag,
    and first non-empty status and mime. Parameters come from every URL.
    """
    from . import filters

    url = F.col("url")
    rows = feeds.where(filters.is_useful(url) & filters.in_scope(url, target_host))
    rows = rows.withColumns({"host": urls.host(url), "key": F.array_join(urls.passive_segments(url), "/")})
    entries = rows.groupBy("host", "key").agg(
        F.min("seq").alias("seq"), F.min_by(F.struct("url", "tag"), "seq").alias("f"),
        F.coalesce(F.min_by("status", F.when(F.col("status") != "", F.col("seq"))), F.lit("")).alias("status"),
        F.coalesce(F.min_by("mime", F.when(F.col("mime") != "", F.col("seq"))), F.lit("")).alias("mime"),
    ).select("host", "key", "seq", "f.*", "status", "mime")
    pairs = rows.select("host", "key", F.explode(urls.query_pairs(url, keep_blank=True)).alias("p"))
    params = pairs.select("host", "key", F.col("p.name").alias("name"), F.col("p.value").alias("value")).distinct()
    return entries, params


def _prefixes(entries: DataFrame) -> DataFrame:
    """(entry, prefix) for the host root and every ancestor; depth counts segments."""
    segs = F.when(F.col("key") == "", F.array().cast("array<string>")).otherwise(F.split("key", "/"))
    rows = entries.withColumn("_segs", segs).withColumn("depth", F.explode(F.sequence(F.lit(0), F.size("_segs"))))
    return rows.select(
        *entries.columns, "depth", F.size("_segs").alias("length"), F.array_join(F.slice("_segs", 1, F.col("depth")), "/").alias("prefix"),
        F.get("_segs", F.col("depth")).alias("child"),
    )


def collapse_paths(entries: DataFrame, threshold: int = COLLAPSE_CHILDREN) -> DataFrame:
    """Entries that stay when crowded directories shrink to one member.

    The shallowest ancestor with more than ``threshold`` children takes in all
    entries below it; of these the earliest leads to the one kept, namely the
    shortest entry on its own path. Elsewhere only leaves stay.
    """
    slim = entries.select("host", "key", "seq")
    spread = _prefixes(slim)
    inner = spread.where(F.col("child").isNotNull()).groupBy("host", "prefix", "child").agg(F.count("*").alias("_n"))
    kids = inner.groupBy("host", "prefix").agg(F.count("*").alias("children"))
    heavy = kids.where(F.col("children") > threshold).select("host", "prefix")
    crowded = spread.join(heavy, ["host", "prefix"], "left_semi")
    top = crowded.groupBy("host", "key", "seq").agg(F.min_by("prefix", "depth").alias("node"), F.min("depth").alias("node_depth"))
    # one leader per crowded node, then the shortest entry on the leader's path
    leader = top.groupBy("host", "node").agg(F.min_by(F.struct("key", "node_depth"), "seq").alias("f")).select("host", "node", "f.*")
    steps = _prefixes(leader.select("host", "node", "node_depth", "key")).where(F.col("depth") >= F.col("node_depth"))
    steps = steps.select("host", "node", "depth", F.col("prefix").alias("key"))
    on_path = steps.join(slim.select("host", "key"), ["host", "key"])
    kept = on_path.groupBy("host", "node").agg(F.min_by("key", "depth").alias("key")).select("host", "key")
    leaves = slim.select("host", "key").join(top.select("host", "key"), ["host", "key"], "left_anti")
    leaves = leaves.join(kids.select("host", F.col("prefix").alias("key")), ["host", "key"], "left_anti")
    return entries.join(kept.unionByName(leaves), ["host", "key"], "left_semi")


def collapsed_endpoints(feeds: DataFrame, target_host: str, samples: int = 3) -> tuple[DataFrame, DataFrame]:
    """(kept entries, typed parameters) of passive feeds; ``samples`` values are shown per parameter."""
    from pyspark.sql import Window

    entries, params = path_entries(feeds, target_host)
    kept = collapse_paths(entries)
    mine = params.join(kept.select("host", "key"), ["host", "key"], "left_semi")
    kinds = parameter_types(mine, ["host", "key", "name"])
    w = Window.partitionBy("host", "key", "name").orderBy("value")
    shown = mine.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= samples)
    shown = shown.groupBy("host", "key", "name").agg(F.array_sort(F.collect_list("value")).alias("sample_values"))
    return kept, kinds.join(shown, ["host", "key", "name"])


def sitemap(endpoints: DataFrame) -> DataFrame:
    """Endpoint count of each host and path prefix, own and below.

    Prefixes are opened on distinct paths with counts, not on raw rows.
    """
    url = F.col("url")
    host = F.coalesce(F.nullif(urls.host(url), F.lit("")), F.lit("unknown"))
    paths = endpoints.groupBy(host.alias("host"), F.array_join(urls.segments(url), "/").alias("key")).agg(F.count("*").alias("n"))
    spread = _prefixes(paths)
    own = F.when(F.col("depth") == F.col("length"), F.col("n")).otherwise(0)
    return spread.groupBy("host", "prefix", "depth").agg(F.sum(own).alias("own"), F.sum("n").alias("subtree"))
