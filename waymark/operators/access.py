"""Access boundaries, 404 baselines, role differences, observed profiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify, structure, urls

LENGTH_TOLERANCE = 0.10
CATCH_ALL_MARGIN = 0.2

# Path words of a login page.
LOGIN_PATH_WORDS = ["login", "signin", "sign-in", "auth", "sso", "cas", "oauth", "saml"]
# Headers that differ without meaning.
NOISE_HEADERS = ["date", "age", "x-request-id", "x-trace-id", "cf-ray"]
# Suffixes of backup copies.
BACKUP_SUFFIXES = [".bak", ".old", ".orig", ".save", ".swp", "~", ".backup", ".copy"]


# ---- 404 baselines -----------------------------------------------------


def learn_baselines(probes: DataFrame) -> DataFrame:
    """Per host: do unknown paths all answer 200 with one near-constant page?

    ``probes``: host, status, length, hash.
    """
    stats = probes.groupBy("host").agg(
        F.count("*").alias("probes"), F.bool_and(F.col("status") == 200).alias("all_200"),
        (F.min("hash") == F.max("hash")).alias("same_page"), F.avg("length").alias("mean_length"),
        F.max("length").alias("longest"), F.min("length").alias("shortest"),
    )
    mean = F.col("mean_length")
    close = (mean > 0) & ((F.col("longest") - mean) <= LENGTH_TOLERANCE * mean) & ((mean - F.col("shortest")) <= LENGTH_TOLERANCE * mean)
    custom = (F.col("probes") >= 2) & F.col("all_200") & F.col("same_page") & close
    return stats.select("host", "probes", "mean_length", custom.alias("has_custom_404"))


def length_bucket(length: str) -> Column:
    """Number of the geometric bucket of a length; neighbouring buckets differ by the tolerance."""
    return F.floor(F.log(F.col(length).cast("double")) / math.log1p(LENGTH_TOLERANCE)).cast("int")


def custom_404_ids(responses: DataFrame, probes: DataFrame, primary_host: str | None = None) -> DataFrame:
    """Ids of responses that look like their host's not-found page.

    ``responses``: id, host, status, length, hash. Hosts without a baseline
    use that of ``primary_host``. Two keyed semi joins. Lengths meet in buckets
    that each span the tolerance: of a bucket's baseline lengths only the ends
    matter, since those inside the row's own bucket are all near, of lower ones
    the largest is nearest and of higher ones the smallest. A row is compared
    with five buckets at most, however many lengths a host has.
    """
    known = probes.select("host").distinct().withColumn("has_own", F.lit(True))
    rows = responses.join(known, "host", "left")
    fallback = F.lit(primary_host) if primary_host else F.lit(None).cast("string")
    rows = rows.withColumn("baseline", F.when(F.col("has_own"), F.col("host")).otherwise(fallback))
    pages = probes.select(F.col("host").alias("baseline"), "hash").distinct()
    same = rows.join(pages, ["baseline", "hash"], "left_semi").select("id")
    own = length_bucket("length")
    lengths = probes.where("length > 0").groupBy(F.col("host").alias("baseline"), "status", own.alias("own")).agg(
        F.min("length").alias("least"), F.max("length").alias("most"))
    lengths = lengths.withColumn("bucket", F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: F.col("own") + d)))
    sized = rows.where("length > 0").withColumn("bucket", own)
    close = [F.abs(sized["length"] - lengths[c]) / lengths[c] <= LENGTH_TOLERANCE for c in ("least", "most")]
    keys = [sized[k] == lengths[k] for k in ("baseline", "status", "bucket")]
    near = sized.join(lengths, keys[0] & keys[1] & keys[2] & (close[0] | close[1]), "left_semi").select("id")
    return same.union(near).distinct()


def catch_all_hosts(probes: DataFrame, least: int = 3) -> DataFrame:
    """Hosts where at least ``least`` unknown paths all answer 200; mean size."""
    return probes.groupBy("host").agg(
        F.count("*").alias("probes"), F.bool_and(F.col("status") == 200).alias("ok"),
        F.floor(F.avg("length")).cast("long").alias("mean_length"),
    ).where((F.col("probes") >= least) & F.col("ok")).select("host", "mean_length")


def without_catch_all(responses: DataFrame, hosts: DataFrame) -> DataFrame:
    """Drops 200 responses within 20% of their host's catch-all page size."""
    rows = responses.join(hosts, "host", "left")
    mean = F.coalesce("mean_length", F.lit(0))
    swallowed = (F.col("status") == 200) & (mean > 0) & (F.abs(F.col("length") - mean) < mean * CATCH_ALL_MARGIN)
    return rows.where(~swallowed).drop("mean_length")


# ---- Boundaries --------------------------------------------------------


def boundary_sightings(txn: DataFrame) -> DataFrame:
    """401, 403 and redirects to a login path, one row each."""
    status = F.col("response_status")
    location = structure.header(F.col("response_headers"), "location")
    # one regex: each word by itself would look the header up again
    to_login = status.isin(classify.REDIRECTS) & F.lower(urls.path(location)).rlike("|".join(LOGIN_PATH_WORDS))
    kind = F.when(status == 403, "forbidden").when(status == 401, "unauthorized").when(to_login, "redirect_to_login")
    rows = txn.select(
        F.col("request_url").alias("url"), F.col("request_method").alias("method"), kind.alias("boundary_type"),
        status.alias("unauth_status"), F.lit(0).alias("auth_status"), F.lit("anonymous").alias("role"),
        status.alias("status"), F.struct("ts", "id").alias("seq"),
    )
    return rows.where("boundary_type IS NOT NULL")


def mixed_status_paths(txn: DataFrame) -> DataFrame:
    """Paths that answer both 200 and 401/403, with the first denied request."""
    status = F.col("response_status")
    denied = status.isin(401, 403)
    return txn.groupBy(urls.path(F.col("request_url")).alias("path")).agg(
        F.bool_or(denied).alias("denied"), F.bool_or(status == 200).alias("allowed"),
        F.min_by(F.struct(F.col("request_method").alias("method"), status.alias("status")), F.when(denied, F.struct("ts", "id"))).alias("f"),
    ).where("denied AND allowed").select(
        F.col("path").alias("url"), F.col("f.method").alias("method"), F.lit("idor_candidate").alias("boundary_type"),
        F.col("f.status").alias("unauth_status"), F.lit(200).alias("auth_status"),
    )


def role_statuses(txn: DataFrame, role: Column) -> DataFrame:
    """Last status per URL, method and role."""
    return txn.groupBy(F.col("request_url").alias("url"), F.col("request_method").alias("method"), role.alias("role")).agg(
        F.max_by("response_status", F.struct("ts", "id")).alias("status")
    )


def role_matrix(txn: DataFrame, role: Column) -> DataFrame:
    """URLs and methods where roles see different statuses."""
    per_role = role_statuses(txn, role)
    rows = per_role.groupBy("url", "method").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "status")))).alias("access_matrix"),
        F.min("status").alias("low"), F.max("status").alias("high"),
        F.max(F.when(F.col("role") == "anonymous", F.col("status"))).alias("anonymous"),
        F.max(F.when(F.col("role") != "anonymous", F.col("status"))).alias("named"),
    )
    return rows.where("low <> high").select(
        "url", "method", F.coalesce("anonymous", F.lit(0)).alias("unauth_status"),
        F.coalesce("named", F.lit(0)).alias("auth_status"), F.lit("role_difference").alias("boundary_type"), "access_matrix",
    )


def role_only_content(txn: DataFrame) -> DataFrame:
    """Successful responses under a role with content no earlier response had."""
    row = F.struct("id", "auth_role", "request_method", "request_url", "response_status")
    first = txn.groupBy("content_hash").agg(F.min_by(row, F.struct("ts", "id")).alias("f")).select("f.*")
    hits = first.where(F.col("response_status").between(200, 399) & (F.col("auth_role") != "anonymous"))
    return hits.select("id", "auth_role", "request_method", "request_url", F.concat(F.lit("auth:"), "auth_role").alias("tag"))


# ---- States ------------------------------------------------------------


def state_endpoints(txn: DataFrame, state: Column) -> DataFrame:
    """Distinct (state, url) of successful responses."""
    ok = txn.where(F.col("response_status").between(200, 399))
    return ok.select(state.alias("state"), F.col("request_url").alias("url")).distinct()


def state_only(pairs: DataFrame) -> DataFrame:
    """Endpoints of a named state that anonymous requests never reached."""
    anonymous = pairs.where(F.col("state") == "anonymous").select("url")
    return pairs.where(F.col("state") != "anonymous").join(anonymous, "url", "left_anti").select("state", "url")


def exclusive_to_state(pairs: DataFrame) -> DataFrame:
    """Endpoints held by exactly one state."""
    one = pairs.groupBy("url").agg(F.min("state").alias("state"), F.max("state").alias("other"))
    return one.where(F.col("state") == F.col("other")).select("state", "url")


def state_sizes(pairs: DataFrame) -> DataFrame:
    """Anonymous endpoint count, and state-only counts of the other states."""
    anonymous = pairs.where(F.col("state") == "anonymous").select("state", "url")
    return anonymous.unionByName(state_only(pairs)).groupBy("state").agg(F.count("*").alias("endpoints"))


def merge_states(states: DataFrame) -> DataFrame:
    """States with equal context and response structure become one."""
    return states.groupBy("context_id", "structure_hash").agg(F.min("id").alias("state_id"), F.count("*").alias("members"))


# ---- Differentials and exposure ----------------------------------------


def baseline_difference(probes: DataFrame, baselines: DataFrame) -> DataFrame:
    """Why a probe differs from its endpoint's baseline; empty when it does not.

    Both: endpoint, status, length, hash, words, headers (lower-case names).
    """
    p, b = probes.alias("p"), baselines.alias("b")
    rows = p.join(b, "endpoint")
    c = F.col
    length = F.abs(c("p.length") - c("b.length"))
    words = F.abs(c("p.words") - c("b.words"))
    fresh = F.array_sort(F.array_except(F.array_except("p.headers", "b.headers"), F.array(*[F.lit(h) for h in NOISE_HEADERS])))
    reason = (
        F.when(c("p.status") == 0, "")
        .when(F.floor(c("p.status") / 100) != F.floor(c("b.status") / 100), F.format_string("status_%d_to_%d", "b.status", "p.status"))
        .when(c("p.hash") == c("b.hash"), "")
        .when(length > F.greatest(c("b.length") * 0.05, F.lit(50)), F.format_string("length_diff_%d", length))
        .when(words > 3, F.format_string("word_diff_%d", words))
        .when(F.size(fresh) > 0, F.concat(F.lit("new_headers_"), F.array_join(fresh, ",")))
        .otherwise("")
    )
    return rows.select("p.id", "endpoint", reason.alias("reason")).withColumn("is_different", F.col("reason") != "")


def exposed_paths(txn: DataFrame, words: DataFrame, extensions: list[str]) -> DataFrame:
    """Recorded pages whose path is a wordlist entry, bare or with an extension.

    ``words`` holds one ``word`` per row; the extensions are appended to words
    without a dot before the join, which is keyed on the path.
    """
    suffixes = F.when(F.col("word").contains("."), F.array(F.lit(""))).otherwise(F.array(F.lit(""), *[F.lit(e) for e in extensions]))
    names = words.select(F.explode(suffixes).alias("ext"), "word").select(F.concat("word", "ext").alias("entry")).distinct()
    pages = txn.where(F.col("page_type").isin("real_content", "auth_required"))
    entry = F.regexp_replace(urls.path(F.col("request_url")), "^/|/$", "")
    pages = pages.select("request_url", "response_status", entry.alias("entry")).distinct()
    return pages.join(names, "entry").select("request_url", "response_status", "entry")


def backup_copies(txn: DataFrame, suffixes: list[str] = BACKUP_SUFFIXES) -> DataFrame:
    """Recorded paths that are another recorded file plus a backup suffix."""
    pattern = "(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"
    seen = txn.select(urls.host(F.col("request_url")).alias("host"), urls.path(F.col("request_url")).alias("path"))
    seen = seen.distinct()
    copies = seen.where(F.col("path").rlike(pattern)).select(
        "host", F.col("path").alias("copy"), F.regexp_replace("path", pattern, "").alias("path")
    )
    return copies.join(seen, ["host", "path"], "left_semi").select("host", F.col("path").alias("original"), "copy")


def observed_profile(txn: DataFrame) -> DataFrame:
    """Per URL: methods that did not answer 405, posted types that did not answer 415."""
    status = F.col("response_status")
    allow = F.nullif(structure.header(F.col("response_headers"), "allow"), F.lit(""))
    posted = F.when((F.col("request_method") == "POST") & (status != 415) & (status != 0) & (F.col("request_content_type") != ""), F.col("request_content_type"))
    return txn.groupBy(F.col("request_url").alias("url")).agg(
        F.array_sort(F.collect_set(F.when(~status.isin(405, 0), F.upper("request_method")))).alias("accepted_methods"),
        F.array_sort(F.collect_set(posted)).alias("accepted_content_types"),
        F.max_by(allow, F.when(allow.isNotNull(), F.struct("ts", "id"))).alias("allow_header"),
    )


def rate_limits(txn: DataFrame) -> DataFrame:
    """429 answers per domain, the worst first."""
    return txn.groupBy(urls.authority(F.col("request_url")).alias("domain")).agg(
        F.count_if(F.col("response_status") == 429).alias("backoffs"), F.count("*").alias("requests")
    ).orderBy(F.col("backoffs").desc(), "domain")
