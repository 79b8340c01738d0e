"""Row filters: transactions, entities, scope, noise, junk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify, urls
from ..functions.text import any_of

# URLs that are marketing, static files or tracking.
NOISE_PATTERNS = [
    r".*/blog/.*",
    r".*/careers/.*",
    r".*/press/.*",
    r".*/customer-stories/.*",
    r".*/events/.*",
    r".*/newsletter/.*",
    r".*/podcast/.*",
    r".*/webinar/.*",
    r".*/cdn-cgi/.*",
    r".*/static/.*",
    r".*/assets/.*",
    r".*/_next/static/.*",
    r".*/_next/image/.*",
    r".*/wp-content/uploads/.*",
    r".*\?utm_.*",
    r".*\?fbclid=.*",
    r".*\?gclid=.*",
]
# What makes a passively collected URL junk.
MAX_URL_LENGTH = 250
MAX_PERCENT_RATIO = 0.15
STATIC_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".webp", ".bmp",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".css", ".less", ".scss",
    ".mp4", ".mp3", ".avi", ".mov", ".flv", ".wmv",
    ".pdf", ".zip", ".tar", ".gz", ".rar", ".7z",
    ".map", ".wasm",
]


def by_host(rows: DataFrame, url: str) -> DataFrame:
    """Adds the host column used for partition pruning."""
    return rows.withColumn("host", urls.host(F.col(url)))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


# ---- Transactions ------------------------------------------------------


def transactions_where(
    txn: DataFrame, *, url_contains: str = "", source_module: str = "", page_type: str = "",
    content_type_contains: str = "", status_range: tuple[int, int] | None = None,
) -> DataFrame:
    """AND of the given predicates; each reaches the Parquet scan."""
    c = F.col
    conditions = []
    if url_contains:
        conditions.append(c("request_url").contains(url_contains))
    if source_module:
        conditions.append(c("source_module") == source_module)
    if page_type:
        conditions.append(c("page_type") == page_type)
    if content_type_contains:
        conditions.append(c("response_content_type").contains(content_type_contains))
    if status_range:
        conditions.append(c("response_status").between(*status_range))
    return txn.where(_all(conditions))


def page_of(rows: DataFrame, order: Sequence, offset: int, limit: int) -> DataFrame:
    """One page; planned as top-k, not as a full sort."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def transaction_summaries(txn: DataFrame) -> DataFrame:
    return txn.select(
        "id", "ts", "request_method", "request_url", "response_status", "response_content_type",
        "source_module", "depth", "page_type",
    )


def transaction_details(txn: DataFrame) -> DataFrame:
    return txn.select(
        "id", "request_method", "request_url", "response_status", "response_headers", "content_hash",
        F.octet_length("request_body").alias("request_body_size"),
        F.octet_length("response_body").alias("response_body_size"),
    )


# ---- Entities ----------------------------------------------------------


def endpoints_where(
    endpoints: DataFrame, *, tag: str | None = None, page_type: str | None = None, method: str | None = None,
    requires_auth: bool | None = None, has_params: bool | None = None, source_module: str | None = None,
    url_contains: str | None = None,
) -> DataFrame:
    c = F.col
    conditions = []
    if tag:
        conditions.append(F.array_contains("tags", tag))
    if page_type:
        conditions.append(c("page_type") == page_type)
    if method:
        conditions.append(F.upper("method") == method.upper())
    if requires_auth is not None:
        conditions.append(c("requires_auth") == requires_auth)
    if has_params is not None:
        conditions.append((c("param_count") > 0) == has_params)
    if source_module:
        conditions.append(c("source_module") == source_module)
    if url_contains:
        conditions.append(F.lower("url").contains(url_contains.lower()))
    return endpoints.where(_all(conditions))


def vectors_where(
    vectors: DataFrame, *, risk: str | None = None, location: str | None = None, reflected: bool | None = None,
    url_contains: str | None = None, source_module: str | None = None,
) -> DataFrame:
    c = F.col
    conditions = []
    if risk:
        conditions.append(F.array_contains("risk_indicators", risk))
    if location:
        conditions.append(c("location") == location)
    if reflected is not None:
        conditions.append(c("is_reflected") == reflected)
    if url_contains:
        conditions.append(F.lower("endpoint_url").contains(url_contains.lower()))
    if source_module:
        conditions.append(c("source_module") == source_module)
    return vectors.where(_all(conditions))


def tech_where(tech: DataFrame, category: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    rows = tech if category is None else tech.where(F.col("category") == category)
    return rows.where(F.col("confidence") >= min_confidence) if min_confidence > 0 else rows


def with_any_risk(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.size("risk_indicators") > 0)


def search_endpoints(endpoints: DataFrame, text: str = "", method: str = "", sort: str = "url") -> DataFrame:
    """URL or any tag contains the text; sorted by url, method, status or params."""
    low = text.lower()
    rows = endpoints
    if low:
        rows = rows.where(F.lower("url").contains(low) | F.exists("tags", lambda t: F.lower(t).contains(low)))
    if method:
        rows = rows.where(F.col("method") == method)
    key = {
        "url": F.col("url"), "method": F.col("method"),
        "status": F.coalesce("status_code", F.lit(0)), "params": F.col("param_count").desc(),
    }[sort]
    return rows.orderBy(key, "url", "method")


def search_vectors(vectors: DataFrame, text: str = "", reflected_only: bool = False, location: str = "") -> DataFrame:
    """Matching vectors, the one with most risk tags first."""
    low = text.lower()
    rows = vectors
    if low:
        rows = rows.where(
            F.lower("name").contains(low) | F.lower("endpoint_url").contains(low)
            | F.exists("risk_indicators", lambda r: F.lower(r).contains(low))
        )
    if reflected_only:
        rows = rows.where("is_reflected")
    if location:
        rows = rows.where(F.col("location") == location)
    return rows.orderBy(F.size("risk_indicators").desc(), "endpoint_url", "name", "location")


# ---- Scope, noise, junk ------------------------------------------------


def in_scope(url: Column, target_host: str, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Target host or a subdomain; excludes win, then any include must match."""
    host = urls.host(url)
    inside = (host == target_host) | host.endswith("." + target_host)
    if exclude:
        inside = inside & ~any_of(url, exclude)
    if include:
        inside = inside & any_of(url, include)
    return inside


def is_noise(url: Column, extra: Sequence[str] = ()) -> Column:
    return any_of(url, [*NOISE_PATTERNS, *extra])


def is_useful(url: Column) -> Column:
    """False for over-long, over-encoded, static or control-character URLs."""
    percents = F.length(url) - F.length(F.replace(url, F.lit("%"), F.lit("")))
    encoded = (percents > 3) & (percents / F.length(url) > MAX_PERCENT_RATIO)
    raw = urls.path(url)
    static = "(?i)(?:" + "|".join(e.replace(".", r"\.") for e in STATIC_EXTENSIONS) + ")/*$"
    plain = urls.decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    blank = (plain == "") | (plain == "/")
    return (
        (F.length(url) <= MAX_URL_LENGTH) & ~encoded & ~raw.rlike(static)
        & (blank | (~plain.rlike(r"[\x00-\x1f]") & ~plain.contains("  ")))
    )


def unsafe_requests(requests: DataFrame) -> DataFrame:
    """Requests that need approval, with the kind of approval."""
    kind = classify.unsafe_request(F.col("method"), F.col("source_module"))
    return requests.withColumn("approval", kind).where("approval IS NOT NULL")
