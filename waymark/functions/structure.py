"""Hashes of content, headers and structure."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import digest

# Headers that make up the header signature.
SIGNATURE_HEADERS = [
    "server", "x-powered-by", "x-aspnet-version", "x-generator",
    "content-type", "x-frame-options", "x-content-type-options",
]
TAG_PATTERN = r"<([A-Za-z0-9_]+)([^>]*)>"


def header(headers: Column, name: str) -> Column:
    """Value of one header, name matched without case; empty when absent."""
    hits = F.map_filter(headers, lambda k, _: F.lower(k) == name)
    return F.coalesce(F.try_element_at(F.map_values(hits), F.lit(-1)), F.lit(""))


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def header_signature(headers: Column) -> Column:
    chosen = F.map_filter(headers, lambda k, _: F.lower(k).isin(SIGNATURE_HEADERS))
    pairs = F.transform(
        F.map_entries(chosen), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"])
    )
    return digest(F.array_join(F.array_sort(pairs), "|"), 12)


def html_hash(body: Column) -> Column:
    tags = F.regexp_extract_all(body, F.lit(TAG_PATTERN), 1)
    return digest(F.array_join(F.transform(tags, F.lower), ">"), 12)


def json_skeleton(body: Column) -> Column:
    """Key tree with value types, all numbers alike; null for bad JSON."""
    shape = F.schema_of_variant(F.try_parse_json(body))
    numeric = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+,[0-9]+\))"
    return F.regexp_replace(shape, rf"(^|: |<){numeric}(?=[,>]|$)", "$1num")


def json_hash(body: Column) -> Column:
    return F.coalesce(
        digest(json_skeleton(body), 12), digest(body, 12)
    )


def size_hash(body: Column) -> Column:
    bucket = F.floor(F.octet_length(body) / 1024).cast("long")
    return digest(F.concat(F.lit("bin:"), bucket.cast("string")), 12)


def structural_hash(body: Column, content_type: Column) -> Column:
    """Hash of the structure only; values do not matter."""
    ct = F.lower(content_type)
    return (
        F.when(F.coalesce(body, F.lit("")) == "", "empty")
        .when(ct.contains("json"), json_hash(body))
        .when(ct.contains("html"), html_hash(body))
        .otherwise(size_hash(body))
    )


def context_identity(level: Column, endpoints_hash: Column, markers: Column) -> Column:
    """Coarse state id; markers are written as a sorted quoted list."""
    listed = F.concat(
        F.lit("["),
        F.array_join(
            F.transform(F.array_sort(F.array_distinct(markers)), lambda m: F.concat(F.lit("'"), m, F.lit("'"))),
            ", ",
        ),
        F.lit("]"),
    )
    return digest(F.concat_ws("|", level, endpoints_hash, listed), 12)


def functional_identity(context_id: Column, flow: Column, actions_hash: Column) -> Column:
    return digest(F.concat_ws("|", context_id, F.coalesce(flow, F.lit("None")), actions_hash), 12)
