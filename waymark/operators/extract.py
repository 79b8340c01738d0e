"""Markup extraction and request candidates: one row to many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import html, urls

# Harmless form input per field name.
SAFE_VALUES = {
    "q": "test", "query": "test", "search": "test", "keyword": "test",
    "s": "test", "term": "test", "searchfor": "test", "find": "test",
    "sort": "name", "order": "asc", "orderby": "name",
    "page": "1", "p": "1", "offset": "0",
    "limit": "10", "per_page": "10", "count": "10",
    "filter": "all", "type": "all", "category": "all",
    "lang": "en", "locale": "en",
    "format": "json", "output": "json",
    "name": "test", "title": "test", "text": "test",
    "message": "test", "comment": "test", "content": "test",
    "email": "test@test.com", "url": "http://test.com",
    "id": "1", "num": "1", "amount": "1",
    "gobutton": "go", "submit": "submit", "action": "search",
}
# Candidate values per slot type.
SLOT_VALUES = {
    "integer": ["0", "1", "2", "-1", "999999", "2147483647", "me", "self", "current", "admin"],
    "uuid": ["00000000-0000-0000-0000-000000000000"],
    "string": ["admin", "test", "internal", "debug", "me", "self"],
}


def links(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    rows = pages.select(F.col(url).alias("page_url"), F.explode(html.links(F.col(body), F.col(url))).alias("l"))
    return rows.select("page_url", "l.url", "l.text", "l.tag")


def forms(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    has_form = F.lower(body).contains("<form")
    rows = pages.where(has_form).select(F.col(url).alias("page_url"), F.posexplode(html.forms(F.col(body), F.col(url))).alias("form_no", "f"))
    return rows.select("page_url", "form_no", "f.*")


def script_files(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    return pages.select(F.col(url).alias("page_url"), F.explode(html.script_files(F.col(body), F.col(url))).alias("url"))


def resources(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    return pages.select(F.col(url).alias("page_url"), F.explode(html.resources(F.col(body), F.col(url))).alias("url"))


def candidate_urls(slots: DataFrame, energy: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidate URLs per template, up to its energy, minus those seen.

    ``slots``: template, slots map, first_url; ``energy``: template, energy;
    ``seen``: url. A template yields a small fixed number of candidates, so
    the cut to the energy is an array slice in the row.
    """
    entries = F.map_entries("slots")

    def fill(slot: Column, kind: str) -> Column:
        mark = F.concat(F.lit("{"), slot, F.lit("}"))
        values = F.array(*[F.lit(v) for v in SLOT_VALUES[kind]])
        return F.transform(values, lambda v: F.replace(F.col("template"), mark, v))

    filled = F.flatten(F.transform(
        entries,
        lambda e: F.when(e["value"] == "integer", fill(e["key"], "integer")).when(e["value"] == "uuid", fill(e["key"], "uuid")).otherwise(fill(e["key"], "string")),
    ))
    version = F.regexp_extract("first_url", r"/v([0-9]{1,6})/", 1)
    number = F.nullif(version, F.lit("")).cast("int")
    # what lies beyond the energy is cut below, so no more versions are listed than that
    siblings = F.filter(F.sequence(F.lit(1), F.least(number + 2, F.col("energy") + 1)), lambda v: v != number)
    versioned = F.when(
        number.isNotNull(),
        F.transform(siblings, lambda v: F.replace(F.col("first_url"), F.concat(F.lit("/v"), version, F.lit("/")), F.concat(F.lit("/v"), v.cast("string"), F.lit("/")))),
    ).otherwise(F.array().cast("array<string>"))
    rows = slots.where(F.size("slots") > 0).join(energy.select("template", "energy"), "template").where(F.col("energy") > 0)
    rows = rows.select("template", F.posexplode(F.slice(F.concat(filled, versioned), 1, F.col("energy"))).alias("rank", "url"))
    return rows.join(seen.select("url"), "url", "left_anti").select("template", "rank", "url")


def form_requests(forms_rows: DataFrame) -> DataFrame:
    """One request per distinct action, method and field set, safely filled."""
    safe = F.create_map(*[F.lit(x) for kv in SAFE_VALUES.items() for x in kv])
    filled = F.transform(
        "fields",
        lambda f: F.struct(
            f["name"].alias("name"),
            F.coalesce(F.try_element_at(safe, F.lower(f["name"])), F.nullif(f["value"], F.lit("")), F.lit("test")).alias("value"),
        ),
    )
    names = F.array_sort(F.transform("fields", lambda f: f["name"]))
    rows = forms_rows.withColumn("filled", filled).withColumn("form_key", F.concat_ws("|", "action", "method", F.array_join(names, ",")))
    rows = rows.groupBy("form_key").agg(F.min_by(F.struct("action", "method", "filled"), F.struct("page_url", "form_no")).alias("r")).select("form_key", "r.*")

    def encode(pairs: Column) -> Column:
        return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&")

    own = F.filter(urls.query_pairs(F.col("action"), keep_blank=True), lambda p: ~F.exists("filled", lambda f: f["name"] == p["name"]))
    merged = encode(F.concat(own, "filled"))
    base = F.substring_index("action", "?", 1)
    is_get = F.col("method") == "GET"
    return rows.select(
        F.when(is_get, F.concat(base, F.lit("?"), merged)).otherwise(F.col("action")).alias("url"), "method",
        F.when(~is_get, encode(F.col("filled"))).otherwise("").alias("body"),
    )
