"""HTML extraction as nested regex expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import urls

# Markup patterns.
LINK_TAG = r"(?is)<((?:a|link|area)\s[^>]*?href\s*=\s*(?:\"[^\"]*\"|'[^']*')[^>]*>(?:[^<]*</a>)?)"
SCRIPT_SRC = r"(?i)<script\s[^>]*?src=[\"']([^\"']+)[\"']"
LINK_HREF = r"(?i)<link\s[^>]*?href=[\"']([^\"']+)[\"']"
META_TAG = r"(?is)(<meta\s[^>]*?name=[\"'][^\"']+[\"'][^>]*?content=[\"'][^\"']+[\"'])"
FORM_TAG = r"(?is)(<form\s+[^>]*>.*?</form>)"
FIELD_TAG = r"(?is)(<(?:input|textarea|select)\s[^>]*>)"
RESOURCE_TAG = r"(?is)(<(?:img|iframe|video|audio|source|embed|object)\s[^>]*>)"
INLINE_SCRIPT = r"(?is)<script[^>]*>(.+?)</script>"
SKIPPED_LINKS = r"^(?:#|javascript:|mailto:|tel:|$)"
SKIPPED_RESOURCES = r"^(?:data:|javascript:|#|$)"


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def attribute(tag: Column, name: str) -> Column:
    """Value of one quoted attribute, empty when absent."""
    return F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def links(html: Column, base: Column) -> Column:
    found = F.transform(
        all_matches(html, LINK_TAG),
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, r"^([A-Za-z]+)", 1)).alias("tag"),
            attribute(t, "href").alias("href"),
            F.trim(F.regexp_extract(t, r"(?s)>([^<]*)</", 1)).alias("text"),
        ),
    )
    kept = F.filter(found, lambda l: ~l["href"].rlike(SKIPPED_LINKS))
    return F.transform(
        kept,
        lambda l: F.struct(
            l["tag"].alias("tag"), urls.normalize(urls.resolve(base, l["href"])).alias("url"), l["text"].alias("text")
        ),
    )


def forms(html: Column, base: Column) -> Column:
    """Forms with at least one named field."""

    def fields(form: Column) -> Column:
        named = F.filter(all_matches(form, FIELD_TAG), lambda t: attribute(t, "name") != "")
        return F.transform(
            named,
            lambda t: F.struct(
                attribute(t, "name").alias("name"),
                F.coalesce(F.nullif(F.lower(attribute(t, "type")), F.lit("")), F.lit("text")).alias("field_type"),
                attribute(t, "value").alias("value"),
                t.rlike(r"(?i)\srequired[\s=>/]").alias("required"),
            ),
        )

    def build(form: Column) -> Column:
        head = F.regexp_extract(form, r"(?is)^(<form\s+[^>]*>)", 1)
        action = attribute(head, "action")
        method = F.upper(attribute(head, "method"))
        return F.struct(
            urls.normalize(urls.resolve(base, action)).alias("action"),
            F.when(method == "", "GET").otherwise(method).alias("method"),
            F.coalesce(
                F.nullif(attribute(head, "enctype"), F.lit("")), F.lit("application/x-www-form-urlencoded")
            ).alias("enctype"),
            fields(form).alias("fields"),
        )

    return F.filter(F.transform(all_matches(html, FORM_TAG), build), lambda f: F.size(f["fields"]) > 0)


def script_files(html: Column, base: Column) -> Column:
    return F.transform(all_matches(html, SCRIPT_SRC), lambda s: urls.normalize(urls.resolve(base, s)))


def resources(html: Column, base: Column) -> Column:
    refs = F.transform(
        all_matches(html, RESOURCE_TAG),
        lambda t: F.coalesce(F.nullif(attribute(t, "src"), F.lit("")), attribute(t, "data")),
    )
    kept = F.filter(refs, lambda r: ~r.rlike(SKIPPED_RESOURCES))
    return F.transform(kept, lambda r: urls.normalize(urls.resolve(base, r)))


def inline_scripts(html: Column) -> Column:
    bodies = F.transform(all_matches(html, INLINE_SCRIPT), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", "")))
    return F.filter(bodies, lambda s: s != "")


def meta_tags(html: Column) -> Column:
    return F.transform(
        all_matches(html, META_TAG),
        lambda t: F.struct(
            F.lower(F.trim(F.regexp_extract(t, r"(?is)name=[\"']([^\"']+)[\"']", 1))).alias("name"),
            F.regexp_extract(t, r"(?is)content=[\"']([^\"']+)[\"']", 1).alias("content"),
        ),
    )


def field_value(html: Column, name: str) -> Column:
    """Value of a named field, written name first or value first."""
    quoted = r"\Q" + name + r"\E"
    ahead = rf"(?i)name\s*=\s*[\"']?{quoted}[\"']?\s+value\s*=\s*[\"']([^\"']+)[\"']"
    behind = rf"(?i)value\s*=\s*[\"']([^\"']+)[\"']\s+name\s*=\s*[\"']?{quoted}[\"']?"
    return F.coalesce(
        F.nullif(F.regexp_extract(html, ahead, 1), F.lit("")),
        F.nullif(F.regexp_extract(html, behind, 1), F.lit("")),
        F.lit(""),
    )


def login_fields(forms_col: Column) -> Column:
    """First form with a password field: its user, password and hidden fields."""

    def kind(fields, *types):
        return F.filter(fields, lambda f: f["field_type"].isin(*types))

    picked = F.filter(forms_col, lambda f: F.size(kind(f["fields"], "password")) > 0)
    form = F.get(picked, F.lit(0))
    fields = form["fields"]
    return F.when(
        F.size(picked) > 0,
        F.struct(
            F.coalesce(F.get(kind(fields, "text", "email"), F.lit(0))["name"], F.lit("username")).alias("user_field"),
            F.try_element_at(kind(fields, "password"), F.lit(-1))["name"].alias("pass_field"),
            form["action"].alias("action"),
            F.transform(kind(fields, "hidden"), lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value"))).alias("hidden"),
        ),
    )
