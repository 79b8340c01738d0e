"""URL expressions, all from one RFC 3986 split.

``parse_url`` raises on odd input under ANSI mode, so the parts come from a
regex that accepts any string.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import digest

# Groups: 1 scheme, 2 authority, 3 path, 4 query, 5 fragment
URL_PATTERN = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
# A URL that ``normalize`` leaves as it is: lower-case scheme, no fragment, nothing to trim at either end of the query
PLAIN_PATTERN = r"^[a-z][a-z0-9+.-]*:[^?#]*(?:\?(?! )[^#]*[^#& \n\r\u0085\u2028\u2029])?\z"
HOST_PATTERN = r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)"

# What counts as a dynamic path segment, in test order.
SEGMENT_RULES = [
    (r"^[0-9]+$", "{id}"),
    (r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "{uuid}"),
    (r"(?i)^[0-9a-f]{8,}$", "{hash}"),
    (r"(?i)^[a-z0-9]+-[a-z0-9]+(-[a-z0-9]+)+$", "{slug}"),
]
PASSIVE_SEGMENT_RULES = [*SEGMENT_RULES[:2], (SEGMENT_RULES[2][0], "{hex}")]
BODY_METHODS = ["POST", "PUT", "PATCH"]


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, URL_PATTERN, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, URL_PATTERN, 4)


def host(url: Column) -> Column:
    """Lower-case host name without user or port."""
    return F.lower(F.regexp_extract(authority(url), HOST_PATTERN, 1))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":([0-9]+)$", 1)


def base_url(url: Column) -> Column:
    """scheme://authority/path."""
    return F.concat(scheme(url), F.lit("://"), authority(url), path(url))


def decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def normalize(url: Column) -> Column:
    """Drop the fragment, trailing ``&`` and an empty query."""
    q = F.trim(F.regexp_replace(query(url), r"&+$", ""))
    bare = F.regexp_extract(url, r"^([^?#]*)", 1)
    lead = F.regexp_extract(bare, r"^([^:/?#]+:)", 1)
    bare = F.concat(F.lower(lead), F.substr(bare, F.length(lead) + 1))
    # most URLs are plain: one regex tells, instead of four that take them apart
    return F.when(url.rlike(PLAIN_PATTERN), url).otherwise(F.concat(bare, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def _slot(rules):
    def replace(seg: Column) -> Column:
        case = None
        for pattern, slot in rules:
            hit = seg.rlike(pattern)
            case = F.when(hit, slot) if case is None else case.when(hit, slot)
        return case.otherwise(seg)

    return replace


def template_segments(url: Column) -> Column:
    return F.transform(segments(url), _slot(SEGMENT_RULES))


def passive_segments(url: Column) -> Column:
    return F.transform(segments(url), _slot(PASSIVE_SEGMENT_RULES))


def query_pairs(url: Column, keep_blank: bool = False) -> Column:
    """Array of (name, value) in URL order; blank values dropped unless kept."""
    parts = F.split(query(url), "&")
    if keep_blank:
        parts = F.filter(parts, lambda p: p != "")
    else:
        parts = F.filter(parts, lambda p: p.rlike("(?s)^[^=]*=."))
    return F.transform(
        parts,
        lambda p: F.struct(
            decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("name"),
            decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)", 1)).alias("value"),
        ),
    )


def query_names(url: Column, keep_blank: bool = False) -> Column:
    names = F.transform(query_pairs(url, keep_blank), lambda p: p["name"])
    return F.array_sort(F.array_distinct(names))


def template(url: Column) -> Column:
    """Path with dynamic segments replaced, plus the sorted query names."""
    names = query_names(url)
    tail = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("="))), "&")
    return F.concat(
        F.lit("/"),
        F.array_join(template_segments(url), "/"),
        F.when(F.size(names) > 0, F.concat(F.lit("?"), tail)).otherwise(""),
    )


def slot_types(url: Column) -> Column:
    """Map of template slot to integer, uuid or string; the last slot wins.

    A final segment that carries a query in the template is not a slot.
    """
    zipped = F.arrays_zip(segments(url).alias("seg"), template_segments(url).alias("slot"))
    whole = F.when(
        F.size(query_names(url)) > 0, F.slice(zipped, 1, F.greatest(F.size(zipped) - 1, F.lit(0)))
    ).otherwise(zipped)
    pairs = F.filter(whole, lambda p: p["slot"].rlike(r"^\{.*\}$"))
    kind = (
        lambda s: F.when(s.rlike("^[0-9]+$"), "integer")
        .when(s.rlike("(?i)^[0-9a-f-]{36}$"), "uuid")
        .otherwise("string")
    )
    return F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.map_concat(
            F.map_filter(m, lambda k, _: k != F.regexp_extract(p["slot"], r"^\{(.*)\}$", 1)),
            F.create_map(F.regexp_extract(p["slot"], r"^\{(.*)\}$", 1), kind(p["seg"])),
        ),
    )


def request_key(url: Column, method: Column, body: Column, role: Column) -> Column:
    """SHA-256 of method, normalised URL, whole body and role: unlike the short fingerprint, it is told apart at any number of requests."""
    none = F.lit("")
    return F.sha2(F.concat_ws("|", F.upper(method), normalize(url), F.coalesce(body, none), F.coalesce(role, none)), 256)


def request_fingerprint(url: Column, method: Column, body: Column, role: Column) -> Column:
    """SHA-256 prefix of METHOD|url[|body hash][|@role]."""
    verb = F.upper(method)
    has_body = verb.isin(BODY_METHODS) & (F.coalesce(body, F.lit("")) != "")
    has_role = F.coalesce(role, F.lit("")) != ""
    return digest(
        F.concat(
            verb, F.lit("|"), normalize(url),
            F.when(has_body, F.concat(F.lit("|"), digest(body, 8))).otherwise(""),
            F.when(has_role, F.concat(F.lit("|@"), role)).otherwise(""),
        )
    )


def endpoint_fingerprint(method: Column, url: Column) -> Column:
    return digest(F.concat(F.upper(method), F.lit("|"), url))


def vector_fingerprint(url: Column, name: Column, location: Column) -> Column:
    return digest(F.concat_ws("|", url, name, location))


def transaction_fingerprint(method: Column, url: Column, body: Column, ts: Column) -> Column:
    body8 = F.when(F.coalesce(body, F.lit("")) != "", digest(body, 8)).otherwise("")
    return digest(F.concat(method, F.lit("|"), url, F.lit("|"), body8, F.lit("|"), ts.cast("string")))


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of ``ref`` seen on ``base``; dot segments are folded."""
    root = F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), F.lit("//"), authority(base))
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    target = (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref == "", base)
        .when(ref.startswith("?"), F.concat(root, path(base), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), ref))
        .otherwise(F.concat(root, folder, ref))
    )
    return F.when(target.rlike(r"/\.\.?(?:/|$|[?#])"), fold_dots(target)).otherwise(target)


def fold_dots(url: Column) -> Column:
    """Remove ``.`` and ``..`` path segments."""
    lead = F.regexp_extract(url, r"^((?:[^:/?#]+:)?(?://[^/?#]*)?)", 1)
    tail = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    parts = F.split(F.regexp_replace(path(url), "^/", ""), "/")
    parts = F.transform(
        parts,
        lambda s, i: F.when((s.isin(".", "..")) & (i == F.size(parts) - 1), F.concat(s, F.lit("/"))).otherwise(s),
    )
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "./", F.array_append(acc, F.lit("")))
        .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == "../", F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.lit("")))
        .otherwise(F.array_append(acc, s)),
    )
    return F.concat(lead, F.lit("/"), F.array_join(kept, "/"), tail)


def parent_path(p: Column) -> Column:
    """Parent directory path; the root stands for itself."""
    trimmed = F.regexp_replace(p, r"/+$", "")
    up = F.regexp_replace(trimmed, r"/?[^/]*$", "")
    return F.when(up == "", "/").otherwise(up)
