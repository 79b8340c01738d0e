"""The scalar rules as SQL functions, inlined by Catalyst when called.

Such a function works on columns but not inside a lambda such as
``transform(arr, x -> f(x))``; write the expression out there.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?"
_SEGMENT = (
    "CASE WHEN s RLIKE '^[0-9]+$' THEN '{id}' "
    "WHEN s RLIKE '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$' THEN '{uuid}' "
    "WHEN s RLIKE '(?i)^[0-9a-f]{8,}$' THEN '{hash}' "
    "WHEN s RLIKE '(?i)^[a-z0-9]+-[a-z0-9]+(-[a-z0-9]+)+$' THEN '{slug}' ELSE s END"
)
_NAMES = (
    f"array_sort(array_distinct(transform(filter(split(regexp_extract(url, '{_URL}', 4), '&'), p -> p RLIKE '^[^=]*=.'), "
    "p -> coalesce(try_url_decode(substring_index(p, '=', 1)), substring_index(p, '=', 1)))))"
)

DEFINITIONS = {
    "url_template(url STRING)": (
        f"concat('/', array_join(transform(filter(split(regexp_extract(url, '{_URL}', 3), '/'), s -> s <> ''), s -> {_SEGMENT}), '/'), "
        f"CASE WHEN size({_NAMES}) > 0 THEN concat('?', array_join(transform({_NAMES}, n -> concat(n, '=')), '&')) ELSE '' END)"
    ),
    "normalize_url(url STRING)": (
        "concat(regexp_extract(url, '^([^?#]*)', 1), CASE WHEN trim(regexp_replace(regexp_extract(url, "
        f"'{_URL}', 4), '&+$', '')) <> '' THEN concat('?', trim(regexp_replace(regexp_extract(url, '{_URL}', 4), '&+$', ''))) ELSE '' END)"
    ),
    "html_structure(body STRING)": (
        "substring(sha2(array_join(transform(regexp_extract_all(body, '<([A-Za-z0-9_]+)([^>]*)>', 1), t -> lower(t)), '>'), 256), 1, 12)"
    ),
    "status_page_type(status INT, location STRING)": (
        "CASE WHEN status BETWEEN 300 AND 399 THEN CASE WHEN location RLIKE '(?i)login|signin|sign-in|auth|sso|cas/' THEN 'auth_required' ELSE 'redirect' END "
        "WHEN status IN (401, 403) THEN 'auth_required' WHEN status >= 500 THEN 'error' WHEN status = 404 THEN 'custom_404' ELSE 'real_content' END"
    ),
}


def register(spark: SparkSession) -> list[str]:
    """Creates the temporary functions of this session; returns their names."""
    for signature, body in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS STRING RETURN {body}")
    return [s.split("(")[0] for s in DEFINITIONS]
