"""DuckDB text fragments for the SQL side of the comparison."""

from __future__ import annotations

U = "'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?'"


def part(x: str, n: int) -> str:
    return f"regexp_extract({x}, {U}, {n})"


def scheme(x): return f"lower({part(x, 1)})"
def authority(x): return part(x, 2)
def path(x): return part(x, 3)
def qs(x): return part(x, 4)
def host(x): return f"lower(regexp_extract({authority(x)}, '^(?:[^@]*@)?([^:]*)', 1))"


def segs(x):
    return f"list_filter(string_split({path(x)}, '/'), lambda s: s <> '')"


def slot(s, hash_slot="{hash}", slug=True):
    tail = f"WHEN regexp_matches({s}, '(?i)^[a-z0-9]+-[a-z0-9]+(-[a-z0-9]+)+$') THEN '{{slug}}' " if slug else ""
    return (
        f"CASE WHEN regexp_matches({s}, '^[0-9]+$') THEN '{{id}}' "
        f"WHEN regexp_matches({s}, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN '{{uuid}}' "
        f"WHEN regexp_matches({s}, '(?i)^[0-9a-f]{{8,}}$') THEN '{hash_slot}' {tail}ELSE {s} END"
    )


def names(x):
    return (
        f"list_sort(list_distinct(list_transform(list_filter(string_split({qs(x)}, '&'), "
        f"lambda p: regexp_matches(p, '(?s)^[^=]*=.')), "
        f"lambda p: url_decode(replace(split_part(p, '=', 1), '+', ' ')))))"
    )


def template(x):
    n = names(x)
    return (
        f"('/' || array_to_string(list_transform({segs(x)}, lambda s: {slot('s')}), '/') || "
        f"CASE WHEN len({n}) > 0 THEN '?' || array_to_string(list_transform({n}, lambda n: n || '='), '&') ELSE '' END)"
    )


def normalize(x):
    q = f"trim(regexp_replace({qs(x)}, '&+$', ''))"
    return f"(regexp_extract({x}, '^([^?#]*)', 1) || CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END)"


def parent(p):
    return (f"CASE WHEN regexp_replace(regexp_replace({p}, '/+$', ''), '/?[^/]*$', '') = '' THEN '/' "
            f"ELSE regexp_replace(regexp_replace({p}, '/+$', ''), '/?[^/]*$', '') END")


def digest(x, n=16): return f"substr(sha256({x}), 1, {n})"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows, cols: str) -> str:
    """(VALUES ...) table text from Python rows."""
    def lit(v):
        return quote(v) if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {cols}"


def first_label(x: str, rules) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({x}, {quote(p)}) THEN {quote(v) if isinstance(v, str) else v}" for p, v in rules
    ) + " END"


def any_of(x: str, patterns) -> str:
    return f"regexp_matches({x}, {quote('|'.join('(?:' + p + ')' for p in patterns))})"


def text_hash(x: str) -> str:
    """Structural hash of HTML text."""
    return (
        f"substr(sha256(array_to_string(list_transform(regexp_extract_all({x}, "
        f"'<([A-Za-z0-9_]+)([^>]*)>', 1), lambda t: lower(t)), '>')), 1, 12)"
    )
