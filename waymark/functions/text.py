"""Small expression builders shared by the classifiers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F


def any_of(col: Column, patterns: Iterable[str]) -> Column:
    """True when one of the regexes is found; one folded pattern, one scan."""
    return col.rlike("|".join(f"(?:{p})" for p in patterns))


def first_label(col: Column, rules: Sequence[tuple[str, object]]) -> Column:
    """Value of the first rule whose regex is found, else null."""
    return F.coalesce(*[F.when(col.rlike(p), F.lit(v)) for p, v in rules])


def every_label(col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Array with the tag of every (tag, regex) rule that is found."""
    return F.array_compact(F.array(*[F.when(col.rlike(p), F.lit(t)) for t, p in rules]))


def contains_any(col: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | col.contains(w)
    return out


def digest(col: Column, length: int = 16) -> Column:
    """Leading hex digits of SHA-256."""
    return F.substring(F.sha2(col, 256), 1, length)


def string_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def sql_text(value: str) -> str:
    """A Spark SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
