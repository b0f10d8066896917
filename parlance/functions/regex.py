"""Regular-expression helpers on Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unicode(pattern: str) -> str:
    r"""The pattern with Unicode-aware ``\b \d \s \w``."""
    return "(?U)" + pattern


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a group, as an array that is empty (never NULL) without any."""
    found = F.regexp_extract_all(text, F.lit(unicode(pattern)), F.lit(group))
    return F.coalesce(found, empty_strings())


def find_first(text: Column, pattern: str, group: int = 0) -> Column:
    """First match, NULL if there is none."""
    hit = F.regexp_extract(text, unicode(pattern), group)
    return F.when(hit != "", hit)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))


def replace_matches(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Text with every match replaced by ``change(match)``; rows without a match pass through."""
    marked = unicode(pattern)

    def rebuilt(whole: Column) -> Column:
        gaps = F.split(whole, marked, -1)
        hits = F.regexp_extract_all(whole, F.lit(marked), F.lit(0))
        changed = F.concat(F.transform(hits, lambda hit: change(hit)), F.array(F.lit("")))
        joined = F.concat_ws("", F.zip_with(gaps, changed, lambda gap, hit: F.concat(gap, hit)))
        return F.when(whole.rlike(marked), joined).otherwise(whole)

    return bind(text, rebuilt)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, unicode(r"\D"), "")
