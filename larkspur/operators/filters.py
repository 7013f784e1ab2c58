"""Predicates of the faceted catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """The conjunction of the facets that are set; no facet keeps everything."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(column: str, values: list[str] | None) -> Column | None:
    """One of the values, case folded; an unset facet is None."""
    return F.lower(column).isin([v.lower() for v in values]) if values else None


def unless_stated(status: Column, matches: Column) -> Column:
    """Only stated evidence excludes: unspecified or conflicting rows pass."""
    return status.isin("unspecified", "conflicting") | status.isNull() | F.coalesce(matches, F.lit(False))


def prefixes_words(text: Column, terms: list[str]) -> Column:
    """Every term begins some word of the text."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    begins = lambda term: F.exists(words, lambda w: w.startswith(term))
    return all_of(*[begins(t.lower()) for t in terms])


def in_half_open(column: Column, since: Column, before: Column) -> Column:
    """since <= column < before."""
    return (column >= since) & (column < before)


def reasons(**named: Column) -> Column:
    """The sorted names of the conditions that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(named.items())])))
