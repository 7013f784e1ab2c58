"""Piecewise pay scores, opportunity scores, vector similarity, evidence weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 1) -> Column:
    """Rounding that sends halves up, also below zero."""
    unit = 10.0**places
    return F.floor(x * unit + 0.5) / unit


def piecewise(x: Column, anchors: list[tuple[float, float]]) -> Column:
    """Linear between (x, y) anchors in ascending order, flat outside."""
    pairs = list(zip(anchors, anchors[1:], strict=False))
    steps = [(x <= anchors[0][0], F.lit(anchors[0][1])), *((x <= b[0], a[1] + (x - a[0]) * ((b[1] - a[1]) / (b[0] - a[0]))) for a, b in pairs)]
    first, *rest = steps
    return reduce(lambda acc, s: acc.when(*s), rest, F.when(*first)).otherwise(F.lit(anchors[-1][1]))


def opportunity(pay: Column, company: Column, role: Column) -> Column:
    """The weighted mean of those parts that are known, to one decimal place; null if none is."""
    parts = [(pay, 0.45), (company, 0.30), (role, 0.25)]
    weight = reduce(lambda a, b: a + b, [F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts])
    total = reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) * w for p, w in parts])
    return half_up(F.try_divide(total, F.nullif(weight, F.lit(0.0))))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)


def unit(a: Column) -> Column:
    """The array at length one, in doubles; null for a zero vector."""
    return F.transform(a, lambda p: F.try_divide(p.cast("double"), F.sqrt(dot(a, a))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, clamped to [0, 1]; null for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))))


def weighted(*parts: tuple[Column, int]) -> Column:
    """The sum of the weights of the conditions that hold."""
    return reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0) for c, w in parts])


def overlap(a: Column, b: Column) -> Column:
    """Shared terms over the smaller number of terms."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b))))


def agreement(ratio: Column, contained: Column) -> Column:
    """How a text agrees with a page: a phrase wholly contained or a term ratio of 0.75 is strong, 0.4 partial."""
    return F.when(contained | (ratio >= 0.75), "strong").when(ratio >= 0.4, "partial").otherwise("weak")
