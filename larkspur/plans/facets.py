"""The catalog request: sixteen optional facets over roles, and the groups that keep some role, summed up anew.

A role has company, title, season, pay and employer_category (strings), open, requires_citizenship, advanced_degree
and release_day_observed (booleans), education_levels, disciplines, work_modes and locations (arrays of strings),
education_evidence (explicit, inferred, unspecified, conflicting), identity_status, credibility (official,
community, corroborated), visible_at (timestamp) and release_day (date). A null counts as absent: it matches no
facet that asks for a value, and an absent flag is false.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.time import zone_day
from larkspur.operators.filters import all_of, prefixes_words

#: Which credibilities a source asked for admits; `all` and None admit every role.
ADMITS = {"corroborated": ("corroborated",), "direct": ("official", "corroborated"), "community": ("community", "corroborated")}
#: Of a group's titles and disciplines so many are shown; places, modes and seasons are shown whole.
SHOWN = {"titles": 3, "disciplines": 6}


@dataclass(frozen=True)
class CatalogRequest:
    """What is asked for; empty lists, None and False ask for nothing. Lists are any-of, without regard to case and spacing."""

    query: str = ""
    status: str | None = None
    employer_categories: Sequence[str] = ()
    hide_citizenship_required: bool = False
    education_level: str | None = None
    confirmed_only: bool = False
    source: str | None = None
    disciplines: Sequence[str] = ()
    seasons: Sequence[str] = ()
    education_levels: Sequence[str] = ()
    work_modes: Sequence[str] = ()
    has_compensation: bool = False
    day: date | None = None
    day_zone: str | None = None
    added_since: datetime | None = None
    added_before: datetime | None = None
    locations: Sequence[str] = ()
    #: Other spellings of disciplines, by their key.
    discipline_keys: Mapping[str, str] = field(default_factory=dict)


def _folded(value: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def _same(values: Sequence[str]) -> list[str]:
    return [" ".join(v.split()).lower() for v in values]


def _some(available: Column, wanted: Sequence[str]) -> Column:
    return F.exists(available, lambda v: F.coalesce(_folded(v).isin(*_same(wanted)), F.lit(False)))


def _instant(at: datetime) -> Column:
    return F.lit(at).cast("timestamp")


def matches(request: CatalogRequest) -> Column:
    """Whether a role is what the request asks for; never null.

    The query's words must each begin a word of company or title. The reader's own level turns away roles that state
    other levels, and undergraduates where an advanced degree is required; asked-for levels let unspecified roles pass.
    A reported release day stays in every zone, an observed one is that of visible_at. The window is half open.
    """
    r, c = request, F.col
    stated = (c("education_evidence") == "explicit") & (F.size("education_levels") > 0)
    asked = "".join(x if x.isalnum() else " " for x in r.query.lower()).split()
    level = F.when(stated, F.array_contains("education_levels", F.lit(r.education_level))).otherwise(~(F.coalesce("advanced_degree", F.lit(False)) & F.lit(r.education_level == "undergraduate")))
    keys = {" ".join(k.split()).lower(): " ".join(v.split()).lower() for k, v in r.discipline_keys.items()}
    spelled = [k for k in sorted({*_same(r.disciplines), *keys, *keys.values()}) if keys.get(k, k) in {keys.get(d, d) for d in _same(r.disciplines)}]
    released = F.when(c("release_day").isNotNull(), F.when(c("release_day_observed"), zone_day(c("visible_at"), r.day_zone)).otherwise(c("release_day")))
    placed = _folded(F.concat_ws(" ", "locations"))
    facets = [
        prefixes_words(F.concat_ws(" ", "company", "title"), asked) if asked else None,
        c("open") == (r.status == "open") if r.status else None,
        c("employer_category").isin(*r.employer_categories) if r.employer_categories else None,
        ~F.coalesce("requires_citizenship", F.lit(False)) if r.hide_citizenship_required else None,
        level if r.education_level else None,
        F.coalesce("identity_status", F.lit("")) != "unconfirmed" if r.confirmed_only else None,
        c("credibility").isin(*ADMITS[r.source]) if r.source and r.source != "all" else None,
        _some(c("disciplines"), spelled) if r.disciplines else None,
        _folded(c("season")).isin(*_same(r.seasons)) if r.seasons else None,
        (c("education_evidence") == "unspecified") | _some(c("education_levels"), r.education_levels) if r.education_levels else None,
        _some(c("work_modes"), r.work_modes) if r.work_modes else None,
        F.trim(F.regexp_replace("pay", r"\s+", " ")) != "" if r.has_compensation else None,
        released == F.lit(r.day) if r.day else None,
        c("visible_at") >= _instant(r.added_since) if r.added_since else None,
        c("visible_at") < _instant(r.added_before) if r.added_before else None,
        F.exists(F.array(*[F.lit(p) for p in _same(r.locations)]), lambda p: F.contains(placed, p)) if r.locations else None,
    ]
    return F.coalesce(all_of(*facets), F.lit(False))


def _of_kind(kind: str, values: Column) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))


def filtered_groups(roles: DataFrame, request: CatalogRequest, group: str = "group_id", role: str = "role_id") -> DataFrame:
    """Groups with some matching role: counts, first and last sight, the newest role, and what the matching roles show.

    Values come in the order of the newest role that has them, ties to the smaller role id, then by value. Distinct
    values are found by an aggregate that combines before the shuffle, so that a large group's roles never meet in one task.
    """
    kept = roles.where(matches(request))
    newest = F.struct((-F.unix_micros(F.col("visible_at").cast("timestamp"))).alias("at"), F.col(role).alias("id"))
    summed = kept.groupBy(group).agg(
        F.count("*").alias("role_count"), F.count_if(F.col("identity_status") == "unconfirmed").alias("unconfirmed_count"), F.min("visible_at").alias("created_at"), F.max("visible_at").alias("updated_at"),
        F.min(newest)["id"].alias("featured_role"),
    )
    shown = {"titles": F.array("title"), "disciplines": F.col("disciplines"), "locations": F.col("locations"), "work_modes": F.col("work_modes"), "seasons": F.array("season")}
    said = F.concat(*[_of_kind(k, v) for k, v in shown.items()])
    pairs = kept.select(group, newest.alias("first"), F.explode(said).alias("s")).select(group, "first", "s.*").where(F.col("value").isNotNull())
    pairs = pairs.groupBy(group, "kind", "value").agg(F.min("first").alias("first"))
    n = F.row_number().over(Window.partitionBy(group, "kind").orderBy("first", "value"))
    pairs = pairs.withColumn("n", n).where(F.coalesce(*[F.when(F.col("kind") == k, F.col("n") <= most) for k, most in SHOWN.items()], F.lit(True)))
    lists = pairs.groupBy(group).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("n", "value")))), lambda x: x["value"]).alias(k) for k in shown])
    joined = summed.join(lists.withColumnRenamed(group, "_of"), F.col(group).eqNullSafe(F.col("_of")), "left").drop("_of")
    return joined.withColumn("has_new_roles", F.coalesce(F.col("created_at") != F.col("updated_at"), F.lit(False)))
