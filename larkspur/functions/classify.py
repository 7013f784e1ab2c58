"""Classification by patterns: categories, technical score, seasons, work mode, early-career signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import company_key


def categories(text: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns that a text matches, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in patterns.items()]))


def hits(text: Column, pattern: str) -> Column:
    """How many different matches a pattern has."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))))


def technical(text: Column, domain: str, skill: str, business: str) -> Column:
    """struct<score, technical>: 3 for each of up to three domain words, 1 for each of up to six skills, less 2 for each business word; 4 with two skills is technical."""
    d, s, b = hits(text, domain), hits(text, skill), hits(text, business)
    score = F.least(d, F.lit(3)) * 3 + F.least(s, F.lit(6)) - 2 * b
    return F.struct(score.alias("score"), ((score >= 4) & (s >= 2)).alias("technical"))


def season(text: Column, year: int) -> Column:
    """`summer-2027` and the like if one season is named with a year from `year` to three years on; `offseason-` if several are."""
    t = F.lower(text)
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(r"\b(spring|summer|fall|autumn|winter)\b"), F.lit(1)))
    at = F.regexp_extract(t, r"\b(20[0-9]{2})\b", 1)
    ok = at.rlike("^20") & at.try_cast("int").between(year, year + 3)
    return F.when(ok & (F.size(found) > 1), F.concat(F.lit("offseason-"), at)).when(ok & (F.size(found) == 1), F.concat(F.replace(F.element_at(found, 1), F.lit("autumn"), F.lit("fall")), F.lit("-"), at))


def past_season(name: Column, today: Column) -> Column:
    """Whether a season is over: its last month, counted from 0, is winter 0, spring 2, summer 4 or fall 8 of its year."""
    kind, year = F.split_part(name, F.lit("-"), F.lit(1)), F.split_part(name, F.lit("-"), F.lit(2)).try_cast("int")
    month = F.when(kind == "winter", 0).when(kind == "spring", 2).when(kind == "summer", 4).when(kind == "fall", 8)
    return F.coalesce((F.year(today) > year) | ((F.year(today) == year) & (F.month(today) - 1 > month)), F.lit(False))


def work_mode(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)\bhybrid\b"), "hybrid").when(text.rlike(r"(?i)\bremote\b"), "remote").when(text.rlike(r"(?i)\bon-?site\b|\bin person\b"), "onsite")


# Employers of two classes, as they are written.
LARGE = ("alphabet", "google", "google deepmind", "amazon", "amazon web services", "aws", "apple", "meta", "facebook", "instagram", "whatsapp", "netflix")
STARTUPS = (
    "astranis", "benchling", "brex", "checkr", "deel", "gusto", "mercury", "modern treasury", "notion", "plaid", "posthog", "retool", "rippling", "scale ai", "sentry", "sentry io",
    "sourcegraph", "supabase", "vanta", "vercel", "webflow", "weights biases", "zapier",
)


def employer_category(company: Column) -> Column:
    """faang, startup or normal, by the company's key; null counts as normal."""
    key = F.coalesce(company_key(company), F.lit(""))
    return F.when(key.isin(*LARGE), "faang").when(key.isin(*STARTUPS), "startup").otherwise("normal")
