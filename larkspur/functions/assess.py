"""Judgements of pages, applications, failures and lifecycles, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.url import TRACKING


def page_confidence(score: Column, agreement: Column, long_text: Column, redirected: Column, generic_title: Column) -> Column:
    """score and level of an application page: 75 at least on strong agreement with a long text, 65 at most for generic pages."""
    raised = F.when((agreement == "strong") & long_text, F.greatest(score, F.lit(75))).otherwise(score)
    value = F.when(redirected | (generic_title & (agreement != "strong")), F.least(raised, F.lit(65))).otherwise(raised)
    return F.struct(value.alias("score"), F.when(value >= 70, "high").when(value >= 45, "medium").otherwise("low").alias("level"))


def application_decision(attributed: Column, reachability: Column, described: Column) -> Column:
    """alert and quarantine: pages that are gone are quarantined; others alert if attributed or not known to lack a description."""
    gone = reachability == "gone"
    return F.struct((~gone & (attributed | F.coalesce(described, F.lit(True)))).alias("alert"), gone.alias("quarantine"))


def location_key(value: Column) -> Column:
    """A comparable location: lower-case terms, with two places that have many spellings folded."""
    terms = F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))
    return F.when(terms.rlike("^(nyc|new york city|new york ny)$"), "new york ny").when(terms.rlike("^remote( us| usa| united states)?$"), "remote").otherwise(terms)


def public_url(url: Column) -> Column:
    """The address without tracking parameters; exactly as given where it has none, or isn't http."""
    head, query, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    name = lambda p: F.lower(F.regexp_extract(p, "^([^=]*)", 1))
    kept = F.filter(F.split(query, "&"), lambda p: ~(name(p).startswith("utm_") | name(p).isin(*sorted(TRACKING))))
    clean = F.concat(head, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""), tail)
    changed = url.rlike("(?i)^https?://") & (query != "") & (F.size(kept) < F.size(F.split(query, "&")))
    return F.when(changed, clean).otherwise(url)


def stable_bucket(value: Column, buckets: int) -> Column:
    """A bucket of an id that never changes."""
    return F.conv(F.left(F.md5(value.cast("string")), F.lit(8)), 16, 10).cast("long") % buckets


def cursor(*parts: Column) -> Column:
    """A page cursor: the parts joined by a zero sign, in URL-safe base 64 without padding."""
    return F.translate(F.base64(F.concat_ws("\u0000", *parts).cast("binary")), "+/=", "-_")


def cursor_parts(value: Column) -> Column:
    """The parts of a page cursor."""
    plain = F.translate(value, "-_", "+/")
    return F.split(F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))).cast("string"), "\u0000")
