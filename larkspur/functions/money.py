"""Pay in texts: amounts, ranges and periods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import once

_AMOUNT = r"\$\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([kK]?)"
RANGE = _AMOUNT + r"(?:\s?(?:-|–|to)\s?\$?\s?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([kK]?))?\s?(?:/|per |an? )?\s?(hour|hr|year|yr|annually)?"
HOURS = 2080


def _number(digits: Column, k: Column) -> Column:
    return F.expr("try_cast(null as double)") if digits is None else F.replace(digits, F.lit(","), F.lit("")).try_cast("double") * F.when(F.lower(k) == "k", 1000.0).otherwise(1.0)


def pay(text: Column) -> Column:
    """struct<low, high, period, hourly> of the first plausible dollar range: 5 to 500 an hour, 10,000 to 1,000,000 a year; else null."""
    at = lambda g: F.regexp_extract(text, RANGE, g)
    low = _number(at(1), at(2))
    high = F.when(at(3) != "", _number(at(3), at(4))).otherwise(low)
    word = F.lower(at(5))
    hourly = word.isin("hour", "hr") | ((word == "") & (high <= 500))
    fits = F.when(hourly, (low >= 5) & (high <= 500)).otherwise((low >= 10_000) & (high <= 1_000_000)) & (low <= high)
    return F.when(fits, F.struct(low.alias("low"), high.alias("high"), F.when(hourly, "hour").otherwise("year").alias("period"), F.when(hourly, high).otherwise(F.round(high / HOURS, 4)).alias("hourly")))


def agreed(values: Column) -> Column:
    """The one value that all bands have, else null."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.element_at(values, 1))


# The currency codes that are read, and the words for periods.
CODES = (
    "USD|CAD|AUD|NZD|SGD|HKD|EUR|GBP|JPY|CNY|INR|CHF|SEK|NOK|DKK|PLN|CZK|HUF|RON|BRL|MXN|ARS|CLP|COP|KRW|TWD|IDR|MYR|PHP|THB|VND|ILS|AED|SAR|ZAR|TRY|XXX"
)
PERIODS = {"hourly": "hourly|hour|hr", "annual": "yearly|year|yr|annum|annually|annualized|annual", "daily": "daily|day", "weekly": "weekly|week", "monthly": "monthly|month", "other": "biweekly|bi-weekly|semimonthly|semi-monthly|bimonthly|fortnightly|one-time"}
#: What a text has in which pay is found with a period.
_PERIOD_HINT = r"(?i)hour|hr|year|yr|ann|dai|day|week|month|fortnight|one-time"
#: What isn't base pay.
NO_PAY = r"(?i)\b(?:sign[ -]?on|signing bonus|revenue|salary expectations?|desired salary|stipend|lunch allowance)\b"
_PLAIN = r"(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
STATED = rf"(?i)(?:\b(?=[A-Z]{{3}}\s?[$€£]?\s?[0-9])({CODES})\s?)?([$€£])?\s?({_PLAIN})\s?(k)?(?:\s?(?:-|–|—|to)\s?(?:({CODES})\s?)?[$€£]?\s?({_PLAIN})\s?(k)?)?\s?(?:({CODES})\s?)?(?:/\s?|per\s|an?\s)?\s?\b({'|'.join(PERIODS.values())})\b"
#: Pay whose period stands in a label before the amounts: label, code, sign, amount, thousands, second amount, thousands, code.
LABELLED = rf"(?i)\b(hourly|annual(?:ized)?|yearly|daily|weekly|monthly)\s+(?:(?:base|estimated|starting)\s+)?(?:pay|salary|wage|rate|compensation)(?:\s+range)?[^.;$€£\d]{{0,100}}?(?:({CODES})\s*)?([$€£])\s*({_PLAIN})\s*(k)?(?:\s*(?:-|–|—|to)\s*[$€£]?\s*({_PLAIN})\s*(k)?)?(?:\s*\(?({CODES})\b\)?)?(?!\s?(?:/|per\b))"


def _groups(hit: Column, pattern: str, n: int, use: Callable[[Callable[[int], Column]], Column]) -> Column:
    """`use` of the groups of a pattern's first match, all of them from one search."""
    parts = F.split(F.regexp_replace(hit, f"(?s)^.*?(?:{pattern}).*$", "\x01".join(f"${g}" for g in range(1, n + 1))), "\x01")
    return once(parts, lambda parts: use(lambda g: F.get(parts, g - 1)))


def _told(low: Column, high: Column, currency: Column, period: Column) -> Column:
    return F.struct(F.least(low, high).alias("low"), F.greatest(low, high).alias("high"), currency.alias("currency"), period.alias("period"))


def _stated(hit: Column) -> Column:
    def told(at: Callable[[int], Column]) -> Column:
        a, b = _number(at(3), at(4)), F.when(at(6) != "", _number(at(6), at(7))).otherwise(_number(at(3), at(4)))
        code = F.upper(F.coalesce(*[F.nullif(at(g), F.lit("")) for g in (1, 5, 8)]))
        symbol = F.when(at(2) == "€", "EUR").when(at(2) == "£", "GBP").when(at(2) == "$", "XXX")
        period = F.coalesce(*[F.when(F.lower(at(9)).isin(words.split("|")), name) for name, words in PERIODS.items()])
        return _told(a, b, F.coalesce(code, symbol), period)

    return _groups(hit, STATED, 9, told)


def _labelled(hit: Column) -> Column:
    def told(at: Callable[[int], Column]) -> Column:
        a, b = _number(at(4), at(5)), F.when(at(6) != "", _number(at(6), at(7))).otherwise(_number(at(4), at(5)))
        code = F.upper(F.coalesce(*[F.nullif(at(g), F.lit("")) for g in (2, 8)]))
        symbol = F.when(at(3) == "€", "EUR").when(at(3) == "£", "GBP").otherwise("XXX")
        period = F.when(F.lower(at(1)).rlike("^(?:annual|yearly)"), "annual").otherwise(F.lower(at(1)))
        return _told(a, b, F.coalesce(code, symbol), period)

    return _groups(hit, LABELLED, 8, told)


def pay_ranges(text: Column) -> Column:
    """array<struct<low, high, currency, period>> of all pay that a text states with a period, behind the amounts or in a label before them, distinct and sorted.

    A bare dollar sign is an unknown currency (XXX). Segments that name several currencies or speak of bonuses and
    stipends are passed over. Dollars must be plausible (5 to 500 an hour, 10,000 to 1,000,000 a year); other money is
    never converted. A single value that is an end of a range of the same period goes. Null and empty texts have none.
    """
    segments = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\bUS\$", "USD \\$"), r"(?<=[.;])\s+|\s*[;\n]\s*")
    codes = lambda s: F.size(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(rf"(?i)\b({CODES})\b"), F.lit(1)), F.upper)))
    told = F.filter(segments, lambda s: s.rlike("[0-9]") & s.rlike(_PERIOD_HINT) & ~s.rlike(NO_PAY) & (codes(s) <= 1))
    found = F.flatten(F.transform(told, lambda s: F.concat(F.transform(F.regexp_extract_all(s, F.lit(STATED), F.lit(0)), _stated), F.transform(F.regexp_extract_all(s, F.lit(LABELLED), F.lit(0)), _labelled))))
    usd = lambda x, low, high: (x["low"] >= low) & (x["high"] <= high)
    plausible = lambda x: F.when(x["currency"] != "USD", (x["low"] > 0) & (x["high"] <= 1_000_000_000)).when(x["period"] == "hourly", usd(x, 5, 500)).when(x["period"] == "annual", usd(x, 10_000, 1_000_000)).otherwise((x["low"] > 0) & (x["high"] <= 1_000_000))
    kept = F.array_sort(F.array_distinct(F.filter(found, lambda x: x["currency"].isNotNull() & plausible(x))))
    wider = lambda x, r: (r["low"] < r["high"]) & (r["period"] == x["period"]) & ((r["currency"] == x["currency"]) | (x["currency"] == "XXX")) & ((x["low"] == r["low"]) | (x["low"] == r["high"]))
    ranges = once(kept, lambda kept: F.filter(kept, lambda x: (x["low"] < x["high"]) | ~F.exists(kept, lambda r: wider(x, r))))
    return F.when(text.rlike("[0-9]") & text.rlike(_PERIOD_HINT), ranges).otherwise(F.array().cast("array<struct<low:double,high:double,currency:string,period:string>>"))
