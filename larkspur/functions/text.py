"""Company and title keys, search text, HTML and Markdown to text, redaction, truncation, links."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Corporate suffixes that a company key drops.
FIXED_SUFFIXES = "co|company|corp|corporation|inc|incorporated|limited|llc|ltd|plc"
#: One more that this engine adds.
SUFFIXES = f"{FIXED_SUFFIXES}|gmbh"


def _table(form: str, drop_marks: bool) -> tuple[str, str, dict[str, str]]:
    """What Unicode's compatibility form makes of single characters: those that become one, beside what they become, and those that become several with an ASCII letter or digit among them."""
    ones, becomes, several = [], [], {}
    for k in (*range(0x80, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(k)
        d = unicodedata.normalize(form, c)
        if drop_marks:
            d = "".join(x for x in d if not "\u0300" <= x <= "\u036f")
        if d != c and len(d) == 1 and (not drop_marks or d.isascii()):
            ones.append(c)
            becomes.append(d)
        elif len(d) > 1 and any(x.isascii() and x.isalnum() for x in d):
            several[c] = d
    gone = [chr(k) for k in range(0x300, 0x370)] if drop_marks else []
    return "".join(ones + gone), "".join(becomes), several


_TABLES = {"NFKD": _table("NFKD", True), "NFKC": _table("NFKC", False)}


def _formed(text: Column, form: str) -> Column:
    ones, becomes, several = _TABLES[form]
    x = F.translate(text, ones, becomes)
    pairs = F.create_map(*[F.lit(y) for pair in several.items() for y in pair])
    long = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")
    return F.when(F.octet_length(text) == F.char_length(text), text).when(x.rlike(f"[{''.join(several)}]"), long).otherwise(x)  # ASCII stays as it is


def fold_marks(text: Column) -> Column:
    """Letters and digits in Unicode's compatible, decomposed form without combining marks, as far as that is ASCII: marked, full-width and styled letters, ligatures. Others are left."""
    return _formed(text, "NFKD")


def compatible(text: Column) -> Column:
    """Characters in Unicode's compatible, composed form, each by itself: full-width and styled ones, ligatures; marks stay as they are written."""
    return _formed(text, "NFKC")


def terms(text: Column) -> Column:
    """Lower-case ASCII terms."""
    return F.filter(F.split(F.lower(fold_marks(text)), "[^a-z0-9]+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Distinct pieces between ASCII characters that no term has; their terms are the text's."""
    return F.array_distinct(F.split(text, r"[\x00-/:-@\[-`{-\x7f]+"))


def company_key(name: Column) -> Column:
    """Terms without trailing corporate suffixes; at least one term stays."""
    plain = F.array_join(terms(name), " ")
    return F.regexp_replace(plain, rf"(?<=\S)(?: (?:{SUFFIXES}))+$", "")


def title_terms(title: Column) -> Column:
    """Distinct terms, sorted."""
    return F.array_sort(F.array_distinct(terms(title)))


def fingerprint(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def html_to_text(html: Column) -> Column:
    """Text of a page: scripts, styles and comments go, blocks become line breaks, entities are decoded once."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)<(?:/p|/div|/li|/h[1-6]|br\s*/?|/tr)\s*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n"))


def markdown_to_text(text: Column) -> Column:
    """Links keep their words, images their alternative text; emphasis, code and heading marks go."""
    x = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"(?m)^#{1,6}\s+", "")
    return F.trim(F.regexp_replace(x, r"[*_`~]+", ""))


def links(text: Column) -> Column:
    """Distinct addresses in order, without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"https?://[^\s<>\"')\]]+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def redact(text: Column, most: int = 500) -> Column:
    """Safe diagnostics: addresses, mail addresses and secrets masked, length bounded."""
    x = F.regexp_replace(text, r"https?://\S+", "[url]")
    x = F.regexp_replace(x, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[email]")
    x = F.regexp_replace(x, r"(?i)\b(token|secret|key|password)\s*[=:]\s*\"?[A-Za-z0-9_-]{8,}\"?", "$1=[secret]")
    return F.left(x, F.lit(most))


def bounded(text: Column, most: int, least_share: float = 0.65) -> Column:
    """At most `most` characters, cut at a blank if that keeps enough of them."""
    head = F.left(text, F.lit(most))
    at = F.char_length(head) - F.instr(F.reverse(head), " ")
    return F.when(F.char_length(text) <= most, text).when((F.instr(head, " ") > 0) & (at >= int(most * least_share)), F.left(head, at)).otherwise(head)


def search_text(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


def mask_path(path: Column) -> Column:
    """Path segments with numbers and uuids masked."""
    uuid = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(s.rlike(r"^[0-9]+$"), ":number").when(F.lower(s).rlike(uuid), ":uuid").otherwise(s)), "/")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is met inside, also in functions over arrays."""
    return F.get(F.transform(F.array(value), use), 0)
