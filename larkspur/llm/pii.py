"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. All of a row's work stays in that row, so nothing is shuffled and a hot
source costs no more than any other rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import text_or_empty

_LOCAL = r"[A-Za-z0-9._%+-]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """How one kind of span is proposed, confirmed and scored.

    Repeats are possessive, which Java matches in a loop instead of by recursion; so texts of any length
    neither overflow the stack nor backtrack. `weight` is the score before context, `words` the context.
    """

    name: str
    pattern: str
    sign: str
    weight: float
    words: str


#: The order is the order of kinds at equal starts; the first four are the base kinds.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"e-?mail|contact|mailto|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7, r"\bip\b|address|host|server|login"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])", "", 0.8, r"card|visa|mastercard|amex|payment|kredit|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"phone|\btel\b|call|mobile|fax|telefon|t.l.phone"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", "", 0.9, r"iban|account|bank|konto|compte|cuenta"),
    Kind("key", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)(?![A-Za-z0-9])", "", 0.9, r"key|secret|credential|access"),
    Kind("secret", r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?(?=[a-z+/_.~-]{0,64}[0-9])[a-z0-9+/_.~-]{8,}+", "", 0.8, r"login|credential|config|export"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"\bssn\b|social security|tax id|taxpayer"),
)
BASE = 4
#: What a context word adds, how far away it may stand, and the least score of a span that is kept.
CONTEXT_BONUS, CONTEXT_CHARS, LEAST_SCORE = 0.3, 48, 0.5
_BLOCK = 256


def _running_sums(xs: Column) -> Column:
    """Sums of all earlier elements, for each element. In blocks, so a long array isn't copied at every step."""
    scan = lambda block, value: F.aggregate(block, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + value(x))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")), lambda b: scan(F.slice(xs, b * _BLOCK + 1, _BLOCK), lambda x: x))
    return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(
        F.flatten(F.zip_with(blocks, F.slice(scan(blocks, lambda b: F.element_at(b, -1)), F.lit(1), F.size(blocks)), lambda block, base: F.transform(F.slice(block, 1, F.greatest(F.size(block) - 1, F.lit(0))), lambda v: v + base)))
    )


def _luhn(match: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(match, "[^0-9]", ""))


def _mod97(match: Column) -> Column:
    """The IBAN check: first four characters moved to the end, letters as 10 to 35, remainder 1."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    digits = F.filter(F.split(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4))), ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(digits, F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def _confirmed(kind: Kind, match: Column) -> Column:
    if kind.name == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind.name == "card":
        return _luhn(match)
    if kind.name == "phone":
        return F.char_length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return _mod97(match) if kind.name == "iban" else F.lit(True)


def _span(place: int, kind: Kind) -> Callable[[Column], Column]:
    """From a match, the texts on its left and right, and what stands before those: the span, its score, and whether a check confirms it."""

    def span(x: Column) -> Column:
        start = x["base"] + F.char_length(x["left"])
        near = F.lower(F.concat_ws(" ", F.right(x["left"], F.lit(CONTEXT_CHARS)), F.left(x["right"], F.lit(CONTEXT_CHARS))))
        score = F.least(F.lit(1.0), F.lit(kind.weight) + F.when(near.rlike(kind.words), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0)))
        return F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(kind.name).alias("kind"), (start + F.char_length(x["hit"])).alias("end"), score.alias("score"), _confirmed(kind, x["hit"]).alias("confirmed"))

    return span


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add `out`: array<struct<start, place, kind, end, score>> of the personal data in each whole text.

    Positions count code points, ends are exclusive, spans go by start and then by kind. Null and empty
    texts have no spans. Repeated rows are judged one by one. Column names beginning with `__pii` are used
    inside; all other columns pass through.
    """
    df = docs.withColumn("__pii_text", text_or_empty(text))
    body = F.col("__pii_text")
    for kind in KINDS:
        hits = F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))
        none = F.array().cast("array<string>")
        df = df.withColumn(f"__pii_h_{kind.name}", F.when(F.contains(body, F.lit(kind.sign)), hits).otherwise(none))
    for place, kind in enumerate(KINDS):
        # What a lambda reads is zipped into its array: an outer column named in a lambda may be computed anew for each element.
        hits, gaps, steps = (F.col(f"__pii_{x}_{kind.name}") for x in "hgn")
        df = df.withColumn(f"__pii_g_{kind.name}", F.when(F.size(hits) > 0, F.split(body, kind.pattern, -1)))
        df = df.withColumn(f"__pii_n_{kind.name}", F.when(F.size(hits) > 0, F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda gap, hit: F.char_length(gap) + F.char_length(hit))))
        zipped = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("left"), F.slice(gaps, 2, F.size(hits)).alias("right"), _running_sums(steps).alias("base"))
        df = df.withColumn(f"__pii_s_{kind.name}", F.when(F.size(hits) > 0, F.transform(zipped, _span(place, kind))))
    kept = [F.coalesce(F.filter(F.col(f"__pii_s_{k.name}"), lambda s: s["confirmed"] & (s["score"] >= LEAST_SCORE)), F.array().cast("array<struct<start:int,place:int,kind:string,end:int,score:double,confirmed:boolean>>")) for k in KINDS]
    spans = F.transform(F.array_sort(F.concat(*kept)), lambda s: s.dropFields("confirmed"))
    return df.withColumn(out, spans).select(*docs.columns, out)


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, all spans, counts of the other kinds and of all, and scores."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    found = find_pii(docs.select("doc_id", "text"))
    pii = F.col("pii")
    count = lambda name: F.size(F.filter(pii, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    counts = [count(k.name) for k in KINDS]
    return found.select(
        "doc_id", *counts[:BASE],
        F.sha2(joined(F.filter(pii, lambda s: s["place"] < BASE)), 256).alias("base_sha256"),
        joined(pii).alias("spans"), *counts[BASE:], F.size(pii).cast("long").alias("n_spans"),
        F.array_join(F.transform(pii, lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
