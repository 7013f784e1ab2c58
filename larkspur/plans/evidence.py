"""What a posting states about its role, as one struct: from its sections, its structured fields and its title.

Everything is built-in expressions over one row, without Python; only texts that come many times are first made distinct, on demand.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions import extract, money, text
from larkspur.storage import written

# Page statements of where work is done, what makes them conditional, and what states a deadline.
_LABELLED_MODE = r"(?i)\b(?:work(?:place| location| arrangement)?|location type|work mode)\s*(?::|\n)\s*(remote|hybrid|on[ -]?site|in[ -]?person)\b"
_ASSERTED_MODE = r"(?i)\b(?:this|the)\s+(?:role|position|job|internship)\s+is\s+(?:a\s+full[ -]time\s+position,?\s+|based\s+|a\s+|fully\s+){0,2}(remote|hybrid|on[ -]?site|in[ -]?person)\b"
#: What a text has that states a mode, and one that states a deadline.
_MODE_HINT, _DUE_HINT = r"(?i)remote|hybrid|on[ -]?site|in[ -]?person", r"(?i)rolling|deadline|close|apply by|submitted by"
_HEDGED = r"(?i)\b(?:not|may|might|could|would|depending|conditional(?:ly)?|potentially|if|unless|subject to)\b"
_ROLLING = r"(?i)\bapplications?\s+(?:are\s+)?(?:reviewed|accepted|considered|processed) on (?:a )?rolling basis\b"
_NOT_ROLLING = r"(?i)\b(?:no applications?|not|never|only if|if|unless|subject to|may|might|could)\b"
_DEADLINE = r"(?i)\b(?:(?:application )?(?:deadline|closes?|apply by)|applications? (?:must be )?submitted by)\b"
_LOCATION = r"(?i)\b(?:job\s+)?locations?\s*(?::|\n)\s*([^.;|\n]{2,120})"
_POSTED, _UPDATED = r"(?i)\b(?:date posted|posted(?: on)?)\s*:\s*([^.;\n]{8,50})", r"(?i)\b(?:last updated|updated(?: on)?)\s*:\s*([^.;\n]{8,50})"
_EDUCATION = r"(?i)\b(?:bachelor|undergrad|four[ -]?year|master|graduate student|mba|ph\.?d\.?|doctoral?|graduat(?:e|ing|ion)|class of)\b"
_SEASON = r"(?i)\b(?:spring|summer|fall|winter)\s*(?:intern(?:ship)?\s*)?20\d{2}\b"

#: A line of its own that ends with a colon, or a heading of Markdown, opens a section; a label has at most 80 characters.
HEADING = r"(?m)^[ \t]*(?:#{1,6}[ \t]+[^\n]{1,80}|[^\n:.;]{1,80}:[ \t]*)$"
#: What a text with a heading has.
_HEADED = r"(?m)^[ \t]*#{1,6}[ \t]|:[ \t]*$"
#: Excerpts and labels are bounded by their feature.
EXCERPT, LABEL = 240, 120
_CONTROLS = r"[\x00-\x08\x0b-\x1f]"
DEADLINE = "struct<kind:string,date:date>"
#: What a posting may state, and which of it are arrays.
FIELDS = ("pay", "housing", "levels", "minimum_degree", "graduation", "season", "locations", "work_mode", "deadline", "posted", "updated")
MANY = ("pay", "housing", "levels", "locations", "title_levels")
#: Bytes of distinct texts and what they state that may be broadcast, and about what is stated beside each text.
FEW_BYTES, TOLD_BYTES = 96 << 20, 512


def _lines(value: Column) -> Column:
    """Line feeds only, and no controls but those and tabs."""
    fed = F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(fed.rlike(_CONTROLS), F.regexp_replace(fed, _CONTROLS, "")).otherwise(fed)


def sections(value: Column) -> Column:
    """array<struct<label, start, text>>: what stands before the first heading (label null), then each heading's text.

    `start` is the place of the section, its heading included, in code points from 0. Sections follow one another
    without a gap. A null or empty text has none.
    """
    whole = F.coalesce(value, F.lit(""))
    heading = lambda p: F.regexp_extract(F.substring_index(p, "\n", 1), HEADING, 0)
    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    label = lambda h: F.left(F.trim(F.regexp_replace(h, r"^[ \t]*#{1,6}|:?[ \t]*$", "")), F.lit(LABEL))
    piece = lambda p, h, start: F.struct(F.when(h != "", label(h)).alias("label"), start.alias("start"), stripped(F.when(h == "", p).otherwise(F.substr(p, F.char_length(h) + 1))).alias("text"))

    def placed(pieces: Column, lengths: Column) -> Column:
        start = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, n: a + n)
        return F.transform(pieces, lambda p, i: text.once(heading(p), lambda h: piece(p, h, start(i))))

    several = text.once(_pieces(whole), lambda pieces: text.once(F.transform(pieces, lambda p: F.char_length(p)), lambda lengths: placed(pieces, lengths)))
    one = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.lit(0).alias("start"), stripped(whole).alias("text")))
    return F.when(whole.rlike(_HEADED), several).when(whole != "", one).otherwise(F.slice(one, 1, 0))


def _pieces(whole: Column) -> Column:
    return F.filter(F.split(whole, f"(?={HEADING})"), lambda p: p != "")


def content_hash(title: Column, description: Column, most_bytes: int = 200_000) -> Column:
    """struct<complete, hash> of a title and a description with line feeds only and without controls.

    The hash is SHA-256 of {title, description, completeness} as JSON. A description beyond `most_bytes` of UTF-8 is
    hashed up to there, at a whole character, and said to be incomplete.
    """
    lines = _lines(description)
    fits = F.octet_length(lines) <= most_bytes
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(lines, "utf-8"), 1, most_bytes).cast("string")), "�+$", "")
    told = F.struct(F.trim(_lines(title)).alias("title"), F.when(fits, lines).otherwise(cut).alias("description"), F.when(fits, "complete").otherwise("incomplete").alias("completeness"))
    return F.struct(fits.alias("complete"), F.sha2(F.to_json(told), 256).alias("hash"))


def _mode(found: Column) -> Column:
    m = F.lower(found)
    return F.when(m == "remote", "remote").when(m == "hybrid", "hybrid").when(m.rlike(r"^(?:on|in)[ -]?"), "onsite")


def page_work_mode(value: Column) -> Column:
    """remote, hybrid or onsite by a label, else by a sentence that asserts it of this role without condition."""
    asserted = F.filter(F.split(value, r"[.!?;\n]"), lambda s: s.rlike(_ASSERTED_MODE) & ~s.rlike(_HEDGED))
    told = text.once(F.regexp_extract(value, _LABELLED_MODE, 1), lambda labelled: F.when(labelled != "", labelled).otherwise(F.regexp_extract(F.get(asserted, 0), _ASSERTED_MODE, 1)))
    return F.when(value.rlike(_MODE_HINT), text.once(told, _mode))


def _sentences(value: Column) -> Column:
    return F.split(value, r"(?<=[.!?;\n])\s+")


def deadline(value: Column) -> Column:
    """struct<kind, date>: the first sentence that states a rolling basis without condition, or a deadline with a date."""
    dated = lambda s: F.struct(F.lit("date").alias("kind"), extract.stated_date(s).alias("date"))
    rolling = F.struct(F.lit("rolling").alias("kind"), F.lit(None).cast("date").alias("date"))
    said = lambda s: F.when(s.rlike(_ROLLING), F.when(~s.rlike(_NOT_ROLLING), rolling)).when(s.rlike(_DEADLINE), dated(s))
    told = F.filter(F.array_compact(F.transform(_sentences(value), said)), lambda d: (d["kind"] == "rolling") | d["date"].isNotNull())
    return F.when(value.rlike(_DUE_HINT), F.get(told, 0).cast(DEADLINE))


def _labelled(ranges: Column, label: Column) -> Column:
    return F.transform(ranges, lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high"), r["currency"].alias("currency"), r["period"].alias("period"), label.alias("label")))


def _section_pay(pieces: Column) -> Column:
    """array<struct<low, high, currency, period, label>> of what each section states."""
    return F.flatten(F.transform(pieces, lambda s: _labelled(money.pay_ranges(s["text"]), s["label"])))


def labelled_pay(found: Column) -> Column:
    """Pay of sections and fields, distinct and sorted. An amount without a label goes where the same one, of an equal or an unknown currency, has one."""
    same = lambda x, r: r["label"].isNotNull() & (r["low"] == x["low"]) & (r["high"] == x["high"]) & (r["period"] == x["period"]) & ((r["currency"] == x["currency"]) | (x["currency"] == "XXX"))
    return text.once(found, lambda found: F.array_sort(F.array_distinct(F.filter(found, lambda x: x["label"].isNotNull() | ~F.exists(found, lambda r: same(x, r))))))


def _told(texts: DataFrame, name: str) -> DataFrame:
    """What each text states by itself, as columns `_field`; `_pay` still with what its labelled twin makes superfluous."""
    read = texts.withColumn("_text", _lines(F.col(name))).withColumn("_pieces", sections(F.col("_text")))
    body = F.col("_text")
    place = F.trim(F.regexp_extract(body, _LOCATION, 1))
    fields = {
        "sections": F.size("_pieces"), "pay": _section_pay(F.col("_pieces")), "housing": extract.housing_kinds(body), "levels": extract.education_levels(body), "minimum_degree": extract.minimum_degree(body), "graduation": extract.graduation_window(body),
        "season": extract.stated_season(body), "locations": F.when((place != "") & ~place.rlike(r"(?i)^(?:remote|hybrid|on[ -]?site|in[ -]?person)$"), F.array(place)).otherwise(F.array().cast("array<string>")),
        "work_mode": page_work_mode(body), "deadline": deadline(body), "posted": extract.stated_date(F.regexp_extract(body, _POSTED, 1)), "updated": extract.stated_date(F.regexp_extract(body, _UPDATED, 1)),
    }
    return read.withColumns({f"_{k}": v for k, v in fields.items()}).drop("_text", "_pieces")


def _told_once(rows: DataFrame, name: str) -> DataFrame:
    """Rows with what their texts state, each distinct text read once. What was told is written; few bytes of it are broadcast, more are joined by shuffle.

    Reading a text takes far longer than moving it, so few bytes of texts are dealt out to all cores too.
    """
    texts = rows.select(name).distinct().repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, name)
    told = written(_told(texts, name), "texts")
    few = (told.agg(F.sum(F.octet_length(name) + TOLD_BYTES)).first()[0] or 0) <= FEW_BYTES
    return rows.join(F.broadcast(told) if few else told, name)


def with_statements(rows: DataFrame, title: str = "title", description: str = "description", pay: str | None = None, due: str | None = None, mode: str | None = None, alike: bool = False) -> DataFrame:
    """Rows with what the posting states, each field a column of its own.

    They are `_` and a name of FIELDS, `_sections` (their number), `_excerpts` (by field), `_title_levels`,
    `_title_season` and `_title_work_mode` (what the title alone tells) and `_stated`, whether there is anything.
    The rest is as in `with_evidence`. With `alike`, texts that come many times are read once; the rows are then
    worked out twice, so they should be cheap.
    """
    column = lambda name: F.coalesce(F.col(name), F.lit("")) if name else F.lit("")
    rows = rows.withColumn("_said", F.coalesce(F.col(description), F.lit("")))
    said = (_told_once if alike else _told)(rows, "_said").withColumn("_title", F.trim(_lines(F.col(title))))
    head, at = F.col("_title"), lambda name: F.col(f"_{name}")
    both = F.concat(head, F.lit("\n"), _lines(F.col("_said")))
    alone = {"title_levels": extract.education_levels(head), "title_season": extract.stated_season(head), "title_work_mode": _mode(F.regexp_extract(head, r"(?i)\b(remote|hybrid|on[ -]?site)\b", 1))}
    said = said.withColumns({f"_{k}": v for k, v in alone.items()})
    # the first season of both begins in the title if it has the word of one; only its year may stand in the text then
    season = F.when(at("title_season").isNotNull(), at("title_season")).when(head.rlike("(?i)spring|summer|fall|winter"), extract.stated_season(both)).otherwise(at("season"))
    found = F.concat(at("pay"), _labelled(money.pay_ranges(column(pay)), F.lit(None).cast("string"))) if pay else at("pay")
    merged = {"season": season, "pay": F.when(F.size(found) > 1, labelled_pay(found)).otherwise(found)}
    if due:
        date = extract.stated_date(column(due))
        given = F.when(column(due).rlike(r"(?i)\brolling\b"), F.struct(F.lit("rolling").alias("kind"), F.lit(None).cast("date").alias("date"))).when(date.isNotNull(), F.struct(F.lit("date").alias("kind"), date.alias("date")))
        merged["deadline"] = F.coalesce(given.cast(DEADLINE), at("deadline"))
    if mode:
        merged["work_mode"] = F.coalesce(_mode(F.regexp_extract(column(mode), r"(?i)\b(remote|hybrid|on[ -]?site|in[ -]?person)\b", 1)), at("work_mode"))
    said = said.withColumns({f"_{k}": v for k, v in merged.items()})
    education = (F.size(at("levels")) > 0) | at("minimum_degree").isNotNull() | at("graduation").isNotNull()
    excerpt = lambda pattern: text.once(F.trim(F.get(F.filter(_sentences(both), lambda s: s.rlike(pattern)), 0)), lambda s: text.bounded(s, EXCERPT))
    excerpts = {"education": F.when(education, excerpt(_EDUCATION)), "season": F.when(at("season").isNotNull(), excerpt(_SEASON)), "deadline": F.when(at("deadline").isNotNull(), excerpt(rf"{_DEADLINE}|\brolling\b"))}
    held = F.map_filter(F.create_map(*[x for k, v in excerpts.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    any_of = lambda names: reduce(or_, [F.size(at(k)) > 0 if k in MANY else at(k).isNotNull() for k in names])
    return said.withColumns({"_excerpts": held, "_stated": any_of((*FIELDS, *alone))}).drop("_said", "_title")


def with_evidence(rows: DataFrame, title: str = "title", description: str = "description", pay: str | None = None, due: str | None = None, mode: str | None = None, into: str = "evidence", alike: bool = False) -> DataFrame:
    """Rows with one struct of what the posting states; null where it states nothing.

    Its fields: pay, housing, levels, minimum_degree, graduation, season, locations, work_mode, deadline, posted,
    updated, excerpts (by field) and from_title, a record of its own that holds what the title alone tells (levels,
    season, work_mode), so that a word in a title never has a page's authority. `pay`, `due` and `mode` name columns
    of structured fields, which come before the text's statements for deadline and mode and beside them for pay.
    Null texts count as empty.
    """
    said = with_statements(rows, title, description, pay, due, mode, alike)
    at = lambda name: F.col(f"_{name}")
    by_title = {k: at(f"title_{k}") for k in ("levels", "season", "work_mode")}
    of_title = F.when((F.size(by_title["levels"]) > 0) | by_title["season"].isNotNull() | by_title["work_mode"].isNotNull(), F.struct(*[v.alias(k) for k, v in by_title.items()]))
    whole = F.struct(*[at(k).alias(k) for k in FIELDS], at("excerpts").alias("excerpts"), of_title.alias("from_title"))
    return said.select(*rows.columns, F.when(at("stated"), whole).alias(into))
