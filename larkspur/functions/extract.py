"""What titles and descriptions say: titles to show and to search, disciplines, degrees, programmes, housing, graduation, closure.

All are built-in expressions. Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import compatible, fold_marks, once

# Disciplines and their patterns.
DISCIPLINES = {
    "ai-ml": r"\b(?:ai|artificial intelligence|machine learning|ml|deep learning)\b",
    "data": r"\b(?:data|analytics|business intelligence)\b",
    "infrastructure-cloud": r"\b(?:infrastructure|cloud|platform|devops|site reliability|sre)\b",
    "security": r"\b(?:security|cybersecurity|infosec)\b",
    "quant": r"\b(?:quant|quantitative|trading)\b",
    "product": r"\b(?:product manager|product management)\b",
    "technical-design": r"\b(?:product design|ux|ui|designer)\b",
    "software": r"\b(?:software|developer|engineering|engineer|frontend|backend|full stack|mobile)\b",
}

# Stated programmes, in the order in which they are tried. "" stands for none.
PROGRAMMES = (
    ("co-op", r"\b(?:co[ -]?ops?|cooperative education|working student|student worker|part[ -]time student|student placement|industrial placement|werkstudent\w*)\b"),
    ("apprenticeship", r"\bapprentices?(?:hips?)?\b"),
    ("internship", r"\b(?:interns?(?:hips?)?|stagiaire\w*|stagiair\w*|praktikant\w*|pflichtpraktikum|praktikum|tirocinio|summer placement)\b"),
    ("new-grad", r"\b(?:new[ -]?grad(?:uate)?s?|graduate (?:(?:software |data |mechanical |electrical )?engineer\w*|program(?:me)?|scheme|trainee|analyst|developer)|(?:university|college|campus)[ -](?:hire|graduate|program(?:me)?))\b"),
    ("", r"\b(?:early[ -]career|campus|university)\b.{0,35}\b(?:talent|recruit\w*)\b"),
    ("entry-level", r"\b(?:early[ -]career|entry[ -]level|placement (?:year|student)|year in industry)\b"),
)

# What follows a degree, what states an audience, what demotes or waives a degree, and form controls.
_NOUN = r"(?:degrees?|program(?:me)?s?|students?|candidates?|studies|thesis|course(?:work)?|level)"
_AUDIENCE = r"\b(?:degrees?|program(?:me)?s?|students?|candidates?|studies|thesis|course(?:work)?|standing|education|qualifications?|pursuing|enrolled|enrolment|enrollment|open to|eligible|eligibility|requirements?|required|must|class of|applicants?)\b"
_DEMOTED = r"\b(?:preferred|preferably|a plus|nice to have|desirable|ideally|bonus|advantage(?:ous)?)\b"
_WAIVED = r"\b(?:not required|need not|no\s+(?:[\w'-]+\s+){0,3}degree\s+(?:is\s+)?required)\b"
_CONTROL = r"\bplease\s+(?:select|indicate|choose|enter)\b|\bselect\s*\.{2,}|\.{2,}\s*select\b|\bdegree\s+of\s+study\b"

# The patterns of each level. Capital abbreviations stand alone, others need a word behind them.
LEVELS = {
    "undergraduate": rf"(?i:\b(?:undergrad(?:uate)?s?|bachelor(?:'s|s)?|college students?|university students?|(?:four|4)[ -]?year(?: college| university)? degree)\b)|(?<![\w.])(?:BSc|B\.Sc\.|BS|B\.S\.|BA|B\.A\.)(?![\w.])|(?i:(?<![\w.])(?:bsc|bs|ba)\s+(?:{_NOUN}|in\s+\w+))",
    "masters": rf"(?i:\bmaster'?s\s+(?:{_NOUN}|of\s+\w+|in\s+\w+))|(?i:\bmaster\s+(?:of|{_NOUN}))|(?i:\bgraduate\s+(?:students?|program(?:me)?s?|degree|level|coursework))|(?<![\w.])(?:MSc|M\.Sc\.|MS|M\.S\.|MA|M\.A\.)(?![\w.])|(?i:(?<![\w.])(?:msc|ms|ma)\s+(?:{_NOUN}|in\s+\w+))",
    "mba": r"(?i:\bm\.?b\.?a\.?s?\b)",
    "doctoral": r"(?i:\b(?:ph\.?\s?d\.?(?!\w)|doctorates?|doctoral)\b)",
}
#: What a part of a text has in which one of the levels is found.
_LEVEL_HINT = r"(?i)undergrad|bachelor|master|graduate|doctora|(?:college|university) student|year|ph\.?\s?d|m\.?b\.?a|(?<![\w.])[bm]\.?(?:sc?|a)(?!\w)"
_BARE_MASTERS = rf"(?<![\w.'])master'?s?\b(?=\s*(?:$|[,;)]|/|or\b|and\b|in\b|of\b|preferred\b|required\b|{_NOUN}))"

# Degrees from the highest to the lowest, as a demand names them.
DEGREES = (("doctoral", r"(?:ph\.?d\.?|doctoral?|doctorate)"), ("masters", r"master(?:'s|s)?"), ("bachelors", r"bachelor(?:'s|s)?"), ("associates", r"associate(?:'s|s)?"))
_ANY_DEGREE = r"(?:associate(?:'s|s)?|bachelor(?:'s|s)?|master(?:'s|s)?|ph\.?d\.?|doctorate|doctoral)"
_OR_DEGREES = rf"\b{_ANY_DEGREE}(?:\s+degree)?\s+(?:or|and/or)\s+{_ANY_DEGREE}(?:\s+degree)?"
_HIGH_SCHOOL = r"\bhigh school diploma\s+(?:is\s+)?required\b|\bminimum[^.;]{0,30}\bhigh school\b"

# Housing clauses that say nothing of the benefit, and the kinds of benefit in the order in which they are tried.
_HOUSING = r"\b(?:housing|accommodation|rent)\b"
_NOT_HOUSING = r"\b(?:reasonable accommodation|disabilit(?:y|ies)|accessibility|interviews?)\b"
HOUSING_KINDS = (
    ("stipend", r"\b(?:stipend|allowance)\b", None),
    ("employer-paid", r"\b(?:free|company[ -]paid|employer[ -]paid)\s+(?:housing|accommodation)\b|\b(?:housing|accommodation|rent)(?:\s+(?:is|are|will be|provided|costs?))*\s+(?:free|at no cost|fully covered by (?:us|the company)|paid for by (?:us|the company))\b", None),
    ("employee-cost", r"\b(?:you|interns?|employees?|residents?)\s+(?:must |will )?(?:pay|cover)\s+(?:for |their )?(?:housing|accommodation|rent)\b|\b(?:housing|accommodation|rent)\s+(?:costs?|charges?)\s*:?\s*(?:[A-Z]{3}\s*)?[$€£]\s*\d", r"\b(?:covered|reimbursed|reimbursement|assistance)\b"),
    ("available", r"\b(?:housing|accommodation)\s+(?:is |will be )?(?:provided|available)|\b(?:provide|offer)\s+(?:company\s+)?housing\b", r"\b(?:assistance|support|help securing)\b"),
)

# How a page says that its posting is closed, on its own or inside a sentence.
_POSTING = r"(?:job|role|position|opening)"
CLOSED = rf"^(?:this {_POSTING} is )?no longer accepting applications\b|^(?:(?:this|the) )?{_POSTING} (?:filled|expired|closed)[.!]?$|^no longer available[.!]?$|\b(?:this|the) {_POSTING} (?:has(?: been)?|is|was) (?:filled|expired|closed|no longer available)\b|\b(?:this|the) {_POSTING} is no longer accepting applications\b|\bwe (?:are|'?re) no longer accepting applications for (?:this|the) {_POSTING}\b"

# Months and the month that a season's graduation falls in.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SEASON_MONTH = {"winter": "01", "spring": "05", "summer": "08", "fall": "12", "autumn": "12"}
_MONTH_YEAR = r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)\s+20\d{2}\b"
_SEASON_YEAR = r"(?i)\b(?:Winter|Spring|Summer|Fall|Autumn)\s+20\d{2}\b"
_GRADUATION = r"(?i)\b(?:graduat(?:es|ed|ing|ion)|graduate(?!\s+(?:students?|school|degree|program|intern|level)\b)|class of|degree completion)\b"
#: What a text with a graduation clause has.
_GRADUATION_HINT = "graduat|class of|degree completion"
# What speaks of the job's own time, not of an applicant's.
_HIRING = r"(?i)\b(?:(?<!degree\s)(?<!academic\s)(?:internship|program|role|position|job)\s+(?:starts?|begins?|runs?|occurs?|in)\b|(?:winter|spring|summer|fall)\s+(?:20\d{2}\s+(?:internship|program|role|position|job)|internship\s+20\d{2}))\b"


def _says(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("’"), F.lit("'"))


def _clauses(text: Column) -> Column:
    return F.split(_plain(text), r"(?<=[.!?;])\s+|\n+")


def display_title(title: Column) -> Column:
    """A title without the pictographs that it begins with, blanks squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(compatible(title), r"^[\x{1F000}-\x{1FAFF}\x{2300}-\x{23FF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\s]+", ""), r"\s+", " "))


def search_title(title: Column) -> Column:
    """Lower-case terms of a shown title, with two abbreviations spelt alike; + and # stay."""
    x = F.regexp_replace(F.regexp_replace(F.lower(fold_marks(title)), r"\bswe\b", "software engineer"), r"\binternship\b", "intern")
    return F.trim(F.regexp_replace(x, "[^a-z0-9+#]+", " "))


def disciplines(title: Column) -> Column:
    """All disciplines of a title, in the table's order."""
    return F.array_compact(F.array(*[F.when(_says(title, p), name) for name, p in DISCIPLINES.items()]))


def without_badges(text: Column) -> Column:
    """A name without requirement badges and their phrases, and without the separators that they leave behind."""
    x = F.regexp_replace(text, "\U0001f1fa\U0001f1f8|\U0001f393", " ")
    x = F.regexp_replace(x, r"(?i)(?:us|u\.s\.)\s+citizenship(?:\s+required)?", " ")
    x = F.regexp_replace(x, r"(?i)(?:master'?s|ph\.?d\.?|advanced degree)\s+(?:degree\s+)?required", " ")
    x = F.regexp_replace(x, r"\s*([|·•,;])(?:\s*[|·•,;])+\s*", "$1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"^[\s|·•,;{}-]+|[\s|·•,;{}-]+$", ""), r"\s+", " "))


def programme(title: Column) -> Column:
    """The programme that a title states, or unknown: a plain role is never an internship."""
    tried = F
    for name, pattern in PROGRAMMES:
        tried = tried.when(_says(title, pattern), name or "unknown")
    return tried.otherwise("unknown")


def education_levels(text: Column) -> Column:
    """Sorted levels whose holders or students may apply.

    A sentence states the audience and its segments are the alternatives; segments that only prefer a degree or
    waive it count for nothing, nor do form controls. Only what has a word of a level is looked at any further.
    """
    hinted = lambda x: x.rlike(_LEVEL_HINT)
    sentences = F.filter(F.split(_plain(text), r"\s*\n+\s*|(?<=[.!?])\s+"), lambda s: hinted(s) & ~_says(s, _CONTROL))
    segments = lambda s: F.filter(F.split(s, r"\s*[;|]\s*|\s*,\s*|\s+/\s+"), lambda g: hinted(g) & ~_says(g, _DEMOTED) & ~_says(g, _WAIVED))
    told = F.flatten(F.transform(sentences, lambda s: once(_says(s, _AUDIENCE), lambda audience: F.transform(segments(s), lambda g: F.struct(g.alias("said"), audience.alias("audience"))))))
    bare = lambda t: (t["audience"] & _says(t["said"], _BARE_MASTERS)) | _says(t["said"], r"\(\s*" + _BARE_MASTERS.replace(r"(?<![\w.'])", "", 1))
    has = lambda told, name, p: F.exists(told, lambda t: t["said"].rlike(p) | bare(t) if name == "masters" else t["said"].rlike(p))
    levels = once(told, lambda told: F.array_sort(F.array_compact(F.array(*[F.when(has(told, name, p), name) for name, p in LEVELS.items()]))))
    return F.when(hinted(_plain(text)), levels).otherwise(F.array().cast("array<string>"))


def minimum_degree(text: Column) -> Column:
    """The degree that a text demands; of demanded alternatives the lowest; null without a demand."""
    told = F.filter(_clauses(text), lambda c: ~_says(c, r"\b(?:not required|no\s+(?:[\w'-]+\s+){0,3}degree\s+(?:is\s+)?required)\b"))
    either = lambda told: F.get(F.filter(told, lambda c: _says(c, rf"{_OR_DEGREES}\s+(?:is\s+|are\s+)?required\b|\bmust (?:have|hold|possess)\s+(?:an?\s+)?{_OR_DEGREES}")), 0)

    def lowest(choices: Column) -> Column:
        tried = F
        for name, p in reversed(DEGREES):
            tried = tried.when(_says(choices, rf"\b{p}"), name)
        return tried.otherwise(None)

    def demanded(whole: Column) -> Column:
        tried = F
        for name, p in DEGREES:
            tried = tried.when(_says(whole, rf"\b{p}(?: degree)?\s+(?:is\s+)?required\b|\bmust\s+(?:have|hold|possess)\s+(?:an?\s+)?{p}(?: degree)?\b|\bminimum(?: education| degree)?[^.;]{{0,30}}\b{p}\b"), name)
        return tried.when(_says(whole, _HIGH_SCHOOL), "high-school").otherwise(None)

    choices = lambda told: F.regexp_extract(either(told), rf"(?i)({_OR_DEGREES})", 1)
    found = once(told, lambda told: once(choices(told), lambda of: F.when(of.isNotNull(), lowest(of)).otherwise(once(F.array_join(told, " "), demanded))))
    return F.when(_says(text, "required|must|minimum") & _says(text, r"associate|bachelor|master|ph\.?d|doctora|high"), found)


def housing_kinds(text: Column) -> Column:
    """The kinds of housing benefit that a text's clauses state, each once, in order. Denied ones and other uses of the word are left out."""
    clauses = F.transform(F.split(_plain(text), r"(?<=[.!?;])\s+|\n+|\s*[•|]\s*"), lambda c: F.trim(c))
    said = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?i)\bnot\s+(?:working\s+)?(?:100\s*%|fully|entirely)\s+remote\b", "onsite"), r"(?i)\bat no cost\b", "free")
    about = F.filter(clauses, lambda c: _says(c, _HOUSING) & ~_says(c, _NOT_HOUSING) & ~_says(said(c), r"\b(?:not|no|cannot|unavailable|without)\b"))

    def kind(c: Column) -> Column:
        tried = F
        for name, p, unless in HOUSING_KINDS:
            tried = tried.when(_says(c, p) & (~_says(c, unless) if unless else F.lit(True)), name)
        return tried.otherwise(None)

    return F.when(_says(_plain(text), "housing|accommodation|rent"), F.array_distinct(F.array_compact(F.transform(about, kind)))).otherwise(F.array().cast("array<string>"))


def graduation_window(text: Column) -> Column:
    """struct<start, end> of the months in which a text's graduation clauses lie; whole years where no month is told; null where nothing is.

    What a clause says of the job's own time, before the graduation or behind it, is cut off.
    """
    clauses = F.filter(_clauses(text), lambda c: c.rlike(_GRADUATION))
    first = lambda c, p: F.regexp_instr(c, F.lit(p))
    cut = lambda c, hiring: once(first(c, _GRADUATION), lambda at: F.when(hiring < at, F.substr(c, at)).otherwise(F.left(c, hiring - 1)))
    own = lambda c: once(first(c, _HIRING), lambda hiring: F.when(hiring == 0, c).otherwise(cut(c, hiring)))
    context = F.array_join(F.transform(F.transform(clauses, own), lambda c: F.left(F.get(F.split(c, r"(?i)\b(?:applications? (?:close|deadline)|apply by)\b"), 0), F.lit(400))), " ")
    number = F.create_map(*[F.lit(v) for k, m in enumerate(MONTHS, 1) for v in (m, f"{k:02d}")])
    season = F.create_map(*[F.lit(v) for pair in SEASON_MONTH.items() for v in pair])
    named = lambda context: F.transform(F.regexp_extract_all(context, F.lit(_MONTH_YEAR), F.lit(0)), lambda d: F.concat(F.right(d, F.lit(4)), F.lit("-"), number[F.lower(F.left(d, F.lit(3)))]))
    turns = lambda context: F.transform(F.regexp_extract_all(context, F.lit(_SEASON_YEAR), F.lit(0)), lambda d: F.concat(F.right(d, F.lit(4)), F.lit("-"), season[F.lower(F.regexp_extract(d, r"^(\w+)", 1))]))
    years = lambda context: F.regexp_extract_all(context, F.lit(r"\b20\d{2}\b"), F.lit(0))
    window = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    whole = lambda years: F.when(F.size(years) > 0, window(F.concat(F.array_min(years), F.lit("-01")), F.concat(F.array_max(years), F.lit("-12"))))
    told = lambda context: once(F.concat(named(context), turns(context)), lambda dates: F.when(F.size(dates) > 0, window(F.array_min(dates), F.array_max(dates))).otherwise(once(years(context), whole)))
    return F.when(_says(text, _GRADUATION_HINT) & _says(text, r"20\d{2}"), once(context, told))


def closed(text: Column) -> Column:
    """Whether a page says outright that its posting is closed."""
    return _says(F.trim(F.regexp_replace(_plain(text), r"\s+", " ")), f"(?:{CLOSED})")


def stable_id(provider: Column, tenant: Column, posting: Column, url: Column) -> Column:
    """An id of 32 hex digits for a posting: by provider, tenant and posting number where they are known, else by its address."""
    key = F.when((provider != "unknown") & posting.isNotNull(), F.concat_ws(":", F.lit("provider"), provider, F.coalesce(tenant, F.lit("-")), posting)).otherwise(F.concat(F.lit("url:"), url))
    return F.left(F.sha2(F.concat(F.lit("posting-v1:"), key), 256), F.lit(32))


def destination_class(said: Column) -> Column:
    """The class of an application page, from a struct of evidence.

    Fields: reachability (live, implied, blocked, unreachable, gone), evidence_gone, rule (or null), postings, links, id_present,
    form, truncated, role_matches, generic, on_route, visible. Null counts as false or zero. Contradicting evidence goes before what
    speaks for a single posting; a network failure proves nothing.
    """
    yes = lambda name: F.coalesce(said[name], F.lit(False))
    count = lambda name: F.coalesce(said[name], F.lit(0))
    is_ = lambda name, value: F.coalesce(said[name] == value, F.lit(False))
    single = ~yes("truncated") & (count("postings") == 1)
    exact = yes("id_present") | single | yes("form")
    many = ((count("links") >= 8) & ~(single & yes("role_matches"))) | ((count("links") > 1) & ~exact)
    shown = F.when(yes("form"), "application-form").otherwise("posting-detail")
    proven = F.when(yes("visible"), yes("role_matches") & exact).otherwise(exact | yes("role_matches"))
    route = yes("on_route") & ~is_("rule", "browser-required")
    hidden = is_("rule", "browser-required") & ~yes("visible")
    return (
        F.when(is_("reachability", "gone") | yes("evidence_gone"), "gone")
        .when(is_("rule", "aggregate-board") | yes("generic") | (count("postings") > 1), "aggregate-board")
        .when(many, F.when(yes("truncated") & (count("postings") == 1) & yes("role_matches"), "unresolved").otherwise("aggregate-board"))
        .when(is_("reachability", "unreachable"), "unresolved")
        .when(route, shown)
        .when(is_("reachability", "blocked"), "blocked-uninspectable")
        .when(hidden | ~is_("reachability", "live"), "unresolved")
        .when(proven, shown)
        .otherwise("unresolved")
    )


def stated_season(text: Column) -> Column:
    """struct<term, year> of the first season named with a year (`Summer 2027`, `Summer Internship 2027`) outside of graduation clauses."""
    others = F.array_join(F.filter(_clauses(text), lambda c: ~c.rlike(_GRADUATION)), "\n")
    hit = F.regexp_extract(F.when(_says(text, _GRADUATION_HINT), others).otherwise(text), r"(?i)\b(?:spring|summer|fall|winter)\s*(?:intern(?:ship)?\s*)?20\d{2}\b", 0)
    told = lambda hit: F.when(hit != "", F.struct(F.lower(F.regexp_extract(hit, r"(?i)^([a-z]{4}(?:er|ng)?)", 1)).alias("term"), F.right(hit, F.lit(4)).cast("int").alias("year")))
    return F.when(_says(text, "spring|summer|fall|winter") & _says(text, r"20\d{2}"), once(hit, told))


_MONTH_NAME = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"


def stated_date(said: Column) -> Column:
    """The first full date of a text: 2027-05-01, else May 1st, 2027, else 1 May 2027, else 5/13/2027 where only one order is possible. Null if that one isn't in the calendar."""

    number = F.create_map(*[F.lit(v) for k, m in enumerate(MONTHS, 1) for v in (m, k)])
    iso, named, turned, slash = r"\b(20\d{2}-\d{2}-\d{2})(?!\d)", rf"(?i)\b({_MONTH_NAME})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(20\d{{2}})\b", rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH_NAME})\s+(20\d{{2}})\b", r"\b(\d{1,2})/(\d{1,2})/(20\d{2})\b"
    month = lambda name: number[F.lower(F.left(name, F.lit(3)))]
    written = lambda y, m, d: F.format_string("%s-%02d-%02d", y, m, d.try_cast("int"))

    def either(hit: Column) -> Column:
        part = lambda g: F.regexp_extract(hit, slash, g)
        a, b = part(1).try_cast("int"), part(2).try_cast("int")
        return F.when((a <= 12) & (b > 12), written(part(3), a, b)).when((a > 12) & (b <= 12), written(part(3), b, a))

    def date(text: Column) -> Column:
        """Each form is searched for once, and only where those before it aren't found; the parts come from what was found."""
        found = lambda p, use, other: once(F.regexp_extract(text, p, 0), lambda hit: F.when(hit != "", use(hit)).otherwise(other))
        worded = lambda p, m, d: lambda hit: written(F.regexp_extract(hit, p, 3), month(F.regexp_extract(hit, p, m)), F.regexp_extract(hit, p, d))
        told = found(iso, lambda hit: hit, found(named, worded(named, 1, 2), found(turned, worded(turned, 2, 1), found(slash, either, F.lit(None).cast("string")))))
        return F.when(text.rlike(r"20\d{2}"), F.try_to_date(told, "yyyy-MM-dd"))

    return once(said, date)
