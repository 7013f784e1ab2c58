"""Classes told by patterns: job categories, focuses, lifecycle and requirement signals, failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 17 job categories and their patterns.
CATEGORIES = {
    "ai-ml": r"\b(ai|artificial intelligence|machine learning|ml|data scien(?:ce|tist)|deep learning|nlp|computer vision|generative ai|llm)\b",
    "grad": r"\b(graduate|grad|master'?s|ph\.?d\.?|mba)\b",
    "swe": r"\b(software|swe|backend|frontend|full[ -]?stack|developer)\b",
    "quant": r"\b(quant|quantitative|trading|trader|research)\b",
    "product": r"\b(product manager|product management|pm)\b",
    "design": r"\b(design|ux|ui|user experience)\b",
    "general-engineering": r"\b(?:engineering (?:intern|co-?op|rotation)|engineering rotation(?: intern)?|project engineer)\b",
    "mechanical": r"\b(?:mechanical|thermal|fluid(?:s| dynamics)?|hvac)\b",
    "electrical": r"\b(?:electrical|electronics?|rf|power systems?|instrumentation)\b",
    "aerospace": r"\b(?:aerospace|aerodynamic|propulsion|flight|space systems?)\b",
    "civil": r"\b(?:civil|structural|transportation|geotechnical|construction)\b",
    "chemical-materials": r"\b(?:chemical|process engineer|materials?|polymers?|metallurgy|batter(?:y|ies))\b",
    "industrial-manufacturing": r"\b(?:industrial|manufacturing|production|tooling|automation)\b",
    "biomedical": r"\b(?:biomedical|bioengineering|medical devices?)\b",
    "environmental-energy": r"\b(?:environmental|renewable energy|utilities)\b",
    "systems-test": r"\b(?:systems?|integration|test|validation|verification|reliability|safety|quality)\b",
    "technical-operations": r"\b(?:engineering technician|technologist|cad|drafting|laboratory technician|technical apprenticeship)\b",
}

# Patterns of the signals that a title marks an early-career role, and of two stated requirements.
LIFECYCLE = (
    r"\b(?:interns?(?:hips?)?|co[ -]?ops?|cooperative education|apprentices?(?:hips?)?)\b",
    r"\bnew ?grad(?:uate)?s?\b",
    r"\b(?:university|campus|college)[ -](?:graduate|hire|programme?|program)\b",
    r"\bgraduate[ -](?:programme?|program|scheme|rotation(?:al)?|analyst|engineer\w*|developer|trainee|role|opportunit\w+)\b",
    r"\b(?:early[ -]career|entry[ -]level|working student|placement (?:year|student|programme?)|year in industry)\b",
)
CITIZEN = r"(?:u\.?s\.?|united states)\s+citizens?"
DEGREE = r"(?:advanced degree|master'?s|ph\.?d\.?|doctorate|mba)"

# The pattern of each failure, in the order in which they are tried; the first category comes from none of them.
FAILURE_ELSE = "persistence"
FAILURES = (
    ("transport", r"application (?:link|page)(?: body)? (?:timed out|could not be reached)"),
    ("link", r"application link|application page (?:returned|redirected|reports)|application host|eligible .* link"),
    ("json", r"shape|schema|malformed json"),
    ("quality", r"quality|suspicious zero-row"),
    ("capacity", r"exceeded(?: cpu| memory)?|resource limit|too much cpu|out of memory|memory limit|response body too large|too many jobs|no browser available"),
    ("transport", r"timeout|timed out|aborted|fetch|network|socket|econn"),
    ("transport", r"d1 statement did not settle"),
)


def _says(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def categories(text: Column) -> Column:
    """All job categories that a title belongs to, in the table's order."""
    return F.array_compact(F.array(*[F.when(_says(text, p), name) for name, p in CATEGORIES.items()]))


def early_career(title: Column) -> Column:
    """Whether a title marks an internship, a graduate programme or another early-career role."""
    return _says(title, "|".join(LIFECYCLE))


def requires(text: Column, what: str) -> Column:
    """Whether a sentence of the text demands `what`: a demand up to 120 characters before it, or up to 80 behind."""
    return _says(text, rf"\b(?:must|requires?|requirement|eligible only)\b[^.]{{0,120}}{what}") | _says(text, rf"{what}[^.]{{0,80}}\b(?:required|must)\b")


def requires_citizenship(text: Column) -> Column:
    """Whether a sentence demands citizenship, or takes nobody but citizens: `only` up to 120 characters before them, or up to 80 behind."""
    return requires(text, CITIZEN) | _says(text, rf"\bonly\b[^.]{{0,120}}{CITIZEN}") | _says(text, rf"{CITIZEN}[^.]{{0,80}}\bonly\b")


def failure_category(message: Column) -> Column:
    """The category of a failure's message: the first pattern that it meets."""
    tried = F
    for name, pattern in FAILURES:
        tried = tried.when(_says(message, pattern), name)
    return tried.otherwise(FAILURE_ELSE)
