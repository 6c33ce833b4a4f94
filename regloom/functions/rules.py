"""Rule packs and the classification rules as column expressions.

A rule pack is data: change it, or pass another one, without touching the expressions. Tokens match as substrings of the
lower-cased text, and among rules of equal score the first wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from regloom.functions.text import SPACE, collapse, strip

# Rule packs of the obligation register.
ACTION_WORDS = ("must", "shall", "required", "require", "ensure", "direct", "comply", "submit", "maintain", "establish", "monitor", "assess")
CATEGORY_RULES = (
    ("Risk Management", ("risk", "mitigate", "exposure", "control", "impact")),
    ("Governance", ("board", "committee", "governance", "approval", "management")),
    ("Reporting / Notification", ("notify", "report", "submit", "inform", "disclose")),
    ("Outsourcing / Third Party", ("outsourc", "service provider", "third party", "agreement")),
    ("Legal & Compliance", ("comply", "regulation", "act", "directive", "legislative")),
)
CATEGORY_DEFAULT = "Informational / Context"
DEPARTMENT_RULES = (
    ("Risk Management", "Enterprise Risk Management", ("risk", "mitigate", "exposure")),
    ("Legal & Compliance", "Regulatory Compliance", ("comply", "regulation", "act", "directive", "legal")),
    ("Operations", "Business Operations", ("process", "service", "outsourc", "operations")),
    ("Board / Senior Management", "Governance Office", ("board", "senior management", "committee")),
    ("Finance", "Finance Control", ("financial", "capital", "amount", "fee")),
)
DEPARTMENT_DEFAULT = ("Legal & Compliance", "Regulatory Compliance")
HIGH_TOKENS = ("must", "shall", "prohibit", "breach", "non-compliance", "effective date")
LOW_TOKENS = ("should", "may", "consider")
NOT_ACTIONABLE = "This section provides contextual or background information and does not create a direct compliance obligation."

# Rule packs of the gap review.
NEGATIVE_PHRASES = ("does not currently require", "does not yet require", "not defined", "not mandatory", "not required", "no requirement", "not documented")
STOPWORDS = (
    "this", "that", "with", "from", "shall", "must", "have", "will", "they", "their", "there",
    "under", "section", "directive", "institution", "regulatory", "obligation", "material", "outsourcing",
    "outsourced", "arrangement", "arrangements", "policy", "business", "function", "functions",
)
INFORMATIONAL_PHRASES = ("contextual background", "background context", "does not create", "no direct implementation obligation", "not applicable", "informational")
ESCALATION_TOKENS = ("notify", "notification", "annual independent", "tested exit", "exit plan")

# Sections of the catalogue.
KNOWN_CATEGORIES = ("Insurer / Micro Insurer", "Joint FSCA / PA Directives", "Retirement Fund")

# Words that tell the section of a catalogue entry, in this order; a blank stands before and after the text.
SECTION_RULES = (
    ("Retirement Fund", ("retirement", "pension")),
    ("Joint FSCA / PA Directives", ("joint", "prudential authority", " pa ")),
    ("Insurer / Micro Insurer", ("long-term", "short-term", "insur", "ltst")),
)
SECTION_DEFAULT = "Directives"
# A year, and the two forms of a directive's number. A word holds letters, figures and underscores of any script.
YEAR_PATTERN = r"(?<![\p{L}\p{N}_])(20\p{Nd}{2}|19\p{Nd}{2})(?![\p{L}\p{N}_])"
NUMBER_PATTERN = rf"(?iU)Directive{SPACE}+([0-9A-Za-z.]+(?:{SPACE}*\([^)]+\))?)"
BARE_NUMBER_PATTERN = r"(?<![\p{L}\p{N}_])(\p{Nd}{2,3}\.[A-Z]\.[A-Za-z])(?![\p{L}\p{N}_])"


def contains_any(lowered: Column, tokens: Sequence[str]) -> Column:
    """Whether lower-cased text contains any token."""
    hit = F.lit(False)
    for t in tokens:
        hit = hit | lowered.contains(t)
    return hit


def token_hits(lowered: Column, tokens: Sequence[str]) -> Column:
    """How many of the tokens occur."""
    return sum((lowered.contains(t).cast("int") for t in tokens), F.lit(0))


def first_best(lowered: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Name of the first rule of the highest score; ``default`` if no token occurs."""
    rated = [F.struct(token_hits(lowered, tokens).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, tokens) in enumerate(rules)]
    # one evaluation of the scores, however often the result is used
    top = F.array(F.array_max(F.array(*rated)))
    return F.element_at(F.transform(top, lambda b: F.when(b["hits"] == 0, default).otherwise(b["name"])), 1)


# The functions below take lower-cased text: lower it once in a column of its own, they read it many times.


def is_actionable(low: Column) -> Column:
    return contains_any(low, ACTION_WORDS)


def category(low: Column) -> Column:
    return first_best(low, CATEGORY_RULES, CATEGORY_DEFAULT)


def department(low: Column) -> Column:
    return first_best(low, [(d, t) for d, _, t in DEPARTMENT_RULES], DEPARTMENT_DEFAULT[0])


def support_function(low: Column) -> Column:
    return first_best(low, [(s, t) for _, s, t in DEPARTMENT_RULES], DEPARTMENT_DEFAULT[1])


def priority(low: Column) -> Column:
    return F.when(contains_any(low, HIGH_TOKENS), "High").when(contains_any(low, LOW_TOKENS), "Low").otherwise("Medium")


def shortened(wording: Column) -> Column:
    """Wording on one line."""
    return strip(collapse(wording))


def obligation_text(section: Column, short: Column, low: Column) -> Column:
    """Wording of the obligation: a fixed sentence, or the clipped clause with its actor and section.

    ``short`` is the wording on one line, ``low`` the same in lower case.
    """
    actor = F.when(low.contains("bank"), "The institution").otherwise("Insurers")
    clipped = F.when(F.length(short) > 240, F.concat(F.regexp_replace(F.substring(short, 1, 237), r"(?U)\s+\z", ""), F.lit("..."))).otherwise(short)
    sentence = F.concat(actor, F.lit(" must address the requirement described in section "), section, F.lit(": "), clipped)
    return F.when(is_actionable(low), sentence).otherwise(NOT_ACTIONABLE)


def is_negative(text: Column) -> Column:
    return contains_any(F.lower(text), NEGATIVE_PHRASES)


def is_informational(obligation: Column, wording: Column) -> Column:
    return contains_any(F.lower(F.concat_ws(" ", obligation, wording)), INFORMATIONAL_PHRASES)


def escalates(obligation: Column, wording: Column) -> Column:
    return contains_any(F.lower(F.concat_ws(" ", obligation, wording)), ESCALATION_TOKENS)


def keywords(text: Column) -> Column:
    """Words of four or more letters that are no stop words; order and repetitions kept."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z][A-Za-z-]{3,}"), F.lit(0)), lambda w: ~w.isin(*STOPWORDS))


def section_of(text: Column) -> Column:
    """Section of a catalogue entry by its words."""
    low = F.lower(text)
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    ladder = F
    for name, tokens in SECTION_RULES:
        ladder = ladder.when(contains_any(padded, tokens), name)
    return ladder.otherwise(SECTION_DEFAULT)


def year_of(text: Column) -> Column:
    """First year 1900-2099 that stands alone, else ``Unknown``."""
    return F.coalesce(F.nullif(F.regexp_extract(text, YEAR_PATTERN, 1), F.lit("")), F.lit("Unknown"))


def directive_number(text: Column) -> Column:
    """Number of a directive from its name, else an empty string."""
    named = F.replace(F.regexp_extract(text, NUMBER_PATTERN, 1), F.lit(" "), F.lit(""))
    return F.coalesce(F.nullif(named, F.lit("")), F.regexp_extract(text, BARE_NUMBER_PATTERN, 1))
