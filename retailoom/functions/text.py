"""Names, keyword rules, text search."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from retailoom import fixed
from retailoom.functions import keywords

_WORD = "[A-Za-z0-9_]"
# A word boundary that treats accented letters as non-word characters.
_ASCII_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_PLAIN = re.compile(r"[A-Z0-9_]+")
# text that stands for itself in a pattern
_LITERAL = re.compile(r"[A-Za-z0-9_ '&/-]+")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_boundaries(pattern: str) -> str:
    return pattern.replace(r"\b", _ASCII_BOUNDARY)


def whole_words(alternatives: str) -> str:
    """Pattern for any of the alternatives as whole words.

    When all of them are literal text that starts and ends with a word character, the search
    first looks for one of their first letters, which turns most positions of a long text down
    at once.
    """
    words = alternatives.split("|")
    simple = all(_LITERAL.fullmatch(w) and re.match(_WORD, w) and re.search(_WORD + "$", w) for w in words)
    if not simple:
        return ascii_boundaries(rf"\b({alternatives})\b")
    first = "".join(sorted({w[0] for w in words}))
    return f"(?=[{first}])(?<!{_WORD})(?:{alternatives})(?!{_WORD})"


def present(values: list[Column]) -> Column:
    """Array of the values that are not NULL, in order, without repeats.

    Unlike ``array_compact`` this has generated code, so the stage around it keeps its own.
    """
    return F.array_except(F.array(*values), F.array(F.lit(None).cast("string")))


def matches(text: Column, pattern: str) -> Column:
    """True when the pattern occurs. Plain words are searched as substrings, and the literal
    text in front of a boundary is searched before the pattern is tried. A pattern with groups,
    classes or quantifiers is tried as it is."""
    if not re.fullmatch(r"(?:[A-Za-z0-9_ '&/|-]|\\b)+", pattern):
        return text.rlike(ascii_boundaries(pattern))
    tests = []
    for part in pattern.split("|"):
        if _PLAIN.fullmatch(part):
            tests.append(text.contains(part))
        else:
            lead = _PLAIN.match(part)
            test = text.rlike(ascii_boundaries(part))
            tests.append(text.contains(lead.group()) & test if lead else test)
    return reduce(lambda a, b: a | b, tests)


def normalize_name(c, strip_year: bool = False) -> Column:
    """Company name reduced to its comparable core.

    Upper case, no punctuation, no legal form at the end, no blanks. ``strip_year`` also
    removes a four digit year at the end. Accents are kept. NULL stays NULL.
    """
    name = F.regexp_replace(F.upper(_col(c)), r"[.,/_\-]", "")
    forms = "|".join(fixed.LEGAL_FORMS)
    name = F.regexp_replace(name, rf"\s+({forms})\s*$", "")
    if strip_year:
        name = F.regexp_replace(name, r"\s*\d{4}\s*$", "")
    return F.regexp_replace(name, r"\s+", "")


def digits_only_key(c) -> Column:
    """Company number without blanks; NULL when it is not nine digits."""
    compact = F.regexp_replace(_col(c), r"\s+", "")
    return F.when(compact.rlike(r"^\d{9}$"), compact)


def classify_keywords(c, rules=fixed.GARMENT_RULES, default=fixed.GARMENT_DEFAULT) -> Column:
    """Label of the first rule whose pattern occurs in the upper-cased text.

    One pass: the text's tokens meet the rules' anchors, and only the rules found are tried
    (``functions.keywords``).
    """
    return keywords.first_label(c, rules, default, whole_word=False)


def classify_words(c, words=fixed.GARMENT_WORDS) -> Column:
    """First of the given words contained in the upper-cased text, else NULL."""
    text = F.upper(_col(c))
    return F.get(present([F.when(text.contains(w), F.lit(w)) for w in words]), F.lit(0))


def keyword_tags(c, rules=fixed.SHOP_TAG_RULES) -> Column:
    """Array of the tags of all rules with a whole-word hit, in rule order; one pass a text."""
    return keywords.all_labels(c, rules, whole_word=True)


def contains_text(c, text: str) -> Column:
    """Case-insensitive search for literal text."""
    return F.lower(_col(c)).contains(text.strip().lower())


def any_contains(columns, text: str) -> Column:
    return reduce(lambda a, b: a | b, [contains_text(c, text) for c in columns])


def id_from_key(c) -> Column:
    """Customer id behind the first bar of a customer key."""
    return F.regexp_replace(_col(c), r"^[^|]*\|", "")


def label_lookup(c, labels: dict, default=None) -> Column:
    """Value of a small constant lookup table."""
    c = _col(c)
    out = None
    for key, label in labels.items():
        hit = c == F.lit(key)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out if default is None else out.otherwise(F.lit(default))
