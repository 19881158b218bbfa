"""Keyword rules in one pass over a text: token postings meet a table of patterns by hash.

A text is upper-cased and cut once into its distinct tokens (runs of ``[A-Z0-9_]``, the ASCII
word characters of the rules' boundaries). Its keys are ``=TOKEN`` for every token and every
three-character piece of a token. Each alternative of a rule gets one anchor that every match of
it must produce:

- a whole-word alternative that starts with literal word characters ending where a word must
  end (end of pattern, ``\\b``, or a literal non-word character): ``=`` and that literal;
- otherwise the first three characters of its leading literal, which lie inside one token;
- no anchor when the leading literal is shorter: the alternative is tried on every text.

The keys of a text look up the anchors in one map (a folded literal, so no shuffle and no join
per row), and only the alternatives found are tried, each by its own regular expression on the
upper-cased text, so the result is the one the plain patterns give. A rule table must fit the
bound ``MAX_ALTERNATIVES``; beyond it the caller splits the table into parts and unions the
hits.

A short rule table (``FEW_ALTERNATIVES``) needs no keys: the leading literal of each alternative
is searched as bytes, and the regular expression runs only on texts that hold it. The upper-cased
text is made once and handed on as the variable of a one-element array. The result is the same.
"""

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# an alternative stands for itself up to its first character outside this set
_WORD_CHAR = re.compile(r"[A-Z0-9_]")
_ASCII_BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_LITERAL_NON_WORD = set(" '&/-,;:")
MAX_ALTERNATIVES = 100_000
# up to here a byte search per alternative costs less than cutting the text into keys
FEW_ALTERNATIVES = 128
GRAM = 3


@dataclass(frozen=True)
class Alternative:
    rank: int
    label: str
    regex: str
    anchor: str | None
    literal: str


def split_alternatives(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern: bars inside groups, classes or escapes stay."""
    out, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    out.append(pattern[start:])
    return out


def leading_literal(alternative: str) -> str:
    """The word characters every match of the alternative starts with; may be empty."""
    n = 0
    while n < len(alternative) and _WORD_CHAR.fullmatch(alternative[n]):
        n += 1
    if alternative[n:n + 1] and alternative[n] in "?*{":
        n = max(n - 1, 0)
    return alternative[:n]


def anchor_of(alternative: str, whole_word: bool) -> str | None:
    """The key every match of the alternative produces, or None."""
    literal = leading_literal(alternative)
    rest = alternative[len(literal):]
    # a literal non-word character ends the token only when it is not optional
    ends_word = rest == "" or rest.startswith("\\b") or (rest[:1] in _LITERAL_NON_WORD and rest[1:2] not in ("?", "*", "{"))
    if whole_word and literal and ends_word:
        return "=" + literal
    if len(literal) >= GRAM:
        return literal[:GRAM]
    return None


def compile_rules(rules: Sequence[tuple[str, str]], whole_word: bool) -> list[Alternative]:
    """One entry per alternative of every rule, in rule order."""
    out = []
    for rank, (label, pattern) in enumerate(rules):
        for alt in split_alternatives(pattern):
            if not alt:
                continue
            body = rf"\b(?:{alt})\b" if whole_word else alt
            out.append(Alternative(rank, label, body.replace(r"\b", _ASCII_BOUNDARY), anchor_of(alt, whole_word), leading_literal(alt)))
    if len(out) > MAX_ALTERNATIVES:
        raise ValueError(f"{len(out)} alternatives: split the rule table into parts of at most {MAX_ALTERNATIVES}")
    return out


def text_keys(upper: Column) -> Column:
    """Distinct ``=TOKEN`` and three-character pieces of the tokens of an upper-cased text."""
    tokens = F.array_distinct(F.filter(F.split(upper, "[^A-Z0-9_]+"), lambda t: t != ""))
    whole = F.transform(tokens, lambda t: F.concat(F.lit("="), t))
    long_ = F.filter(tokens, lambda t: F.length(t) >= GRAM)
    pieces = F.flatten(F.transform(long_, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - (GRAM - 1)), lambda i: F.substring(t, i, GRAM))))
    return F.array_distinct(F.concat(whole, pieces))


def _upper(c) -> Column:
    return F.upper(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _on_upper(c, make) -> Column:
    """``make(text)`` of the upper-cased text, which is computed once."""
    return F.get(F.transform(F.array(_upper(c)), make), F.lit(0))


def _rule_conditions(text: Column, alternatives: list[Alternative]) -> dict[int, Column]:
    """Per rule, in rule order: does one of its alternatives match the upper-cased text?"""
    out: dict[int, Column] = {}
    for alt in alternatives:
        hit = text.rlike(alt.regex)
        if alt.literal:
            held = text.contains(alt.literal)
            hit = held if alt.regex == alt.literal else held & hit
        out[alt.rank] = out[alt.rank] | hit if alt.rank in out else hit
    return out


def rule_hits(c, alternatives: list[Alternative]) -> Column:
    """Sorted distinct ranks of the rules that match the upper-cased text (NULL as empty)."""
    if not alternatives:
        return F.array().cast("array<int>")
    upper = _upper(c)
    postings: dict[str, list[int]] = {}
    always = []
    for i, alt in enumerate(alternatives):
        if alt.anchor is None:
            always.append(i)
        else:
            postings.setdefault(alt.anchor, []).append(i)
    table = F.from_json(F.lit(json.dumps(postings)), "map<string, array<int>>")
    regexes = F.array(*[F.lit(a.regex) for a in alternatives])
    ranks = F.array(*[F.lit(a.rank) for a in alternatives])
    found = F.flatten(F.transform(text_keys(upper), lambda k: F.coalesce(table[k], F.array().cast("array<int>"))))
    candidates = F.array_distinct(F.concat(F.array(*[F.lit(i) for i in always]).cast("array<int>"), found))
    verified = F.filter(candidates, lambda i: F.regexp(upper, F.element_at(regexes, i + 1)))
    return F.array_sort(F.array_distinct(F.transform(verified, lambda i: F.element_at(ranks, i + 1))))


def first_label(c, rules: Sequence[tuple[str, str]], default: str, whole_word: bool = False) -> Column:
    """Label of the first rule that matches, else the default."""
    alternatives = compile_rules(rules, whole_word)
    if 0 < len(alternatives) <= FEW_ALTERNATIVES:
        def first_of(text):
            out = F
            for rank, hit in _rule_conditions(text, alternatives).items():
                out = out.when(hit, F.lit(rules[rank][0]))
            return out.otherwise(F.lit(default).cast("string"))
        return F.coalesce(_on_upper(c, first_of), F.lit(default).cast("string"))
    labels = F.array(*[F.lit(label) for label, _ in rules])
    hits = rule_hits(c, alternatives)
    # element_at of a literal array at a NULL index is not NULL in every plan: test the size first
    first = F.when(F.size(hits) > 0, F.element_at(labels, F.get(hits, 0) + 1))
    return F.coalesce(first, F.lit(default).cast("string"))


def all_labels(c, rules: Sequence[tuple[str, str]], whole_word: bool = True) -> Column:
    """Labels of all rules that match, in rule order."""
    alternatives = compile_rules(rules, whole_word)
    if 0 < len(alternatives) <= FEW_ALTERNATIVES:
        return _on_upper(c, lambda text: F.array_compact(F.array(
            *[F.when(hit, F.lit(rules[rank][0])) for rank, hit in _rule_conditions(text, alternatives).items()])))
    labels = F.array(*[F.lit(label) for label, _ in rules])
    return F.transform(rule_hits(c, alternatives), lambda r: F.element_at(labels, r + 1))


def any_match(c, patterns: Sequence[str], whole_word: bool = True) -> Column:
    """True when any of the patterns matches."""
    alternatives = compile_rules([(str(i), p) for i, p in enumerate(patterns) if p], whole_word)
    if 0 < len(alternatives) <= FEW_ALTERNATIVES:
        return _on_upper(c, lambda text: reduce(lambda a, b: a | b, _rule_conditions(text, alternatives).values()))
    return F.size(rule_hits(c, alternatives)) > 0
