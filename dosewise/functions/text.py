"""Native text expressions: word statistics, lexicon scores, output-format rules, prompts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from dosewise import lexicons as L

# White space as Unicode-aware string splitting and stripping see it (Java's \s is ASCII only).
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def words(text: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def length(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column, tokens: Column | None = None) -> Column:
    return F.size(words(text) if tokens is None else tokens)


def distinct_word_share(text: Column, tokens: Column | None = None) -> Column:
    """Distinct words (case-sensitive) per word; NULL without words.

    ``tokens`` is an existing column with ``words(text)``, here and below, to split a text only once.
    """
    tokens = words(text) if tokens is None else tokens
    return F.try_divide(F.size(F.array_distinct(tokens)), F.size(tokens))


def is_coherent(
    text: Column,
    min_length: int = 50,
    min_words: int = 10,
    min_share: float = 0.3,
    tokens: Column | None = None,
) -> Column:
    """Long enough and not repetitive; short texts are incoherent."""
    return (
        (F.length(text) >= min_length)
        & (word_count(text, tokens) >= min_words)
        & (F.coalesce(distinct_word_share(text, tokens), F.lit(0.0)) >= min_share)
    )


def is_repetitive(
    text: Column, threshold: float = 0.3, min_words: int = 10, tokens: Column | None = None
) -> Column:
    """Few distinct words; texts below ``min_words`` are never repetitive."""
    return (word_count(text, tokens) >= min_words) & (
        F.coalesce(distinct_word_share(text, tokens), F.lit(1.0)) < threshold
    )


def is_coherent_loose(
    text: Column, min_length: int = 50, threshold: float = 0.3, tokens: Column | None = None
) -> Column:
    """Variant in which a text longer than ``min_length`` with few words still counts as coherent."""
    return (F.length(text) > min_length) & ~is_repetitive(text, threshold, tokens=tokens)


def keyword_hits(text: Column, terms: Sequence[str]) -> Column:
    """Number of distinct terms that occur as substrings, ignoring case."""
    lowered = F.lower(text)
    return reduce(lambda a, b: a + b, [F.contains(lowered, F.lit(t)).cast("int") for t in terms], F.lit(0))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    lowered = F.lower(text)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(t)) for t in terms], F.lit(False))


def contains_markers(
    text: Column, scenario: Column, markers: Mapping[str, Sequence[str]] = L.SCENARIO_MARKERS, minimum: int = 2
) -> Column:
    """At least ``minimum`` of the scenario's markers occur; an unknown scenario has none."""
    found = F.lit(0)
    for name, terms in markers.items():
        found = F.when(scenario == name, keyword_hits(text, terms)).otherwise(found)
    return found >= minimum


def lexical_majority(
    text: Column, positive: Sequence[str] = L.MAJORITY_POSITIVE, task: Sequence[str] = L.MAJORITY_TASK
) -> Column:
    """More positive than task terms; a tie is false."""
    return keyword_hits(text, positive) > keyword_hits(text, task)


def lexical_majority3(
    text: Column, positive: Sequence[str] = L.MAJORITY3_POSITIVE, task: Sequence[str] = L.MAJORITY3_TASK
) -> Column:
    """1.0, 0.0, or 0.5 for a tie."""
    p, t = keyword_hits(text, positive), keyword_hits(text, task)
    return F.when(p > t, 1.0).when(t > p, 0.0).otherwise(0.5)


def lexical_ratio(
    text: Column,
    positive: Sequence[str] = L.RATIO_POSITIVE,
    task: Sequence[str] = L.RATIO_TASK,
    min_length: int = 10,
) -> Column:
    """Positive share of all hits; 0.5 without hits, 0.0 for a missing or very short text."""
    p, t = keyword_hits(text, positive), keyword_hits(text, task)
    return (
        F.when(text.isNull() | (F.length(text) < min_length), 0.0)
        .when(p + t == 0, 0.5)
        .otherwise(F.try_divide(p, p + t))
    )


def flags(text: Column, terms: Mapping[str, Sequence[str]] = L.FLAG_TERMS) -> Column:
    """Struct with one any-of flag per name."""
    return F.struct(*[any_term(text, t).alias(name) for name, t in terms.items()])


def detect_format(text: Column, terms: Mapping[str, Sequence[str]] = L.FORMAT_TERMS) -> Column:
    """Output-format class by fixed priority."""
    rules, steps, grid, game = (any_term(text, terms[k]) for k in ("rules", "steps", "grid", "game"))
    has_json = F.regexp_like(text, F.lit(r"\{[^}]*:")) & text.like("%{%{%")
    has_table = (
        F.contains(text, F.lit("|"))
        | F.contains(text, F.lit("```"))
        | F.regexp_like(text, F.lit(rf"\n{SPACE}*[-=]{{3,}}"))
    )
    return (
        F.when(has_json, "json_schema")
        .when(has_table, "table/grid")
        .when(rules & steps, "rule_list")
        .when(steps & grid, "action_sequence")
        .when(game, "game_documentation")
        .when(word_count(text) > L.FORMAT_NARRATIVE_WORDS, "narrative")
        .otherwise("other")
    )


def fill_template(template: str, columns: Mapping[str, Column]) -> Column:
    """Template with ``{name}`` fields filled from columns; a missing value becomes the empty string."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(F.coalesce(columns[piece].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def strip_prompt(full: Column, prompt: Column) -> Column:
    """Completion after the prompt, cut by the prompt's length (the prefix is not compared) and stripped."""
    return strip(F.substring(full, F.length(prompt) + 1, F.length(full)))


def preview(text: Column, n: int, ellipsis: str = "...") -> Column:
    """First ``n`` characters, the ellipsis always added."""
    return F.concat(F.left(text, F.lit(n)), F.lit(ellipsis))


def first_non_empty(*columns: Column) -> Column:
    """First of several alternative fields that is not blank, stripped."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in columns])
