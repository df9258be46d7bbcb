"""The text and rule expressions as functions for SQL users, with lexicons and thresholds as parameters.

``register_functions(spark)`` makes them temporary functions of the session. They are SQL functions: Spark puts their
bodies into the query's plan, so no Python runs and columns are pruned as usual. Parameters with a default can be left out
or given by name: ``is_coherent(text, min_words => 20)``. Results are those of the column functions of the same names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from dosewise import lexicons as L
from dosewise.functions.text import SPACE


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def terms_sql(terms: Sequence[str]) -> str:
    """A list of terms as a SQL array."""
    return f"array({', '.join(map(quoted, terms))})"


def lexicon_sql(lexicon: Mapping[str, Sequence[str]]) -> str:
    """Named lists of terms as a SQL map."""
    return f"map({', '.join(f'{quoted(name)}, {terms_sql(terms)}' for name, terms in lexicon.items())})"


def _with(value: str, name: str, body: str) -> str:
    """The body, in which ``name`` stands for the value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_TERMS = "ARRAY<STRING>"
_LEXICON = f"MAP<STRING, {_TERMS}>"
_EDGES = rf"r'\A{SPACE}+|{SPACE}+\z'"
_HITS = "aggregate({terms}, 0, (n, term) -> n + int(contains(lowered, term)))"
_ANY = "aggregate({terms}, false, (found, term) -> found OR contains(lowered, term))"


def _two_lists(positive: Sequence[str], task: Sequence[str]) -> str:
    return f"text STRING, positive {_TERMS} DEFAULT {terms_sql(positive)}, task {_TERMS} DEFAULT {terms_sql(task)}"


_BOTH = "struct(keyword_hits(text, positive) AS p, keyword_hits(text, task) AS t)"

#: Name, parameters, type of the result, body; a function may use those before it.
FUNCTIONS: list[tuple[str, str, str, str]] = [
    ("text_words", "text STRING", _TERMS, f"array_remove(split(text, r'{SPACE}+'), '')"),
    ("text_strip", "text STRING", "STRING", f"regexp_replace(text, {_EDGES}, '')"),
    ("word_count", "text STRING", "INT", "size(text_words(text))"),
    (
        "distinct_word_share",
        "text STRING",
        "DOUBLE",
        _with("text_words(text)", "w", "try_divide(size(array_distinct(w)), size(w))"),
    ),
    (
        "is_coherent",
        "text STRING, min_length INT DEFAULT 50, min_words INT DEFAULT 10, min_share DOUBLE DEFAULT 0.3D",
        "BOOLEAN",
        "length(text) >= min_length AND word_count(text) >= min_words AND coalesce(distinct_word_share(text), 0) >= min_share",
    ),
    (
        "is_repetitive",
        "text STRING, threshold DOUBLE DEFAULT 0.3D, min_words INT DEFAULT 10",
        "BOOLEAN",
        "word_count(text) >= min_words AND coalesce(distinct_word_share(text), 1) < threshold",
    ),
    (
        "is_coherent_loose",
        "text STRING, min_length INT DEFAULT 50, threshold DOUBLE DEFAULT 0.3D",
        "BOOLEAN",
        "length(text) > min_length AND NOT is_repetitive(text, threshold)",
    ),
    ("keyword_hits", f"text STRING, terms {_TERMS}", "INT", _with("lower(text)", "lowered", _HITS.format(terms="terms"))),
    ("any_term", f"text STRING, terms {_TERMS}", "BOOLEAN", _with("lower(text)", "lowered", _ANY.format(terms="terms"))),
    (
        "contains_markers",
        f"text STRING, scenario STRING, markers {_LEXICON} DEFAULT {lexicon_sql(L.SCENARIO_MARKERS)}, minimum INT DEFAULT 2",
        "BOOLEAN",
        f"keyword_hits(text, coalesce(try_element_at(markers, scenario), CAST(array() AS {_TERMS}))) >= minimum",
    ),
    (
        "lexical_majority",
        _two_lists(L.MAJORITY_POSITIVE, L.MAJORITY_TASK),
        "BOOLEAN",
        "keyword_hits(text, positive) > keyword_hits(text, task)",
    ),
    (
        "lexical_majority3",
        _two_lists(L.MAJORITY3_POSITIVE, L.MAJORITY3_TASK),
        "DOUBLE",
        _with(_BOTH, "h", "CASE WHEN h.p > h.t THEN 1D WHEN h.t > h.p THEN 0D ELSE 0.5D END"),
    ),
    (
        "lexical_ratio",
        _two_lists(L.RATIO_POSITIVE, L.RATIO_TASK) + ", min_length INT DEFAULT 10",
        "DOUBLE",
        "CASE WHEN text IS NULL OR length(text) < min_length THEN 0D ELSE "
        + _with(_BOTH, "h", "CASE WHEN h.p + h.t = 0 THEN 0.5D ELSE try_divide(h.p, h.p + h.t) END")
        + " END",
    ),
    (
        "text_flags",
        f"text STRING, terms {_LEXICON} DEFAULT {lexicon_sql(L.FLAG_TERMS)}",
        "MAP<STRING, BOOLEAN>",
        _with("lower(text)", "lowered", f"transform_values(terms, (name, list) -> {_ANY.format(terms='list')})"),
    ),
    (
        "detect_format",
        f"text STRING, terms {_LEXICON} DEFAULT {lexicon_sql(L.FORMAT_TERMS)}, narrative_words INT DEFAULT {L.FORMAT_NARRATIVE_WORDS}",
        "STRING",
        _with(
            "text_flags(text, terms)",
            "f",
            "CASE WHEN regexp_like(text, r'\\{[^}]*:') AND text LIKE '%{%{%' THEN 'json_schema'"
            f" WHEN contains(text, '|') OR contains(text, '```') OR regexp_like(text, r'\\n{SPACE}*[-=]{{3,}}') THEN 'table/grid'"
            " WHEN f['rules'] AND f['steps'] THEN 'rule_list' WHEN f['steps'] AND f['grid'] THEN 'action_sequence'"
            " WHEN f['game'] THEN 'game_documentation'"
            f" WHEN size(array_remove(split(text, r'{SPACE}+'), '')) > narrative_words THEN 'narrative' ELSE 'other' END",
        ),
    ),
    ("strip_prompt", "full STRING, prompt STRING", "STRING", "text_strip(substring(full, length(prompt) + 1, length(full)))"),
    ("preview", "text STRING, n INT, ellipsis STRING DEFAULT '...'", "STRING", "concat(left(text, n), ellipsis)"),
    (
        "condition_name",
        "alpha DOUBLE, negative_branch BOOLEAN DEFAULT true",
        "STRING",
        "CASE WHEN alpha = 0 THEN 'baseline'"
        " WHEN negative_branch AND alpha < 0 THEN concat('anti_empathy_', CAST(abs(alpha) AS STRING))"
        " ELSE concat(CASE WHEN alpha <= 3 THEN 'soft_' WHEN alpha = 5 THEN 'median_' WHEN alpha = 10 THEN 'hard_'"
        " ELSE 'extreme_' END, CAST(alpha AS STRING)) END",
    ),
    (
        "drop_verdict",
        "auroc_drop DOUBLE",
        "STRING",
        "CASE WHEN auroc_drop < 0.15D THEN 'STRONG' WHEN auroc_drop > 0.30D THEN 'WEAK' WHEN auroc_drop IS NOT NULL THEN 'MEDIUM' END",
    ),
    (
        "variance_verdict",
        "score DOUBLE",
        "STRING",
        "CASE WHEN score > 0.7D THEN 'high' WHEN score > 0.4D THEN 'moderate' WHEN score IS NOT NULL THEN 'low' END",
    ),
    ("auroc_target", "auroc DOUBLE, target DOUBLE DEFAULT 0.75D", "BOOLEAN", "auroc >= target"),
    (
        "correlation_target",
        "r DOUBLE, target DOUBLE DEFAULT 0.4D, absolute BOOLEAN DEFAULT true",
        "BOOLEAN",
        "CASE WHEN absolute THEN abs(r) >= target ELSE r > target END",
    ),
    ("three_decimals", "x DOUBLE", "STRING", "format_string('%.3f', x)"),
    ("percent", "x DOUBLE", "STRING", "format_string('%.1f%%', x * 100)"),
    (
        "rating_category",
        "rating INT",
        "STRING",
        "CASE rating WHEN 0 THEN 'low_empathy' WHEN 1 THEN 'medium_empathy' WHEN 2 THEN 'high_empathy' END",
    ),
    ("rating_extremes", "rating INT", "INT", "CASE rating WHEN 2 THEN 1 WHEN 0 THEN 0 END"),
    ("rating_at_least_one", "rating INT", "INT", "int(rating >= 1)"),
]


def register_functions(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session's SQL; returns their names. Doing it again replaces them."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
