"""Queries written in SQL alone, with the functions of ``dosewise.functions.sql``."""

from __future__ import annotations

from dosewise.functions.sql import lexicon_sql, register_functions, terms_sql
from workload.registry import query, r, rounded, sql_any, sql_hits, sql_strip, with_views
from workload.text_queries import FLAGS, FORMATS, MARKERS, POSITIVE, RATIO_SQL, SHARE, TASK, WORDS, format_sql

MARKERS_SQL = "CASE scenario " + " ".join(f"WHEN '{s}' THEN {sql_hits(t)} >= 2" for s, t in MARKERS.items()) + " ELSE false END"
#: The columns of ``gen`` from the documents.
GENERATED = """
    SELECT lang AS model, doc_id AS sample, concat('s', CAST(substr(source, 4) AS INT) % 3) AS scenario, text,
           CAST(array(-20, -10, -5, 0, 5, 10, 20)[(doc_id DIV 2) % 7] AS DOUBLE) AS alpha
    FROM parquet.`{sf_dir}/documents.parquet`"""


@query(
    f"""SELECT doc_id, len({WORDS}) AS n_words, {r(SHARE)} AS distinct_share,
               length(text) >= 20 AND len({WORDS}) >= 10 AND {SHARE} >= 0.5 AS coherent,
               len({WORDS}) >= 10 AND {SHARE} < 0.6 AS repetitive, {sql_hits(POSITIVE)} AS hits,
               {sql_any(TASK)} AS on_task, {sql_hits(POSITIVE)} > {sql_hits(TASK)} AS majority, {r(RATIO_SQL)} AS ratio,
               {format_sql(FORMATS)} AS format, {sql_any(FLAGS['digits'])} AS digits,
               {sql_strip('substr(text, 6)')} AS completion, substr(text, 1, 20) || '...' AS start
        FROM documents"""
)
def sql_text_functions(spark, sf_dir):
    """All scores of a text in one statement."""
    register_functions(spark)
    positive, task = terms_sql(POSITIVE), terms_sql(TASK)
    return rounded(
        spark.sql(
            f"""SELECT doc_id, word_count(text) AS n_words, distinct_word_share(text) AS distinct_share,
                       is_coherent(text, min_length => 20, min_share => 0.5) AS coherent,
                       is_repetitive(text, threshold => 0.6) AS repetitive, keyword_hits(text, {positive}) AS hits,
                       any_term(text, {task}) AS on_task, lexical_majority(text, {positive}, {task}) AS majority,
                       lexical_ratio(text, {positive}, {task}) AS ratio,
                       detect_format(text, {lexicon_sql(FORMATS)}) AS format,
                       text_flags(text, {lexicon_sql(FLAGS)})['digits'] AS digits,
                       strip_prompt(text, 'abcde') AS completion, preview(text, 20) AS start
                FROM parquet.`{sf_dir}/documents.parquet`"""
        )
    )


@query(
    with_views("gen")
    + f""", scored AS (SELECT *, {MARKERS_SQL} AS marked, {RATIO_SQL} AS ratio FROM gen)
    SELECT model, CASE WHEN alpha = 0 THEN 'baseline' WHEN alpha < 0 THEN 'anti_empathy_' || abs(alpha)
                       WHEN alpha <= 3 THEN 'soft_' || alpha WHEN alpha = 5 THEN 'median_' || alpha
                       WHEN alpha = 10 THEN 'hard_' || alpha ELSE 'extreme_' || alpha END AS condition_name,
           count(*) AS n, count(*) FILTER (marked) AS n_marked,
           count(*) FILTER (ratio > 0.7) AS n_high, count(*) FILTER (ratio <= 0.4) AS n_low,
           count(*) FILTER (ratio >= 0.5) AS n_reached, {r("avg(ratio)")} AS ratio
    FROM scored GROUP BY ALL"""
)
def sql_dose_report(spark, sf_dir):
    """Markers and verdicts per model and condition."""
    register_functions(spark)
    return rounded(
        spark.sql(
            f"""WITH gen AS ({GENERATED.format(sf_dir=sf_dir)}),
                scored AS (SELECT *, contains_markers(text, scenario, {lexicon_sql(MARKERS)}) AS marked,
                                  lexical_ratio(text, {terms_sql(POSITIVE)}, {terms_sql(TASK)}) AS ratio FROM gen)
                SELECT model, condition_name(alpha) AS condition_name, count(*) AS n, count_if(marked) AS n_marked,
                       count_if(variance_verdict(ratio) = 'high') AS n_high, count_if(variance_verdict(ratio) = 'low') AS n_low,
                       count_if(auroc_target(ratio, 0.5D)) AS n_reached, avg(ratio) AS ratio
                FROM scored GROUP BY 1, 2"""
        )
    )
