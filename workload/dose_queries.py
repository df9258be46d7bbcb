"""Queries over texts under a dose: conditions, effects, success, failures, curves, formats, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dosewise.functions import text as T
from dosewise.operators import conditions as C, formats as M, grid as G
from dosewise.operators.evaluation import best_layer
from dosewise.plans import analyses as A
from workload import views as v
from workload.registry import query, r, rounded, sql_hits, sql_words, with_views
from workload.text_queries import FORMATS, MARKERS, POSITIVE, RATIO_SQL, TASK, format_sql

WORDS = sql_words()
SHARE = f"len(list_distinct({WORDS})) / len({WORDS})"

RATES = (
    with_views("gen")
    + f""", samples AS (
        SELECT model, layer, scenario, alpha,
               length(text) >= 50 AND len({WORDS}) >= 10 AND {SHARE} >= 0.3 AS coherent,
               CASE scenario """
    + " ".join(f"WHEN '{s}' THEN {sql_hits(t)} >= 2" for s, t in MARKERS.items())
    + f""" ELSE false END AS has_context,
               {sql_hits(POSITIVE)} > {sql_hits(TASK)} AS positive_language,
               length(text) AS length, len({WORDS}) AS word_count
        FROM gen),
    rates AS (
        SELECT model, layer, scenario, alpha, count(*) AS num_samples, avg(coherent::INT) AS coherent_rate,
               avg(has_context::INT) AS context_rate, avg(positive_language::INT) AS positive_rate,
               avg(length) AS avg_length, avg(word_count) AS avg_word_count
        FROM samples GROUP BY ALL),
    based AS (
        SELECT *, max(positive_rate) FILTER (alpha = 0) OVER (PARTITION BY model, layer, scenario) AS baseline_rate
        FROM rates),
    effects AS (
        SELECT *, positive_rate - baseline_rate AS effect,
               CASE WHEN alpha <> 0 THEN (alpha > 0) = (positive_rate - baseline_rate > 0) END AS matches
        FROM based WHERE baseline_rate IS NOT NULL),
    summary AS (
        SELECT model, layer, scenario,
               coalesce(avg(matches::INT::DOUBLE) FILTER (alpha <> 0), 0) AS success_rate,
               max(baseline_rate) AS baseline_rate, count(*) - 1 AS num_alphas
        FROM effects GROUP BY ALL)"""
)
RATIO_CELLS = (
    with_views("gen")
    + f""", cells AS (
        SELECT model, layer, scenario, alpha, count(*) AS num_samples, avg({RATIO_SQL}) AS score_mean,
               stddev_pop({RATIO_SQL}) AS score_std
        FROM gen GROUP BY ALL)"""
)


def scorers() -> dict:
    """The test lexicons in place of the default ones."""
    text = F.col("text")
    return {
        "has_context": T.contains_markers(text, F.col("scenario"), MARKERS),
        "positive_language": T.lexical_majority(text, POSITIVE, TASK),
    }


def analysis(spark, sf_dir, mode: str = "reference") -> dict[str, DataFrame]:
    return A.dose_response(v.generations(spark, sf_dir), scorers(), mode)


def ratio():
    return T.lexical_ratio(F.col("text"), POSITIVE, TASK)


def ratio_cells(spark, sf_dir) -> DataFrame:
    return C.condition_scores(v.generations(spark, sf_dir), ratio())


# --- conditions and effects ---


@query(
    RATES
    + f""" SELECT model, layer, scenario, alpha, num_samples, {r('coherent_rate')} AS coherent_rate,
                  {r('context_rate')} AS context_rate, {r('positive_rate')} AS positive_rate,
                  {r('avg_length')} AS avg_length, {r('avg_word_count')} AS avg_word_count FROM rates"""
)
def condition_rates(spark, sf_dir):
    return rounded(analysis(spark, sf_dir)["rates"])


@query(
    RATIO_CELLS
    + f""" SELECT model, layer, scenario, alpha, num_samples, {r('score_mean')} AS score_mean,
                  {r('score_std')} AS score_std FROM cells"""
)
def condition_scores(spark, sf_dir):
    return rounded(ratio_cells(spark, sf_dir))


@query(
    RATES
    + f""" SELECT model, layer, scenario, alpha, {r('positive_rate')} AS positive_rate,
                  {r('baseline_rate')} AS baseline_rate, {r('effect')} AS steering_effect, matches AS matches_expected,
                  {r('coherent_rate')} AS coherent_rate, {r('context_rate')} AS context_rate FROM effects"""
)
def steering_effects(spark, sf_dir):
    return rounded(analysis(spark, sf_dir)["effects"])


@query(
    RATES
    + """ SELECT model, layer, scenario, alpha, CASE WHEN alpha <> 0 THEN sign(alpha) = sign(effect) END
                 AS matches_expected FROM effects"""
)
def steering_effects_strict(spark, sf_dir):
    return analysis(spark, sf_dir, "strict")["effects"].select(*v.CELL, "matches_expected")


@query(
    RATES
    + f""" SELECT model, layer, scenario, {r('success_rate')} AS success_rate, {r('baseline_rate')} AS baseline_rate,
                  num_alphas FROM summary"""
)
def success_rate(spark, sf_dir):
    return rounded(analysis(spark, sf_dir)["summary"])


@query(
    RATES
    + f""" SELECT CASE WHEN grouping(layer) = 0 THEN 'model_layer' WHEN grouping(model) = 0 THEN 'model'
                       ELSE 'scenario' END AS level,
                  model, layer, scenario, {r('avg(success_rate)')} AS success_rate, count(*) AS num_series
           FROM summary GROUP BY GROUPING SETS ((model), (model, layer), (scenario))"""
)
def success_rollup(spark, sf_dir):
    return rounded(analysis(spark, sf_dir)["rollup"])


@query(
    RATES
    + f"""
    SELECT 'resistance_to_extreme_steering' AS type, model, layer, scenario, alpha, {r('effect')} AS effect,
           {r('coherent_rate')} AS coherent_rate, NULL::VARCHAR AS expected
    FROM effects WHERE alpha <> 0 AND abs(alpha) >= 10 AND NOT matches
    UNION ALL
    SELECT 'early_breakdown', model, layer, scenario, alpha, NULL, {r('coherent_rate')}, NULL
    FROM effects WHERE alpha <> 0 AND abs(alpha) <= 5 AND coherent_rate < 0.5
    UNION ALL
    SELECT 'reverse_steering', model, layer, scenario, alpha, {r('effect')}, NULL,
           CASE WHEN alpha > 0 THEN 'more' ELSE 'less' END
    FROM effects WHERE alpha <> 0 AND abs(alpha) >= 5 AND NOT matches AND coherent_rate > 0.5"""
)
def failure_cases(spark, sf_dir):
    return rounded(analysis(spark, sf_dir)["failures"])


@query(
    RATES.split(",\n    rates AS")[0].replace("model, layer, scenario, alpha,\n", "model, layer, scenario, alpha, sample,\n")
    + """ SELECT sample, coherent, has_context, positive_language, length::INT AS length, word_count::INT AS word_count
          FROM samples"""
)
def sample_scores(spark, sf_dir):
    return C.sample_scores(v.generations(spark, sf_dir), scorers()).select(
        "sample", "coherent", "has_context", "positive_language", "length", "word_count"
    )


# --- dose curves ---

POOLED = (
    with_views("gen")
    + f""", cell AS (
        SELECT model, layer, scenario, alpha, avg(({sql_hits(POSITIVE)} > 0)::INT) AS rate,
               avg({sql_hits(POSITIVE)}) AS hits
        FROM gen WHERE alpha > 0 GROUP BY ALL),
    pooled AS (SELECT model, layer, alpha, avg(rate) AS success_rate, avg(hits) AS mean_hits, count(*) AS num_cells
               FROM cell GROUP BY model, layer, alpha)"""
)


def pooled(spark, sf_dir) -> DataFrame:
    return C.pooled_positive_doses(v.generations(spark, sf_dir), T.keyword_hits(F.col("text"), POSITIVE))


@query(
    POOLED
    + f" SELECT model, layer, alpha, {r('success_rate')} AS success_rate, {r('mean_hits')} AS mean_hits, num_cells FROM pooled"
)
def pooled_positive(spark, sf_dir):
    return rounded(pooled(spark, sf_dir))


@query(
    POOLED
    + f""" SELECT model, layer, {r('arg_min(mean_hits, alpha)')} AS first_value, {r('arg_max(mean_hits, alpha)')} AS last_value,
                  {r('CASE WHEN arg_min(mean_hits, alpha) > 0 THEN arg_max(mean_hits, alpha) / arg_min(mean_hits, alpha) END')}
                  AS fold_change
           FROM pooled GROUP BY model, layer"""
)
def fold_change(spark, sf_dir):
    return rounded(C.fold_change(pooled(spark, sf_dir), ["model", "layer"], "mean_hits"))


@query(
    RATIO_CELLS
    + f""", ends AS (
        SELECT model, layer, scenario, max(score_mean) FILTER (alpha = 0) AS baseline_value, max(alpha) AS max_alpha,
               arg_max(score_mean, alpha) AS max_value
        FROM cells GROUP BY ALL)
    SELECT model, layer, scenario, {r('baseline_value')} AS baseline_value, max_alpha, {r('max_value')} AS max_value,
           {r('max_value - baseline_value')} AS gain
    FROM ends WHERE baseline_value IS NOT NULL"""
)
def max_vs_baseline(spark, sf_dir):
    return rounded(A.dose_curve(v.generations(spark, sf_dir), ratio())["extremes"])


@query(
    RATIO_CELLS
    + f""", base AS (SELECT model, layer, scenario, score_mean AS baseline_value FROM cells WHERE alpha = 0),
    best AS (
        SELECT model, layer, scenario, alpha AS max_alpha, score_mean AS max_value FROM cells WHERE alpha > 0
        QUALIFY row_number() OVER (PARTITION BY model, layer, scenario ORDER BY (alpha = 10) DESC, alpha DESC) = 1)
    SELECT model, layer, scenario, {r('baseline_value')} AS baseline_value, max_alpha, {r('max_value')} AS max_value,
           {r('max_value - baseline_value')} AS gain
    FROM base JOIN best USING (model, layer, scenario)"""
)
def preferred_vs_baseline(spark, sf_dir):
    return rounded(A.dose_curve(v.generations(spark, sf_dir), ratio(), preferred=10.0)["extremes"])


@query(
    RATIO_CELLS
    + f""", based AS (
        SELECT *, max(score_mean) FILTER (alpha = 0) OVER (PARTITION BY model, layer, scenario) AS b FROM cells)
    SELECT model, layer, scenario, alpha, {r('score_mean')} AS score_mean, {r('score_mean - b')} AS delta,
           {r('0.02 * alpha')} AS ideal
    FROM based WHERE b IS NOT NULL"""
)
def dose_delta(spark, sf_dir):
    return rounded(A.dose_curve(v.generations(spark, sf_dir), ratio())["delta"])


@query(
    RATIO_CELLS
    + f""", based AS (
        SELECT *, max(score_mean) FILTER (alpha = 0) OVER (PARTITION BY model, layer, scenario) AS b FROM cells)
    SELECT model, layer, scenario, alpha, {r('score_mean', 9)} AS score_mean,
           {r('CASE WHEN b <> 0 THEN (score_mean - b) / b * 100 END', 9)} AS percent_change
    FROM based WHERE b IS NOT NULL"""
)
def pct_change(spark, sf_dir):
    return rounded(C.percent_change(ratio_cells(spark, sf_dir), "score_mean"), 9)


@query(
    with_views("gen")
    + f""", m AS (SELECT model, layer, alpha, avg({sql_hits(TASK)}) AS t, avg({sql_hits(POSITIVE)}) AS p FROM gen GROUP BY ALL)
    SELECT model, layer, alpha, {r('t')} AS mean_task_hits, {r('p')} AS mean_positive_hits,
           {r('CASE WHEN p <> 0 THEN t / p END')} AS task_ratio FROM m"""
)
def hit_ratio(spark, sf_dir):
    text = F.col("text")
    return rounded(
        C.hit_ratio(v.generations(spark, sf_dir), T.keyword_hits(text, TASK), T.keyword_hits(text, POSITIVE))
    )


@query(
    with_views("gen")
    + f""" SELECT model, layer, scenario,
           count(*) FILTER (alpha = 0 AND {sql_hits(POSITIVE)} > 0) AS flagged_0,
           count(*) FILTER (alpha = 0) AS texts_0,
           count(*) FILTER (alpha = 10 AND {sql_hits(POSITIVE)} > 0) AS flagged_10,
           count(*) FILTER (alpha = 10) AS texts_10
    FROM gen WHERE (model, layer) IN (SELECT (model, min(layer)) FROM gen GROUP BY model) GROUP BY ALL"""
)
def flag_tally(spark, sf_dir):
    tally = C.flag_tally(v.generations(spark, sf_dir), T.any_term(F.col("text"), POSITIVE), [0.0, 10.0])
    return C.first_layer(tally)


@query(
    RATIO_CELLS
    + f""", wide AS (
        SELECT model, scenario, max(score_mean) FILTER (layer = 0) AS lo, max(score_mean) FILTER (layer = 1) AS hi
        FROM cells WHERE alpha = 20 GROUP BY ALL)
    SELECT model, scenario, {r('lo')} AS low_layer, {r('hi')} AS high_layer,
           {r('CASE WHEN lo <> 0 THEN (hi - lo) / lo * 100 END')} AS improvement FROM wide"""
)
def layer_pivot(spark, sf_dir):
    return rounded(C.layer_pivot(ratio_cells(spark, sf_dir), "score_mean", 20.0, 0, 1))


@query(
    RATIO_CELLS
    + f""", chosen AS (SELECT model, layer FROM cells GROUP BY model, layer
                      QUALIFY row_number() OVER (PARTITION BY model ORDER BY sum(num_samples) DESC, layer) = 1)
    SELECT model, layer, scenario, alpha, {r('score_mean')} AS score_mean FROM cells
    WHERE (model, layer) IN (SELECT (model, layer) FROM chosen)"""
)
def layer_selection(spark, sf_dir):
    cells = A.dose_curve(v.generations(spark, sf_dir), ratio())["curve"]
    totals = cells.groupBy("model", "layer").agg(F.sum("num_samples").alias("n"))
    chosen = best_layer(totals, metric="n").withColumnRenamed("best_layer", "layer")
    return rounded(C.select_layers(cells, chosen).select(*v.CELL, "score_mean"))


@query(
    with_views("gen")
    + f""", s AS (SELECT *, length(text) > 50 AND NOT (len({WORDS}) >= 10 AND {SHARE} < 0.3) AS ok FROM gen)
    SELECT model, layer, scenario, alpha, count(*) FILTER (ok) AS coherent, count(*) AS num_samples,
           {r('avg(ok::INT) * 100')} AS coherent_percent FROM s GROUP BY ALL"""
)
def coherent_share(spark, sf_dir):
    return rounded(C.coherent_share(v.generations(spark, sf_dir)))


# --- formats ---

FORMAT_COUNTS = (
    with_views("gen")
    + f""", fmt AS (SELECT model, layer, scenario, alpha, sample, text, {format_sql(FORMATS)} AS format FROM gen),
    counts AS (SELECT model, layer, scenario, format, count(*) AS n FROM fmt WHERE alpha = 0 GROUP BY ALL),
    shares AS (SELECT *, n / sum(n) OVER (PARTITION BY model, layer, scenario) AS p FROM counts),
    doses AS (SELECT model, alpha, format, count(*) AS n FROM fmt GROUP BY ALL)"""
)


def formats(spark, sf_dir) -> dict[str, DataFrame]:
    return A.format_variance(v.generations(spark, sf_dir), terms=FORMATS)


@query(FORMAT_COUNTS + f" SELECT model, layer, scenario, format, n, {r('100 * p')} AS percent FROM shares")
def format_share(spark, sf_dir):
    return rounded(formats(spark, sf_dir)["share"])


@query(
    FORMAT_COUNTS
    + f""" SELECT model, alpha, format, n, {r('100 * n / sum(n) OVER (PARTITION BY model, alpha)')} AS percent
           FROM doses"""
)
def format_by_dose(spark, sf_dir):
    return rounded(formats(spark, sf_dir)["by_dose"])


@query(
    FORMAT_COUNTS
    + f""" SELECT model, layer, scenario, count(*) AS n_formats, sum(n)::BIGINT AS n_texts,
                  {r('count(*) / sum(n)')} AS distinct_share FROM counts GROUP BY ALL"""
)
def format_distinct(spark, sf_dir):
    return rounded(formats(spark, sf_dir)["distinct"])


@query(
    FORMAT_COUNTS
    + f""", e AS (SELECT model, layer, scenario, count(*) AS n_formats, 1 - sum(p * p) AS gini,
                         CASE WHEN count(*) = 1 THEN 0 ELSE -sum(p * ln(p)) / ln(count(*)) END AS entropy
                  FROM shares GROUP BY ALL)
    SELECT model, layer, scenario, n_formats, {r('gini')} AS gini_simpson, {r('entropy')} AS entropy,
           CASE WHEN round(entropy, 9) > 0.7 THEN 'high' WHEN round(entropy, 9) > 0.4 THEN 'moderate' ELSE 'low' END
           AS verdict FROM e"""
)
def format_entropy(spark, sf_dir):
    return rounded(formats(spark, sf_dir)["diversity"])


@query(
    FORMAT_COUNTS
    + """ SELECT model, layer, scenario, format, n FROM counts
          QUALIFY row_number() OVER (PARTITION BY model, layer, scenario ORDER BY n DESC, format) = 1"""
)
def mode_format(spark, sf_dir):
    return formats(spark, sf_dir)["most_common"]


@query(
    FORMAT_COUNTS
    + """, sets AS (SELECT model, alpha, array_to_string(list_sort(list(format)), ',') AS formats
                    FROM doses GROUP BY ALL),
    based AS (SELECT *, coalesce(max(formats) FILTER (alpha = 0) OVER (PARTITION BY model), '') AS b FROM sets)
    SELECT model, alpha, formats, formats = b AS same_as_baseline,
           bool_and(alpha = 0 OR formats = b) OVER (PARTITION BY model) AS all_same FROM based"""
)
def format_set_change(spark, sf_dir):
    return formats(spark, sf_dir)["set_change"].withColumn("formats", F.array_join("formats", ","))


@query(
    FORMAT_COUNTS
    + """ SELECT model, format, left(arg_min(text, sample), 150) || '...' AS example
          FROM fmt WHERE alpha = 0 GROUP BY ALL"""
)
def format_examples(spark, sf_dir):
    at_zero = v.generations(spark, sf_dir).filter("alpha = 0")
    return M.format_examples(at_zero, ["model"], terms=FORMATS)


# --- grids ---

# Doses allowed per model: as many as the length of its name in tens.
CAPS = """, models AS (SELECT model, layer, (10 * length(model) - 10 * layer)::DOUBLE AS max_alpha
                       FROM (SELECT DISTINCT model, layer FROM gen))"""
DOSES = [-20.0, -10.0, -5.0, 0.0, 3.0, 5.0, 7.0, 10.0, 20.0]
DOSES_SQL = "(SELECT unnest([-20.0, -10.0, -5.0, 0.0, 3.0, 5.0, 7.0, 10.0, 20.0]::DOUBLE[]) AS alpha)"


def capped_models(spark, sf_dir) -> DataFrame:
    found = v.generations(spark, sf_dir).select("model", "layer").distinct()
    return found.withColumn("max_alpha", (10 * F.length("model") - 10 * F.col("layer")).cast("double"))


@query(
    """SELECT 's' || doc_id AS scenario_id, m AS source_model, k::INT AS run_id
    FROM documents, (SELECT unnest(['a', 'b']) AS m), (SELECT unnest(range(0, 5)) AS k)"""
)
def pair_grid(spark, sf_dir):
    return G.pair_grid(v.scenarios(spark, sf_dir), ["a", "b"], 5)


@query(
    with_views("gen")
    + CAPS
    + f" SELECT model, layer, max_alpha, alpha FROM models, {DOSES_SQL} WHERE abs(alpha) <= max_alpha"
)
def alpha_cap_grid(spark, sf_dir):
    return G.capped_doses(capped_models(spark, sf_dir), DOSES)


GRID = (
    with_views("gen")
    + CAPS
    + f""", grid AS (SELECT model, layer, max_alpha, alpha, scenario, k::INT AS sample_idx
                     FROM models, {DOSES_SQL}, (SELECT unnest(['s0', 's1', 's2', 's3']) AS scenario),
                          (SELECT unnest(range(0, 2)) AS k) WHERE abs(alpha) <= max_alpha)"""
)


def expected_grid(spark, sf_dir) -> DataFrame:
    return A.experiment_grid(capped_models(spark, sf_dir), ["s0", "s1", "s2", "s3"], DOSES, 2)


@query(
    GRID
    + """ SELECT *, CASE WHEN alpha = 0 THEN 'baseline' WHEN alpha < 0 THEN 'anti_empathy_' || abs(alpha)
              WHEN alpha <= 3 THEN 'soft_' || alpha WHEN alpha = 5 THEN 'median_' || alpha
              WHEN alpha = 10 THEN 'hard_' || alpha ELSE 'extreme_' || alpha END AS condition_name FROM grid"""
)
def dose_grid(spark, sf_dir):
    return expected_grid(spark, sf_dir)


@query(
    GRID
    + """, cells AS (SELECT DISTINCT model, layer, scenario, alpha FROM grid),
    found AS (SELECT model, layer, scenario, alpha, count(*) AS n FROM gen GROUP BY ALL)
    SELECT count(*) AS expected_cells, count(n) AS present_cells, count(*) FILTER (n IS NULL) AS missing_cells,
           coalesce(sum(n), 0)::BIGINT AS result_rows
    FROM cells LEFT JOIN found USING (model, layer, scenario, alpha)"""
)
def grid_audit(spark, sf_dir):
    return G.audit_grid(expected_grid(spark, sf_dir), v.generations(spark, sf_dir), v.CELL)


@query(
    GRID
    + """ SELECT DISTINCT model, layer, scenario, alpha FROM grid
          WHERE (model, layer, scenario, alpha) NOT IN (SELECT (model, layer, scenario, alpha) FROM gen)"""
)
def grid_missing(spark, sf_dir):
    return G.missing_cells(expected_grid(spark, sf_dir), v.generations(spark, sf_dir), v.CELL).distinct()


@query(
    with_views("gen")
    + """ SELECT sample FROM gen WHERE scenario IN (SELECT scenario FROM gen WHERE model = 'en' AND scenario <> 's1')"""
)
def scenario_subset(spark, sf_dir):
    generations = v.generations(spark, sf_dir)
    wanted = generations.filter("model = 'en' and scenario != 's1'")
    return G.only_scenarios(generations, wanted).select("sample")
