"""Queries over the embedding vectors: directions, scores, metrics, controls, agreement with ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dosewise.functions import rules, vectors as V
from dosewise.operators import agreement, directions as D, evaluation as E, random_control as R
from dosewise.plans import analyses as A
from dosewise.session import broadcast_rows, materialize, vectors_size
from workload import views as v
from workload.registry import AUROC_VIEWS, SCORE_VIEWS, query, r, rounded, with_views

DIR_VIEWS = SCORE_VIEWS[:-1]
RANDOM_TRIALS = 100


def stored_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fit_directions(v.train(spark, sf_dir), v.GROUP)


def test_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.project(v.test(spark, sf_dir), stored_directions(spark, sf_dir), v.GROUP, digits=v.DIGITS)


def test_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.validate_directions(v.test(spark, sf_dir), stored_directions(spark, sf_dir), v.GROUP, v.DIGITS)


def rated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return test_scores(spark, sf_dir).join(v.ratings(spark, sf_dir), "text_id")


def components(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    return rounded(df.select(*keys, F.posexplode(vec).alias("dim", "value")))


# --- directions ---


@query(
    with_views("act", "long_means")
    + f" SELECT model, layer, label, (i - 1)::INT AS dim, {r('x')} AS value FROM long_means"
)
def class_means(spark, sf_dir):
    return components(D.class_means(v.train(spark, sf_dir), [*v.GROUP, "label"]), [*v.GROUP, "label"], "mean")


@query(
    with_views(*DIR_VIEWS)
    + f"""
    SELECT model, layer, (generate_subscripts(direction, 1) - 1)::INT AS dim, {r('unnest(direction)')} AS value
    FROM dirs"""
)
def direction_fit(spark, sf_dir):
    return components(D.fit_directions(v.train(spark, sf_dir), v.GROUP), v.GROUP, "direction")


@query(
    with_views(*DIR_VIEWS)
    + f" SELECT model, layer, {r('norm')} AS norm, n_pos, n_neg, norm = 0 AS degenerate FROM dirs"
)
def direction_norms(spark, sf_dir):
    fitted = D.fit_directions(v.train(spark, sf_dir), v.GROUP)
    return rounded(fitted.select(*v.GROUP, "norm", "n_pos", "n_neg", "degenerate"))


@query(
    with_views(*DIR_VIEWS)
    + f"""
    SELECT model, layer, len(direction)::INT AS dim, {r('sqrt(list_dot_product(direction, direction))')} AS norm,
           {r('list_avg(direction)')} AS mean, {r('list_stddev_pop(direction)')} AS std
    FROM dirs"""
)
def direction_stats(spark, sf_dir):
    return rounded(D.direction_stats(stored_directions(spark, sf_dir), v.GROUP))


@query(
    with_views(*DIR_VIEWS)
    + f"""
    , comps AS (SELECT model, layer, generate_subscripts(direction, 1) - 1 AS dim, unnest(direction) AS value FROM dirs)
    SELECT model, layer, rnk::INT AS rank, dim::INT AS dim, {r('value')} AS value,
           CASE WHEN value < 0 THEN 'negative' ELSE 'positive' END AS sign
    FROM (SELECT *, row_number() OVER (PARTITION BY model, layer ORDER BY abs(value) DESC, dim) AS rnk FROM comps)
    WHERE rnk <= 20"""
)
def top_components(spark, sf_dir):
    return rounded(D.top_components(stored_directions(spark, sf_dir), v.GROUP, 20))


@query(
    with_views(*DIR_VIEWS)
    + f""", comps AS (SELECT model, layer, unnest(direction) AS x FROM dirs),
    rng AS (SELECT model, layer, min(x) AS lo, max(x) AS hi FROM comps GROUP BY ALL),
    binned AS (SELECT model, layer, lo, hi, least(floor((x - lo) / (hi - lo) * 50) + 1, 50)::INT AS bin
               FROM comps JOIN rng USING (model, layer))
    SELECT model, layer, bin, {r('min(lo + (bin - 1) * (hi - lo) / 50)')} AS bin_start, count(*) AS n
    FROM binned GROUP BY model, layer, bin"""
)
def component_histogram(spark, sf_dir):
    parts = stored_directions(spark, sf_dir).select(*v.GROUP, F.explode("direction").alias("x"))
    return rounded(agreement.histogram(parts, v.GROUP, "x", 50))


@query(
    with_views("act")
    + """
    SELECT model, layer, min(len(vec))::INT AS dim, count(*) AS n_vectors, min(len(vec)) = max(len(vec)) AS uniform
    FROM act GROUP BY model, layer"""
)
def dimension_check(spark, sf_dir):
    return D.dimension_check(v.activations(spark, sf_dir), v.GROUP)


@query(
    with_views(*DIR_VIEWS)
    + """
    SELECT DISTINCT model, layer FROM act
    WHERE (model, layer) NOT IN (SELECT (model, layer) FROM dirs WHERE n_pos % 2 = 0)"""
)
def missing_direction_anti(spark, sf_dir):
    stored = stored_directions(spark, sf_dir).filter(F.col("n_pos") % 2 == 0)
    return D.missing_directions(v.activations(spark, sf_dir), stored, v.GROUP)


# --- pooling ---


def _pool_sql(condition: str) -> str:
    return (
        with_views("states")
        + f"""
        SELECT text_id, (i - 1)::INT AS dim, {r('avg(x)')} AS value
        FROM (SELECT text_id, generate_subscripts(vec, 1) AS i, unnest(vec) AS x FROM states WHERE {condition})
        GROUP BY text_id, i"""
    )


@query(_pool_sql("true"))
def pool_mean(spark, sf_dir):
    return components(D.pool_mean(v.token_states(spark, sf_dir), ["text_id"]), ["text_id"], "vec")


@query(_pool_sql("pos < 3"))
def truncate_pool(spark, sf_dir):
    states = D.truncate_positions(v.token_states(spark, sf_dir), 3)
    return components(D.pool_mean(states, ["text_id"]), ["text_id"], "vec")


@query(
    with_views("states")
    + f"""
    SELECT text_id, (generate_subscripts(vec, 1) - 1)::INT AS dim, {r('unnest(vec)')} AS value
    FROM (SELECT text_id, arg_max(vec, pos) AS vec FROM states GROUP BY text_id)"""
)
def pool_last(spark, sf_dir):
    pooled = D.pool_last(v.token_states(spark, sf_dir), ["text_id"])
    return components(pooled.withColumn("vec", pooled["vec"].cast("array<double>")), ["text_id"], "vec")


# --- projection ---


@query(with_views(*SCORE_VIEWS) + f" SELECT model, layer, text_id, label, {r('score')} AS score FROM scores")
def projection(spark, sf_dir):
    return rounded(test_scores(spark, sf_dir))


@query(with_views(*SCORE_VIEWS) + f" SELECT model, layer, text_id, label, {r('score')} AS score FROM scores")
def projection_blocks(spark, sf_dir):
    """The projection with a limit that only three of the ten directions fit, so they are broadcast in blocks."""
    directions = stored_directions(spark, sf_dir)
    limit = vectors_size(directions) // 3
    return rounded(D.project(v.test(spark, sf_dir), directions, v.GROUP, digits=v.DIGITS, limit=limit))


@query(
    with_views(*SCORE_VIEWS)
    + f"""
    , moved AS (
        SELECT a.model, a.layer, a.text_id, ((a.text_id % 3) * 5.0)::DOUBLE AS alpha, d.direction,
               list_transform(list_zip(a.vec, d.direction), lambda z: z[1] + (a.text_id % 3) * 5.0 * z[2]) AS vec
        FROM act a JOIN dirs d ON a.model = d.model AND a.layer = d.layer WHERE a.split = 'test')
    SELECT m.model, m.layer, m.text_id, m.alpha, {r('list_dot_product(m.vec, m.direction)')} AS shifted_score,
           {r('s.score + m.alpha')} AS expected_score
    FROM moved m JOIN scores s USING (model, layer, text_id)"""
)
def shift_project(spark, sf_dir):
    directions = stored_directions(spark, sf_dir)
    test = v.test(spark, sf_dir)
    before = D.project(test, directions, v.GROUP, digits=v.DIGITS).withColumn("alpha", (F.col("text_id") % 3) * 5.0)
    moved = D.shift_vectors(test, directions, v.GROUP, (F.col("text_id") % 3) * 5.0)
    after = D.project(moved, directions, v.GROUP, keep=["text_id", "alpha"])
    return rounded(
        after.withColumnRenamed("score", "shifted_score").join(
            before.select(*v.GROUP, "text_id", (F.col("score") + F.col("alpha")).alias("expected_score")),
            [*v.GROUP, "text_id"],
        )
    )


# --- evaluation ---


@query(
    with_views(*AUROC_VIEWS) + f" SELECT model, layer, n_pos, n_neg, {r('auroc')} AS auroc FROM aurocs"
)
def direction_auroc(spark, sf_dir):
    return rounded(test_metrics(spark, sf_dir).select(*v.GROUP, "n_pos", "n_neg", "auroc"))


@query(
    with_views(*AUROC_VIEWS[:-1])
    + f"""
    SELECT model, layer,
           {r('any_value(med)')} AS median,
           {r('avg(((score >= med)::INT = label)::INT)')} AS accuracy_median,
           {r('avg(((score > med)::INT = label)::INT)')} AS accuracy_median_strict,
           {r('avg(((score > mid)::INT = label)::INT)')} AS accuracy_midpoint,
           {r('avg(((score > 0)::INT = label)::INT)')} AS accuracy_zero,
           {r('avg(score) FILTER (label = 1)')} AS pos_mean, {r('avg(score) FILTER (label = 0)')} AS neg_mean,
           {r('stddev_pop(score) FILTER (label = 1)')} AS pos_std,
           {r('stddev_pop(score) FILTER (label = 0)')} AS neg_std,
           {r('avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0)')} AS separation,
           {r('abs(avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0))')} AS abs_separation
    FROM ranked GROUP BY model, layer"""
)
def direction_metrics(spark, sf_dir):
    return rounded(
        test_metrics(spark, sf_dir).select(
            *v.GROUP,
            "median",
            *[f"accuracy_{rule}" for rule in E.RULES],
            "pos_mean",
            "neg_mean",
            "pos_std",
            "neg_std",
            "separation",
            "abs_separation",
        )
    )


@query(
    with_views(*AUROC_VIEWS)
    + f"""
    SELECT model, layer AS best_layer, {r('auroc')} AS best_auroc
    FROM aurocs QUALIFY row_number() OVER (PARTITION BY model ORDER BY auroc DESC, layer) = 1"""
)
def best_group(spark, sf_dir):
    return rounded(E.best_layer(test_metrics(spark, sf_dir)))


@query(
    with_views(*AUROC_VIEWS)
    + f"""
    SELECT * FROM (SELECT model, layer, {r('auroc')} AS auroc,
                          row_number() OVER (PARTITION BY model ORDER BY auroc DESC, layer)::INT AS rank FROM aurocs)
    WHERE rank <= 3"""
)
def top3(spark, sf_dir):
    return rounded(E.top_layers(test_metrics(spark, sf_dir), 3))


@query(
    with_views(*SCORE_VIEWS)
    + """
    SELECT model, layer, text_id, rank() OVER (PARTITION BY model, layer ORDER BY round(score, 1))
           + (count(*) OVER (PARTITION BY model, layer, round(score, 1)) - 1) / 2.0::DOUBLE AS rank
    FROM scores"""
)
def average_rank(spark, sf_dir):
    from dosewise.operators.ordering import average_ranks

    scores = test_scores(spark, sf_dir).withColumn("score", F.round("score", 1))
    scores = materialize(scores, "rounded-scores")
    ranks = broadcast_rows(materialize(average_ranks(scores, v.GROUP, "score", "rank"), "ranks"))
    return scores.join(ranks, [*v.GROUP, "score"]).select(*v.GROUP, "text_id", "rank")


@query(
    with_views(*SCORE_VIEWS)
    + f"""
    SELECT model, layer, {r('quantile_cont(score, 0.5)')} AS median, {r('quantile_cont(score, 0.95)')} AS p95
    FROM scores GROUP BY model, layer"""
)
def score_quantiles(spark, sf_dir):
    from dosewise.operators.ordering import exact_quantiles

    return rounded(exact_quantiles(test_scores(spark, sf_dir), v.GROUP, "score", {"median": 0.5, "p95": 0.95}))


@query(
    with_views(*AUROC_VIEWS)
    + """
    SELECT model, layer, auroc >= 0.75 AS target_reached, printf('%.3f', auroc) AS auroc_text,
           printf('%.1f%%', auroc * 100) AS auroc_percent,
           CASE WHEN 1 - auroc < 0.15 THEN 'STRONG' WHEN 1 - auroc > 0.30 THEN 'WEAK' ELSE 'MEDIUM' END AS verdict
    FROM aurocs"""
)
def formatted_metrics(spark, sf_dir):
    auroc = F.col("auroc")
    return test_metrics(spark, sf_dir).select(
        *v.GROUP,
        rules.auroc_target(auroc).alias("target_reached"),
        rules.three_decimals(auroc).alias("auroc_text"),
        rules.percent(auroc).alias("auroc_percent"),
        rules.drop_verdict(1 - auroc).alias("verdict"),
    )


# --- random directions ---

RANDOM_SQL = (
    with_views("act")
    + f"""
    , parts AS (
        SELECT t AS trial, i,
               sqrt(-2 * ln((('0x' || substr(h, 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE))
               * cos(2 * pi() * ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE) AS x
        FROM (SELECT t, i, md5('42:' || t || ':' || i) AS h
              FROM range(0, {RANDOM_TRIALS}) a(t), range(0, (SELECT max(len(embedding)) FROM embeddings)) b(i))),
    rdirs AS (SELECT trial, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n FROM parts GROUP BY trial),
    proj AS (
        SELECT e.vec_id AS text_id, d.trial,
               round(list_dot_product(e.embedding::DOUBLE[], list_transform(d.v, lambda x: x / d.n)), 9) AS score
        FROM embeddings e, rdirs d WHERE e.vec_id % 10 >= 7),
    rscores AS (SELECT a.model, a.layer, a.label, p.trial, p.score
                FROM act a JOIN proj p ON a.text_id = p.text_id WHERE a.split = 'test'),
    rranked AS (
        SELECT *, rank() OVER (PARTITION BY model, layer, trial ORDER BY score)
                  + (count(*) OVER (PARTITION BY model, layer, trial, score) - 1) / 2.0 AS rnk FROM rscores),
    trials AS (
        SELECT model, layer, trial,
               (sum(rnk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
               / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)) AS auroc,
               avg(((score > 0)::INT = label)::INT) AS accuracy
        FROM rranked GROUP BY model, layer, trial),
    summary AS (
        SELECT model, layer, count(*) AS num_trials, avg(auroc) AS mean_auroc, median(auroc) AS median_auroc,
               stddev_pop(auroc) AS std_auroc, min(auroc) AS min_auroc, max(auroc) AS max_auroc,
               quantile_cont(auroc, 0.95) AS p95_auroc, avg(accuracy) AS mean_accuracy
        FROM trials GROUP BY model, layer)"""
)


def random_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trial_metrics(v.test(spark, sf_dir), RANDOM_TRIALS, keys=v.GROUP, digits=v.DIGITS)


@query(
    RANDOM_SQL + f" SELECT model, layer, trial, {r('auroc')} AS auroc, {r('accuracy')} AS accuracy FROM trials"
)
def random_dirs_auroc(spark, sf_dir):
    return rounded(random_trials(spark, sf_dir))


SUMMARY_FIELDS = ["mean_auroc", "median_auroc", "std_auroc", "min_auroc", "max_auroc", "p95_auroc", "mean_accuracy"]


@query(
    RANDOM_SQL
    + " SELECT model, layer, num_trials, "
    + ", ".join(f"{r(c)} AS {c}" for c in SUMMARY_FIELDS)
    + " FROM summary"
)
def random_summary(spark, sf_dir):
    summary = R.random_summary(random_trials(spark, sf_dir), v.GROUP)
    return rounded(summary.select(*v.GROUP, "num_trials", *SUMMARY_FIELDS))


@query(
    RANDOM_SQL
    + ", "
    + with_views(*AUROC_VIEWS[1:])[len("WITH ") :]
    + f"""
    SELECT model, layer, {r('auroc')} AS auroc, {r('(auroc - mean_auroc) / (std_auroc + 1e-10)')} AS z_score,
           {r('auroc - mean_auroc')} AS difference_from_mean, {r('auroc - median_auroc')} AS difference_from_median,
           {r('auroc - p95_auroc')} AS difference_from_p95, auroc > p95_auroc AS significant_at_95
    FROM aurocs JOIN summary USING (model, layer)"""
)
def random_compare(spark, sf_dir):
    test = v.test(spark, sf_dir)
    compared = A.random_baseline(test, test_metrics(spark, sf_dir), RANDOM_TRIALS, digits=v.DIGITS)
    return rounded(compared.drop("mean_auroc", "std_auroc", "p95_auroc"))


MIXED_TRIALS = 5


@query(
    with_views("act")
    + f""", parts AS (
        SELECT t AS trial, i,
               sqrt(-2 * ln((('0x' || substr(h, 1, 8))::BIGINT + 1) / 4294967297.0::DOUBLE))
               * cos(2 * pi() * ('0x' || substr(h, 9, 8))::BIGINT / 4294967296.0::DOUBLE) AS x
        FROM (SELECT t, i, md5('42:' || t || ':' || i) AS h FROM range(0, {MIXED_TRIALS}) a(t), range(0, 128) b(i))),
    rdirs AS (SELECT d, trial, list(x ORDER BY i) AS v, sqrt(sum(x * x)) AS n
              FROM parts, (SELECT unnest([64, 128]) AS d) WHERE i < d GROUP BY d, trial),
    vecs AS (SELECT *, CASE WHEN model = 'm1' THEN list_concat(vec, vec) ELSE vec END AS w FROM act WHERE split = 'test'),
    rscores AS (
        SELECT a.model, a.layer, a.label, r.trial,
               round(list_dot_product(a.w, list_transform(r.v, lambda x: x / r.n)), 9) AS score
        FROM vecs a JOIN rdirs r ON r.d = len(a.w)),
    rranked AS (
        SELECT *, rank() OVER (PARTITION BY model, layer, trial ORDER BY score)
                  + (count(*) OVER (PARTITION BY model, layer, trial, score) - 1) / 2.0 AS rnk FROM rscores)
    SELECT model, layer, trial, round(
               (sum(rnk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0)
               / (count(*) FILTER (label = 1)::DOUBLE * count(*) FILTER (label = 0)), 6) + 0.0 AS auroc
    FROM rranked GROUP BY model, layer, trial"""
)
def random_mixed_dims(spark, sf_dir):
    """Random directions for models of different dimension: the vectors of one model are joined to themselves."""
    longer = F.when(F.col("model") == "m1", F.concat("vec", "vec")).otherwise(F.col("vec"))
    test = v.test(spark, sf_dir).withColumn("vec", longer)
    return rounded(R.trial_metrics(test, MIXED_TRIALS, keys=v.GROUP, digits=v.DIGITS).drop("accuracy"))


@query(
    with_views(*AUROC_VIEWS)
    + f""" SELECT model, layer, {r('auroc')} AS auroc, n_pos, n_neg FROM aurocs
    UNION ALL SELECT 'none', 0, 0.5, 0, 0"""
)
def unlabelled_group(spark, sf_dir):
    """AUROC with a further group whose labels are all NULL; it has no accuracy and does not disturb the others."""
    scores = test_scores(spark, sf_dir).select(*v.GROUP, "label", "score")
    without = scores.select(
        F.lit("none").alias("model"), F.lit(0).alias("layer"), F.lit(None).cast("int").alias("label"), "score"
    )
    metrics = E.evaluate_scores(scores.unionByName(without), v.GROUP)
    return rounded(metrics.select(*v.GROUP, "auroc", "n_pos", "n_neg"))


@query(
    with_views(*AUROC_VIEWS)
    + f""" SELECT model, string_agg(layer || '=' || printf('%.3f', auroc), ' ' ORDER BY layer) AS layers
    FROM aurocs GROUP BY model"""
)
def ordered_layers(spark, sf_dir):
    """Metrics of each model's layers in order of the layer, in one field per model: a model has few layers."""
    entry = F.struct("layer", rules.three_decimals(F.col("auroc")).alias("text"))
    layers = test_metrics(spark, sf_dir).groupBy("model").agg(F.array_sort(F.collect_list(entry)).alias("l"))
    text = F.transform("l", lambda e: F.concat_ws("=", e["layer"].cast("string"), e["text"]))
    return layers.select("model", F.array_join(text, " ").alias("layers"))


# --- ratings ---

RATED = with_views(*SCORE_VIEWS, "ratings", "rated")


@query(
    RATED + f" SELECT model, layer, count(*) AS n, {r('corr(score, true_score)')} AS pearson FROM rated GROUP BY ALL"
)
def rating_pearson(spark, sf_dir):
    return rounded(agreement.pearson(rated_scores(spark, sf_dir), v.GROUP, "score", "true_score"))


RANKED_SQL = """
    , rr AS (
        SELECT model, layer, score, true_score,
               rank() OVER (PARTITION BY model, layer ORDER BY score)
               + (count(*) OVER (PARTITION BY model, layer, score) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY model, layer ORDER BY true_score)
               + (count(*) OVER (PARTITION BY model, layer, true_score) - 1) / 2.0 AS ry
        FROM rated)"""


@query(
    RATED
    + RANKED_SQL
    + f" SELECT model, layer, count(*) AS n, {r('corr(rx, ry)')} AS spearman FROM rr GROUP BY model, layer"
)
def rating_spearman(spark, sf_dir):
    return rounded(agreement.spearman(rated_scores(spark, sf_dir), v.GROUP, "score", "true_score"))


# Student's t distribution by its finite series for integer degrees of freedom.
P_SQL = """
    , tt AS (SELECT *, atan(abs(pearson) * sqrt((n - 2) / (1 - pearson * pearson)) / sqrt(n - 2)) AS th, n - 2 AS df
             FROM cc),
    pp AS (
        SELECT *, CASE WHEN df % 2 = 0 THEN
            1 - sin(th) * list_sum(list_transform(range(0, df // 2), lambda k:
                exp(lgamma(2 * k + 1.0) - 2 * lgamma(k + 1.0) - k * ln(4.0)) * pow(cos(th), 2 * k)))
        ELSE
            1 - 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda k:
                exp(2 * lgamma(k + 1.0) - lgamma(2 * k + 2.0) + k * ln(4.0)) * pow(cos(th), 2 * k + 1))), 0))
        END AS p FROM tt)"""


@query(
    RATED
    + ", cc AS (SELECT model, layer, count(*) AS n, corr(score, true_score) AS pearson FROM rated GROUP BY ALL)"
    + P_SQL
    + f" SELECT model, layer, n, {r('pearson')} AS pearson, {r('p')} AS p_value FROM pp"
)
def rating_p_value(spark, sf_dir):
    linear = agreement.pearson(rated_scores(spark, sf_dir), v.GROUP, "score", "true_score")
    return rounded(linear.withColumn("p_value", agreement.correlation_p_value(F.col("pearson"), F.col("n"))))


@query(
    RATED
    + """, cc AS (SELECT model, layer, count(*) AS n, regr_slope(score, true_score) AS slope,
                         regr_intercept(score, true_score) AS intercept, corr(score, true_score) AS pearson,
                         regr_syy(score, true_score) AS syy, regr_sxx(score, true_score) AS sxx
                  FROM rated GROUP BY ALL)"""
    + P_SQL
    + f"""
    SELECT model, layer, n, {r('slope')} AS slope, {r('intercept')} AS intercept, {r('pearson')} AS r,
           {r('sqrt((1 - pearson * pearson) * syy / sxx / (n - 2))')} AS slope_stderr, {r('p')} AS p_value
    FROM pp"""
)
def rating_ols(spark, sf_dir):
    return rounded(agreement.line_fit(rated_scores(spark, sf_dir), v.GROUP, "true_score", "score"))


EXTREMES = """
    , sub AS (SELECT model, layer, score, (true_score = 2)::INT AS label FROM rated WHERE true_score IN (0, 2)),
    med AS (SELECT model, layer, quantile_cont(score, 0.5) AS t FROM sub GROUP BY ALL),
    cm AS (
        SELECT model, layer, count(*) FILTER (score >= t AND label = 1) AS tp, count(*) FILTER (score >= t AND label = 0) AS fp,
               count(*) FILTER (score < t AND label = 0) AS tn, count(*) FILTER (score < t AND label = 1) AS fn
        FROM sub JOIN med USING (model, layer) GROUP BY ALL)"""
BINARISED = """
    , sub AS (SELECT model, layer, score, (true_score >= 1)::INT AS label FROM rated),
    med AS (SELECT model, layer, quantile_cont(score, 0.5) AS t FROM sub GROUP BY ALL),
    cm AS (
        SELECT model, layer, count(*) FILTER (score > t AND label = 1) AS tp, count(*) FILTER (score > t AND label = 0) AS fp,
               count(*) FILTER (score <= t AND label = 0) AS tn, count(*) FILTER (score <= t AND label = 1) AS fn
        FROM sub JOIN med USING (model, layer) GROUP BY ALL)"""


def _matrix(counts: DataFrame, layout: str) -> DataFrame:
    return counts.select(*v.GROUP, *[
        F.get(F.get(F.col(layout), F.lit(i)), F.lit(j)).alias(f"cell_{i}{j}") for i in (0, 1) for j in (0, 1)
    ])


@query(
    RATED
    + EXTREMES
    + " SELECT model, layer, tn AS cell_00, fp AS cell_01, fn AS cell_10, tp AS cell_11 FROM cm"
)
def rating_confusion_a(spark, sf_dir):
    metrics = agreement.rating_extremes_metrics(rated_scores(spark, sf_dir), v.GROUP, "true_score", "score")
    return _matrix(E.confusion(metrics, v.GROUP, "median"), "matrix_tn_first")


@query(
    RATED
    + BINARISED
    + " SELECT model, layer, tp AS cell_00, fp AS cell_01, fn AS cell_10, tn AS cell_11 FROM cm"
)
def rating_confusion_b(spark, sf_dir):
    metrics = agreement.rating_binarised_metrics(rated_scores(spark, sf_dir), v.GROUP, "true_score", "score")
    return _matrix(E.confusion(metrics, v.GROUP, "median_strict"), "matrix_tp_first")


@query(
    RATED
    + EXTREMES
    + f"""
    SELECT model, layer, {r('tp / (tp + fp)')} AS precision, {r('tp / (tp + fn)')} AS recall,
           {r('tn / (tn + fp)')} AS specificity, {r('2 * tp / (2 * tp + fp + fn)')} AS f1
    FROM cm"""
)
def prf(spark, sf_dir):
    metrics = agreement.rating_extremes_metrics(rated_scores(spark, sf_dir), v.GROUP, "true_score", "score")
    return rounded(E.precision_recall(E.confusion(metrics, v.GROUP, "median"), v.GROUP))


@query(
    RATED
    + RANKED_SQL
    + ", cc AS (SELECT model, layer, count(*) AS n, corr(score, true_score) AS pearson FROM rated GROUP BY ALL)"
    + P_SQL
    + ", rho AS (SELECT model, layer, count(*) AS n, corr(rx, ry) AS pearson FROM rr GROUP BY ALL)"
    + P_SQL.replace("tt", "tr").replace("pp", "pr").replace("FROM cc", "FROM rho")
    + EXTREMES
    + BINARISED.replace("sub ", "sub2 ").replace("med ", "med2 ").replace("cm ", "cm2 ")
    .replace("FROM sub GROUP", "FROM sub2 GROUP").replace("FROM sub JOIN", "FROM sub2 JOIN")
    + f"""
    SELECT model, layer, pp.n, {r('pp.pearson')} AS pearson, {r('pr.pearson')} AS spearman,
           {r('(cm.tp + cm.tn) / (cm.tp + cm.tn + cm.fp + cm.fn)')} AS accuracy_extremes,
           {r('(cm2.tp + cm2.tn) / (cm2.tp + cm2.tn + cm2.fp + cm2.fn)')} AS accuracy_binarised,
           {r('pp.p')} AS pearson_p, {r('pr.p')} AS spearman_p, abs(pp.pearson) >= 0.4 AS target_reached
    FROM pp JOIN pr USING (model, layer) JOIN cm USING (model, layer) JOIN cm2 USING (model, layer)"""
)
def rating_agreement(spark, sf_dir):
    return rounded(A.rating_agreement(test_scores(spark, sf_dir), v.ratings(spark, sf_dir)))


@query(
    """SELECT count(*) FILTER (label % 3 = 2) AS n_high, count(*) FILTER (label % 3 = 1) AS n_medium,
           count(*) FILTER (label % 3 = 0) AS n_low
    FROM embeddings"""
)
def rating_counts(spark, sf_dir):
    return agreement.rating_counts(v.ratings(spark, sf_dir))


@query(
    """SELECT vec_id AS text_id, CASE label % 3 WHEN 0 THEN 'low_empathy' WHEN 1 THEN 'medium_empathy'
              ELSE 'high_empathy' END AS category,
              CASE label % 3 WHEN 0 THEN 0 WHEN 2 THEN 1 END AS extreme, (label % 3 >= 1)::INT AS at_least_one
    FROM embeddings"""
)
def rating_classes(spark, sf_dir):
    rating = F.col("true_score")
    return v.ratings(spark, sf_dir).select(
        "text_id",
        rules.rating_category(rating).alias("category"),
        rules.rating_extremes(rating).alias("extreme"),
        rules.rating_at_least_one(rating).alias("at_least_one"),
    )


@query(
    with_views(*SCORE_VIEWS)
    + f"""
    , rng AS (SELECT model, layer, min(score) AS lo, max(score) AS hi FROM scores GROUP BY ALL),
    binned AS (SELECT model, layer, lo, hi, least(floor((score - lo) / (hi - lo) * 20) + 1, 20)::INT AS bin
               FROM scores JOIN rng USING (model, layer))
    SELECT model, layer, bin, {r('min(lo + (bin - 1) * (hi - lo) / 20)')} AS bin_start, count(*) AS n
    FROM binned GROUP BY model, layer, bin"""
)
def score_histogram(spark, sf_dir):
    return rounded(agreement.histogram(test_scores(spark, sf_dir), v.GROUP, "score", 20))


@query(
    with_views(*AUROC_VIEWS, "ratings", "rated")
    + f"""
    , cc AS (SELECT model, layer, corr(score, true_score) AS pearson FROM rated GROUP BY ALL),
    best AS (SELECT * FROM aurocs QUALIFY row_number() OVER (PARTITION BY model ORDER BY auroc DESC, layer) = 1)
    SELECT b.model, b.layer AS best_layer, {r('b.auroc')} AS best_auroc, b.auroc >= 0.75 AS auroc_target,
           {r('c.pearson')} AS pearson, abs(c.pearson) >= 0.4 AS correlation_target
    FROM best b JOIN cc c ON b.model = c.model AND b.layer = c.layer"""
)
def run_summary(spark, sf_dir):
    scores = materialize(test_scores(spark, sf_dir), "scores")
    rated = scores.join(v.ratings(spark, sf_dir), "text_id")
    return rounded(
        A.run_summary(E.evaluate_scores(scores, v.GROUP), agreement.pearson(rated, v.GROUP, "score", "true_score"))
    )
