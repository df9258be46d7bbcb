"""Composite analyses: the calls a user makes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dosewise import lexicons as L
from dosewise.functions import rules, text as T
from dosewise.operators import (
    ablation,
    agreement,
    conditions,
    directions as D,
    evaluation,
    formats,
    grid,
    random_control,
    splits,
)
from dosewise.session import materialize
from dosewise.sources import writers

GROUP = ("model", "layer")


def fit_directions(activations: DataFrame, keys: Sequence[str] = GROUP, path: str | None = None) -> DataFrame:
    """Directions of all groups in one job, stored (at ``path`` or in the scratch folder) for the joins that follow."""
    fitted = D.fit_directions(activations, keys)
    if path is None:
        return materialize(fitted, "directions")
    writers.write_directions(fitted, path)
    return fitted.sparkSession.read.parquet(path)


def validate_directions(
    activations: DataFrame, directions: DataFrame, keys: Sequence[str] = GROUP, digits: int | None = None
) -> DataFrame:
    """All metrics per group of the test vectors projected on stored directions."""
    scores = D.project(activations, directions, keys, digits=digits, keep=["label"])
    return evaluation.evaluate_scores(scores, keys)


def random_baseline(
    activations: DataFrame,
    metrics: DataFrame,
    n: int,
    dim: int | None = None,
    keys: Sequence[str] = GROUP,
    seed: int = 42,
    digits: int | None = None,
) -> DataFrame:
    """Fitted directions against ``n`` random ones on the same vectors.

    Each group has its own dimension, found in the data unless ``dim`` is given; a group whose vectors differ in
    dimension raises an error.
    """
    if dim is None:
        mixed = D.dimension_check(activations.filter(F.col("vec").isNotNull()), keys).filter("not uniform").first()
        if mixed is not None:
            raise ValueError(f"vectors of different dimensions in one group: {mixed.asDict()}")
    trials = random_control.trial_metrics(activations, n, dim, keys, seed, digits=digits)
    summary = random_control.random_summary(trials, keys)
    return random_control.compare_with_random(metrics, summary, keys)


def ablation_report(
    texts: DataFrame,
    scorer: Callable[[Column], Column],
    keys: Sequence[str],
    synonyms: Mapping[str, Sequence[str]] = L.SYNONYMS,
    row_id: str = "row_id",
    seed: int = 42,
    accuracy: str = "accuracy_zero",
) -> DataFrame:
    """Metrics of a text scorer before and after keyword replacement in the positive texts (label 1) only.

    ``texts`` has ``keys, row_id, label, text``.
    """
    both = text_ablation_metrics(texts, scorer, keys, synonyms, row_id, seed)
    original, ablated = (both.filter(F.col("variant") == name) for name in ("original", "ablated"))
    return ablation.metric_drop(original, ablated, keys, accuracy)


def text_ablation_metrics(
    texts: DataFrame,
    scorer: Callable[[Column], Column],
    keys: Sequence[str],
    synonyms: Mapping[str, Sequence[str]] = L.SYNONYMS,
    row_id: str = "row_id",
    seed: int = 42,
) -> DataFrame:
    """Stored metrics per group and variant (``original``, ``ablated``); the texts are read once for both."""
    replaceable = texts.withColumn("_target", F.when(F.col("label") == 1, F.col("text")))
    scored = ablation.ablate_text(replaceable, "_target", row_id, synonyms, seed).select(
        *keys,
        "label",
        scorer(F.col("text")).alias("_before"),
        scorer(F.coalesce("ablated", "text")).alias("_after"),
    )
    long = scored.withColumn("variant", F.explode(F.array(F.lit("original"), F.lit("ablated")))).select(
        *keys,
        "variant",
        "label",
        F.when(F.col("variant") == "original", F.col("_before")).otherwise(F.col("_after")).alias("score"),
    )
    return materialize(evaluation.evaluate_scores(long, [*keys, "variant"]), "ablation_metrics")


def vector_ablation_report(
    original: DataFrame,
    ablated: DataFrame,
    directions: DataFrame,
    keys: Sequence[str] = GROUP,
    accuracy: str = "accuracy_zero",
    digits: int | None = None,
) -> DataFrame:
    """Metrics on the vectors of the original and of the ablated texts, with drop and verdict."""
    return ablation.metric_drop(
        validate_directions(original, directions, keys, digits),
        validate_directions(ablated, directions, keys, digits),
        keys,
        accuracy,
    )


def rating_agreement(
    scores: DataFrame, ratings: DataFrame, keys: Sequence[str] = GROUP, rating: str = "true_score"
) -> DataFrame:
    """Correlations with p-values and the binary accuracies (0 against 2, and at least 1) per scoring group.

    The rated scores (a few numbers per text) are stored once, so the vectors behind them are projected once.
    """
    rated = materialize(
        scores.select(*keys, "text_id", "score").join(ratings.select("text_id", rating), "text_id"), "rated"
    )
    linear = agreement.pearson(rated, keys, "score", rating)
    ranked = agreement.spearman(rated, keys, "score", rating).drop("n")
    extremes = agreement.rating_extremes_metrics(rated, keys, rating, "score").select(
        *keys, F.col("accuracy_median").alias("accuracy_extremes")
    )
    binarised = agreement.rating_binarised_metrics(rated, keys, rating, "score").select(
        *keys, F.col("accuracy_median_strict").alias("accuracy_binarised")
    )
    n = F.col("n")
    return (
        linear.join(ranked, list(keys), "left")
        .join(extremes, list(keys), "left")
        .join(binarised, list(keys), "left")
        .withColumn("pearson_p", agreement.correlation_p_value(F.col("pearson"), n))
        .withColumn("spearman_p", agreement.correlation_p_value(F.col("spearman"), n))
        .withColumn("target_reached", rules.correlation_target(F.col("pearson")))
    )


def dose_response(
    generations: DataFrame, scorers: Mapping[str, Column] | None = None, mode: str = "reference"
) -> dict[str, DataFrame]:
    """Rates, effects, summary, roll-up and failure cases.

    The texts are read once, for the rates, which are stored; everything else works on that small table.
    """
    rates = materialize(conditions.condition_rates(conditions.sample_scores(generations, scorers)), "rates")
    effects = conditions.steering_effects(rates, mode)
    summary = conditions.success_summary(effects)
    return {
        "rates": rates,
        "effects": effects,
        "summary": summary,
        "rollup": conditions.success_rollup(summary),
        "failures": conditions.failure_cases(effects),
    }


def format_variance(
    generations: DataFrame,
    keys: Sequence[str] = conditions.SERIES,
    terms: Mapping[str, Sequence[str]] = L.FORMAT_TERMS,
) -> dict[str, DataFrame]:
    """Formats of the zero-dose texts, their diversity per series, and the change of formats across doses.

    The texts are read once, for the stored counts per condition and format.
    """
    fine = list(dict.fromkeys([*keys, "model", "alpha"]))
    counts = materialize(formats.format_counts(generations, fine, terms), "formats")
    at_zero = counts.filter(F.col("alpha") == 0).groupBy(*keys, "format").agg(F.sum("n").alias("n"))
    by_dose = counts.groupBy("model", "alpha", "format").agg(F.sum("n").alias("n"))
    return {
        "share": formats.format_share(at_zero, keys),
        "distinct": formats.format_distinct(at_zero, keys),
        "diversity": formats.format_diversity(at_zero, keys),
        "most_common": formats.most_common_format(at_zero, keys),
        "by_dose": formats.format_share(by_dose, ["model", "alpha"]),
        "set_change": formats.format_set_change(by_dose, ["model"]),
    }


def dose_curve(
    generations: DataFrame, score: Column | None = None, preferred: float | None = None
) -> dict[str, DataFrame]:
    """Score curve over the doses, baseline beside maximum, change from the baseline; the curve is stored."""
    scorer = T.lexical_ratio(F.col("text")) if score is None else score
    cells = materialize(conditions.condition_scores(generations, scorer), "curve")
    return {
        "curve": cells,
        "extremes": conditions.baseline_and_maximum(cells, "score_mean", preferred),
        "delta": conditions.dose_delta(cells, "score_mean"),
    }


def experiment_grid(
    models: DataFrame, scenarios: Sequence[str], alphas: Sequence[float], samples: int
) -> DataFrame:
    """Full grid with capped doses and condition names."""
    return grid.dose_grid(models, scenarios, alphas, samples).withColumn(
        "condition_name", rules.condition_name(F.col("alpha"))
    )


def make_split(pairs: DataFrame, path: str, row_id: str = "pair_id", fraction: float = 0.7, seed: int = 42) -> DataFrame:
    """Splits the pairs, writes them by split and returns the summary record of what was written."""
    writers.write_pairs(splits.hash_split(pairs, row_id, fraction, seed), path)
    schema = "scenario_id string, source_model string, run_id int, split string"
    return splits.dataset_summary(pairs.sparkSession.read.schema(schema).json(path))


def run_summary(metrics: DataFrame, agreement_table: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Best layer per model with its targets, beside the correlation of that layer."""
    best = evaluation.best_layer(metrics).withColumn("auroc_target", rules.auroc_target(F.col("best_auroc")))
    at_best = agreement_table.select(*keys, F.col("layer").alias("best_layer"), "pearson")
    return best.join(at_best, [*keys, "best_layer"], "left").withColumn(
        "correlation_target", rules.correlation_target(F.col("pearson"))
    )
