"""Dose-response analysis: rates per condition, effect against the zero dose, success, roll-ups, failure cases.

``generations`` has one text per row: ``model, layer, scenario, alpha, text``. The first aggregation reduces it to one
row per (model, layer, scenario, alpha), with map-side partial sums; everything after it works on those cells, so its
windows see one row per dose of a design cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dosewise.functions import text as T

SERIES = ["model", "layer", "scenario"]
CELL = [*SERIES, "alpha"]


def sample_scores(
    generations: DataFrame, scorers: Mapping[str, Column] | None = None
) -> DataFrame:
    """Per-text analysis, one row per sample (kept as rows rather than collected per condition)."""
    text, tokens = F.col("text"), F.col("_tokens")
    columns = {
        "coherent": T.is_coherent(text, tokens=tokens),
        "has_context": T.contains_markers(text, F.col("scenario")),
        "positive_language": T.lexical_majority(text),
        "length": T.length(text),
        "word_count": T.word_count(text, tokens),
    } | dict(scorers or {})
    return generations.withColumn("_tokens", T.words(text)).withColumns(columns).drop("_tokens")


def condition_rates(samples: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Sample count, rates and mean lengths per condition."""
    return samples.groupBy(*keys).agg(
        F.count("*").alias("num_samples"),
        F.avg(F.col("coherent").cast("int")).alias("coherent_rate"),
        F.avg(F.col("has_context").cast("int")).alias("context_rate"),
        F.avg(F.col("positive_language").cast("int")).alias("positive_rate"),
        F.avg("length").alias("avg_length"),
        F.avg("word_count").alias("avg_word_count"),
    )


def condition_scores(generations: DataFrame, score: Column, keys: Sequence[str] = CELL) -> DataFrame:
    """Mean and population standard deviation of a per-text score per condition."""
    return (
        generations.select(*keys, score.cast("double").alias("_score"))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("num_samples"),
            F.avg("_score").alias("score_mean"),
            F.stddev_pop("_score").alias("score_std"),
        )
    )


def against_baseline(cells: DataFrame, value: str, baseline: str, series: Sequence[str] = SERIES) -> DataFrame:
    """Adds the value at dose 0 of the same series; series without a zero dose are dropped."""
    at_zero = F.max(F.when(F.col("alpha") == 0, F.col(value))).over(Window.partitionBy(*series))
    return cells.withColumn(baseline, at_zero).filter(F.col(baseline).isNotNull())


def steering_effects(rates: DataFrame, mode: str = "reference") -> DataFrame:
    """Effect of each dose and whether its sign is as expected (NULL at dose 0).

    ``reference`` mode compares ``alpha > 0`` with ``effect > 0``, so no effect counts as a match for a negative dose;
    ``strict`` counts no effect as a miss for both signs.
    """
    effect = F.col("steering_effect")
    if mode == "strict":
        matches = F.signum(F.col("alpha")) == F.signum(effect)
    elif mode == "reference":
        matches = (F.col("alpha") > 0) == (effect > 0)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return (
        against_baseline(rates, "positive_rate", "baseline_rate")
        .withColumn("steering_effect", F.col("positive_rate") - F.col("baseline_rate"))
        .withColumn("matches_expected", F.when(F.col("alpha") != 0, matches))
        .select(
            *CELL,
            "positive_rate",
            "baseline_rate",
            "steering_effect",
            "matches_expected",
            "coherent_rate",
            "context_rate",
        )
    )


def success_summary(effects: DataFrame) -> DataFrame:
    """Share of non-zero doses with the expected sign, per series; 0 without any."""
    dosed = F.col("alpha") != 0
    return effects.groupBy(*SERIES).agg(
        F.coalesce(F.avg(F.when(dosed, F.col("matches_expected").cast("double"))), F.lit(0.0)).alias("success_rate"),
        F.max("baseline_rate").alias("baseline_rate"),
        (F.count("*") - 1).alias("num_alphas"),
    )


def success_rollup(summary: DataFrame) -> DataFrame:
    """Unweighted mean success by model, by model and layer, and by scenario in one pass."""
    view = summary.select("model", "layer", "scenario", "success_rate")
    grouped = view.groupingSets(
        [[F.col("model")], [F.col("model"), F.col("layer")], [F.col("scenario")]], "model", "layer", "scenario"
    )
    return grouped.agg(
        F.grouping_id().alias("_gid"),
        F.avg("success_rate").alias("success_rate"),
        F.count("*").alias("num_series"),
    ).select(
        F.when(F.col("_gid") == 3, "model").when(F.col("_gid") == 1, "model_layer").otherwise("scenario").alias("level"),
        "model",
        "layer",
        "scenario",
        "success_rate",
        "num_series",
    )


def failure_cases(effects: DataFrame) -> DataFrame:
    """Resistance at strong doses, early breakdown at weak ones, effects of the wrong sign; one scan, not exclusive."""
    dose = F.abs(F.col("alpha"))
    miss = ~F.col("matches_expected")
    none = F.lit(None)

    def case(kind: str, effect: Column, coherent: Column, expected: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            effect.cast("double").alias("effect"),
            coherent.cast("double").alias("coherent_rate"),
            expected.cast("string").alias("expected"),
        )

    effect, coherent = F.col("steering_effect"), F.col("coherent_rate")
    direction = F.when(F.col("alpha") > 0, "more").otherwise("less")
    cases = F.array_compact(
        F.array(
            F.when((dose >= 10) & miss, case("resistance_to_extreme_steering", effect, coherent, none)),
            F.when((dose <= 5) & (coherent < 0.5), case("early_breakdown", none, coherent, none)),
            F.when((dose >= 5) & miss & (coherent > 0.5), case("reverse_steering", effect, none, direction)),
        )
    )
    return (
        effects.filter(F.col("alpha") != 0)
        .select(*CELL, F.explode(cases).alias("case"))
        .select("case.type", *CELL, "case.effect", "case.coherent_rate", "case.expected")
    )


def pooled_positive_doses(
    generations: DataFrame, hits: Column, keys: Sequence[str] = ("model", "layer", "alpha")
) -> DataFrame:
    """Per model, layer and positive dose: mean over the cells of the share of texts with a hit and of the mean hits."""
    per_cell = (
        generations.filter(F.col("alpha") > 0)
        .select(*CELL, hits.alias("_hits"))
        .groupBy(*CELL)
        .agg(F.avg((F.col("_hits") > 0).cast("int")).alias("_rate"), F.avg("_hits").alias("_mean"))
    )
    return per_cell.groupBy(*keys).agg(
        F.avg("_rate").alias("success_rate"), F.avg("_mean").alias("mean_hits"), F.count("*").alias("num_cells")
    )


def fold_change(curve: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value at the highest dose over the value at the lowest; NULL unless the latter is positive."""
    first, last = F.min_by(value, "alpha"), F.max_by(value, "alpha")
    return (
        curve.groupBy(*keys)
        .agg(first.alias("first_value"), last.alias("last_value"))
        .withColumn("fold_change", F.when(F.col("first_value") > 0, F.col("last_value") / F.col("first_value")))
    )


def baseline_and_maximum(cells: DataFrame, value: str, preferred: float | None = None) -> DataFrame:
    """Value at dose 0 and at the highest dose (or at the preferred positive dose where present), with the gain."""
    alpha = F.col("alpha")
    if preferred is None:
        top_dose, top_value = F.max(alpha), F.max_by(value, alpha)
    else:
        order = F.when(alpha > 0, F.struct((alpha == preferred).cast("int").alias("hit"), alpha.alias("alpha")))
        top_dose, top_value = F.max(order)["alpha"], F.max_by(value, order)
    return (
        cells.groupBy(*SERIES)
        .agg(
            F.max(F.when(alpha == 0, F.col(value))).alias("baseline_value"),
            top_dose.alias("max_alpha"),
            top_value.alias("max_value"),
        )
        .filter(F.col("baseline_value").isNotNull() & F.col("max_value").isNotNull())
        .withColumn("gain", F.col("max_value") - F.col("baseline_value"))
    )


def dose_delta(cells: DataFrame, value: str, slope: float = 0.02) -> DataFrame:
    """Change from the zero dose along the curve, next to the ideal line ``slope * alpha``."""
    return against_baseline(cells, value, "baseline_value").select(
        *CELL,
        value,
        (F.col(value) - F.col("baseline_value")).alias("delta"),
        (F.lit(slope) * F.col("alpha")).alias("ideal"),
    )


def percent_change(cells: DataFrame, value: str) -> DataFrame:
    """Change from the zero dose in percent; NULL where the zero-dose value is 0."""
    return against_baseline(cells, value, "baseline_value").select(
        *CELL,
        value,
        (F.try_divide(F.col(value) - F.col("baseline_value"), F.col("baseline_value")) * 100).alias("percent_change"),
    )


def hit_ratio(
    generations: DataFrame,
    task_hits: Column,
    positive_hits: Column,
    keys: Sequence[str] = ("model", "layer", "alpha"),
) -> DataFrame:
    """Mean task hits per mean positive hit for each model, layer and dose."""
    return (
        generations.select(*keys, task_hits.alias("_task"), positive_hits.alias("_pos"))
        .groupBy(*keys)
        .agg(F.avg("_task").alias("mean_task_hits"), F.avg("_pos").alias("mean_positive_hits"))
        .withColumn("task_ratio", F.try_divide(F.col("mean_task_hits"), F.col("mean_positive_hits")))
    )


def flag_tally(
    generations: DataFrame, flag: Column, doses: Sequence[float], keys: Sequence[str] = SERIES
) -> DataFrame:
    """Flagged texts at each of a few doses side by side, with the number of texts."""
    alpha = F.col("alpha")
    aggs = []
    for dose in doses:
        tag = f"{dose:g}".replace("-", "minus_").replace(".", "_")
        aggs.append(F.count_if((alpha == dose) & F.col("_flag")).alias(f"flagged_{tag}"))
        aggs.append(F.count_if(alpha == dose).alias(f"texts_{tag}"))
    counted = F.when(alpha.isin(list(doses)), flag).alias("_flag")  # the flag is not computed for other doses
    return generations.select(*keys, "alpha", counted).groupBy(*keys).agg(*aggs)


def first_layer(cells: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Cells of the smallest layer per model; works on aggregated cells, not on texts."""
    first = F.min("layer").over(Window.partitionBy(*keys))
    return cells.withColumn("_first", first).filter(F.col("layer") == F.col("_first")).drop("_first")


def select_layers(cells: DataFrame, selection: DataFrame) -> DataFrame:
    """Cells of the chosen (model, layer) pairs, e.g. the best layer of each model."""
    return cells.join(selection.select("model", "layer"), ["model", "layer"], "left_semi")


def layer_pivot(cells: DataFrame, value: str, alpha: float, low: int, high: int) -> DataFrame:
    """Two layers side by side at one dose, per (model, scenario), with the improvement in percent."""
    at = cells.filter(F.col("alpha") == alpha)

    def layer(n: int) -> Column:
        return F.max(F.when(F.col("layer") == n, F.col(value)))

    return (
        at.groupBy("model", "scenario")
        .agg(layer(low).alias("low_layer"), layer(high).alias("high_layer"))
        .withColumn(
            "improvement", F.try_divide(F.col("high_layer") - F.col("low_layer"), F.col("low_layer")) * 100
        )
    )


def coherent_share(generations: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Coherent texts per condition by the loose rule."""
    return (
        generations.select(*keys, "text", T.words(F.col("text")).alias("_tokens"))
        .select(*keys, T.is_coherent_loose(F.col("text"), tokens=F.col("_tokens")).alias("_ok"))
        .groupBy(*keys)
        .agg(
            F.count_if("_ok").alias("coherent"),
            F.count("*").alias("num_samples"),
            (F.avg(F.col("_ok").cast("int")) * 100).alias("coherent_percent"),
        )
    )
