"""Score evaluation per group: AUROC, accuracy rules, confusion counts, separation, best groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from dosewise.operators.ordering import rank_counts

RULES = ("median", "median_strict", "midpoint", "zero")


def evaluate_scores(
    scores: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score"
) -> DataFrame:
    """One row per group with every metric of a binary score, from two shuffles of ``(group, score, counts)`` rows.

    ``label`` is 1 or 0. Per threshold rule the row has ``tp_/fp_/tn_/fn_<rule>`` and ``accuracy_<rule>``:
    ``median`` is ``score >= median``, ``median_strict`` is ``score > median``, ``midpoint`` compares with the mean of
    the two class means and ``zero`` with 0. AUROC is 0.5 when only one class is present, or none. Rows whose label is
    neither 1 nor 0 count nowhere; a group without any labelled row has NULL accuracies, means and median.
    """
    ranked = rank_counts(
        scores,
        keys,
        score,
        {"pos": f"if({label} = 1, 1, 0)", "neg": f"if({label} = 0, 1, 0)"},
        sums={"pos_sum": f"pos * `{score}`", "neg_sum": f"neg * `{score}`"},
    ).selectExpr(
        *keys,
        f"`{score}` as v",
        "pos",
        "neg",
        "neg_below",
        "pos_total",
        "neg_total",
        "pos_below + neg_below as below",
        # zero-based positions of the two middle values, equal for an odd count
        "floor((pos_total + neg_total - 1) / 2) as low",
        "ceil((pos_total + neg_total - 1) / 2) as high",
        "try_divide(pos_sum, pos_total) as pos_mean",
        "try_divide(neg_sum, neg_total) as neg_mean",
    )
    predicted = {
        "median": "below + pos + neg - 1 >= high",
        "median_strict": "below > low",
        "midpoint": "v > (pos_mean + neg_mean) / 2",
        "zero": "v > 0",
    }
    per_group = ranked.groupBy(*keys).agg(
        F.expr("max(pos_total) as n_pos"),
        F.expr("max(neg_total) as n_neg"),
        F.expr("sum(cast(pos as double) * (neg_below + neg / 2.0D)) as wins"),
        F.expr("max(pos_mean) as pos_mean"),
        F.expr("max(neg_mean) as neg_mean"),
        F.expr("sum(pos * (v - pos_mean) * (v - pos_mean)) as pos_ss"),
        F.expr("sum(neg * (v - neg_mean) * (v - neg_mean)) as neg_ss"),
        F.expr("max(case when below <= low and low < below + pos + neg then v end) as v_low"),
        F.expr("max(case when below <= high and high < below + pos + neg then v end) as v_high"),
        *[F.expr(f"sum(if({c}, pos, 0)) as tp_{rule}") for rule, c in predicted.items()],
        *[F.expr(f"sum(if({c}, neg, 0)) as fp_{rule}") for rule, c in predicted.items()],
    )
    by_rule = []
    for rule in RULES:
        by_rule += [
            f"tp_{rule}",
            f"fp_{rule}",
            f"n_neg - fp_{rule} as tn_{rule}",
            f"n_pos - tp_{rule} as fn_{rule}",
            f"try_divide(tp_{rule} + n_neg - fp_{rule}, cast(n_pos + n_neg as double)) as accuracy_{rule}",
        ]
    return per_group.selectExpr(
        *keys,
        "n_pos",
        "n_neg",
        "if(n_pos = 0 or n_neg = 0, 0.5D, try_divide(wins, cast(n_pos as double) * n_neg)) as auroc",
        "(v_low + v_high) / 2 as median",
        "pos_mean",
        "neg_mean",
        "sqrt(try_divide(pos_ss, n_pos)) as pos_std",
        "sqrt(try_divide(neg_ss, n_neg)) as neg_std",
        "pos_mean - neg_mean as separation",
        "abs(pos_mean - neg_mean) as abs_separation",
        *by_rule,
    )


def auroc(scores: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Tie-averaged AUROC per group."""
    return evaluate_scores(scores, keys, label, score).select(*keys, "n_pos", "n_neg", "auroc")


def confusion(metrics: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """The four counts of one threshold rule and both matrix layouts in use: TN first and TP first."""
    tp, fp, tn, fn = (F.col(f"{c}_{rule}") for c in ("tp", "fp", "tn", "fn"))
    return metrics.select(
        *keys,
        tp.alias("tp"),
        fp.alias("fp"),
        tn.alias("tn"),
        fn.alias("fn"),
        F.array(F.array(tn, fp), F.array(fn, tp)).alias("matrix_tn_first"),
        F.array(F.array(tp, fp), F.array(fn, tn)).alias("matrix_tp_first"),
    )


def precision_recall(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, specificity and F1 from ``tp, fp, tn, fn``; undefined ratios are NULL."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.select(
        *keys,
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def best_layer(metrics: DataFrame, model: str = "model", layer: str = "layer", metric: str = "auroc") -> DataFrame:
    """Layer of greatest metric per model; ties go to the smallest layer."""
    return (
        metrics.groupBy(model)
        .agg(F.max(F.struct(F.col(metric), (-F.col(layer)).alias("_order"))).alias("_best"))
        .select(model, (-F.col("_best._order")).alias("best_layer"), F.col(f"_best.{metric}").alias(f"best_{metric}"))
    )


def top_layers(
    metrics: DataFrame, k: int, model: str = "model", layer: str = "layer", metric: str = "auroc"
) -> DataFrame:
    """The ``k`` best layers per model; the window runs over metric rows, one per layer."""
    order = Window.partitionBy(model).orderBy(F.col(metric).desc(), F.col(layer))
    return (
        metrics.select(model, layer, metric)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )
