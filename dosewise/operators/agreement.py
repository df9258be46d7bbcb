"""Agreement of scores with ratings: correlations, p-values, line fit, histogram."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from dosewise.functions import rules
from dosewise.operators.evaluation import evaluate_scores
from dosewise.operators.ordering import average_ranks
from dosewise.session import broadcast_rows, materialize


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation from ``n`` pairs (t test), for one row per group.

    The helpers are local so that they travel to the workers with the function.
    """

    def beta_fraction(a: float, b: float, x: float) -> float:
        # Regularised incomplete beta function by its continued fraction (modified Lentz), x <= (a+1)/(a+b+2).
        tiny = 1e-300
        log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
        c, d = 1.0, 1 / max(tiny, 1.0 - (a + b) * x / (a + 1))
        value = d
        for m in range(1, 100_000):
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            for term in (even, odd):
                d = 1 + term * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + term / c
                c = c if abs(c) > tiny else tiny
                step = c * d
                value *= step
            if abs(step - 1) < 1e-15:
                break
        return math.exp(log_front) / a * value

    def two_sided(corr: float, pairs: float) -> float:
        if math.isnan(corr) or math.isnan(pairs) or pairs < 3:
            return math.nan
        a, x = (pairs - 2) / 2, 1 - corr * corr
        if x <= 0:
            return 0.0
        if x >= 1:
            return 1.0
        if x <= (a + 1) / (a + 2.5):
            return beta_fraction(a, 0.5, x)
        return 1 - beta_fraction(0.5, a, 1 - x)

    @F.pandas_udf(DoubleType())
    def p_values(corr: pd.Series, pairs: pd.Series) -> pd.Series:
        return pd.Series([two_sided(c, k) for c, k in zip(corr, pairs)], dtype="float64")

    return F.nanvl(p_values(r.cast("double"), n.cast("double")), F.lit(None))


def pearson(scores: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation per group; NULL when a column is constant."""
    products = scores.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_sxy(y, x).alias("_xy"),
        F.regr_sxx(y, x).alias("_xx"),
        F.regr_syy(y, x).alias("_yy"),
    )
    return products.select(*keys, "n", F.expr("try_divide(_xy, sqrt(_xx) * sqrt(_yy)) as pearson"))


def _join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join that keeps NULL groups. It infers no filters, so ``left`` stays shareable with other branches."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    condition = [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on]
    return left.join(renamed, condition).drop(*[f"_right_{c}" for c in on])


def spearman(scores: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks per group; NULL when a column is constant.

    Works on distinct (x, y) pairs with counts, which are stored, as are the ranks of the distinct values. A value that
    many pairs share comes from a column of few distinct values, whose ranks are broadcast after their number has been
    measured; the ranks of a column of many values are joined by values that no group holds often. Ranks are centred on
    their known mean before the products are summed.
    """
    cells = materialize(scores.groupBy(*keys, x, y).agg(F.count("*").alias("_w")), "rank-cells")
    rank_x = broadcast_rows(materialize(average_ranks(cells, keys, x, "_rx", "_w"), "ranks-x"))
    rank_y = broadcast_rows(materialize(average_ranks(cells, keys, y, "_ry", "_w").drop("n_total"), "ranks-y"))
    ranked = _join_null_safe(_join_null_safe(cells, rank_x, [*keys, x]), rank_y, [*keys, y])
    centre = (F.col("n_total") + 1) / 2.0
    w, dx, dy = F.col("_w"), F.col("_rx") - centre, F.col("_ry") - centre
    sums = ranked.groupBy(*keys).agg(
        F.max("n_total").alias("n"),
        F.sum(w * dx * dy).alias("_xy"),
        F.sum(w * dx * dx).alias("_xx"),
        F.sum(w * dy * dy).alias("_yy"),
    )
    scale = F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))
    return sums.select(*keys, "n", F.when(scale > 0, F.col("_xy") / scale).alias("spearman"))


def line_fit(scores: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line y = slope * x + intercept per group, with r, standard error of the slope and p-value."""
    fit = scores.groupBy(*keys).agg(
        F.regr_count(y, x).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
    )
    with_r = fit.withColumn("r", F.expr("try_divide(_sxy, sqrt(_sxx) * sqrt(_syy))"))
    residual = F.greatest(F.lit(0.0), 1 - F.col("r") * F.col("r"))
    return with_r.select(
        *keys,
        "n",
        "slope",
        "intercept",
        "r",
        F.when(
            F.col("n") > 2,
            F.sqrt(F.try_divide(residual * F.col("_syy"), F.col("_sxx") * (F.col("n") - 2))),
        ).alias("slope_stderr"),
        correlation_p_value(F.col("r"), F.col("n")).alias("p_value"),
    )


def histogram(scores: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal-width bins between the group's minimum and maximum; the maximum falls into the last bin.

    A constant column gets a range of one unit around its value. The range of each group is found first and stored; its
    rows are broadcast after their number has been measured, so that bins are counted where the scores are and at most
    ``bins`` rows per group and task are shuffled. ``scores`` is read twice: store it first if that is dear.
    """
    same = F.min(value) == F.max(value)
    ranges = scores.groupBy(*keys).agg(
        F.when(same, F.min(value) - 0.5).otherwise(F.min(value)).alias("lo"),
        F.when(same, F.max(value) + 0.5).otherwise(F.max(value)).alias("hi"),
    )
    ranges = broadcast_rows(materialize(ranges, "histogram-ranges"))
    slot = F.least(F.width_bucket(F.col(value), F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))
    return (
        scores.select(*keys, value)
        .join(ranges, list(keys))
        .select(*keys, "lo", ((F.col("hi") - F.col("lo")) / bins).alias("_width"), slot.cast("int").alias("bin"))
        .groupBy(*keys, "bin", "lo", "_width")
        .agg(F.count("*").alias("n"))
        .filter(F.col("bin").isNotNull())
        .select(*keys, "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("_width")).alias("bin_start"), "n")
    )


def rating_counts(ratings: DataFrame, rating: str = "true_score") -> DataFrame:
    """Number of texts rated 2, 1 and 0."""
    return ratings.agg(
        F.count_if(F.col(rating) == 2).alias("n_high"),
        F.count_if(F.col(rating) == 1).alias("n_medium"),
        F.count_if(F.col(rating) == 0).alias("n_low"),
    )


def rating_extremes_metrics(scores: DataFrame, keys: Sequence[str], rating: str, score: str) -> DataFrame:
    """Metrics on the texts rated 0 or 2 only, with the median of that subset as threshold."""
    subset = scores.withColumn("_label", rules.rating_extremes(F.col(rating))).filter(F.col("_label").isNotNull())
    return evaluate_scores(subset, keys, "_label", score)


def rating_binarised_metrics(scores: DataFrame, keys: Sequence[str], rating: str, score: str) -> DataFrame:
    """Metrics with ratings of at least 1 as the positive class."""
    return evaluate_scores(
        scores.withColumn("_label", rules.rating_at_least_one(F.col(rating))), keys, "_label", score
    )
