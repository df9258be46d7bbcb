"""Names, verdicts, target flags and number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def condition_name(alpha: Column, negative_branch: bool = True) -> Column:
    """Name of a dose. Without the negative branch a negative dose counts as soft."""
    value = alpha.cast("double")
    name = F.when(value == 0, "baseline")
    if negative_branch:
        name = name.when(value < 0, F.concat(F.lit("anti_empathy_"), F.abs(value).cast("string")))
    return (
        name.when(value <= 3, F.concat(F.lit("soft_"), value.cast("string")))
        .when(value == 5, F.concat(F.lit("median_"), value.cast("string")))
        .when(value == 10, F.concat(F.lit("hard_"), value.cast("string")))
        .otherwise(F.concat(F.lit("extreme_"), value.cast("string")))
    )


def drop_verdict(drop: Column) -> Column:
    """Robustness of a detector by its AUROC drop under keyword replacement."""
    return F.when(drop < 0.15, "STRONG").when(drop > 0.30, "WEAK").when(drop.isNotNull(), "MEDIUM")


def variance_verdict(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "moderate").when(score.isNotNull(), "low")


def auroc_target(auroc: Column, target: float = 0.75) -> Column:
    return auroc >= target


def correlation_target(r: Column, target: float = 0.4, absolute: bool = True) -> Column:
    """``|r| >= target``, or ``r > target`` in the signed variant."""
    return F.abs(r) >= target if absolute else r > target


def three_decimals(x: Column) -> Column:
    return F.format_string("%.3f", x)


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def rating_category(rating: Column) -> Column:
    return F.when(rating == 0, "low_empathy").when(rating == 1, "medium_empathy").when(rating == 2, "high_empathy")


def rating_extremes(rating: Column) -> Column:
    """1 for rating 2, 0 for rating 0, NULL between: the binary subset."""
    return F.when(rating == 2, 1).when(rating == 0, 0)


def rating_at_least_one(rating: Column) -> Column:
    return (rating >= 1).cast("int")
