"""Experiment grids and their audit. Dimension lists are small literals exploded per row, so nothing is cross-joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dosewise.session import materialize


def _explode(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def pair_grid(scenarios: DataFrame, models: Sequence[str], runs: int, scenario: str = "id") -> DataFrame:
    """scenario x model x run."""
    grid = _explode(scenarios.select(F.col(scenario).alias("scenario_id")), models, "source_model")
    return grid.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def capped_doses(models: DataFrame, alphas: Sequence[float], cap: str = "max_alpha") -> DataFrame:
    """Doses of each model whose magnitude does not exceed the model's cap."""
    doses = F.array(*[F.lit(float(a)) for a in alphas])
    return models.withColumn("alpha", F.explode(F.filter(doses, lambda a: F.abs(a) <= F.col(cap))))


def dose_grid(
    models: DataFrame, scenarios: Sequence[str], alphas: Sequence[float], samples: int, cap: str = "max_alpha"
) -> DataFrame:
    """(model, layer) x scenario x capped dose x sample."""
    grid = _explode(capped_doses(models, alphas, cap), scenarios, "scenario")
    return grid.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def only_scenarios(df: DataFrame, wanted: DataFrame, scenario: str = "scenario") -> DataFrame:
    """Rows of the wanted scenarios.

    The distinct names are stored first, so that the planner sees their true size and need not shuffle the texts.
    """
    return df.join(materialize(wanted.select(scenario).distinct(), "scenarios"), scenario, "left_semi")


def missing_cells(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Grid cells without any result."""
    return expected.select(*keys).join(present.select(*keys).distinct(), list(keys), "left_anti")


def audit_grid(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected, present and missing cells, and the number of result rows.

    Results are counted per cell first, so both sides of the join hold one row per cell.
    """
    cells = expected.select(*keys).distinct().withColumn("_expected", F.lit(1))
    found = present.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return cells.join(found, list(keys), "left").agg(
        F.count("*").alias("expected_cells"),
        F.count("_rows").alias("present_cells"),
        F.count_if(F.col("_rows").isNull()).alias("missing_cells"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("result_rows"),
    )
