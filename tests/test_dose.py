"""Dose-response rules on hand-made cells."""

import pytest
from pyspark.sql import functions as F

from dosewise.functions import text as T
from dosewise.operators import conditions as C, formats as M, grid as G
from dosewise.plans import analyses as A

RATES = "model string, layer int, scenario string, alpha double, positive_rate double, coherent_rate double, context_rate double"


def effects(spark, rows, mode="reference"):
    df = spark.createDataFrame([("m", 1, s, a, p, c, 0.0) for s, a, p, c in rows], RATES)
    return C.steering_effects(df, mode)


CELLS = [
    ("s", -10.0, 0.5, 1.0),  # no effect, negative dose
    ("s", 0.0, 0.5, 1.0),
    ("s", 5.0, 0.5, 0.4),  # no effect, positive dose, broken
    ("s", 10.0, 0.9, 0.2),
    ("t", 5.0, 0.9, 1.0),  # no baseline
]


def test_zero_effect_asymmetry_and_missing_baseline(spark):
    rows = {r["alpha"]: r for r in effects(spark, CELLS).collect()}
    assert len(rows) == 4
    assert rows[-10.0]["matches_expected"] is True and rows[5.0]["matches_expected"] is False
    assert rows[0.0]["matches_expected"] is None and rows[10.0]["steering_effect"] == pytest.approx(0.4)
    strict = {r["alpha"]: r["matches_expected"] for r in effects(spark, CELLS, "strict").collect()}
    assert strict == {-10.0: False, 0.0: None, 5.0: False, 10.0: True}
    with pytest.raises(ValueError):
        effects(spark, CELLS, "other")


def test_success_summary_and_only_baseline(spark):
    r = C.success_summary(effects(spark, CELLS)).first()
    assert r["success_rate"] == pytest.approx(2 / 3) and r["num_alphas"] == 3 and r["baseline_rate"] == 0.5
    alone = C.success_summary(effects(spark, [("s", 0.0, 1.0, 1.0)])).first()
    assert alone["success_rate"] == 0.0 and alone["num_alphas"] == 0
    flat = [("s", a, 1.0, 1.0) for a in (-10.0, -5.0, 0.0, 5.0, 10.0)]
    assert C.success_summary(effects(spark, flat)).first()["success_rate"] == 0.5


def test_failure_cases_are_not_exclusive(spark):
    rows = [("s", 0.0, 0.5, 1.0), ("s", 10.0, 0.4, 0.9), ("s", 5.0, 0.6, 0.3), ("s", -20.0, 0.9, 0.5), ("s", 4.0, 0.1, 0.9)]
    got = {(r["type"], r["alpha"]): r for r in C.failure_cases(effects(spark, rows)).collect()}
    assert set(got) == {
        ("resistance_to_extreme_steering", 10.0),
        ("reverse_steering", 10.0),
        ("early_breakdown", 5.0),
        ("resistance_to_extreme_steering", -20.0),
    }
    assert got["reverse_steering", 10.0]["expected"] == "more" and got["reverse_steering", 10.0]["coherent_rate"] is None
    assert got["early_breakdown", 5.0]["effect"] is None


def test_curves(spark):
    schema = "model string, layer int, scenario string, alpha double, x double"
    rows = [("m", 0, "s", a, x) for a, x in ((-5.0, 0.1), (0.0, 0.0), (10.0, 0.6), (20.0, 0.3))]
    cells = spark.createDataFrame(rows + [("m", 1, "s", 20.0, 0.9)], schema)
    top = C.baseline_and_maximum(cells, "x").collect()
    assert len(top) == 1 and (top[0]["max_alpha"], top[0]["gain"]) == (20.0, 0.3)
    preferred = C.baseline_and_maximum(cells, "x", preferred=10.0).first()
    assert (preferred["max_alpha"], preferred["max_value"]) == (10.0, 0.6)
    fallback = C.baseline_and_maximum(cells, "x", preferred=7.0).first()
    assert fallback["max_alpha"] == 20.0
    delta = {r["alpha"]: r for r in C.dose_delta(cells, "x").collect()}
    assert delta[20.0]["delta"] == pytest.approx(0.3) and delta[20.0]["ideal"] == pytest.approx(0.4)
    assert all(r["percent_change"] is None for r in C.percent_change(cells, "x").collect())
    fold = C.fold_change(cells.filter("layer = 0 and alpha >= 10"), ["model"], "x").first()
    assert fold["fold_change"] == pytest.approx(0.5)
    assert C.fold_change(cells.filter("layer = 0 and alpha >= 0"), ["model"], "x").first()["fold_change"] is None
    pivot = C.layer_pivot(cells, "x", 20.0, 0, 1).first()
    assert (pivot["low_layer"], pivot["high_layer"]) == (0.3, 0.9) and pivot["improvement"] == pytest.approx(200)


GEN = "model string, layer int, scenario string, alpha double, sample long, text string"


def test_whole_analysis_on_texts(spark):
    good = "I want to help and support you because I care about what you feel today my friend"
    task = "The objective is to win the task quickly with an optimal strategy and then proceed on"
    rows = [("m", 1, "the_listener", a, i, t) for a, ts in ((0.0, [good, task]), (10.0, [good, good]), (-10.0, [task, "x"])) for i, t in enumerate(ts)]
    out = A.dose_response(spark.createDataFrame(rows, GEN))
    rates = {r["alpha"]: r for r in out["rates"].collect()}
    assert rates[0.0]["positive_rate"] == 0.5 and rates[-10.0]["coherent_rate"] == 0.5
    assert rates[10.0]["avg_length"] == len(good) and rates[10.0]["num_samples"] == 2
    assert out["summary"].first()["success_rate"] == 1.0 and out["failures"].count() == 0
    levels = {r["level"] for r in out["rollup"].collect()}
    assert levels == {"model", "model_layer", "scenario"}


def test_formats_across_doses(spark):
    texts = [(0.0, 1, "a | b"), (0.0, 2, "short"), (5.0, 1, "a | b"), (5.0, 2, "tiny")]
    rows = [("m", 0, "s", *t) for t in texts]
    out = A.format_variance(spark.createDataFrame(rows, GEN))
    assert all(r["all_same"] for r in out["set_change"].collect())
    rows.append(("m", 0, "s", 10.0, 1, "a | b"))
    changed = {r["alpha"]: r for r in A.format_variance(spark.createDataFrame(rows, GEN))["set_change"].collect()}
    assert not changed[10.0]["same_as_baseline"] and changed[5.0]["same_as_baseline"] and not changed[0.0]["all_same"]
    no_base = spark.createDataFrame(rows[2:], GEN)
    counts = M.format_counts(no_base, ["model", "alpha"])
    assert not any(r["same_as_baseline"] for r in M.format_set_change(counts, ["model"]).collect())


def test_pooled_rate_is_a_mean_of_means(spark):
    rows = [("m", 0, "s", 5.0, i, t) for i, t in enumerate(["help", "no", "no", "no"])] + [("m", 0, "t", 5.0, 9, "help care")]
    r = C.pooled_positive_doses(spark.createDataFrame(rows, GEN), T.keyword_hits(F.col("text"), ["help", "care"])).first()
    assert r["success_rate"] == pytest.approx((0.25 + 1) / 2) and r["mean_hits"] == pytest.approx((0.25 + 2) / 2)


def test_grid_and_audit(spark):
    models = spark.createDataFrame([("a", 1, 20.0), ("b", 2, 5.0)], "model string, layer int, max_alpha double")
    grid = A.experiment_grid(models, ["s", "t"], [-10, -5, 0, 5, 20], 3)
    assert grid.count() == (5 + 3) * 2 * 3
    present = spark.createDataFrame([("a", 1, "s", 0.0)] * 4, "model string, layer int, scenario string, alpha double")
    r = G.audit_grid(grid, present, C.CELL).first()
    assert (r["expected_cells"], r["present_cells"], r["missing_cells"], r["result_rows"]) == (16, 1, 15, 4)
    pairs = G.pair_grid(spark.createDataFrame([("s1",), ("s2",)], "id string"), ["x", "y"], 5)
    assert pairs.count() == 20 and pairs.agg(F.max("run_id")).first()[0] == 4
