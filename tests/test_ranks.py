"""Distributed ranks, quantiles and score metrics against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.operators.evaluation import best_layer, confusion, evaluate_scores, precision_recall, top_layers
from dosewise.operators import ordering
from dosewise.operators.ordering import average_ranks, exact_quantiles, rank_counts


def brute_auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    if len(pos) == 0 or len(neg) == 0:
        return 0.5
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


@pytest.fixture(scope="module")
def rows():
    """Three groups: continuous, one value holding a third of the rows, and a single class."""
    rng = np.random.default_rng(7)
    out = []
    for g, n in (("a", 700), ("b", 500), ("c", 40)):
        score = rng.normal(size=n).round(3)
        if g == "b":
            score[: n // 3] = 0.25
        label = np.zeros(n, int) if g == "c" else rng.integers(0, 2, n)
        out += [(g, int(y), float(s)) for y, s in zip(label, score)]
    return out


@pytest.fixture(scope="module")
def scores(spark, rows):
    return spark.createDataFrame(rows, "g string, label int, score double").repartition(5)


@pytest.mark.parametrize("pairs", [1, 8, 20, 100, 16384])
def test_counts_below_any_cut_points(scores, rows, pairs):
    got = rank_counts(scores, ["g"], "score", {"n": "1", "pos": "label"}, range_pairs=pairs).collect()
    for g in "abc":
        s = np.array([r[2] for r in rows if r[0] == g])
        y = np.array([r[1] for r in rows if r[0] == g])
        mine = {r["score"]: r for r in got if r["g"] == g}
        assert set(mine) == set(s)
        for value, r in mine.items():
            assert r["n"] == (s == value).sum() and r["n_below"] == (s < value).sum() and r["n_total"] == len(s)
            assert r["pos_below"] == y[s < value].sum() and r["pos_total"] == y.sum()


def test_null_values_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", None), ("x", 5.0)], "g string, v double")
    got = {(r["g"], r["v"]): r["n_below"] for r in rank_counts(df, ["g"], "v", {"n": "1"}).collect()}
    assert got == {(None, 1.0): 0, (None, 2.0): 1, ("x", 5.0): 0}


def test_ungrouped_quantiles_and_average_ranks(spark):
    values = [5.0, 1.0, 1.0, 9.0, 3.0, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    q = exact_quantiles(df, [], "v", {"median": 0.5, "p95": 0.95}).first()
    assert q["median"] == np.median(values) and q["p95"] == pytest.approx(np.percentile(values, 95))
    ranks = {r["v"]: r["rank"] for r in average_ranks(df, [], "v", "rank").collect()}
    assert ranks == {1.0: 2.0, 3.0: 4.0, 5.0: 5.0, 9.0: 6.0}


def test_metrics_equal_brute_force(scores, rows):
    got = {r["g"]: r for r in evaluate_scores(scores, ["g"]).collect()}
    for g in "abc":
        s = np.array([r[2] for r in rows if r[0] == g])
        y = np.array([r[1] for r in rows if r[0] == g])
        r = got[g]
        assert r["auroc"] == pytest.approx(brute_auroc(y, s), abs=1e-12)
        assert r["median"] == pytest.approx(np.median(s))
        assert r["accuracy_median"] == pytest.approx(((s >= np.median(s)) == y).mean())
        assert r["accuracy_median_strict"] == pytest.approx(((s > np.median(s)) == y).mean())
        assert r["accuracy_zero"] == pytest.approx(((s > 0) == y).mean())
        assert r["neg_mean"] == pytest.approx(s[y == 0].mean()) and r["neg_std"] == pytest.approx(s[y == 0].std())
        if g == "c":
            assert r["pos_mean"] is None and r["separation"] is None
            continue
        middle = (s[y == 1].mean() + s[y == 0].mean()) / 2
        assert r["accuracy_midpoint"] == pytest.approx(((s > middle) == y).mean())
        assert r["separation"] == pytest.approx(s[y == 1].mean() - s[y == 0].mean())
        assert r["pos_std"] == pytest.approx(s[y == 1].std())


def test_auroc_laws(scores):
    base = {r["g"]: r["auroc"] for r in evaluate_scores(scores, ["g"]).collect()}
    scaled = evaluate_scores(scores.withColumn("score", F.col("score") * 4 + 1), ["g"])
    flipped = evaluate_scores(scores.withColumn("label", 1 - F.col("label")), ["g"])
    moved = evaluate_scores(scores.repartition(1).orderBy("score"), ["g"])
    assert {r["g"]: r["auroc"] for r in scaled.collect()} == pytest.approx(base)
    assert {r["g"]: r["auroc"] for r in moved.collect()} == pytest.approx(base)
    assert {r["g"]: 1 - r["auroc"] for r in flipped.collect()} == pytest.approx(base)


def test_all_tied_and_separable(spark):
    rows = [("tied", i % 2, 0.5) for i in range(6)] + [("split", int(i >= 3), float(i)) for i in range(6)]
    got = {r["g"]: r for r in evaluate_scores(spark.createDataFrame(rows, "g string, label int, score double"), ["g"]).collect()}
    assert got["tied"]["auroc"] == 0.5 and got["tied"]["accuracy_median_strict"] == 0.5
    assert got["split"]["auroc"] == 1.0 and got["split"]["accuracy_median"] == 1.0 and got["split"]["separation"] == 3.0


def test_confusion_layouts_and_ratios(spark):
    rows = [("g", 1, 2.0), ("g", 1, -1.0), ("g", 0, 3.0), ("g", 0, -2.0), ("g", 0, -3.0)]
    metrics = evaluate_scores(spark.createDataFrame(rows, "g string, label int, score double"), ["g"])
    counts = confusion(metrics, ["g"], "zero")
    r = counts.first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (1, 1, 2, 1)
    assert r["matrix_tn_first"] == [[2, 1], [1, 1]] and r["matrix_tp_first"] == [[1, 1], [1, 2]]
    p = precision_recall(counts, ["g"]).first()
    assert (p["precision"], p["recall"], p["f1"]) == (0.5, 0.5, 0.5) and p["specificity"] == pytest.approx(2 / 3)


def test_best_and_top_layers_break_ties_by_layer(spark):
    rows = [("m", 16, 0.9), ("m", 8, 0.99), ("m", 12, 0.99), ("n", 3, 0.2)]
    metrics = spark.createDataFrame(rows, "model string, layer int, auroc double")
    assert {(r["model"], r["best_layer"]) for r in best_layer(metrics).collect()} == {("m", 8), ("n", 3)}
    top = top_layers(metrics, 2).filter("model = 'm'").orderBy("rank").collect()
    assert [r["layer"] for r in top] == [8, 12]


def test_plan_has_no_window_over_a_whole_group(scores):
    """Row-level windows are partitioned by bucket too, and the reduction is shared by exchange reuse."""
    plan = evaluate_scores(scores, ["g"])._jdf.queryExecution().toString()
    optimized = plan.split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1]
    row_windows = [line for line in optimized.splitlines() if "Window [" in line and "score" in line]
    assert row_windows and all("_bucket" in line for line in row_windows)


def test_scores_are_evaluated_once(spark, scores, rows):
    """Cut points, bucket totals and rows come from one shared exchange."""
    from pyspark.sql.types import DoubleType

    seen = spark.sparkContext.accumulator(0)

    def touch(x):
        seen.add(1)
        return x

    counted = scores.withColumn("score", F.udf(touch, DoubleType())("score"))
    evaluate_scores(counted, ["g"]).collect()
    assert seen.value == len(rows)


def test_ranges_follow_the_number_of_pairs(spark):
    """A million pairs, a third of them in a narrow band: no range, and so no window, has more than 65,536."""
    x = F.when(F.col("id") % 3 == 0, F.col("id") * 1e-12).otherwise(F.hash("id") * 1.0)
    pairs = spark.range(1_000_000).select(F.lit("g").alias("g"), x.alias("score"), F.lit(1).alias("n"))
    cuts = ordering._cut_points(pairs, "score", ordering.RANGE_PAIRS)
    placed = pairs.withColumn("_cuts", cuts.scalar()).selectExpr(f"{ordering._bucket_of('score', '_cuts')} as b")
    sizes = placed.groupBy("b").count().agg(F.count("*").alias("n"), F.max("count").alias("most")).first()
    assert 40 <= sizes["n"] <= 90 and sizes["most"] <= 65_536
