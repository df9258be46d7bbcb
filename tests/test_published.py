"""Aggregates recomputed from published row values (fixed values, copied as data)."""

import pytest

from dosewise.operators import agreement, conditions, evaluation, formats, random_control
from pyspark.sql import functions as F

# --- fixed values: AUROC of 100 random directions ---
RANDOM_AUROCS = [
    0.76, 0.3711111111111111, 0.1711111111111111, 0.8133333333333335, 0.56, 0.28888888888888886, 0.45333333333333337,
    0.18666666666666665, 0.6111111111111112, 0.38222222222222224, 0.44, 0.08444444444444443, 0.6799999999999999,
    0.6577777777777778, 0.5377777777777778, 0.7822222222222223, 0.36000000000000004, 0.9688888888888889,
    0.09333333333333332, 0.7511111111111111, 0.6755555555555556, 0.37333333333333335, 0.5577777777777778, 0.4,
    0.5733333333333333, 0.7288888888888889, 0.29777777777777775, 0.4311111111111111, 0.8400000000000001,
    0.2733333333333333, 0.9244444444444445, 0.76, 0.3511111111111111, 0.022222222222222227, 0.4622222222222222,
    0.38222222222222224, 0.0711111111111111, 0.41333333333333333, 0.48, 0.41333333333333333, 0.8533333333333334,
    0.6577777777777778, 0.5733333333333334, 0.5111111111111111, 0.7177777777777778, 0.5866666666666667,
    0.731111111111111, 0.3466666666666667, 0.76, 0.5244444444444445, 0.09333333333333332, 0.7533333333333334,
    0.2533333333333333, 0.5333333333333334, 0.6844444444444444, 0.2177777777777778, 0.3844444444444444,
    0.7511111111111111, 0.49777777777777776, 0.2488888888888889, 0.40888888888888886, 0.3244444444444445,
    0.9333333333333333, 0.2866666666666667, 0.4044444444444444, 0.9466666666666667, 0.7377777777777778,
    0.2177777777777778, 0.76, 0.07999999999999999, 0.27999999999999997, 0.5911111111111111, 0.648888888888889,
    0.768888888888889, 0.6444444444444444, 0.4822222222222222, 0.12, 0.44666666666666666, 0.7622222222222221,
    0.4955555555555555, 0.23555555555555557, 0.05333333333333333, 0.9422222222222223, 0.41111111111111115,
    0.7733333333333333, 0.8222222222222222, 0.6044444444444443, 0.508888888888889, 0.21111111111111114,
    0.33999999999999997, 0.8244444444444444, 0.6533333333333333, 0.4444444444444444, 0.29333333333333333,
    0.31555555555555553, 0.1911111111111111, 0.2977777777777778, 0.3933333333333333, 0.8488888888888889,
    0.2088888888888889,
]

# --- fixed values: ratings of 12 texts and their scores by three models ---
RATINGS = [2, 0, 2, 0, 2, 0, 2, 0, 2, 0, 1, 1]
SCORES = {
    "a": [
        -10.203125, -16.65625, -12.8203125, -19.265625, -14.9296875, -20.046875, -13.515625, -24.34375, -14.625,
        -18.1875, -20.09375, -23.734375,
    ],
    "b": [
        -19.125322341918945, -15.684734344482422, -20.057008743286133, -18.208072662353516, -8.570436477661133,
        -11.030363082885742, -20.533918380737305, -13.61843490600586, -4.260695934295654, -11.004572868347168,
        -15.604218482971191, -16.084373474121094,
    ],
    "c": [
        -0.09513595700263977, -0.09515807032585144, -0.11173827946186066, -0.13848479092121124, -0.09123846888542175,
        -0.23275277018547058, -0.03004932403564453, -0.07048620283603668, -0.02625994384288788, -0.013840198516845703,
        -0.38972169160842896, -0.09259284287691116,
    ],
}

# --- fixed values: success rates per (model, layer, scenario) ---
SUCCESS = {
    ("b", 16): [0.875, 0.5, 0.875], ("b", 20): [0.625, 0.5, 0.75], ("b", 12): [0.5, 0.5, 0.75],
    ("c", 8): [1.0, 0.6666666666666666, 1.0], ("c", 12): [1.0, 1.0, 1.0], ("c", 16): [1.0, 0.8333333333333334, 1.0],
    ("a", 8): [0.6, 0.5, 0.8], ("a", 12): [0.8, 0.5, 0.7], ("a", 16): [0.6, 0.5, 0.6], ("a", 20): [0.7, 0.5, 0.6],
}

# --- fixed values: AUROC per layer ---
LAYER_AUROC = {
    "a": {8: 0.9911111111111112, 12: 1.0, 16: 0.9955555555555555, 20: 0.9733333333333334, 24: 0.9600000000000001},
    "b": {8: 0.7911111111111111, 12: 0.9644444444444444, 16: 1.0, 20: 0.9911111111111112, 24: 0.9644444444444445},
    "c": {8: 0.9955555555555555, 12: 0.9955555555555555, 16: 0.9822222222222222, 20: 0.9688888888888889,
          24: 0.9688888888888889, 28: 0.9777777777777777},
}

# --- fixed values: format counts at dose 0 ---
FORMAT_COUNTS = {
    "action_sequence": 13, "game_documentation": 3, "narrative": 1, "json_schema": 4, "table/grid": 5, "rule_list": 4,
}


def test_random_summary_and_z_score(spark):
    trials = spark.createDataFrame(
        [("m", 12, i, x, 0.5) for i, x in enumerate(RANDOM_AUROCS)],
        "model string, layer int, trial int, auroc double, accuracy double",
    )
    summary = random_control.random_summary(trials, ["model", "layer"])
    metrics = spark.createDataFrame([("m", 12, 1.0)], "model string, layer int, auroc double")
    r = summary.first()
    assert r["num_trials"] == 100 and len(r["all_aurocs"]) == 100
    assert r["mean_auroc"] == pytest.approx(0.4977777777777777)
    assert r["median_auroc"] == pytest.approx(0.4811111111111111)
    assert r["std_auroc"] == pytest.approx(0.24030392279079005)
    assert (r["min_auroc"], r["max_auroc"]) == (0.022222222222222227, 0.9688888888888889)
    assert r["p95_auroc"] == pytest.approx(0.8568888888888887)
    c = random_control.compare_with_random(metrics, summary, ["model", "layer"]).first()
    assert c["z_score"] == pytest.approx(2.089945999135708) and c["significant_at_95"]
    assert c["difference_from_p95"] == pytest.approx(0.1431111111111113)
    assert c["difference_from_median"] == pytest.approx(0.518888888888889)


@pytest.fixture(scope="module")
def rated(spark):
    rows = [(m, 0, i, s, t) for m, scores in SCORES.items() for i, (s, t) in enumerate(zip(scores, RATINGS))]
    return spark.createDataFrame(rows, "model string, layer int, text_id long, score double, true_score int")


def test_correlations_and_p_values(rated):
    from dosewise.plans.analyses import rating_agreement

    got = rating_agreement(rated.drop("true_score"), rated.filter("model = 'a'").select("text_id", "true_score"))
    rows = {r["model"]: r for r in got.collect()}
    want = {
        "a": (0.7090147002351057, 0.009829258358197989, 0.713995945219726, 0.009100572742189523),
        "b": (-0.057482335517966374, 0.8591609361726682, -0.21155435413917806, 0.509220429651607),
        "c": (0.179905316611776, 0.5758223044440138, 0.21155435413917806, 0.509220429651607),
    }
    for m, (r, p, rho, rho_p) in want.items():
        assert rows[m]["pearson"] == pytest.approx(r) and rows[m]["pearson_p"] == pytest.approx(p)
        assert rows[m]["spearman"] == pytest.approx(rho) and rows[m]["spearman_p"] == pytest.approx(rho_p)
    assert rows["a"]["accuracy_extremes"] == 1.0 and rows["a"]["target_reached"] and not rows["b"]["target_reached"]
    assert rows["b"]["accuracy_binarised"] == pytest.approx(0.4166666666666667)
    assert rows["c"]["accuracy_binarised"] == pytest.approx(0.5833333333333334)


def test_confusion_matrices_in_both_layouts(rated):
    extremes = agreement.rating_extremes_metrics(rated, ["model"], "true_score", "score")
    a = evaluation.confusion(extremes, ["model"], "median").filter("model = 'a'").first()
    assert a["matrix_tn_first"] == [[5, 0], [0, 5]]
    binarised = agreement.rating_binarised_metrics(rated, ["model"], "true_score", "score")
    tp_first = evaluation.confusion(binarised, ["model"], "median_strict").select("model", "matrix_tp_first")
    got = {r["model"]: r["matrix_tp_first"] for r in tp_first.collect()}
    assert got["b"] == [[3, 3], [4, 2]] and got["c"] == [[4, 2], [3, 3]]


def test_line_fit_agrees_with_correlation(rated):
    for r in agreement.line_fit(rated, ["model"], "true_score", "score").collect():
        want = {"a": 0.7090147002351057, "b": -0.057482335517966374, "c": 0.179905316611776}[r["model"]]
        assert r["r"] == pytest.approx(want)
        t = r["slope"] / r["slope_stderr"]
        assert t == pytest.approx(want * (10 / (1 - want * want)) ** 0.5)


def test_success_rollup(spark):
    scenarios = ["s0", "s1", "s2"]
    rows = [(m, layer, s, x) for (m, layer), xs in SUCCESS.items() for s, x in zip(scenarios, xs)]
    summary = spark.createDataFrame(rows, "model string, layer int, scenario string, success_rate double")
    out = conditions.success_rollup(summary).collect()
    by_model = {r["model"]: r["success_rate"] for r in out if r["level"] == "model"}
    assert {m: round(x, 4) for m, x in by_model.items()} == {"a": 0.6167, "b": 0.6528, "c": 0.9444}
    assert sum(r["level"] == "model_layer" for r in out) == 10 and sum(r["level"] == "scenario" for r in out) == 3


def test_best_layers(spark):
    rows = [(m, layer, x) for m, by_layer in LAYER_AUROC.items() for layer, x in by_layer.items()]
    metrics = spark.createDataFrame(rows, "model string, layer int, auroc double")
    best = {r["model"]: r["best_layer"] for r in evaluation.best_layer(metrics).collect()}
    assert best == {"a": 12, "b": 16, "c": 8}
    top = evaluation.top_layers(metrics, 3).filter("model = 'b'").orderBy("rank").collect()
    assert [r["layer"] for r in top][:2] == [16, 20]


def test_format_statistics(spark):
    rows = [("m", k, n) for k, n in FORMAT_COUNTS.items()]
    counts = spark.createDataFrame(rows, "model string, format string, n long")
    assert formats.format_distinct(counts, ["model"]).first()["n_formats"] == 6
    assert formats.most_common_format(counts, ["model"]).first()["format"] == "action_sequence"
    share = formats.format_share(counts, ["model"]).filter("format = 'action_sequence'").first()
    assert share["percent"] == pytest.approx(100 * 13 / 30)
    d = formats.format_diversity(counts, ["model"]).first()
    assert 0.8 < d["entropy"] < 1 and d["verdict"] == "high"
    even = counts.withColumn("n", F.lit(5).cast("long"))
    assert formats.format_diversity(even, ["model"]).first()["entropy"] == pytest.approx(1.0)
    single = counts.filter("format = 'narrative'")
    assert formats.format_diversity(single, ["model"]).first()["entropy"] == 0.0
