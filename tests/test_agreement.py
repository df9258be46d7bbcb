"""Correlation edge cases, p-values and histogram."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.operators import agreement as G


def test_constant_columns_give_null(spark):
    df = spark.createDataFrame([("g", 1.0, 2), ("g", 2.0, 2), ("g", 3.0, 2)], "g string, s double, t int")
    assert G.pearson(df, ["g"], "s", "t").first()["pearson"] is None
    assert G.spearman(df, ["g"], "s", "t").first()["spearman"] is None
    fit = G.line_fit(df, ["g"], "t", "s").first()
    assert fit["slope"] is None and fit["r"] is None and fit["p_value"] is None


def test_spearman_with_heavy_ties(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 5, 300).astype(float), rng.integers(0, 3, 300)
    x[:100] = 2.0
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(x, y)], "g string, s double, t int")
    import pandas as pd

    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert G.spearman(df.repartition(4), ["g"], "s", "t").first()["spearman"] == pytest.approx(want)


def test_p_values_at_known_points(spark):
    # df = 1: p = 1 - 2/pi * atan(t); df = 2: p = 1 - t / sqrt(t^2 + 2)
    rows = []
    for n, r in ((3, 0.5), (4, 0.3), (4, -0.9), (12, 0.0), (5, 1.0), (2, 0.5)):
        rows.append((n, r))
    got = spark.createDataFrame(rows, "n long, r double").select("n", "r", G.correlation_p_value(F.col("r"), F.col("n")).alias("p"))
    p = [x["p"] for x in got.collect()]
    t = lambda n, r: r * np.sqrt((n - 2) / (1 - r * r))
    assert p[0] == pytest.approx(1 - 2 / np.pi * np.arctan(t(3, 0.5)))
    assert p[1] == pytest.approx(1 - t(4, 0.3) / np.sqrt(t(4, 0.3) ** 2 + 2))
    assert p[2] == pytest.approx(1 - t(4, 0.9) / np.sqrt(t(4, 0.9) ** 2 + 2))
    assert p[3] == 1.0 and p[4] == 0.0 and p[5] is None


def test_p_value_of_a_huge_sample(spark):
    from math import erfc, sqrt

    got = spark.createDataFrame([(10_000_000_000, 2e-5)], "n long, r double")
    p = got.select(G.correlation_p_value(F.col("r"), F.col("n")).alias("p")).first()["p"]
    assert p == pytest.approx(erfc(2.0 / sqrt(2)), rel=1e-4)


@pytest.mark.parametrize("data", [[0.0, 0.1, 0.5, 0.9, 1.0, 1.0], [3.0, 3.0, 3.0]])
def test_histogram_equals_numpy(spark, data):
    df = spark.createDataFrame([("g", x) for x in data], "g string, s double")
    counts, edges = np.histogram(data, bins=20)
    got = {r["bin"]: r for r in G.histogram(df, ["g"], "s", 20).collect()}
    assert {b: r["n"] for b, r in got.items()} == {i + 1: c for i, c in enumerate(counts) if c}
    assert all(r["bin_start"] == pytest.approx(edges[b - 1]) for b, r in got.items())
