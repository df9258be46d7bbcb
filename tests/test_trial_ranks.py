"""Packed ranks of random directions against the rows of vectors times trials."""

import numpy as np
import pytest

from dosewise.operators import random_control as R

SCHEMA = "model string, layer int, label int, vec array<double>"


def rows(n, dim=6, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        model = ["hot", "hot", "small", None][rng.integers(4)]
        label = [0, 1, 1, 2, None][rng.integers(5)]
        vec = [1.0] * dim if i % 3 == 0 else rng.integers(-2, 3, dim).astype(float).tolist()  # a third of all the same
        out.append((model, int(rng.integers(2)), label, vec))
    out += [("one class", 0, 1, [0.5] * dim), ("unlabelled", 0, None, [0.5] * dim), ("none", 0, 1, None)]
    return out + [("odd", 0, i % 2, [0.0] * (dim - 1) + [x]) for i, x in enumerate([np.nan, 0.0, -0.0, 1e308, -1e-300, np.inf])]


def plain(df, n, **more):
    scores = R.project_random(df, n, keep=["model", "layer", "label"], **more)
    return R.random_metrics(scores, ["model", "layer"])


def values(df):
    return sorted(((r.model, r.layer, r.trial, round(r.auroc, 12), r.accuracy) for r in df.collect()), key=str)


@pytest.mark.parametrize("digits", [None, 3])
def test_equals_rows(spark, digits):
    df = spark.createDataFrame(rows(400), SCHEMA).repartition(3)
    got = values(R.trial_metrics(df, 7, digits=digits))
    assert got == values(plain(df, 7, digits=digits))
    assert {r[3:] for r in got if r[0] == "unlabelled"} == {(0.5, None)}


def test_ranges_blocks_and_small_chunks(spark, monkeypatch):
    df = spark.createDataFrame(rows(400), SCHEMA).repartition(3)
    whole = values(R.trial_metrics(df, 7))
    monkeypatch.setattr(R, "RANGE_ROWS", 20)
    monkeypatch.setattr(R, "CHUNK_SCORES", 50)
    assert values(R.trial_metrics(df, 7)) == whole
    assert values(R.trial_metrics(df, 7, block_bytes=3 * 6 * 8)) == whole


def test_dimensions_and_empty_table(spark):
    mixed = rows(60) + [("long", 0, i % 2, [float(i)] * 9) for i in range(20)]
    df = spark.createDataFrame(mixed, SCHEMA)
    assert values(R.trial_metrics(df, 4)) == values(plain(df, 4))
    assert R.trial_metrics(df.limit(0), 4).collect() == []
    with pytest.raises(Exception, match="components"):
        R.trial_metrics(df, 4, dim=6).collect()


def test_packed_runs_are_exact():
    rng = np.random.default_rng(2)
    for scores in (rng.normal(size=1000), np.array([]), np.array([-np.inf, -5e-324, 0.0, 5e-324, 1e308, np.inf, np.nan]), np.round(rng.normal(size=50), 9)):
        scores = np.unique(scores)
        for digits in (None, 9):
            assert (R._scores(R._packed_scores(scores, digits)).view(np.int64) == scores.view(np.int64)).all()
    for n in (0, 1, 7, 8, 9):
        for top in (1, 300, 2**33):
            pos = rng.integers(0, top + 1, n)
            for neg in (1 - pos, pos + 1) if top == 1 else (pos * 0,):
                assert [c.tolist() for c in R._counts(R._packed_counts(pos, neg))] == [pos.tolist(), neg.tolist()]


def test_shuffle_is_a_tenth(spark):
    df = spark.createDataFrame(
        [("m", 0, i % 2, np.random.default_rng(i).normal(size=8).tolist()) for i in range(4000)], SCHEMA
    ).repartition(2).persist()
    df.count()

    def shuffled(work):
        sc = spark.sparkContext
        store = sc._jsc.sc().statusStore()

        def total():
            stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
            return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

        before = total()
        work().collect()
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        return total() - before

    packed = shuffled(lambda: R.trial_metrics(df, 20, dim=8))
    assert packed * 10 < shuffled(lambda: plain(df, 20))
    df.unpersist()
