"""Directions, projections, pooling and random controls against numpy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.operators import directions as D, random_control as R
from dosewise.operators.evaluation import evaluate_scores
from dosewise.plans import analyses as A
from dosewise.session import materialize

KEYS = ["model", "layer"]
SCHEMA = "model string, layer int, text_id long, label int, vec array<float>"


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    rows = []
    for layer in (0, 1):
        shift = rng.normal(size=8) * (layer + 1)
        for i in range(60):
            label = i % 2
            rows.append(("m", layer, i, label, (rng.normal(size=8) + label * shift).astype(np.float32)))
    return rows


@pytest.fixture(scope="module")
def activations(spark, data):
    return spark.createDataFrame([(*r[:4], [float(x) for x in r[4]]) for r in data], SCHEMA).repartition(6)


def expected_direction(data, layer):
    pos = np.mean([r[4] for r in data if r[1] == layer and r[3] == 1], axis=0, dtype=np.float64)
    neg = np.mean([r[4] for r in data if r[1] == layer and r[3] == 0], axis=0, dtype=np.float64)
    return (pos - neg) / np.linalg.norm(pos - neg)


def test_direction_is_the_unit_mean_difference(activations, data):
    for r in D.fit_directions(activations, KEYS).collect():
        assert np.allclose(r["direction"], expected_direction(data, r["layer"]), atol=1e-6)
        assert np.linalg.norm(r["direction"]) == pytest.approx(1) and not r["degenerate"]
        assert r["n_pos"] == r["n_neg"] == 30


@pytest.mark.parametrize("fanout", [1, 3])
def test_direction_does_not_depend_on_partitioning(activations, data, fanout):
    means = D.class_means(activations.repartition(11), [*KEYS, "label"], fanout=fanout).collect()
    for r in means:
        want = np.mean([x[4] for x in data if x[1] == r["layer"] and x[3] == r["label"]], axis=0, dtype=np.float64)
        assert np.allclose(r["mean"], want, atol=1e-6) and r["n"] == 30


def test_swapped_labels_negate_the_direction(activations, data):
    swapped = D.fit_directions(activations.withColumn("label", 1 - F.col("label")), KEYS)
    for r in swapped.collect():
        assert np.allclose(r["direction"], -expected_direction(data, r["layer"]), atol=1e-6)


def test_zero_difference_and_missing_class_give_no_direction(spark):
    rows = [("same", 0, 1, 1, [1.0, 2.0]), ("same", 0, 2, 0, [1.0, 2.0]), ("one", 0, 3, 1, [1.0, 2.0])]
    fitted = D.fit_directions(spark.createDataFrame(rows, SCHEMA), KEYS)
    assert [(r["direction"], r["degenerate"]) for r in fitted.collect()] == [(None, True), (None, True)]
    wanted = spark.createDataFrame([("same", 0), ("other", 1)], "model string, layer int")
    assert D.missing_directions(wanted, fitted, KEYS).count() == 2


def test_project_and_shift_law(activations, data):
    directions = materialize(D.fit_directions(activations, KEYS), "directions")
    scores = {(r["layer"], r["text_id"]): r["score"] for r in D.project(activations, directions, KEYS).collect()}
    for _, layer, i, _, vec in data:
        assert scores[layer, i] == pytest.approx(float(vec.astype(float) @ expected_direction(data, layer)), abs=1e-5)
    moved = D.shift_vectors(activations, directions, KEYS, F.lit(-2.5))
    for r in D.project(moved, directions, KEYS).collect():
        assert r["score"] == pytest.approx(scores[r["layer"], r["text_id"]] - 2.5, abs=1e-9)


def test_stored_directions_are_broadcast_and_vectors_not_shuffled(activations):
    directions = materialize(D.fit_directions(activations, KEYS), "directions")
    stored = materialize(activations, "activations")
    plan = D.project(stored, directions, KEYS)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_oversized_directions_are_not_hinted(activations):
    from dosewise.session import broadcast_vectors

    directions = materialize(D.fit_directions(activations, KEYS), "directions")
    hinted = broadcast_vectors(directions)._jdf.queryExecution().logical().toString()
    plain = broadcast_vectors(directions, limit=10)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted and "broadcast" not in plain


def test_pooling(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [3.0, 2.0]), (1, 2, [5.0, 7.0]), (2, 0, [4.0, 4.0])]
    states = spark.createDataFrame(rows, "text_id long, pos int, vec array<float>")
    mean = {r["text_id"]: r["vec"] for r in D.pool_mean(states, ["text_id"]).collect()}
    assert mean == {1: [3.0, 3.0], 2: [4.0, 4.0]}
    last = {r["text_id"]: r["vec"] for r in D.pool_last(states, ["text_id"]).collect()}
    assert last == {1: [5.0, 7.0], 2: [4.0, 4.0]}
    cut = {r["text_id"]: r["vec"] for r in D.pool_mean(D.truncate_positions(states, 2), ["text_id"]).collect()}
    assert cut == {1: [2.0, 1.0], 2: [4.0, 4.0]}


def test_stats_components_and_dimensions(spark):
    directions = spark.createDataFrame([("m", 1, [3.0, -4.0, 0.0, 4.0])], "model string, layer int, direction array<double>")
    r = D.direction_stats(directions, KEYS).first()
    assert (r["dim"], r["mean"]) == (4, 0.75) and r["norm"] == pytest.approx(np.sqrt(41))
    assert r["std"] == pytest.approx(np.std([3, -4, 0, 4]))
    top = D.top_components(directions, KEYS, 3).collect()
    assert [(t["rank"], t["dim"], t["value"], t["sign"]) for t in top] == [
        (1, 1, -4.0, "negative"), (2, 3, 4.0, "positive"), (3, 0, 3.0, "positive"),
    ]
    mixed = spark.createDataFrame([("m", 0, 1, 1, [1.0]), ("m", 0, 2, 0, [1.0, 2.0])], SCHEMA)
    check = D.dimension_check(mixed, KEYS).first()
    assert check["uniform"] is False and check["n_vectors"] == 2


def hashed_direction(seed, trial, dim):
    out = []
    for i in range(dim):
        h = hashlib.md5(f"{seed}:{trial}:{i}".encode()).hexdigest()
        u1, u2 = int(h[:8], 16), int(h[8:16], 16)
        out.append(np.sqrt(-2 * np.log((u1 + 1) / 4294967297)) * np.cos(2 * np.pi * u2 / 4294967296))
    return np.array(out) / np.linalg.norm(out)


def test_random_directions_are_reproducible_unit_vectors(spark):
    for r in R.random_unit_directions(spark, 5, 8, seed=9).collect():
        assert np.allclose(r["direction"], hashed_direction(9, r["trial"], 8), atol=1e-12)


def test_random_projection_in_one_or_many_blocks(activations, data):
    one = R.project_random(activations, 5, 8, keep=["layer", "text_id"])
    many = R.project_random(activations, 5, 8, keep=["layer", "text_id"], block_bytes=2 * 8 * 8)
    got = {(r["layer"], r["text_id"], r["trial"]): r["score"] for r in many.collect()}
    assert got == pytest.approx({(r["layer"], r["text_id"], r["trial"]): r["score"] for r in one.collect()})
    assert len(got) == 120 * 5
    vec = next(r[4] for r in data if r[1] == 1 and r[2] == 7)
    assert got[1, 7, 3] == pytest.approx(float(vec.astype(float) @ hashed_direction(42, 3, 8)), abs=1e-9)


def test_small_slices_give_the_same_scores(activations, monkeypatch):
    def scores():
        rows = R.project_random(activations, 5, 8, keep=["layer", "text_id"]).collect()
        return {(r["layer"], r["text_id"], r["trial"]): r["score"] for r in rows}

    whole = scores()
    monkeypatch.setattr(R, "CHUNK_SCORES", 12)
    assert scores() == pytest.approx(whole)


def test_fit_validate_and_control_end_to_end(activations):
    directions = A.fit_directions(activations)
    metrics = A.validate_directions(activations, directions)
    compared = A.random_baseline(activations, metrics, 20, 8).collect()
    assert len(compared) == 2 and all(r["auroc"] > r["mean_auroc"] for r in compared)
    report = A.vector_ablation_report(activations, activations, directions).collect()
    assert all(r["auroc_drop"] == 0 and r["verdict"] == "STRONG" for r in report)


def test_group_without_direction_drops_out(activations):
    directions = materialize(D.fit_directions(activations.filter("layer = 0"), KEYS), "directions")
    assert {r["layer"] for r in evaluate_scores(D.project(activations, directions, KEYS), KEYS).collect()} == {0}


def test_missing_vectors_are_ignored(spark, activations):
    extra = spark.createDataFrame([("m", 0, 999, 1, None)], SCHEMA)
    got = D.fit_directions(activations.unionByName(extra), KEYS).filter("layer = 0").first()
    assert got["n_pos"] == 30


def test_other_dimensions_raise(spark):
    rows = [("m", 0, i, i % 2, [1.0, 2.0, 3.0, 4.0]) for i in range(4)] + [("m", 0, 9, 1, [1.0, 2.0])]
    activations = spark.createDataFrame(rows, SCHEMA)
    directions = materialize(
        spark.createDataFrame([("m", 0, [1.0, 0.0, 0.0, 0.0])], "model string, layer int, direction array<double>"), "d"
    )
    with pytest.raises(Exception, match="components"):
        D.project(activations, directions, KEYS).collect()
    with pytest.raises(Exception, match="components"):
        D.shift_vectors(activations, directions, KEYS, F.lit(1.0)).collect()
    with pytest.raises(Exception, match="components"):
        R.project_random(activations, 3, 4, keep=["text_id"]).collect()
    with pytest.raises(ValueError, match="different dimensions"):
        A.random_baseline(activations, directions, 3, keys=KEYS)


def test_models_of_different_dimension(spark):
    rows = [("a", 0, i, i % 2, [float(i), 1.0]) for i in range(6)] + [("b", 0, i, i % 2, [1.0, 2.0, float(i)]) for i in range(6)]
    scores = R.project_random(spark.createDataFrame(rows, SCHEMA), 4, keep=["model", "text_id"])
    assert {(r["model"], r["count"]) for r in scores.groupBy("model").count().collect()} == {("a", 24), ("b", 24)}


def test_more_directions_than_the_limit_are_broadcast_in_blocks(spark, activations, monkeypatch):
    """The vectors are not shuffled, whatever the directions' size; with too many blocks the rest is."""
    rng = np.random.default_rng(4)
    rows = [(m, int(x), i, i % 2, rng.normal(size=8).tolist()) for m in ("a", "b", None) for x in range(6) for i in range(9)]
    many = spark.createDataFrame(rows, SCHEMA)
    directions = A.fit_directions(many.filter("model is not null"), KEYS)
    whole = sorted(map(str, D.project(many, directions, KEYS).collect()))
    moved = sorted(map(str, D.shift_vectors(many, directions, KEYS, F.lit(2.0)).select(*KEYS, "text_id", "vec").collect()))
    for limit in (400, 200):
        part = D.project(many, directions, KEYS, limit=limit)
        assert sorted(map(str, part.collect())) == whole and len(whole) == 108
        shifted = D.shift_vectors(many, directions, KEYS, F.lit(2.0), limit=limit)
        assert sorted(map(str, shifted.select(*KEYS, "text_id", "vec").collect())) == moved
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    monkeypatch.setattr("dosewise.session.BLOCKS", 2)
    assert sorted(map(str, D.project(many, directions, KEYS, limit=200).collect())) == whole
    assert sorted(map(str, D.project(many, directions, KEYS, limit=1).collect())) == whole
