"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from dosewise.operators import splits as S
from dosewise.plans import analyses as A
from dosewise.sources import readers as R, writers as W


@pytest.fixture()
def folder(tmp_path):
    return tmp_path


def test_scenarios_from_a_json_array(spark, folder):
    rows = [{"id": "s1", "title": "T", "objective": "O", "rubric": {"0": "no", "2": "yes"}}, {"id": "s2"}]
    (folder / "scenarios.json").write_text(json.dumps(rows, indent=2))
    got = R.read_scenarios(spark, str(folder / "scenarios.json")).orderBy("id").collect()
    assert got[0]["rubric"]["2"] == "yes" and got[1]["id"] == "s2" and got[1]["title"] is None


def test_pair_lines(spark, folder):
    lines = [
        json.dumps({"scenario_id": "a", "empathic_text": " x ", "non_empathic_text": "y", "run_id": 1,
                    "generated_at": "2025-11-13T23:09:02.237836"}),
        "",
        "{broken",
        json.dumps({"scenario_id": "b", "empathetic": "x", "non_empathic": "y"}),
        json.dumps({"scenario_id": "c", "empathic_text": "", "empathic": "z", "non_empathetic": "y"}),
        json.dumps({"scenario_id": "d", "empathic_text": "  ", "non_empathic_text": "y"}),
    ]
    (folder / "train_pairs.jsonl").write_text("\n".join(lines))
    (folder / "test_pairs.jsonl").write_text(lines[0])
    got = {(r["scenario_id"], r["split"]): r for r in R.read_pairs(spark, str(folder)).collect()}
    assert set(got) == {("a", "train"), ("b", "train"), ("c", "train"), ("a", "test")}
    assert got["a", "train"]["positive_text"] == "x" and got["c", "train"]["positive_text"] == "z"
    assert got["a", "test"]["generated_at"].year == 2025
    rejected = R.rejected_lines(R.read_pair_lines(spark, str(folder))).collect()
    assert [(r["split"], r["_corrupt"]) for r in rejected] == [("train", "{broken")]
    assert R.read_pairs(spark, str(folder), "test").count() == 1


RUN = {
    "model": "big model",
    "layers_tested": [8],
    "layer_results": [
        {"layer": 8, "experiments": [{"scenario": "s", "title": "t", "conditions": [
            {"alpha": 0, "condition_name": "baseline", "samples": ["p", "q"]}, {"alpha": 5.0, "samples": ["r"]}]}]}
    ],
}
FLAT = {("k", 8, "s", 0.0, 0, "p"), ("k", 8, "s", 0.0, 1, "q"), ("k", 8, "s", 5.0, 0, "r")}


def flat(df):
    return {(r["model"], r["layer"], r["scenario"], r["alpha"], r["sample"], r["text"]) for r in df.collect()}


@pytest.mark.parametrize("wrapped", [True, False])
def test_generations_with_and_without_wrapper(spark, folder, wrapped):
    doc = {"models": {"k": RUN}} if wrapped else {"k": RUN}
    (folder / "runs.json").write_text(json.dumps(doc, indent=1))
    assert flat(R.read_generations(spark, str(folder / "runs.json"))) == FLAT


def test_single_run_forms(spark, folder):
    conditions = RUN["layer_results"][0]["experiments"][0]["conditions"]
    (folder / "a.json").write_text(json.dumps({"model": "k", "experiments": [
        {"layer": 8, "scenario": "s", "conditions": conditions}]}))
    assert flat(R.read_single_run(spark, str(folder / "a.json"))) == FLAT
    (folder / "b.json").write_text(json.dumps({"model": "k", "target_layer": 8, "experiments": [
        {"scenario": "s", "baseline_samples": ["p", "q"], "steered_completions": [{"alpha": 5, "samples": ["r"]}]}]}))
    assert flat(R.read_single_run(spark, str(folder / "b.json"))) == FLAT
    (folder / "c.json").write_text(json.dumps({"model": "k", "target_layer": 8, "experiments": [
        {"scenario": "s", "baseline": "p", "steered_completions": [{"alpha": 5.0, "completion": "r"}]}]}))
    assert flat(R.read_single_run(spark, str(folder / "c.json"))) == {x for x in FLAT if x[5] != "q"}


def test_metric_files_in_both_layouts(spark, folder):
    layer = {"layer": 8, "auroc": 0.5, "accuracy": 0.25}
    (folder / "one.json").write_text(json.dumps({"layer_results": {"8": layer, "12": layer}, "best_layer": 8}))
    (folder / "many.json").write_text(json.dumps({"m": {"model": "M", "layers": {"28": layer}}}))
    merged = R.merge_metrics(
        R.read_validation(spark, str(folder / "one.json"), "single"), R.read_model_metrics(spark, str(folder / "many.json"))
    )
    assert {(r["model"], r["layer"], r["auroc"]) for r in merged.collect()} == {
        ("single", 8, 0.5), ("single", 12, 0.5), ("m", 28, 0.5)}


def test_ratings_file(spark, folder):
    (folder / "r.json").write_text(json.dumps({"layer_used": 8, "detailed_results": [
        {"scenario": "s", "true_score": 2, "probe_score": -1.5, "expected_category": "high", "text_preview": "x..."}]}))
    r = R.read_ratings(spark, str(folder / "r.json")).first()
    assert (r["layer_used"], r["true_score"], r["probe_score"]) == (8, 2, -1.5)


def test_csv_and_nested_json(spark, folder):
    rows = spark.createDataFrame([("m", 8, "s", 0.5, 0.2, 8)], R.S.SUMMARY_CSV)
    W.write_summary_csv(rows, str(folder / "csv"))
    assert R.read_success_csv(spark, str(folder / "csv")).collect() == rows.collect()
    metrics = spark.createDataFrame([("m", 8, 0.5), ("m", 12, 0.75)], "model string, layer int, auroc double")
    doc = json.loads(W.nested_metrics(metrics, ["auroc"]).first()["doc"])
    assert doc["m"]["layers"] == {"8": {"auroc": 0.5}, "12": {"auroc": 0.75}}


def test_dynamic_layer_overwrite(spark, folder):
    path = str(folder / "layers")
    make = lambda layer, x: spark.createDataFrame([(layer, x)], "layer int, x int")
    W.write_layers(make(1, 10), path)
    W.write_layers(make(2, 20), path)
    W.write_layers(make(1, 11), path)
    assert {(r["layer"], r["x"]) for r in spark.read.parquet(path).collect()} == {(1, 11), (2, 20)}


@pytest.mark.parametrize("n, fraction", [(50, 0.7), (1, 0.7), (10, 0.0), (10, 1.0), (333, 0.31)])
def test_split_is_exact_and_independent_of_partitioning(spark, n, fraction):
    df = spark.range(n).withColumnRenamed("id", "pair_id")
    got = {r["pair_id"]: r["split"] for r in S.hash_split(df, "pair_id", fraction, digits=1).collect()}
    assert sum(s == "train" for s in got.values()) == int(n * fraction)
    again = S.hash_split(df.repartition(7), "pair_id", fraction).collect()
    assert got == {r["pair_id"]: r["split"] for r in again}


def test_make_split_summary_and_files(spark, folder):
    rows = [(str(i), f"s{i % 5}", f"m{i % 2}", i % 5, "x", "y") for i in range(50)]
    pairs = spark.createDataFrame(
        rows, "pair_id string, scenario_id string, source_model string, run_id int, positive_text string, negative_text string"
    )
    r = A.make_split(pairs, str(folder / "pairs")).first()
    assert (r["total_pairs"], r["train_pairs"], r["test_pairs"]) == (50, 35, 15)
    assert r["scenarios"] == [f"s{i}" for i in range(5)] and r["models_used"] == ["m0", "m1"] and r["runs_per_model"] == {"m0": 1, "m1": 1}
    back = R.read_pairs(spark, str(folder / "pairs"))
    assert back.filter(F.col("split") == "test").count() == 15


def test_split_goes_down_to_whole_keys(spark, monkeypatch):
    monkeypatch.setattr(S, "WINDOW_COUNTS", 3)
    got = S.hash_split(spark.range(500).withColumnRenamed("id", "pair_id"), "pair_id", 0.7, digits=1).collect()
    assert sum(r["split"] == "train" for r in got) == 350


def test_broken_documents_raise_or_are_rejected(spark):
    docs = spark.createDataFrame([('{"m": {"layer_results": []}}',), ('{"m": {"layer_res',), ("  ",)], "doc string")
    with pytest.raises(Exception, match="not a JSON document"):
        R.parse_model_map(docs).collect()
    assert R.parse_model_map(docs, errors="reject").count() == 1
    assert [r["doc"] for r in R.rejected_documents(docs).collect()] == ['{"m": {"layer_res']
    with pytest.raises(Exception, match="not a JSON document"):
        R.parse_single_run(docs).collect()


def test_stored_directions_keep_their_columns(spark, folder):
    rows = [("k", 1, [1.0, 0.0]), ("k", 0, [0.0, 1.0])]
    activations = spark.createDataFrame(rows, "concept string, label int, vec array<double>")
    stored = A.fit_directions(activations, keys=["concept"])
    filed = A.fit_directions(activations, keys=["concept"], path=str(folder / "directions"))
    assert stored.columns == filed.columns and stored.collect() == filed.collect()


def test_long_form(spark):
    pairs = spark.createDataFrame([("p", "good", "bad")], "pair_id string, positive_text string, negative_text string")
    assert {tuple(r) for r in S.to_long(pairs, ["pair_id"]).collect()} == {("p", 1, "good"), ("p", 0, "bad")}
