"""Large documents read in parts, against the readers of whole documents."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from dosewise.sources import readers as R, split_json


def texts(rng):
    marks = ["}", "{", '"', "\\", "[", "]", ",", " ", "é", "\n", "a", '"}', "\\\\", "},{", "漢"]
    return lambda: "".join(rng.choice(marks) for _ in range(rng.randrange(30)))


def runs(rng, n):
    text = texts(rng)

    def one():
        conditions = [{"alpha": float(a), "samples": [text(), text()]} for a in range(rng.randrange(3))]
        experiments = [{"scenario": text(), "title": "t", "conditions": conditions}]
        return {"model": text(), "layers_tested": [8], "layer_results": [{"layer": 8, "experiments": experiments}]}

    return {f"m{j}{text()}": one() for j in range(n)}


@pytest.fixture(params=["128m", "900b"])
def blocks(spark, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def same(reader, spark, path):
    whole = sorted(map(str, reader(spark, path).collect()))
    assert sorted(map(str, reader(spark, path, split=True).collect())) == whole
    return len(whole)


def test_scenarios(spark, tmp_path, blocks):
    rng = random.Random(1)
    text = texts(rng)
    for i, n in enumerate([0, 1, 2, 30]):
        rows = [{"id": f"s{j}", "title": text(), "description": text(), "rubric": {"0": text(), "1": "}"}} for j in range(n)]
        (tmp_path / f"{i}.json").write_text(json.dumps(rows, indent=i or None, ensure_ascii=i % 2 == 0), encoding="utf-8")
    (tmp_path / "odd.json").write_text('\n [null, {"id": "a"}, null, {"id": "b"} , null\n]\n')
    (tmp_path / "mark.json").write_bytes(b"\xef\xbb\xbf" + b'[{"id": "c"}]')
    (tmp_path / "empty.json").write_text("")
    assert same(R.read_scenarios, spark, str(tmp_path)) == 36
    assert R.split_documents(spark, str(tmp_path)).filter("part > 0").count() > 30


def test_models_with_and_without_wrapper(spark, tmp_path, blocks):
    rng = random.Random(2)
    plain, last = runs(rng, 9), {"z": None}
    documents = [
        plain, {}, {"models": {}}, {"models": runs(rng, 8)}, {**runs(rng, 2), "none": None, **runs(rng, 1), **last},
        {"models": {**runs(rng, 3), **last}, "note": {"m": {"models": {"k": runs(rng, 1)}}}, "x": [{}]},
        {"first": 1, "models": runs(rng, 2)},
    ]
    for i, document in enumerate(documents):
        written = json.dumps(document, indent=i % 3 or None, ensure_ascii=i % 2 == 0).encode()
        (tmp_path / f"{i}.json").write_bytes(written)
    with gzip.open(tmp_path / "zipped.json.gz", "wb") as f:
        f.write(json.dumps(plain).encode())
    assert same(R.read_generations, spark, str(tmp_path)) > 20


def test_metrics(spark, tmp_path, blocks):
    document = {f"m{i}": {"model": "M", "layers": {str(k): {"layer": k, "auroc": 0.5} for k in range(3)}} for i in range(5)}
    (tmp_path / "m.json").write_text(json.dumps(document))
    whole = sorted(R.read_model_metrics(spark, str(tmp_path)).collect())
    assert sorted(R.read_model_metrics(spark, str(tmp_path), split=True).collect()) == whole and len(whole) == 15


@pytest.mark.parametrize(
    "text, ids, offsets",
    [
        ('[{"id": "a"}, {"id": "b"}, {"id": "c', ["a", "b"], [25]),  # cut inside an element
        ('[{"id": "a"}, {"id": "b"}', ["a"], [12]),  # cut between elements
        ('[{"id": "a"}, {"id" "b"}, {"id": "c"}]', ["a", "c"], [12]),
        ('[{"id": "a"} {"id": "b"}, {"id": "c"}]', ["a", "c"], [12]),  # no comma
        ('[{"id": "a"}, {"id": "b"},]', ["a", "b"], [25]),
        ('[{"id": "a"}, {"id": "b}, {"id": "c"}]', ["a"], [12]),  # a quote too few
        ('x[{"id": "a"}, {"id": "b"}]', [], [0]),
    ],
)
def test_malformed_parts_are_reported_with_their_offset(spark, tmp_path, text, ids, offsets):
    (tmp_path / "a.json").write_text(text)
    parts = R.read_documents(spark, str(tmp_path), split=True)
    assert sorted(r.id for r in R.parse_scenarios(parts, errors="reject").collect()) == ids
    assert [r.offset for r in R.rejected_documents(parts).collect()][: len(offsets)] == offsets
    with pytest.raises(Exception, match="not a JSON document"):
        R.read_scenarios(spark, str(tmp_path), split=True).collect()


def test_parts_without_an_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(split_json, "PART_BYTES", 100)
    (tmp_path / "a.json").write_text('[{"id": "a"}, {"id": "b}' + ', {"id": "c"}' * 50 + "]")
    parts = R.read_documents(spark, str(tmp_path), split=True)
    assert [r.id for r in R.parse_scenarios(parts, errors="reject").collect()] == ["a"]
    assert R.rejected_documents(parts).select(F.max(F.length("doc"))).first()[0] <= 101


def test_large_documents(spark, tmp_path):
    """A valid document above the size of a variant is read whole and in parts; cut off, it is reported."""
    filler = "x" * 1000
    path = tmp_path / "large.json"
    with open(path, "w") as f:
        f.write("[" + ",".join(f'{{"id":"{i}","title":"{filler}","rubric":{{"0":"no"}}}}' for i in range(143_360)) + "]")
    assert path.stat().st_size > 128 << 20
    for split in (False, True):
        read = R.read_scenarios(spark, str(path), split=split, errors="reject")
        assert read.agg(F.count("*"), F.countDistinct("id"), F.sum(F.length("title"))).first() == (143_360, 143_360, 143_360_000)
    assert R.rejected_documents(R.read_documents(spark, str(path))).count() == 0
    with open(path, "rb+") as f:
        f.truncate(path.stat().st_size - 500)
    assert R.rejected_documents(R.read_documents(spark, str(path))).count() == 1
    assert R.read_scenarios(spark, str(path), errors="reject").count() == 0
    parts = R.read_documents(spark, str(path), split=True)
    assert [r.offset > 140 << 20 for r in R.rejected_documents(parts).collect()] == [True]
