"""Mixing against brute force, the pipeline stage by stage, and the registered queries."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from dosewise.llm import line_dedup, mixing
from dosewise.llm.queries import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


def level_targets(words):
    """Targets by resharing the excess until none is left."""
    names = sorted((n for n in words if n is not None)) + [None] * (None in words)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), 1.5 * sum(words.values()), set(names)
    while left > 1e-9 and open_:
        share, left = left / sum(weight[n] for n in open_), 0.0
        for n in list(open_):
            target[n] += share * weight[n]
            if target[n] > 2 * words[n]:
                left += target[n] - 2 * words[n]
                target[n] = 2.0 * words[n]
                open_.discard(n)
    return target


@pytest.fixture(scope="module")
def mix_rows():
    rows = []
    for i in range(400):
        source = ["b", "a", None, "ä", "z"][i % 5 if i % 3 else 0]
        rows.append((i, " ".join(["w"] * ((i * 37) % 90)), source))
    return [*rows, (900, None, "a"), (901, "", "only empty"), (902, "x " * 20_000, "long"), (903, "one", "tiny"), (7, "again w", "b")]


@pytest.mark.parametrize("span", [16_384, 16])
def test_mix_equals_targets(spark, mix_rows, monkeypatch, span):
    monkeypatch.setattr(mixing, "RANGE", span)
    docs = spark.createDataFrame([(*r, 1) for r in mix_rows], "doc_id long, text string, source string, size int")
    sizes, sources, taken = mixing.mix(docs.repartition(3))
    words = {}
    for _, text, source in mix_rows:
        words[source] = words.get(source, 0) + len((text or "").split())
    want = level_targets(words)
    names = {r["source_no"]: r["source"] for r in sources.collect()}
    for r in sources.collect():
        assert r["source_size"] == words[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6)
    got, per_doc = {}, {}
    for r in taken.filter("from_word < to_word").collect():
        n = r["to_word"] - r["from_word"]
        got[names[r["source_no"]]] = got.get(names[r["source_no"]], 0) + n
        per_doc[r["doc_id"], r["start"]] = per_doc.get((r["doc_id"], r["start"]), 0) + n
    assert all(abs(got.get(s, 0) - want[s]) <= 1 for s in words)
    size = {(r["doc_id"], r["start"]): r["size"] for r in taken.collect()}
    assert all(n <= 2 * size[k] for k, n in per_doc.items())
    slots = [r["slot"] for r in mixing.schedule(sources).collect()]
    assert sorted(slots) == list(range(len(slots)))


def test_mix_is_even(spark):
    """In every stretch of slots a source has about its share."""
    docs = spark.createDataFrame([(i, "w " * 3000, f"s{i % 4}") for i in range(80)], "doc_id long, text string, source string")
    _, sources, _ = mixing.mix(docs)
    order = [r["source_no"] for r in mixing.schedule(sources).orderBy("slot").collect()]
    share = {s: order.count(s) / len(order) for s in set(order)}
    for s, p in share.items():
        for low in range(0, len(order) - 50, 50):
            assert abs(order[low : low + 50].count(s) - 50 * p) <= 3


def test_mix_of_nothing_and_reruns(spark, mix_rows):
    docs = spark.createDataFrame(mix_rows, "doc_id long, text string, source string")
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    once, again = (sorted(map(str, mixing.mixed_documents(d).collect())) for d in (docs, docs.repartition(5)))
    assert once == again
    assert mixing.mixed_documents(docs.filter("doc_id in (900, 901)")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 997, 10_000])
def test_golden_step(n):
    step = mixing.golden_step(n)
    assert math.gcd(step, n) == 1 or n == 1


def test_every_operator_has_a_query():
    registered = entry_points.queries()
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(registered) and set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    mine = sorted(str([r[c] for c in columns]) for r in df.collect())
    result = con.execute(ORACLE[name])
    order = [d[0] for d in result.description]
    assert mine == sorted(str([row[order.index(c)] for c in columns]) for row in result.fetchall())


def test_pipeline_stages(spark):
    docs = corpus_pipeline.documents(spark, SMALL).withColumn("size", F.lit(1))  # an extra column of a clashing name
    extra = spark.createDataFrame(
        [(10_001, "123 ... 456", "en", "src1", 11, 1), (10_002, None, None, None, None, 1)], docs.schema
    )
    docs = docs.unionByName(extra)
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SMALL), name)
        rows = {r["doc_id"]: r for r in out.collect()}
        if name != "bpe":
            assert out.columns == columns
        if name == "language_id":
            assert out.count() == 200 and 10_001 not in rows and 10_002 not in rows
        elif name == "line_dedup":
            want = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
            assert {i: r["text"] for i, r in rows.items()} == {i: t for i, t in want.items() if t.strip()}
            assert all(r["n_chars"] == len(r["text"]) for r in rows.values())
        elif name == "minhash_near_dedup":
            from test_words import brute_components

            groups = brute_components([(i, r["text"]) for i, r in before.items()])
            assert set(rows) == {i for i, (_, c) in groups.items() if i == c}
        elif name == "source_mix":
            words = sum(len(r["text"].split()) for r in before.values())
            taken = sum(len(r["text"].split()) for r in out.collect())
            assert abs(taken - 1.5 * words) <= 20 and set(rows) <= set(before)
        else:
            assert {"n_tokens", "token_ids", "decoded"} <= set(out.columns)
            assert all(r["n_tokens"] == len(r["token_ids"]) > 0 for r in rows.values())
        docs, before = out, rows


def test_pipeline_of_nothing(spark):
    docs = corpus_pipeline.documents(spark, SMALL).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "empty")
    assert docs.count() == 0


def test_language_stage_keeps_switching_and_unlabelled_texts(spark):
    vocabulary = {"a": "der die das und nicht", "b": "the and of shall thing", "c": "el los por que donde", "d": "le des pour avec chez"}
    rows = [(10 * n + i, f"{w} " * 6, lang, "s") for n, (lang, w) in enumerate(vocabulary.items()) for i in range(10)]
    switching = " ".join(f"{w} {w}" for w in vocabulary.values())
    rows += [(100, switching, None, "s"), (101, "12 ?!", "a", "s"), (102, None, "a", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {r[0] for r in rows} - {101, 102}
    assert {r["doc_id"] for r in corpus_pipeline.in_a_language(spark, docs, SMALL).collect()} == want
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.in_a_language(spark, unlabelled, SMALL).collect()} == want


def test_repeated_ids_with_other_texts(spark):
    """Of an id's texts only the near-duplicate one goes, be it an exact copy or not."""
    text = lambda name, n=80: " ".join(f"{name}{i}" for i in range(n))
    rows = [(3, text("a")), (5, text("a")), (5, text("u")), (7, text("a") + " end"), (7, text("v")), (7, text("v"))]
    rows += [(9, text("w")), (9, text("w") + " end"), (None, text("a")), (11, None), (12, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, docs, SMALL).collect()]
    rest = [r for r in got if r[0] != 9]
    assert sorted(map(str, rest)) == sorted(map(str, [rows[i] for i in (0, 2, 4, 5, 8, 9, 10)]))
    assert len(got) == len(rest) + 1


def test_mix_keeps_sources_apart(spark):
    rows = [(1, "one two three", "a"), (1, "one two three", None), (2, "four five six", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = {}
    for r in mixing.mixed_documents(docs).collect():
        words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    _, sources, _ = mixing.mix(docs)
    assert words == {r["source"]: int(r["target"]) for r in sources.collect()}


NAMES = """covered _lines _removed _id _hash _id2 _hash2 _split row n_lines n_removed lines at passage h1 h2 _size _source _doc_id _place
    _order _from _to _slot c0 c1 slot start size pass block order source_no _score _lang_pred __score _key __key n_tokens""".split()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, stage):
    """All names that a stage uses inside, and more, as the caller's own columns: with the same rows as without them."""
    text = "the and of to in that is was for\nline b of it\nline c of it\nline d of it"
    rows = [(i, f"{text} {i}\nthe and of {i} it is", "en", f"s{i % 2}", 5) for i in range(30)] + [(30, "la de que el en y a los", "es", "s1", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in NAMES if n != "n_tokens"])
    plain, full = stage(spark, docs, ""), stage(spark, extra, "")
    key = lambda r: str((r["doc_id"], r["text"]))
    assert sorted(map(key, plain.collect())) == sorted(map(key, full.collect()))
    for r in full.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in NAMES if n != "n_tokens")


def test_mixed_rows_come_in_the_order_of_the_schedule(spark):
    """Files of the mix, read in order, hold each source in every stretch as often as its target says."""
    docs = spark.createDataFrame([(i, f"{i} " + "w " * 1100, f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    mixed = mixing.mixed_documents(docs).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect()
    order = [r["source"] for r in mixed]
    share = {s: order.count(s) / len(order) for s in set(order)}
    worst = max(abs(order[a : a + 100].count(s) - 100 * p) for s, p in share.items() for a in range(0, len(order) - 100, 100))
    assert worst <= 12


def test_mix_shuffles_the_texts_twice(spark):
    """Once to meet what the mix takes of them, once into the order of the schedule."""
    rows = [(i % 300, f"{i % 300} " + "w " * 90, [None, "a", "b"][i % 3]) for i in range(600)] + [(None, "w v", "a")] * 2
    docs = corpus_pipeline.materialize(spark.createDataFrame(rows, "doc_id long, text string, source string"), "texts")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on tables that are too large for it
    try:
        mixed = mixing.mixed_documents(docs)
        plan = mixed._jdf.queryExecution().executedPlan().toString().splitlines()
        words = {}
        for r in mixed.collect():
            words[r["source"]] = words.get(r["source"], 0) + len(r["text"].split())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # From the scan of the texts upwards, each step with less indentation.
    nodes = [(len(line) - len(line.lstrip(" :+-")), line.lstrip(" :+-")) for line in plan]
    at = next(k for k, (_, node) in enumerate(nodes) if node.startswith("FileScan") and "text#" in node)
    depth, shuffles = nodes[at][0], 0
    for indent, node in reversed(nodes[:at]):
        if indent < depth:
            depth, shuffles = indent, shuffles + node.startswith("Exchange")
    assert shuffles == 2
    _, sources, _ = mixing.mix(docs)
    assert words == {r["source"]: int(r["target"]) for r in sources.collect()}
