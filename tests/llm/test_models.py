"""Language identification, quality, personal data and the vector index."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from dosewise.llm import language, multi_index, pii, quality

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(6))
def test_forward_backward_equals_definition(seed):
    rng = np.random.default_rng(seed)
    k, sizes = int(rng.integers(2, 5)), rng.integers(1, 200, 4)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    emissions, moves = rng.random((starts[-1], k)) + 1e-3, rng.normal(size=(k, k))
    got, _, _ = language.posteriors(emissions, moves, starts)
    a = np.exp(moves)
    for low, high in zip(starts[:-1], starts[1:]):
        forward, backward = [emissions[low]], [np.ones(k)]
        for t in range(low + 1, high):
            x = (forward[-1] @ a) * emissions[t]
            forward.append(x / x.sum())
        for t in range(high - 1, low, -1):
            x = a @ (backward[-1] * emissions[t])
            backward.append(x / x.sum())
        both = np.array(forward) * np.array(backward[::-1])
        assert np.abs(both / both.sum(axis=1, keepdims=True) - got[low:high]).max() < 1e-9


LINES = {"a": "der die das und nicht schule", "b": "the and of shall thing with", "c": "el los por que donde niño"}


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    rows = [(" ".join(rng.choices(words.split(), k=30)), lang) for lang, words in LINES.items() for _ in range(15)]
    return language.fit(rows)


def test_code_switched_text(model):
    labeller = language.Labeller(model)
    text = LINES["a"] + " " + LINES["b"]
    post, starts = labeller.label([text, None, "123", LINES["c"] * 200])
    assert [model.languages[y] for y in post[: starts[1]].argmax(axis=1)] == ["a"] * 6 + ["b"] * 6
    assert starts.tolist()[1:4] == [12, 12, 12] and (post[12:].argmax(axis=1) == 2).mean() > 0.99


def word_features(word):
    """Hash buckets of a word's features, one by one."""
    marked = f"<{word}>"
    names = ["w" + word]
    for n in range(1, min(4, len(word)) + 1):
        names += ["p" + word[:n], "s" + word[-n:]]
    names += [marked[i : i + 2] for i in range(len(marked) - 1)]
    names += [marked[i : i + 3] for i in range(len(marked) - 2)]
    return [zlib.crc32(f.encode()) % language.BUCKETS for f in names]


def test_features_of_all_words_are_made_together(monkeypatch):
    """Equal to those of single words, with one checksum of bytes a word and two of marks; also for longer characters."""
    rng = random.Random(8)
    alphabet = "abcdefghéßñłя日本語한𝒜𝒷'’"
    words = ["".join(rng.choices(alphabet, k=n)) for n in range(1, 12) for _ in range(40)] + ["x" * 700, "日" * 300, "a", "𝒜"]
    want = [word_features(w) for w in words]
    calls, checksum = [], zlib.crc32
    monkeypatch.setattr(language.zlib, "crc32", lambda *of: calls.append(of) or checksum(*of))
    flat, starts = language.feature_rows(words)
    assert [flat[a:b].tolist() for a, b in zip(starts, starts[1:])] == want and len(starts) == len(words) + 1
    assert len(calls) <= len(words) + 10
    assert [x.tolist() for x in language.feature_rows([])] == [[], [0]]


def test_words_equal_pattern():
    """Texts without rare characters are searched by another library, and find the same words."""
    find = regex.compile(r"\p{L}[\p{L}\p{M}'’]*").findall
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x11000)]):
        text = f"a{c}b {c} É{c}'x’ 1{c.upper()}2"
        assert language.words(text) == find(text.lower()), ascii(c)
    assert language.words(None) == language.words("") == []


def test_language_edge_cases(spark, model):
    rows = [(1, None, "a", 1.0), (2, "", "a", 1.0), (3, "12 ?!", "a", 1.0), (None, LINES["b"], "a", 1.0), (4, LINES["b"], None, 1.0), (4, LINES["b"], None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = language.predict(docs, model).collect()
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got) == [
        ("1", "und"), ("2", "und"), ("3", "und"), ("4", "b"), ("4", "b"), ("None", "b"),
    ]
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0) for r in got)
    assert language.predict(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.train(docs.filter("lang is null")) is None
    assert language.labelled(docs, model).columns == [*docs.columns, "_lang_pred", "_score"]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.op7_crf_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r["n"] > 100 and r["right"] >= 0.98


def sample_rows(n):
    """Texts of about ``n`` words of four made-up languages."""
    rng = random.Random(5)
    known = {lang: ["".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(500)] for lang, letters in zip("abcd", ("abcdefg", "efghijk", "klmnopq", "qrstuvw"))}
    return [(" ".join(rng.choices(w, k=500)), lang) for _ in range(n // 2000) for lang, w in known.items()]


def test_fit_holds_messages_of_one_part_only(monkeypatch):
    monkeypatch.setattr(language, "STEPS", 1)
    rows = sample_rows(200_000)
    tracemalloc.start()
    language.fit(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # 137 MB with the messages of the whole sample


@pytest.mark.parametrize("part", [1, 100, 1000])
def test_fit_does_not_depend_on_parts(monkeypatch, part):
    rows = sample_rows(4000)
    monkeypatch.setattr(language, "STEPS", 5)
    whole = language.fit(rows)
    monkeypatch.setattr(language, "PART", part)
    cut = language.fit(rows)
    assert np.abs(whole.weights - cut.weights).max() < 1e-4 and np.abs(whole.moves - cut.moves).max() < 1e-9


def test_labelling_holds_messages_of_a_small_slice_only(model):
    text = " ".join(LINES.values()) + " "
    batch = pa.RecordBatch.from_arrays([pa.array([text * 100] * 400)], names=["text"])
    next(language._predict(iter([batch.slice(0, 1)]), model))  # so that the words are known
    tracemalloc.start()
    rows = sum(part.num_rows for part in language._predict(iter([batch]), model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 400 and peak < 100e6  # 193 MB with slices of 4 MB, now 66


def test_quality_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    scored = quality.op4_pu_quality(spark, DATA).filter("held_out").join(labels, "doc_id").collect()
    right = [r["predicted"] == r["quality"] for r in scored]
    assert len(right) > 80 and sum(right) / len(right) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_quality_edge_cases(spark):
    rows = [(i, f"a plain text number {i}, with some words and an end.", i) for i in range(40)]
    rows += [(100, None, 1), (101, "", 1), (None, "x", 1), (102, "!!" * 20_000, 1), (5, "twice", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, 1, "x") for i in range(30)] + [(3, 0, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score_quality(docs, labels.filter("quality = 0")).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_risk_is_not_negative():
    """Newton steps on the risk keep it at 0 or more, and find the prior's share."""
    assert len(quality.features(b"ABC! abc|d\n\n x")) == quality.N_FEATURES == len(quality.features(None))
    assert np.isfinite(quality.features(b"")).all()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute_spans(text):
    card = lambda m: re.sub("[ -]", "", m)
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 12 <= len(card(m[0])) <= 19 and luhn(card(m[0]))],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15],
    }


def test_base_spans_equal_patterns():
    rng = random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choice("0123456789.@+- ab-()é") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("9" * 50_000 + "a" * 50_000 + "@")["email"] == []


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail joe (at) example [dot] com now", "email", "joe (at) example [dot] com"),
        ("é joe at mail dot example dot org.", "email", "joe at mail dot example dot org"),
        ("jоe@exаmple.com!", "email", "jоe@exаmple.com"),
        ("jo​e@exa‌mple.com", "email", "jo​e@exa‌mple.com"),
        ("call plus four nine one five one two three four five six seven, ok", "phone", "plus four nine one five one two three four five six seven"),
        ("card ４１１１ 1111 １１１１ 1111.", "card", "４１１１ 1111 １１１１ 1111"),
        ("at １０.0.0.７ now", "ip", "１０.0.0.７"),
    ],
)
def test_disguised(text, kind, found):
    added = pii.added_spans(text, pii.base_spans(text))
    assert {k: [text[a:b] for a, b in spans] for k, spans in added.items()} == {kind: [found]}


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("host 192 dot 168 dot 1 dot 1 is up", "ip", "192 dot 168 dot 1 dot 1"),
        ("on 5, phone 192 dot 168 dot 1 dot 1 or", "ip", "192 dot 168 dot 1 dot 1"),
        ("host one nine two dot one six eight dot one dot one.", "ip", "one nine two dot one six eight dot one dot one"),
        ("host 192.one six eight.1.1 and", "ip", "192.one six eight.1.1"),
        ("host one zero [dot] 0 dot zero (dot) seven", "ip", "one zero [dot] 0 dot zero (dot) seven"),
        ("call +49 one five one 2345678 now", "phone", "+49 one five one 2345678"),
        ("call plus 49 151 two three 45678 now", "phone", "plus 49 151 two three 45678"),
        ("mail joe@example dot com now", "email", "joe@example dot com"),
        ("mail joe [at] example dot com now", "email", "joe [at] example dot com"),
        ("mail joe at example [dot] com now", "email", "joe at example [dot] com"),
        ("é joe dot smith at example dot com.", "email", "joe dot smith at example dot com"),
        ("é joe dot smith [at] example (dot) com.", "email", "joe dot smith [at] example (dot) com"),
    ],
)
def test_disguised_in_short_or_mixed_forms(text, kind, found):
    added = pii.added_spans(text, pii.base_spans(text))
    assert {k: [text[a:b] for a, b in spans] for k, spans in added.items()} == {kind: [found]}


@pytest.mark.parametrize(
    "text",
    [
        "I was at example.com today", "one dot two dot three", "1. 2. 3. 4", "section 1 dot 2", "plus one 20 30", "a dot b dot c",
        "one two three four dot five", "see 192 dot 168 dot 1 dot 1 dot 7", "joe@example.com dot net", "999 dot 1 dot 1 dot 1",
        "the dot " * 20_000, "a at b " * 20_000, "one " * 20_000 + "dot", "x dot @ dot y",
    ],
)
def test_plain_dots_and_numbers_get_no_span(text):
    assert pii.added_spans(text, pii.base_spans(text)) == {}


@pytest.mark.parametrize("text", ["I was at home dot", "one two three words", "joe@example.com and 10.0.0.7", "a² + b² = c²", "at (dot) at", ""])
def test_plain_text_gets_no_span(text):
    assert pii.added_spans(text, pii.base_spans(text)) == {}


def test_personal_data_table(spark):
    rows = [(1, "a@b.cd x (at) y (dot) z", "s"), (1, "a@b.cd x (at) y (dot) z", "s"), (2, None, "s"), (None, "", "s"), (3, "x " * 70_000 + "+49 151 2345678", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find_personal_data(docs).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 5 and pii.find_personal_data(docs.limit(0)).count() == 0
    for r in got:
        if r["doc_id"] == 1:
            assert (r["n_email"], r["spans"], r["n_added"]) == (1, "email:0:6,email:7:23", 1)
            assert r["base_sha256"] == hashlib.sha256(b"email:0:6").hexdigest()
        elif r["doc_id"] == 3:
            assert r["spans"] == "phone:140000:140015"
        else:
            assert (r["n_email"], r["n_phone"], r["spans"], r["base_sha256"]) == (0, 0, "", empty)


def brute_links(vectors):
    out = {}
    ids = sorted(vectors)
    usual = [i for i in ids if vectors[i] and None not in vectors[i] and np.isfinite(vectors[i]).all() and any(vectors[i])]
    x = np.array([vectors[i] for i in usual], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(len(usual))
    while True:
        new = np.array([min([label[i], *label[row]]) for i, row in enumerate(linked)])
        if (new == label).all():
            break
        label = new
    for i, v in enumerate(usual):
        out[v] = (int(linked[i].sum()), usual[label[i]])
    return {i: out.get(i, (0, i)) for i in ids}


@pytest.mark.parametrize("side", [2048, 16])
def test_index_equals_brute_force(spark, monkeypatch, side):
    monkeypatch.setattr(multi_index, "SIDE", side)
    rng = np.random.default_rng(4)
    vectors = {}
    for g in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 30))):
            vectors[len(vectors) * 3] = (centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2])).tolist()
    nan, inf = float("nan"), float("inf")
    vectors |= {9001: None, 9002: [], 9003: [0.0] * 16, 9004: [nan] * 16, 9005: [inf] * 16, 9006: [None, *[1.0] * 15]}
    rows = [(i, v, 1) for i, v in vectors.items()] + [(0, vectors[0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id int")
    got = multi_index.linked_vectors(table).collect()
    assert len(got) == len(rows)
    want = brute_links(vectors)
    found, true = sum(r["n_links"] for r in got if r["vec_id"]), sum(n for i, (n, _) in want.items() if i)
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got) and found >= 0.98 * true
    assert np.mean([r["component_id"] == want[r["vec_id"]][1] for r in got]) > 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_index_of_nothing(spark):
    table = spark.createDataFrame([(1, None), (2, None)], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, multi_index.linked_vectors(table).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert multi_index.linked_vectors(table.limit(0)).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(0)
    grid = multi_index.Grid(rng.normal(size=(7, 3)), rng.normal(size=(5, 4)))
    x = rng.normal(size=(20, 7))
    d = multi_index.distances(x[:, :3], grid.left)[:, :, None] + multi_index.distances(x[:, 3:], grid.right)[:, None, :]
    want = np.sort(d.reshape(20, -1), axis=1)[:, :12]
    cells = grid.traverse(x, 12)
    assert np.allclose(np.take_along_axis(d.reshape(20, -1), cells, axis=1), want)
    assert grid.traverse(x, 1000).shape == (20, 35)


def turned(x, rng):
    """Unit vectors at exactly the least cosine from those of ``x``."""
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    return 0.95 * x + np.sqrt(1 - 0.95**2) * side


def share_met(grid, x, rng):
    """Share of turned vectors whose home cell is visited by the vector they came from."""
    return (grid.traverse(x, grid.visits) == grid.traverse(turned(x, rng), 1)).any(axis=1).mean()


def test_visits_hold_for_vectors_outside_the_sample():
    rng = np.random.default_rng(5)
    rows, k = 5000, 500
    x = rng.normal(size=(rows + 1500, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = multi_index.fit(x[:rows], multi_index.PER_CELL * k * k)
    assert len(grid.left) == k and share_met(grid, x[rows:], rng) >= 0.975


def test_strays_take_no_others_along(spark):
    """Vectors of another dimension, first in their slice or not, stand alone; all others keep their links."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 16))
    vectors = {i: (centres[i % 30] + 0.01 * rng.normal(size=16)).tolist() for i in range(10, 310)}
    strays = {i: rng.normal(size=(5, 17)[i % 2]).tolist() for i in (*range(10), 400, 401)}
    rows = sorted({**vectors, **strays}.items())
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = {**brute_links(vectors), **{i: (0, i) for i in strays}}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in multi_index.linked_vectors(table).collect()}
    assert got == want
    x, places = multi_index.clean([[1.0, 2.0], [3.0, 0.0, 4.0], None, [0.0, 0.0, 2.0]], 3)
    assert x.tolist() == [[0.6, 0.0, 0.8], [0.0, 0.0, 1.0]] and places.tolist() == [1, 3]


def test_visits_have_no_cap():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1600, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    grid = multi_index.fit(x[:1500], multi_index.PER_CELL * 1000 * 1000)
    assert 1024 < grid.visits < 1000 * 1000 and share_met(grid, x[1500:], rng) >= 0.97


@pytest.mark.parametrize("side", [2048, 16])
def test_links_count_at_both_ends(spark, monkeypatch, side):
    """With few cells visited, a link that one end alone finds still counts for the other."""
    grids, fit = [], multi_index.fit

    def short(x, n):
        grids.append(fit(x, n))
        grids[0].visits = 2
        return grids[0]

    monkeypatch.setattr(multi_index, "fit", short)
    monkeypatch.setattr(multi_index, "SIDE", side)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(40, 8)), 10, axis=0) + 0.15 * rng.normal(size=(400, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in multi_index.linked_vectors(table).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cells = grids[0].traverse(unit, 2)
    meets = (cells[:, None, :] == cells[None, :, :1]).any(axis=2)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    assert (linked & meets & ~meets.T).any()
    assert [got[i]["n_links"] for i in range(400)] == (linked & (meets | meets.T)).sum(axis=1).tolist()
    assert all(r["n_links"] for r in got.values() if r["component_id"] != r["vec_id"])
