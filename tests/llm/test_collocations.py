"""Collocations against plain counting and against the SQL."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from dosewise.llm import collocations as co

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrases_of(rows):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    return counts, totals


def expected(rows, least=10, covered=50, top=2000):
    counts, totals = phrases_of(rows)
    found = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, words), a in found.items():
        longer = [b for (other, w), b in found.items() if other == lang and len(w) == 3 and len(words) == 2 and words in (w[:2], w[1:])]
        if any(100 * b >= covered * a for b in longer):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), left, right))
    out.sort()
    ranked, rank = [], Counter()
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(ranked)


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def random_rows(n, seed=1):
    rng = random.Random(seed)
    words = ["The", "of", "a", "ä", "漢字", "x\x00y", "New", "York", "City", *[f"w{i}" for i in range(40)]]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "; ", " \x1c ", "　"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.choice([3, 9, 49])]) + rng.choice(marks) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "en", "fr", "und", None]), text + rng.choice(["", " New York City"])))
    return rows + [("en", None), ("fr", ""), (None, None), ("one", "hapax"), ("", "...")] + [("en", rows[0][1])] * 30


@pytest.mark.parametrize("ranges", [1, 9, 60])
def test_equals_plain_counting(spark, monkeypatch, ranges):
    rows = random_rows(500)
    size = sum(len((t or "").encode()) for _, t in rows)
    monkeypatch.setattr(co, "RANGE_BYTES", size // ranges + 1)
    monkeypatch.setattr(co, "BLOCK_BYTES", 3000)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    assert result(co.collocations(df)) == expected(rows)


def test_hot_pair_long_text_and_limits(spark, monkeypatch):
    monkeypatch.setattr(co, "RANGE_BYTES", 4000)
    monkeypatch.setattr(co, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(co, "HOT", 0.2)
    rows = [("en", f"user id {i}, user id {i % 50}. ") for i in range(2000)]  # a pair that a third of all suffixes begin with
    rows += [("en", "to be or not. " * 3000), ("en", "no end " * 4000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert result(co.collocations(df, least=3, top=20)) == expected(rows, least=3, top=20)


def test_partitions_are_counts():
    rng = np.random.default_rng(3)
    keys = np.stack([rng.integers(0, 2, 4000), *(rng.zipf(1.5, 4000) % 30 for _ in range(3))]).astype(np.int32)
    keys[1] += 1
    keys[3][keys[2] == 0] = 0
    n = rng.integers(1, 4, 4000)
    want = Counter()
    for column, times in zip(keys.T.tolist(), n.tolist()):
        for d in range(4):
            if d == 0 or column[d]:
                want[tuple(column[: d + 1])] += times
    first, last = min(map(tuple, keys.T.tolist())), max(map(tuple, keys.T.tolist()))
    got = {}
    for depth, pointer, count in co.equal_partitions(keys, n, 25):
        for p, c in zip(pointer.tolist(), count.tolist()):
            prefix = tuple(keys[: depth + 1, p].tolist())
            assert prefix not in got
            got[prefix] = c
    for prefix, count in want.items():
        at_edge = prefix in (first[: len(prefix)], last[: len(prefix)])
        assert got.get(prefix, 0) == (count if count >= 25 or at_edge else 0) or len(prefix) == 1
    assert set(got) <= set(want)


def test_splitters_cut_at_the_right_places():
    rng = random.Random(4)
    texts = [(rng.choice([b"en", b"fr"]), " ".join(rng.choice("abcdefgh") for _ in range(30)).encode()) for _ in range(20)]
    langs, names, keys = co.suffixes(texts, 3)
    keys, _ = co.counted(keys)
    spelled = [(langs[c[0]], *[names[i - 1] if i else b"" for i in c[1:]]) for c in keys.T.tolist()]
    assert spelled == sorted(set(spelled))
    splitters = sorted({rng.choice(spelled) for _ in range(10)} | {(b"e", b"", b"", b""), (b"fr", b"bb", b"", b""), (b"z", b"a", b"", b"")})
    assert co.cuts(langs, names, keys, splitters) == [sum(s < t for s in spelled) for t in splitters]


def test_names_empty_table_and_size_of_counts(spark):
    rows = [("en", "New York " * 12, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "l string, body string, phrase int, n int, lang int, range int")
    assert [r.phrase for r in co.collocations(df, lang="l", text="body").orderBy("rank").collect()] == ["new york new", "york new york"]
    assert co.collocations(df.limit(0), lang="l", text="body").collect() == []


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables not present")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({co.OP12_SQL})").fetchall()
    assert result(co.op12_suffix_collocations(spark, folder)) == sorted(want)
