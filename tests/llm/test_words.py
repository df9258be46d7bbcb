"""MinHash and line dedup against brute force, with the edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosewise.llm import line_dedup, minhash
from dosewise.llm.common import connected, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep int, bucket string"


def table(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "b") for i, t in rows], SCHEMA).repartition(4)


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = words((text or "").encode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def family_rows(sizes, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    passage = [word() for _ in range(40)]
    for n in sizes:
        base = [word() for _ in range(90)]
        for _ in range(n):
            own = list(base)
            for _ in range(rng.randint(0, 8)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rows += [" ".join([*[word() for _ in range(40)], *passage]) for _ in range(60)]
    return [((i * 37) % 10007, t) for i, t in enumerate(rows)]


def test_minhash_equals_brute_force(spark):
    rows = family_rows([2, 6, 150])
    rows += [(20000, None), (20001, ""), (20002, " \n\t"), (20003, "One two"), (20004, "one  TWO"), (20005, "x " * 3000)]
    rows += [(20006, rows[0][1]), (20007, rows[0][1])]
    want = brute_components(rows)
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_minhash_repeated_rows_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "other words here")]
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in minhash.near_duplicates(table(spark, rows)).collect())
    assert got == [("3", "3"), ("5", "3"), ("5", "3"), ("None", "None")]
    assert minhash.near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_circulant_signature():
    sets = [minhash.shingle_hashes(" ".join(f"w{i}" for i in range(a, a + 400)).encode()) for a in (0, 40)]
    x, y = map(minhash.signature, sets)
    circle = minhash._circle()
    places = (minhash._mixed(sets[0] ^ minhash._MIX) >> np.uint64(44)).astype(np.int64)
    assert x[17] == circle[places + 17].min()  # coordinate k reads the second permutation k places further
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs((x == y).mean() - true) < 0.06


def test_common_counts(monkeypatch):
    monkeypatch.setattr(minhash, "MATCHES", 7)
    rng = np.random.default_rng(1)
    x, y = ([np.unique(rng.integers(0, 30, n)) for n in rng.integers(0, 20, k)] for k in (9, 6))
    assert (minhash.common_counts(x, y) == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all()


def test_connected(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    parent = list(range(500))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = connected(spark.createDataFrame(pairs, "a long, b long"), "test").collect()
    assert {r["id"]: r["component"] for r in got} == {i: root(i) for p in pairs for i in p if p[0] != p[1]}
    assert connected(spark.createDataFrame([], "a long, b long"), "none").count() == 0


def brute_lines(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if not "".join(window).strip(" \t\n\x0b\x0c\r"):
                continue
            if window in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(window)
        out[i] = ("\n".join(t for k, t in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(70, "\n\n\n\n"), (71, "\n\n\n"), (72, "x\ny\nz"), (73, "x\ny\nz"), (74, ""), (75, "same\n" * 2000), (76, "a\r\n b\t\nc")]
    got = line_dedup.dedup_lines(table(spark, rows))
    assert got.columns[:3] == ["doc_id", "lang", "source"] and "bucket" in got.columns
    assert {r["doc_id"]: (r["text"], r["_lines"], r["_removed"]) for r in got.collect()} == brute_lines(rows)


def test_line_dedup_white_space_and_letters_of_its_escapes(spark):
    """Lines of the characters x, 0, B and f are words; vertical tabs and form feeds are not."""
    texts = ["0\n0\n0", "0 0 0\nx\nB f", "\x0b\n\x0c\n\x0b\x0c", "\r\n\t\n \x0b"]
    rows = [(i, t) for i, t in enumerate(2 * texts)]
    got = {r["doc_id"]: (r["text"], r["_lines"], r["_removed"]) for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert got == brute_lines(rows)
    assert [got[i][2] for i in range(8)] == [0, 0, 0, 0, 3, 3, 0, 0]


def test_line_dedup_edge_cases(spark):
    copy = "p\nq\nr\ns"
    rows = [(1, copy), (1, copy), (2, None), (None, copy), (3, copy + "\nnew"), (1, "p\nq\nr")]
    got = line_dedup.dedup_lines(table(spark, rows)).collect()
    texts = sorted((str(r["doc_id"]), r["text"]) for r in got if r["text"] is not None)
    # The null id comes first and keeps its lines; the equal rows of id 1 are treated alike.
    assert texts == [("1", ""), ("1", ""), ("1", ""), ("3", "new"), ("None", copy)]
    assert len(got) == 6 and line_dedup.dedup_lines(table(spark, rows).filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("text, found", [(b"A\x0bb \xc3\x89\x85c", [b"a", b"b", b"\xc3\x89\x85c"]), (None, []), (b"", [])])
def test_words(text, found):
    assert words(text) == found
