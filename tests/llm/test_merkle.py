"""Merkle manifest against a plain construction of the trees, and against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from dosewise.llm import merkle

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climbed(level):
    """The top over a list of digests, and for each the siblings on its left and right on the way up."""
    paths, places = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for path, place in zip(paths, places):
            start = place // 8 * 8
            path.append((level[start:place], level[place + 1 : start + 8]))
        level = [digest("".join(level[b : b + 8])) for b in range(0, len(level), 8)]
        places = [p // 8 for p in places]
    return level[0], paths


def expected(rows):
    parts = []
    for lang in sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode())):
        mine = sorted(((r, leaf_of(r, r[4])) for r in rows if r[2] == lang), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        parts.append((mine, *climbed([d for _, d in mine])))
    if not parts:
        return []
    root, above = climbed([subroot for _, subroot, _ in parts])
    out = []
    for (mine, subroot, paths), more in zip(parts, above):
        for (row, leaf), path in zip(mine, paths):
            now = leaf
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                now = leaf_of(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]))
            for left, right in path + more:
                now = digest("".join([*left, now, *right]))
            proof = digest("".join("".join(left + right) for left, right in path + more))
            out.append((row[0], leaf, subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def tables():
    rng = random.Random(5)
    yield "empty", []
    yield "one row", [(3, "s", "x", 4, "Text")]
    yield "lone languages", [(i, "s", f"l{i}", 1, "AB") for i in range(9)]
    yield "exactly eight", [(i, "s", "x", 1, "Ab") for i in range(8)]
    yield "one language", [(i, "s", "x", 1, "Ab") for i in range(65)]
    odd = []
    for i in range(700):
        lang = rng.choice([None, "hot", "hot", "hot", *[f"l{j}é" for j in range(12)]])
        odd.append((rng.choice([None, i, i // 2, -i]), rng.choice([None, "s"]), lang, rng.choice([None, i]), rng.choice([None, "", "-", f"Ä Text {i}"])))
    yield "nulls, ties and repeated rows", odd + odd[:90] + [odd[0]] * 70


@pytest.mark.parametrize("rows", [pytest.param(r, id=n) for n, r in tables()])
def test_equals_brute_force_and_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op13_pointer_proofs(spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    sql = con.execute(f"select {', '.join(COLUMNS)} from ({merkle.OP13_SQL})").fetchall()
    assert sorted(sql, key=str) == expected(rows)


def test_proofs_are_of_the_real_siblings(spark):
    rows = [(i, "s", "x" if i % 3 else "y", 1, f"Text {i}") for i in range(200)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    root = {bytes(r.root) for r in found}
    assert len(root) == 1
    for r in found:
        now = r.leaf.hex()
        for step in r.path:
            assert len(step.before) + len(step.after) <= 7 * 32
            now = digest(step.before.hex() + now + step.after.hex())
        assert now == r.root.hex()


def test_other_column_names(spark):
    rows = [(i, "s", "x", 1, f"Text {i}", 7, 7, 7, 7, 7) for i in range(20)]
    docs = spark.createDataFrame(rows, "k long, s string, l string, c long, body string, tree int, at int, size int, id int, leaf int")
    found = merkle.manifest(docs, F.upper("body"), fields=("k", "s", "l", "c", "body"))
    assert found.count() == 20 and found.filter("changed = leaf").count() == 0


def test_places_do_not_depend_on_partitions(spark):
    rows = spark.range(0, 5000).selectExpr("case when id % 3 = 0 then null else 'g' end as g", "id % 100 as v")
    for parts in (1, 7):
        put = merkle.placed(rows.repartition(parts), "g", ["v"], "test").groupBy("g").agg(
            F.countDistinct("at").alias("n"), F.max("at").alias("last"), F.max("size").alias("size")
        )
        assert sorted(tuple(r)[1:] for r in put.collect()) == [(1667, 1666, 1667), (3333, 3332, 3333)]
