"""Token counts against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dosewise.llm import token_counts as tc


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def expected(library, texts):
    return sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts)


def counted(df):
    return sorted((r.n_bytes, r.n_tokens) for r in tc.token_counts(df).collect())


def test_random_texts(spark, library):
    rng = random.Random(7)
    alphabet = list(" \n\t\r\x0b\x1c\x85\xa0\xad　  abcXYZ019,.!'éß½²ſ漢語\x00\x7f")
    alphabet += ["  ", "'ll", " 's", "<|", "|>", "<|endoftext|>", " <|endoftext|> "]
    alphabet += [chr(c) for c in (rng.randrange(0x20000) for _ in range(300)) if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(8000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    assert counted(df) == expected(library, texts)


def test_every_code_point(spark, library):
    texts = [f"a{chr(c)}b1 {chr(c)}2 x {chr(c)} y" for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    assert counted(spark.createDataFrame([(0, t) for t in texts], "doc_id int, text string")) == expected(library, texts)


def test_blocks_long_texts_and_ties(spark, library, monkeypatch):
    monkeypatch.setattr(tc, "BLOCK_BYTES", 2000)
    long = "the same words again, " * 3000 + "x" * 5000 + " \n" * 500
    texts = [long, long, None, "", " ", "one", "one"] + [f"word{i % 7} and, {i}" for i in range(2000)]
    rows = [(i % 5 or None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert counted(df) == expected(library, texts)
    nulls = tc.token_counts(df).filter("doc_id is null").count()
    assert nulls == sum(1 for i, _ in rows if i is None)


def test_other_columns_and_empty_table(spark):
    df = spark.createDataFrame([("a", "some text", 1, 2, 3)], "key string, body string, id int, block int, n_tokens int")
    out = tc.token_counts(df, id="key", text="body")
    assert [tuple(r) for r in out.collect()] == [("a", 9, 2)]
    assert out.filter("n_tokens > 9").columns == ["key", "n_bytes", "n_tokens"]
    assert tc.token_counts(df.limit(0), id="key", text="body").collect() == []


def test_each_distinct_pre_token_is_encoded_once(library):
    class Recording(tc.PreTokens):
        seen: list = []

        def pieces(self, tokens):
            self.seen += tokens
            return super().pieces(tokens)

    import pyarrow as pa

    pre = Recording(tc.default_vocabulary())
    rows = [(b, 1, b" a\xff b" if b % 2 else b" b\xff c") for b in range(20)]
    names = ["block", "bucket", "tokens"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([1] * 20, pa.int32()), pa.array([r[2] for r in rows])], names=names
    )
    original, tc._pre_tokens = tc._pre_tokens, lambda path: pre
    try:
        out = list(tc._count_pieces(iter([batch]), ""))
    finally:
        tc._pre_tokens = original
    assert len(out) == 20 and sorted(pre.seen) == [b" a", b" b", b" c"]


def test_query(spark, library):
    from pathlib import Path

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("test tables not present")
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.op11_pretoken_counts(spark, folder).collect()}
    sizes = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs}
    assert got == {r.doc_id: (len((r.text or "").encode()), sizes[r.doc_id], sizes[r.doc_id] > 1024) for r in docs}
