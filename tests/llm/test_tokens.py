"""BPE against the tokenizers library, Simple-8b round trips and token files."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from dosewise.llm import bpe, pool, simple8b
from dosewise.session import scratch_dir

ODD = [
    "", " ", "It's THE end. don't", "a\x1cb\x1fc\x85d e f　g​h", "ΑΣ ΣΑΣ. Σ", "İstanbul ǅ ﬁ K Å", "é à́ ́x",
    "aaaaaaaaaaaaaaaaaaa bananana " * 3, "x<|endoftext|>y <|startoftext|> <|endoftext|> <|end", "１２３ ⅷ ² 12 3", "😀👍🏽 日本語 한국어 ไทย",
    "'S 'T I'LL y'all've", "\x00\x01 ￿", "a  b", "a \tb\n c", " lead", "trail ", "x՘y", "a\xa0 b \x1c",
]


def odd_texts(n):
    rng = random.Random(2)
    blocks = [(0, 0x250), (0x300, 0x600), (0x2000, 0x2070), (0x1E00, 0x2000), (0xFF00, 0xFF60)]
    pool = [chr(x) for a, b in blocks for x in range(a, b)] + [" "] * 150
    return ODD + ["".join(rng.choice(pool) for _ in range(60)) for _ in range(n)] + ["".join(rng.choice("ab ") for _ in range(40_000))]


def test_bpe_equals_library():
    own, library = bpe.Codec(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    texts = odd_texts(300)
    ids, starts = own.encode(texts)
    for k, text in enumerate(texts):
        want, got = library.encode(text, add_special_tokens=False).ids, ids[starts[k] : starts[k + 1]].tolist()
        assert got == want and own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_bpe_equals_library_on_every_code_point():
    """Alone between letters, and after a capital and a mark, in both of Unicode's lower planes and the last ones in use."""
    own, library = bpe.Codec(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]]
    for start in range(0, len(points), 20_000):
        texts = [f"a{c}b É{c}\u0301 {c}" for c in points[start : start + 20_000]]
        ids, starts = own.encode(texts)
        for k, e in enumerate(library.encode_batch_fast(texts, add_special_tokens=False)):
            assert ids[starts[k] : starts[k + 1]].tolist() == e.ids, ascii(texts[k])


def test_bpe_cuts_units_together(monkeypatch):
    """Only units with rare characters or what may be a special token are cut one by one; ids are the library's."""
    own, library, alone = bpe.Codec(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary()), []
    cut = own._words
    monkeypatch.setattr(own, "_words", lambda unit: alone.append(unit) or cut(unit))
    texts = ["İt's été, Ⱥ 12½ <|endoftext|> naïve’s", "日本語 x<|endoftext|>y the <|end", "ΑΣ. don't", "", "aaaa a\x1cb"]
    ids, starts = own.encode(texts)
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert sorted(alone) == sorted(["<|endoftext|>", "日本語", "x<|endoftext|>y", "<|end", "ΑΣ."])


def test_pool_is_bounded_in_bytes():
    """Long units are forgotten, and the store starts again; opening one store drops another."""
    found = pool.UnitPool(lambda units: (np.arange(len(units), dtype=np.int32), np.arange(len(units) + 1)), 100_000)
    for i in range(200):
        ids, starts = found.lookup([[f"{i} " * 2000, "short", f"u{i}"], [], ["short"]])
        assert starts.tolist() == [0, 3, 3, 4] and ids[1] == ids[3]
        assert all(len(str(u)) <= pool.LONG for u in found.known) and found.size <= 105_000
    first = pool.opened("a", list)
    assert pool.opened("a", list) is first
    pool.opened("b", list)
    assert list(pool._OPEN) == ["b"] and pool.opened("a", list) is not first


def test_bpe_is_the_same_after_the_cache_starts_again(monkeypatch):
    own = bpe.Codec(bpe.default_vocabulary())
    first = own.encode(ODD)
    own.pool.limit = -1
    again = own.encode(ODD)
    assert (first[0] == again[0]).all() and (first[1] == again[1]).all()


def test_bpe_tables(spark):
    rows = [(1, "Hello hello", 5), (1, "Hello hello", 5), (2, None, 5), (None, "", 5), (3, "the  end " * 5000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    encoded = bpe.encode_documents(docs)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    digests = bpe.token_digests(encoded).collect()
    for r, (i, text, _) in zip(sorted(digests, key=lambda r: (str(r["doc_id"]))), sorted(rows, key=lambda r: str(r[0]))):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert sorted(str(r["text"])[:7] for r in bpe.decode_documents(encoded).collect())[-1].startswith("the</w>")
    assert bpe.with_tokens(docs).columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    assert bpe.encode_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_simple8b_round_trip(seed):
    rng = np.random.default_rng(seed)
    n, bits = int(rng.integers(0, 2000)), int(rng.integers(1, 65))
    values = rng.integers(0, 2**64, n, dtype=np.uint64) >> np.uint64(64 - bits)
    if seed % 3 == 0:
        values = values >> rng.integers(0, 64, n).astype(np.uint64)
    if seed % 5 == 0:
        values[n // 3 :] = 0
    words, escaped = simple8b.pack(values)
    assert (simple8b.unpack(words, escaped, n) == values).all()
    # By the definition: one word at a time.
    out, more = [], 0
    for w in words.tolist():
        s = w >> 60
        count, width = int(simple8b.COUNTS[s]), int(simple8b.WIDTHS[s])
        part = [w >> k * width & ((1 << width) - 1) for k in range(count)]
        out += [int(escaped[part[0]])] if s == simple8b.ESCAPE else part
        more += s == simple8b.ESCAPE
    assert out[:n] == values.tolist() and more == len(escaped)


def test_units_equal_library():
    own, library = simple8b.library(simple8b.default_vocabulary()), Tokenizer.from_file(simple8b.default_vocabulary())
    texts = odd_texts(300)
    ids, starts = own.encode(texts)
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_token_files(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["tion", "the", "été"]) for _ in range(rng.randint(0, 300))), "x") for i in range(-5, 60)]
    rows += [(7, "again", "x"), (7, "again", "x"), (None, "no id", "x"), (61, None, "x"), (62, "", "x"), (63, "w " * 90_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    folder = f"{scratch_dir(spark)}/tokens"
    got = simple8b.read_tokens(simple8b.write_tokens(docs, folder, partitions=4), folder).collect()
    library = Tokenizer.from_file(simple8b.default_vocabulary())
    want = {}
    for i, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found = {}
    for r in got:
        found.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = f"{scratch_dir(spark)}/no-tokens"
    assert simple8b.read_tokens(simple8b.write_tokens(docs, folder), folder).count() == 0
