"""Byte-pair encoding and decoding with a pair occurrence index.

Method. The distinct words of a slice of texts are laid out as one array of symbols with links to the left and right
neighbour. An index maps the rank of every adjacent pair to all its positions. Active ranks are taken from a heap in
ascending order; all positions of a rank are merged at once and only the lists of the pairs beside them are updated.
A worker keeps the white-space-separated units it has encoded (up to ``CACHED_BYTES``, then it starts again; long ones are not
kept), so each is merged once.

The vocabulary is a public ``tokenizers`` file: NFC, lower case, words by a fixed pattern, bytes as symbols, an end-of-
word mark. Its path is a parameter; it is read by the workers and never copied. The literals of its special tokens in a
text become their ids. ``decode`` joins the token strings with a space, as the file names no decoder.

A null text is empty; an empty text has no ids and decodes to the empty text. Repeated rows come out once per row. Extra
columns do not matter. Whole texts are encoded, long ones in a slice of their own.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from dosewise.llm.common import slices
from dosewise.llm.pool import Numbers, UnitPool, opened

SLICE = 4 << 20
CACHED_BYTES = 100 << 20
_NONE = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PairIndex:
    """Merges of a vocabulary, applied to many words at once."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]], end: str = "</w>"):
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[c] for c in symbols], np.int32)
        self.final = np.array([vocabulary[c + end] for c in symbols], np.int32)
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        self.doubles = np.array([a == b for a, b in merges])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (non-empty) words in one array, and where each word starts, with the end as last entry."""
        if not words:
            return np.empty(0, np.int32), np.zeros(1, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(words), np.uint8)
        n = len(raw)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        right = np.arange(1, n + 1, dtype=np.int32)
        right[ends - 1] = -1
        left = np.arange(-1, n - 1, dtype=np.int32)
        left[ends - sizes] = -1
        current = np.full(n, _NONE, np.int32)
        alive = np.ones(n, bool)
        renewed = np.zeros(n, bool)

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def refresh(at: np.ndarray) -> None:
            """Ranks of the pairs that start at these positions, entered in the index."""
            found = self.rank(symbol[at], symbol[right[at]])
            current[at] = found
            known = found != _NONE
            at, found = at[known], found[known]
            if not len(at):
                return
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist()]
            for r, start, end in zip(found[cuts].tolist(), cuts, [*cuts[1:], len(at)]):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[start:end])

        refresh(np.flatnonzero(right >= 0).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.concatenate(lists) if len(lists) > 1 else lists[0]
            at = np.sort(at[current[at] == r])
            if not len(at):
                continue
            if len(lists) > 1:  # a pair that came back is in several lists
                at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            if self.doubles[r]:  # in a run of equal symbols every second position is taken, from the left
                runs = np.concatenate([[True], right[at[:-1]] != at[1:]])
                first = np.maximum.accumulate(np.where(runs, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = right[at]
            after = right[gone]
            symbol[at] = self.made[r]
            alive[gone] = False
            current[gone] = _NONE
            current[at] = _NONE
            right[at] = after
            inside = after >= 0
            left[after[inside]] = at[inside]
            before = left[at]
            before = before[before >= 0]
            at = at[inside]
            renewed[at] = True  # a position that is merged too can be the one before another
            refresh(np.concatenate([at, before[~renewed[before]]]))
            renewed[at] = False
        kept = np.concatenate([[0], np.cumsum(alive)])
        return symbol[alive], kept[np.concatenate([[0], ends])]


def _gathered(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of an array one after the other, and where each starts, with the end as last entry."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return flat[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])], ends


class Codec:
    """A vocabulary file with the words encoded so far."""

    # Fixed value of the vocabulary's format: the pattern of its words, with the classes of letters and numbers.
    WORDS = r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^\s{L}{N}]+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.index = PairIndex(model["vocab"], model["merges"], model["end_of_word_suffix"])
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        tokens = {i: t for t, i in (model["vocab"] | special).items()}
        self.tokens = [tokens.get(i, "") for i in range(max(tokens) + 1)]
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.find = regex.compile(self.WORDS.replace("{L}", r"[\p{L}]").replace("{N}", r"[\p{N}]")).findall
        self.is_rare = re.compile("[^\\x00-\u024f\u2010-\u2027]").search
        # Words and line feeds of a text in lower case without rare characters; of these NFC leaves all as they are.
        common = {c for x in [*range(0x250), *range(0x2010, 0x2028)] for c in chr(x) + chr(x).lower()}
        space, letter, number = ("".join(sorted(c for c in common if regex.match(k, c))) for k in (r"\s", r"\p{L}", r"\p{N}"))
        lines = self.WORDS.removeprefix("(?V1)").replace(r"[^\s{L}{N}]", f"[^{space}{letter}{number}]") + r"|\n"
        self.find_lines = re.compile(lines.replace("{L}", f"[{letter}]").replace("{N}", f"[{number}]")).findall
        # Python, ``regex`` and the library each know another version of Unicode; they agree on the characters that are not rare.
        # Texts with others are normalised and cut by the library.
        whole = Tokenizer.from_file(path)
        self.normalise, self.cut = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        self.bytes = {c: b for b, c in enumerate(byte_symbols())}
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        self.pool = UnitPool(self._encode_units, CACHED_BYTES)
        self.separators = regex.compile(r"\s+").split
        self.is_odd = re.compile("[\x1c-\x1f]").search  # white space for str.split, but not for the pattern

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units without a line feed. They are cut together, with line feeds between them, which stand for no id.

        Units with rare characters, or with what may be a special token, are cut one by one and follow the others.
        """
        joined, alone = "\n".join(units), []
        if "<|" in joined or self.is_rare(joined):
            alone = [k for k, u in enumerate(units) if "<|" in u or self.is_rare(u)]
            rest = list(units)
            for k in alone:
                rest[k] = ""
            joined = "\n".join(rest)
        found = self.find_lines(joined.lower())
        for k in alone:
            found += ["\n", *self._words(units[k])]
        numbers = Numbers()
        numbers["\n"] = 0
        word = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
        plain = [w for w in numbers.new if w not in self.special]
        ids, starts = self.index.encode([w.encode() for w in plain])
        starts = np.concatenate([[0], starts])
        if len(plain) < len(numbers.new):
            # Special tokens follow the plain words in the array.
            at = dict(zip(["\n", *plain, *self.special], range(1 + len(plain) + len(self.special))))
            ids = np.concatenate([ids, np.array(list(self.special.values()), np.int32)])
            starts = np.concatenate([starts, starts[-1] + 1 + np.arange(len(self.special))])
            word = np.fromiter(map(at.__getitem__, numbers), np.int64, len(numbers))[word]
        ids, ends = _gathered(ids, starts[word], np.diff(starts)[word])
        ends = ends[np.concatenate([[0], np.flatnonzero(word == 0), [len(word)]])]
        if alone:
            row = np.arange(len(units))
            row[alone] = len(units) + np.arange(len(alone))
            ids, ends = _gathered(ids, ends[row], np.diff(ends)[row])
        return ids, ends

    def _words(self, text: str) -> list[str]:
        """Words of a text, in which literals of special tokens are words of their own."""
        if self.split and "<|" in text:
            parts = self.split(text)
            if len(parts) > 1:
                return [w for p in parts for w in ([p] if p in self.special else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if self.is_rare(text):
                cut = self.cut(self.normalise(text))
                return [bytes(map(self.bytes.__getitem__, written)).decode() for written, _ in cut]
            text = unicodedata.normalize("NFC", text)
        return self.find(text.lower())

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text starts, with the end as last entry.

        No word, composed letter or special token reaches over white space, so texts are cut there first.
        """
        units = [[] if not t else self.separators(t) if self.is_odd(t) else t.split() for t in texts]
        return self.pool.lookup(units)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


def codec(path: str) -> Codec:
    return opened(("bpe", path), lambda: Codec(path))


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in slices(batches, "text", SLICE):
        ids, starts = own.encode(batch.column("text").to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        column = batch.column("ids")
        flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
        rows: list[tuple[int, str, str]] = []
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            ids = flat[start:end].tolist()
            written = " ".join(map(own.decimals.__getitem__, ids)).encode()
            decoded = own.decode(ids).encode()
            rows.append((len(ids), hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        n, written, decoded = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(written, pa.string()), pa.array(decoded, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in batches:
        texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def encode_documents(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, ids)``, the ids of each whole text."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(partial(_encode, path=path or default_vocabulary()), f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(partial(_decode, path=path or default_vocabulary()), f"doc_id {kind}, text string")


def _with_tokens(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = codec(path)
    for batch in slices(batches, "text", SLICE // 4):
        ids, starts = own.encode(batch.column("text").to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))
        flat = ids.tolist()
        decoded = [own.decode(flat[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        added = [pa.array(np.diff(starts)), lists, pa.array(decoded, pa.string())]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, *added], names=[*batch.schema.names, "n_tokens", "token_ids", "decoded"]
        )


def with_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``docs`` (with a column ``text``) with ``n_tokens``, ``token_ids`` and ``decoded``.

    Columns of these names in ``docs`` are replaced.
    """
    docs = docs.drop("n_tokens", "token_ids", "decoded")
    added = T.StructType().add("n_tokens", "long").add("token_ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    schema = T.StructType([*docs.schema, *added])
    return docs.mapInArrow(partial(_with_tokens, path=path or default_vocabulary()), schema)


def token_digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Number of ids, and checksums of the ids and of the decoded text, of ``(doc_id, ids)``."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return encoded.select("doc_id", "ids").mapInArrow(partial(_digest, path=path or default_vocabulary()), schema)


def op3_pair_index_bpe(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded texts of all documents."""
    return token_digests(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
