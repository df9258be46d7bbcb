"""Token counts from the pieces of distinct pre-tokens.

Method. Texts are cut into the library's pre-tokens. For a block of texts a table of per-document pre-token frequencies is
stored, with its distinct pre-tokens. These are routed by a hash, so that the pieces of each distinct pre-token of the whole
table are counted once, by one task; the counts go back to the blocks that asked for them, are joined to the frequencies
there and summed. No document's ids are made: of a pre-token's encoding only the length is read.

Bounds. A block holds about ``BLOCK_BYTES`` of text (a longer text is a block of its own) and each distinct pre-token once, so
even the commonest pre-token has one entry per block. The number of hash buckets follows the size of the texts.

A null text is empty: no bytes, no tokens. Rows of a null id, equal ids or equal texts are counted one by one, each a row of
the result. Only the two named columns are read, so other columns may have any names. An empty table gives an empty result.
Literals of special tokens in a text count as one token each, as by the library's default.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dosewise.llm.bpe import byte_symbols
from dosewise.llm.common import documents, gathered, packed, unpacked
from dosewise.llm.pool import Numbers, opened
from dosewise.session import materialize

BLOCK_BYTES = 8 << 20
#: Bytes of text for each hash bucket of distinct pre-tokens, and the greatest number of buckets.
BUCKET_BYTES, BUCKETS = 32 << 20, 4096
#: Stands between pre-tokens; no UTF-8 text holds it.
SEPARATOR = b"\xff"
#: Documents of more tokens than this are marked.
LIMIT = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# The pattern of byte-level pre-tokens with its classes written out for the printable characters below U+0180,
# whose classes are the same in every version of Unicode. Texts with others are given to the library.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_NUMBER = "0-9²³¹¼½¾"
_PRETOKEN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^ {_LETTER}{_NUMBER}]+")
_WRITTEN_OUT = re.compile("[!-~¡-¬®-ſ]+")


class PreTokens:
    """The library's pre-tokenizer and its model apart, and the literals of the special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        if described["normalizer"] or described["pre_tokenizer"]["type"] != "ByteLevel" or described["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("expected a byte-level vocabulary without a normalizer or a prefix space")
        literals = []
        for added in described["added_tokens"]:
            if " " in added["content"] or any(added[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError(f"special token {added['content']!r}: only plain literals without a space are read")
            literals.append(added["content"])
        whole = Tokenizer.from_file(path)
        self.library = whole.pre_tokenizer.pre_tokenize_str
        self.model = Tokenizer(whole.model)
        longest_first = sorted(literals, key=len, reverse=True)
        self.literals = re.compile("|".join(map(re.escape, longest_first))) if literals else None
        self.symbols = dict(enumerate(byte_symbols()))

    def _split(self, text: str) -> list[str]:
        return [text[start:end] for _, (start, end) in self.library(text)]

    def of(self, unit: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special literals it holds."""
        if self.literals is None or not self.literals.search(unit):
            return self._split(unit), 0
        parts = self.literals.split(unit)
        return [token for part in parts for token in self._split(part)], len(parts) - 1

    def of_word(self, word: str) -> tuple[list[str], int]:
        """Pre-tokens of a space and a word without white space, and how many special literals it holds."""
        if _WRITTEN_OUT.fullmatch(word) and not (self.literals and self.literals.search(word)):
            return _PRETOKEN.findall(" " + word), 0
        return self.of(" " + word)

    def pieces(self, tokens: list[bytes]) -> np.ndarray:
        """Number of pieces of each pre-token."""
        written = [t.decode("latin-1").translate(self.symbols) for t in tokens]
        encoded = self.model.encode_batch_fast(written, add_special_tokens=False)
        return np.fromiter(map(len, encoded), np.int32, len(tokens))


def _pre_tokens(path: str) -> PreTokens:
    return opened(("token_counts", path), lambda: PreTokens(path))


class _Units(dict):
    """Numbers of a block's units; each distinct one is cut into pre-tokens when it is first met.

    A unit is a text between two spaces where a pre-token surely begins, with the space before it.
    """

    def __init__(self, pre: PreTokens):
        self.pre, self.tokens = pre, Numbers()
        self.flat: list[int] = []
        self.ends = [0]
        self.literals: list[int] = []
        self.open: list[bool] = []

    def __missing__(self, piece: str) -> int:
        # Beside white space (never printable) or another space a pre-token may go on: such units are joined first.
        is_open = not piece or not piece[0].isprintable() or not piece[-1].isprintable()
        self[piece] = number = self._add(([], 0) if is_open else self.pre.of_word(piece), is_open)
        return number

    def _add(self, found: tuple[list[str], int], is_open: bool = False) -> int:
        tokens, literals = found
        self.flat.extend(map(self.tokens.__getitem__, tokens))
        self.ends.append(len(self.flat))
        self.literals.append(literals)
        self.open.append(is_open)
        return len(self.open) - 1

    def numbers(self, text: str) -> np.ndarray:
        """Numbers of the units of one text."""
        pieces = text.split(" ")
        numbers = np.fromiter(map(self.__getitem__, pieces), np.int32, len(pieces))
        is_open = np.fromiter(map(self.open.__getitem__, numbers.tolist()), bool, len(pieces))
        joined = np.flatnonzero(is_open)
        # The first unit has no space before it; an open piece is one unit with both its neighbours.
        link = np.zeros(len(pieces) + 1, bool)
        link[joined] = True
        link[joined + 1] = True
        link[0] = link[-1] = False
        starts = np.flatnonzero(~link[:-1])
        ends = np.append(starts[1:], len(pieces))
        result = numbers[starts]
        for i in np.flatnonzero(ends - starts > 1).tolist():
            lead = " " if starts[i] else ""
            result[i] = self._add(self.pre.of(lead + " ".join(pieces[starts[i] : ends[i]])))
        if ends[0] == 1:
            result[0] = self._add(self.pre.of(pieces[0]))
        return result


def _frequencies(batches: Iterator[pa.RecordBatch], path: str, buckets: int, block_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row per block: its documents, their pre-token frequencies, and the distinct pre-tokens by bucket."""
    pre = _pre_tokens(path)
    task = TaskContext.get().partitionId()
    for at, batch in enumerate(gathered(batches, "text", block_bytes)):
        units = _Units(pre)
        texts = batch.column(1).to_pylist()
        lengths = [len(t.encode()) if t else 0 for t in texts]
        found = [units.numbers(t) if t else np.empty(0, np.int32) for t in texts]
        del texts
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        unit = np.concatenate(found)
        row = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
        ends = np.array(units.ends, np.int32)
        counts = np.diff(ends)[unit]
        place = np.repeat(ends[unit] - (np.cumsum(counts) - counts), counts)
        place += np.arange(len(place))
        token = np.array(units.flat, np.int32)[place]
        del place
        literals = np.bincount(row, np.array(units.literals, np.int64)[unit], len(found)).astype(np.int64)
        # Distinct pre-tokens are numbered bucket by bucket, so counts that come back need no numbers with them.
        names = [token.encode() for token in units.tokens]
        bucket = np.fromiter((zlib.crc32(n) % buckets for n in names), np.int64, len(names))
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(names), np.int64)
        number[order] = np.arange(len(names))
        width = np.int64(max(1, len(names)))
        pair = np.repeat(row, counts) * width
        pair += number[token]
        pair.sort()
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        frequency = np.diff(np.append(first, len(pair)))
        pair = pair[first]
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        groups = np.split(order, cuts) if len(names) else []
        chunks = [{"bucket": int(bucket[g[0]]), "tokens": SEPARATOR.join([names[i] for i in g.tolist()])} for g in groups]
        per_row = np.bincount(pair // width, minlength=len(found))
        index = np.diff(pair % width, prepend=0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([(task << 32) + at], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), batch.column(0)),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.array([literals.tolist()], pa.list_(pa.int64())),
                pa.array([packed(per_row)], pa.binary()),
                pa.array([packed(index)], pa.binary()),
                pa.array([packed(frequency)], pa.binary()),
                pa.array([chunks], pa.list_(pa.struct([("bucket", pa.int32()), ("tokens", pa.binary())]))),
            ],
            names=["block", "ids", "bytes", "literals", "per_row", "index", "frequency", "chunks"],
        )


def _count_pieces(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Pieces of the pre-tokens of each chunk; the rows come bucket by bucket, each distinct pre-token is encoded once."""
    pre = _pre_tokens(path)
    current, known = None, {}
    for batch in batches:
        for i in range(batch.num_rows):
            bucket = batch.column(1)[i].as_py()
            tokens = batch.column(2)[i].as_py().split(SEPARATOR)
            if bucket != current:
                current, known = bucket, {}
            new = [t for t in tokens if t not in known]
            known.update(zip(new, pre.pieces(new).tolist()))
            pieces = np.fromiter(map(known.__getitem__, tokens), "<i4", len(tokens))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([pieces.tobytes()], pa.binary())],
                names=["block", "bucket", "pieces"],
            )


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block's documents: frequencies times pieces, summed per document, and the special literals."""
    for batch in batches:
        for row in range(batch.num_rows):
            cell = {name: batch.column(name)[row] for name in batch.schema.names}
            literals = np.array(cell["literals"].as_py(), np.int64)
            per_row = unpacked(cell["per_row"].as_py())
            pieces = np.frombuffer(b"".join(c["pieces"] for c in cell["counted"].as_py() or []), "<i4")
            steps = unpacked(cell["index"].as_py())
            total = np.zeros(len(literals), np.int64)
            if len(steps):
                weight = pieces[np.cumsum(steps)] * unpacked(cell["frequency"].as_py())
                sums = np.concatenate([[0], np.cumsum(weight)])
                ends = np.cumsum(per_row)
                total = sums[ends] - sums[ends - per_row]
            ids = cell["ids"].values
            yield pa.RecordBatch.from_arrays(
                [ids, cell["bytes"].values, pa.array(total + literals, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )


def token_counts(docs: DataFrame, vocabulary: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_bytes, n_tokens)`` of every row of ``docs``: UTF-8 bytes and tokens of its text."""
    path = vocabulary or default_vocabulary()
    docs = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(BUCKETS, 8 + size // BUCKET_BYTES)
    schema = (
        f"block long, ids array<{kind}>, bytes array<long>, literals array<long>, per_row binary, index binary, "
        "frequency binary, chunks array<struct<bucket: int, tokens: binary>>"
    )
    frequencies = partial(_frequencies, path=path, buckets=buckets, block_bytes=BLOCK_BYTES)
    blocks = materialize(docs.mapInArrow(frequencies, schema), "token-frequencies")
    chunks = blocks.select("block", F.inline("chunks")).repartition("bucket").sortWithinPartitions("bucket")
    counted = chunks.mapInArrow(partial(_count_pieces, path=path), "block long, bucket int, pieces binary")
    back = counted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "pieces"))).alias("counted"))
    joined = blocks.drop("chunks").join(back, "block", "left")
    return joined.mapInArrow(_sums, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id)


def op11_pretoken_counts(spark, sf_dir: str) -> DataFrame:
    """All documents with their bytes and tokens, and whether they exceed the limit."""
    counts = token_counts(documents(spark, sf_dir))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
