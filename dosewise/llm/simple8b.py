"""Token files in Simple-8b word-aligned coding.

Method. A 64-bit word holds a 4-bit selector and as many ids of one width as fit: 60 x 1, 30 x 2, 20 x 3, 15 x 4, 12 x 5,
10 x 6, 8 x 7, 7 x 8, 6 x 10, 5 x 12, 4 x 15, 3 x 20, 2 x 30 or 1 x 60 bits, or 120 zeros. A value of more than 60 bits is
an escape: its word holds a place in the block's list of raw 64-bit values. Packing is greedy, the largest count first.

File: ``S8B1``, then blocks of at most 65,536 ids, each decoded on its own and without a loop over words, then the
directory: per block the byte offset, words, escapes and ids; per document its id, whether it has one, and its number of
ids; and the sizes of both with the directory's offset in the last 24 bytes. Documents are in ascending order over the
files, and by text where ids repeat.

Files are written to the shared folder under a name of their own for each attempt and then renamed to the name of their
range, so a repeated or speculative task leaves the same file. Documents are dealt by ranges of (id, text hash): one id
may repeat without bound. The manifest has one row per file; a running sum over it gives each file's first position.

A null text is empty; every document has at least the end id. Rows with a null doc_id come first. Repeated rows come out
once per row. Extra columns do not matter. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from dosewise.llm.common import slices
from dosewise.llm.pool import UnitPool, opened
from dosewise.session import materialize, scratch_dir

COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 0
BLOCK = 65_536
MAGIC = b"S8B1"
END_ID = 0
CACHED_BYTES = 150 << 20
#: Units of one text given to the library.
CHUNK = 50_000
#: A space in the vocabulary's tokens (fixed value of its format).
SPACE = "Ġ"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a block of unsigned values, and its escaped values."""
    values = np.asarray(values).astype(np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    large = values >> np.uint64(60) != 0
    escaped = values[large]
    padded = np.concatenate([values, np.zeros(120, np.uint64)])  # the last word may be padded with zeros
    padded[:n][large] = np.arange(len(escaped), dtype=np.uint64)
    limits = np.array([1 << int(w) for w in WIDTHS[1:]], np.uint64)
    narrow = np.searchsorted(limits, padded, side="right").astype(np.uint8) + np.uint8(1)  # first selector that is wide enough
    narrow[:n][large] = 16
    selector = np.full(n, 15, np.uint8)
    for s in range(14, 0, -1):
        fits = np.concatenate([[False], narrow <= s, [False]])
        edges = np.flatnonzero(fits[1:] != fits[:-1])
        first, last = edges[::2], np.minimum(edges[1::2] - COUNTS[s], n - 1)
        keep = last >= first
        if keep.any():
            change = np.zeros(n + 1, np.int8)
            change[first[keep]] = 1
            change[last[keep] + 1] -= 1
            selector[np.cumsum(change[:n], dtype=np.int8).astype(bool)] = s
    selector[large] = ESCAPE
    # The chain of words is walked four words at a time.
    after = np.concatenate([np.minimum(np.arange(n) + COUNTS[selector], n), [n]])
    twice = after[after]
    far = memoryview(twice[twice])
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = far[at]
    where = np.array(starts)
    where = np.stack([where, after[where], twice[where], after[twice[where]]], axis=1).ravel()
    where = where[where < n]
    chosen = selector[where]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen).tolist():
        if s == 1:
            continue
        rows = np.flatnonzero(chosen == s)
        for k in range(COUNTS[s]):
            words[rows] |= padded[where[rows] + k] << np.uint64(k * WIDTHS[s])
    return words, escaped


def unpack(words: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    starts = np.cumsum(COUNTS[selector]) - COUNTS[selector]
    out = np.zeros(n + 120, np.uint64)
    for s in np.unique(selector).tolist():
        rows = np.flatnonzero(selector == s)
        if s == 1:
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            part = words[rows] >> np.uint64(k * WIDTHS[s]) & mask
            out[starts[rows] + k] = escaped[part.astype(np.int64)] if s == ESCAPE else part
    return out[:n]


class Writer:
    """Writes a file of documents block by block."""

    def __init__(self, stream) -> None:
        self.stream, self.at = stream, 0
        self.blocks: list[tuple[int, int, int, int]] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        words, escaped = pack(ids)
        self.blocks.append((self.at, len(words), len(escaped), len(ids)))
        self._put(words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes())

    def add(self, doc_ids: np.ndarray, known: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Documents with the ids of all of them in one array."""
        self.docs.append((doc_ids, known, sizes))
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            ids = np.concatenate(self.rest)
            whole = len(ids) - len(ids) % BLOCK
            for start in range(0, whole, BLOCK):
                self._block(ids[start : start + BLOCK])
            self.rest, self.waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> tuple[int, int]:
        """Numbers of documents and of ids."""
        if self.waiting:
            self._block(np.concatenate(self.rest))
        at = self.at
        doc_ids, known, sizes = (
            np.concatenate([d[k] for d in self.docs]) if self.docs else np.empty(0) for k in range(3)
        )
        self._put(np.array(self.blocks, "<i8").tobytes())
        self._put(doc_ids.astype("<i8").tobytes() + known.astype("u1").tobytes() + sizes.astype("<i8").tobytes())
        self._put(struct.pack("<qqq", at, len(self.blocks), len(sizes)))
        return len(sizes), sum(b[3] for b in self.blocks)


class Reader:
    """Reads a file; ids come block by block, so memory holds one block and the directory."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        at, blocks, docs = struct.unpack("<qqq", self._read(size - 24, 24))
        if self._read(0, 4) != MAGIC:
            raise ValueError("not a token file")
        data = self._read(at, size - 24 - at)
        self.blocks = np.frombuffer(data, "<i8", blocks * 4).reshape(-1, 4)
        self.doc_ids = np.frombuffer(data, "<i8", docs, blocks * 32)
        self.known = np.frombuffer(data, "u1", docs, blocks * 32 + docs * 8).astype(bool)
        self.sizes = np.frombuffer(data, "<i8", docs, blocks * 32 + docs * 9)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, k: int) -> np.ndarray:
        at, words, escapes, n = self.blocks[k].tolist()
        data = np.frombuffer(self._read(at, 8 * (words + escapes)), "<u8")
        return unpack(data[:words], data[words:], n)

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of each document, in order."""
        parts, held, k = [], 0, 0
        for size in self.sizes.tolist():
            while held < size:
                block = self.block(k)
                parts, held, k = [*parts, block], held + len(block), k + 1
            flat = np.concatenate(parts) if len(parts) != 1 else parts[0]
            yield flat[:size]
            parts, held = [flat[size:]], held - size


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class LibraryIds:
    """Ids by the tokenizers library, which encodes each distinct unit of a text once.

    A unit begins at a space before a character that is no white space; the vocabulary's words never reach over that
    place. Texts with white space after a space are given to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pool = UnitPool(self._library, CACHED_BYTES)
        self.is_odd = re.compile(r" [\s\x1c-\x1f\x85]").search
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(tokens.values()) + 1, bool)
        self.opens[[i for t, i in tokens.items() if t.startswith(SPACE)]] = True

    def _library(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units: one without a space before it is marked by a space, all others follow a space.

        The latter are encoded in long texts, in which a unit starts at each id whose token starts with a space.
        """
        sizes = np.zeros(len(units), np.int64)
        spaced = [k for k, u in enumerate(units) if u[0] != " "]
        parts = []
        for start in range(0, len(spaced), CHUNK):
            chosen = spaced[start : start + CHUNK]
            text = "".join([" " + units[k] for k in chosen])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) != len(chosen):
                raise ValueError("units and ids do not agree")
            sizes[chosen] = np.diff(np.append(begins, len(ids)))
            parts.append(ids)
        marked = [k for k, u in enumerate(units) if u[0] == " "]
        for k, e in zip(marked, self.tokenizer.encode_batch_fast([units[k][1:] for k in marked], add_special_tokens=False)):
            sizes[k] = len(e.ids)
            parts.append(np.array(e.ids, np.int32))
        order = np.array(spaced + marked, np.int64)
        made = np.concatenate([[0], np.cumsum(sizes[order])])
        first = np.empty(len(units), np.int64)
        first[order] = made[:-1]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])
        return np.concatenate([*parts, np.empty(0, np.int32)])[flat], ends

    def _units(self, text: str | None) -> list[str]:
        if not text:
            return []
        if text[0] == " " or text[-1] == " " or self.is_odd(text):
            return [" " + text]
        units = text.split(" ")
        units[0] = " " + units[0]
        return units

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.pool.lookup([self._units(t) for t in texts])


def library(path: str) -> LibraryIds:
    return opened(("simple8b", path), lambda: LibraryIds(path))


def _open(folder: str):
    return pa.fs.FileSystem.from_uri(folder)


def _write(batches: Iterator[pa.RecordBatch], folder: str, encode: Callable[[], object]) -> Iterator[pa.RecordBatch]:
    own = encode()
    fs, base = _open(folder)
    part = TaskContext.get().partitionId()
    name, attempt = f"part-{part:06d}.s8b", f"_{uuid.uuid4().hex}.tmp"
    fs.create_dir(base, recursive=True)
    with fs.open_output_stream(f"{base}/{attempt}") as stream:
        writer = Writer(stream)
        for batch in slices(batches, "text"):
            ids, starts = own.encode(batch.column("text").to_pylist())
            closed = np.insert(ids, starts[1:], END_ID)
            column = batch.column("doc_id")
            writer.add(
                column.fill_null(0).to_numpy(), np.asarray(column.is_valid()), np.diff(starts) + 1, closed
            )
        docs, n = writer.close()
    fs.move(f"{base}/{attempt}", f"{base}/{name}")
    yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_docs": [docs], "n_ids": [n]}, schema=_MANIFEST)


_MANIFEST = pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = _open(folder)
    for batch in batches:
        for row in batch.to_pylist():
            with fs.open_input_file(f"{base}/{row['file']}") as source:
                reader = Reader(source)
                sums = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in reader.documents()]
                starts = row["start"] + np.cumsum(reader.sizes) - reader.sizes
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(reader.doc_ids, mask=~reader.known),
                        pa.array(starts, pa.int64()),
                        pa.array(reader.sizes, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, partitions: int | None = None) -> DataFrame:
    """Writes the ids of all texts to ``folder`` and returns the stored manifest ``(part, file, n_docs, n_ids, start)``.

    ``docs`` needs ``doc_id`` (an integer) and ``text``. Each partition becomes a file; without ``partitions`` their
    number is the session's number of shuffle partitions, which Spark may lower.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_tie", F.xxhash64("text"))
    keys = ["doc_id", "_tie"]
    dealt = docs.repartitionByRange(partitions, *keys) if partitions else docs.repartitionByRange(*keys)
    ordered = dealt.sortWithinPartitions("doc_id", "_tie", "text").drop("_tie")
    encode = partial(library, path or default_vocabulary())
    written = ordered.mapInArrow(
        partial(_write, folder=folder, encode=encode), "part int, file string, n_docs bigint, n_ids bigint"
    )
    manifest = materialize(written, "tokens-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files, a task per file."""
    files = manifest.repartitionByRange(max(1, manifest.count()), "part")
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    return files.select("file", "start").mapInArrow(partial(_read, folder=folder), schema)


def op9_simple8b_tokens(spark, sf_dir: str) -> DataFrame:
    """Positions and checksums of all documents' ids, read back from the token files."""
    folder = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder), folder)
