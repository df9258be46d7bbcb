"""Media columns of lossless WebP images.

The texts of a slice are coded at once, and their stored forms read back at once (``webp_lockstep``).
``encode_media`` gives one binary value per row, ``decode_media`` the pixel arrays of such a column. A null
text is an empty payload; payloads are padded with spaces to a multiple of 192 bytes, at least one row. Equal texts have
equal values. Repeated rows come out once per row; an empty table gives an empty result. Damaged data raise an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dosewise.llm import webp
from dosewise.llm.common import raw_texts, slices
from dosewise.llm.webp import WIDTH, encode_many, stream_of
from dosewise.llm.webp_lockstep import decode_streams
from dosewise.session import materialize

MOST_ROWS, ROW_BYTES = 16_383, 3 * WIDTH
#: Bits of the colour cache of images below and from so many pixels: slots in use cost code lengths to write and read.
CACHE_BITS, LARGE, LARGE_CACHE_BITS = 6, 4096, 10
#: Pixels that are coded at once, a larger image alone.
BATCH = 1 << 18


def payload(text: bytes | None) -> bytes:
    """The text padded with spaces to a positive multiple of a row's bytes."""
    text = text or b""
    return text.ljust(max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The images of each payload one after the other; those with few colours have a palette, the others the
    transforms that leave the least information (``webp.transformed``) and a colour cache."""
    out: list[list[bytes]] = [[] for _ in payloads]
    #: Images of a kind (bits of the cache, 0 with a palette), with the places of their files.
    waiting: dict[int, list[tuple[list[bytes], int, np.ndarray]]] = {0: [], CACHE_BITS: [], LARGE_CACHE_BITS: []}
    size = dict.fromkeys(waiting, 0)

    def finish(kind: int) -> None:
        if waiting[kind]:
            owners, places, flat = zip(*waiting[kind])
            for owner, place, data in zip(owners, places, encode_many(list(flat), kind, palette=not kind)):
                owner[place] = data
        waiting[kind], size[kind] = [], 0

    for files, data in zip(out, payloads):
        for start in range(0, len(data), MOST_ROWS * ROW_BYTES):
            c = np.frombuffer(data, np.uint8, min(len(data) - start, MOST_ROWS * ROW_BYTES), start).reshape(-1, 3)
            argb = np.full((len(c), 4), 255, np.uint8)
            argb[:, 2::-1] = c
            pixels = argb.view("<u4").ravel()
            kind = CACHE_BITS if pixels.size < LARGE else LARGE_CACHE_BITS
            few = min(256, pixels.size // 4)
            # Slots of a large cache are never more than colours, and quicker to count.
            if np.count_nonzero(np.bincount(webp._slots(pixels, 12))) <= few and len(np.unique(pixels)) <= few:
                kind = 0
            if size[kind] + pixels.size > BATCH or len(waiting[kind]) == 65_536 >> max(kind, CACHE_BITS):
                finish(kind)
            waiting[kind].append((files, len(files), pixels))
            size[kind] += pixels.size
            files.append(b"")
    for kind in waiting:
        finish(kind)
    return [b"".join(files) for files in out]


def encode_payload(data: bytes) -> bytes:
    return encode_payloads([data])[0]


def images_of(values: list[bytes]) -> list[list[np.ndarray]]:
    """All images of each stored value."""
    streams, counts = [], []
    for view in values:
        known = len(streams)
        while view:
            stream, end = stream_of(view)
            streams.append(stream)
            view = view[end:]
        counts.append(len(streams) - known)
    pixels = iter(decode_streams(streams))
    return [list(islice(pixels, n)) for n in counts]


def images(data: bytes) -> list[np.ndarray]:
    return images_of([data])[0]


def payload_of(pixels: np.ndarray) -> bytes:
    """Red, green and blue bytes of the pixels in order."""
    return np.ascontiguousarray(webp._channels(pixels)[..., 2::-1]).tobytes()


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        texts = raw_texts(batch, "text")
        media = encode_payloads([payload(t) for t in texts])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(media, pa.binary())],
            names=["doc_id", "n_bytes", "media"],
        )


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("width", pa.int32()), ("height", pa.int32()), ("argb", pa.binary())]))
    for batch in slices(batches, "media"):
        rows = [
            [{"width": p.shape[1], "height": p.shape[0], "argb": p.astype(">u4").tobytes()} for p in frames]
            for frames in images_of([m or b"" for m in batch.column("media").to_pylist()])
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "images"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media"):
        rows = []
        values = batch.column("media").to_pylist()
        for media, frames in zip(values, images_of(values)):
            data = b"".join(map(payload_of, frames))
            counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
            share = counts[counts > 0] / len(data)
            feature = (
                f"{len(frames)}x{frames[0].shape[1]}x{sum(len(f) for f in frames)};distinct={len(share)};"
                f"mean={(counts * np.arange(256)).sum() / len(data):.3f};entropy={-(share * np.log2(share)).sum():.3f}"
            )
            tail = zlib.crc32(data[-16:])
            rows.append((len(data), hashlib.sha256(data).hexdigest(), tail, len(media), hashlib.sha256(media).hexdigest(), feature))
        size, sha, tail, media_size, media_sha, feature = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_bytes"),
                pa.array(size, pa.int64()),
                pa.array(sha, pa.string()),
                pa.array(tail, pa.int64()),
                pa.array(media_size, pa.int64()),
                pa.array(media_sha, pa.string()),
                pa.array(feature, pa.string()),
            ],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def encode_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: the texts as lossless images."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_encode, f"doc_id {kind}, n_bytes bigint, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """``(doc_id, images)``: the pixel arrays, four bytes (alpha, red, green, blue) for each pixel, row by row."""
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, images array<struct<width int, height int, argb binary>>"
    return media.select("doc_id", "media").mapInArrow(_decode, schema)


def media_features(media: DataFrame) -> DataFrame:
    """Checksums and features of the decoded pixels of ``(doc_id, n_bytes, media)``."""
    kind = media.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string"
    )
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, schema)


def op1_lossless_webp(spark, sf_dir: str) -> DataFrame:
    """All documents stored as lossless WebP, read back and measured."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return media_features(materialize(encode_media(docs), "media"))
