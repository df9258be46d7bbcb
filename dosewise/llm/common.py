"""Helpers shared by the operators: tables, Arrow batches in bounded slices, words and connected components."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F

from dosewise.session import materialize

#: Texts are worked on in slices of about this many bytes, whatever the size of the Arrow batch.
SLICE_BYTES = 4 << 20
#: Characters that separate words: space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = b" \t\n\x0b\x0c\r"

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free(name: str, columns: list[str]) -> str:
    """The name, with as many underscores before it as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into row ranges whose texts hold about ``limit`` bytes; a longer text is a range of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pa.compute.binary_length(batch.column(text)).fill_null(0), dtype=np.int64)
        groups = np.cumsum(sizes) // limit
        cuts = np.flatnonzero(np.diff(groups)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(start, end - start)


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in blocks whose texts hold about ``limit`` bytes, however small the batches are."""
    held, size = [], 0
    for part in slices(batches, text, limit):
        more = pa.compute.sum(pa.compute.binary_length(part.column(text))).as_py() or 0
        if held and size + more > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(part)
        size += more
    if held:
        yield pa.concat_batches(held)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2**31 as compressed bytes, byte plane by byte plane."""
    planes = values.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(planes.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def raw_texts(batch: pa.RecordBatch, text: str) -> list[bytes | None]:
    """The texts as UTF-8 bytes, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.schema.field(text).type) else pa.binary()
    return batch.column(text).cast(kind).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lowered."""
    return text.translate(_LOWER).split() if text else []


def connected(links: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """``(id, component)`` of all ids in ``links(a, b)``, component being the smallest id reachable.

    Alternating large-star and small-star steps; each step's table is stored in the shared folder, so lineage stays
    short and nothing is collected but one count and checksum per step.
    """
    edges = links.selectExpr("least(a, b) as lo", "greatest(a, b) as hi").filter("lo < hi").distinct()
    edges = materialize(edges, f"{name}-edges")
    seen = None
    for step in range(rounds):
        # Large star: every larger neighbour of a node is linked with the node's smallest neighbour (or itself).
        both = edges.selectExpr("hi as u", "lo as v").unionAll(edges.selectExpr("lo as u", "hi as v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").selectExpr("m as lo", "v as hi").filter("lo < hi").distinct()
        # Small star: the smaller neighbours of a node, and the node, are linked with the smallest of them.
        down = large.selectExpr("hi as u", "lo as v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").selectExpr("m as lo", "v as hi").unionAll(least.selectExpr("m as lo", "u as hi"))
        edges = materialize(small.filter("lo < hi").distinct(), f"{name}-step{step}")
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.countDistinct("hi")
        ).first()
        if tuple(state) == seen and state[0] == state[2]:
            break
        seen = tuple(state)
    else:
        raise RuntimeError(f"{name}: components did not settle in {rounds} steps")
    own = edges.selectExpr("lo as id", "lo as component").distinct()
    return edges.selectExpr("hi as id", "lo as component").unionAll(own)
