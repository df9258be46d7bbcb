"""Near-duplicate documents by circulant MinHash.

Method. A document is its set of five-word shingles (64-bit hashes; fewer words: the whole sequence). Two permutations
give all signature coordinates: the first places a shingle at a position of a circle of ``2**20`` positions, the second
is an array over that circle, read at ``position + k`` for coordinate ``k``. The 672 coordinates form 96 bands of seven,
so that a pair of similarity 0.75 shares no band with probability 1e-6.

Links are confirmed on the full shingle sets, never on signatures. No group is expanded into all of its pairs:

1. documents of equal sets are one class with its smallest id as representative;
2. in each band bucket every representative is tested against the smallest one, and the links give components;
3. the members of buckets that still hold several components are searched exactly, with prefixes of their sets: shingles
   are ordered from rare to frequent, and two sets of the needed similarity share a shingle near the front of both, in
   a place that depends on their sizes only. Documents joined by such shingles, by classes of size, where these hold
   several components, form a family. A family is dealt to blocks of about 1,024 documents; a task counts the common
   shingles of all pairs of two blocks and gives the edges of a spanning forest of their links, never the pairs.

Nulls, empty texts and texts without words have an empty set and are linked with nothing. Repeated rows of one id and
text are one document and come out once per row. An id must not have several texts: components join its texts. Where it
may, the id is to be a struct of id and text hash, as in the pipeline. Extra columns do not matter. An empty table gives an
empty result.

Hash width: two different shingles of a pair collide with probability below ``n**2 / 2**64``; the class fingerprint has
128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from dosewise.llm.common import connected, raw_texts, slices, words
from dosewise.llm.multi_index import forest
from dosewise.llm.pool import opened
from dosewise.session import materialize

WORDS_PER_SHINGLE = 5
BANDS, ROWS = 96, 7
COORDINATES = BANDS * ROWS
POSITIONS = 1 << 20
#: A link needs ``100 * intersection >= PERCENT * union``.
PERCENT = 75
#: Documents of a block, and of a family that shares a block with others.
SIDE, SMALL_FAMILY = 1024, 256
#: Matches of shingles that are counted at a time.
MATCHES = 4_000_000
#: Ratio of the largest to the smallest set of a size class.
CLASS_RATIO = 1.05

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, found), np.uint64, len(found))
    n = max(1, len(found) - WORDS_PER_SHINGLE + 1)
    out = np.full(n, min(len(found), WORDS_PER_SHINGLE), np.uint64)
    for k in range(min(len(found), WORDS_PER_SHINGLE)):
        out = _mixed(out * _MIX + h[k : k + n])
    return np.unique(out)


def _circle() -> np.ndarray:
    """The second permutation, continued past its end by as many positions as there are shifts."""
    return opened("minhash", _permuted)


def _permuted() -> np.ndarray:
    order = np.random.Generator(np.random.PCG64(20_24)).permutation(POSITIONS).astype(np.int32)
    return np.concatenate([order, order[:COORDINATES]])


def signature(hashes: np.ndarray) -> np.ndarray:
    """All coordinates of a non-empty set."""
    circle = np.lib.stride_tricks.sliding_window_view(_circle(), COORDINATES)
    places = (_mixed(hashes ^ _MIX) >> np.uint64(44)).astype(np.int64)
    out = np.full(COORDINATES, POSITIONS, np.int32)
    for start in range(0, len(places), 256):
        np.minimum(out, circle[places[start : start + 256]].min(axis=0), out=out)
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per band; the band number is part of it."""
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = _mixed(out * _MIX + rows[:, k])
    return out


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = [shingle_hashes(t) for t in raw_texts(batch, "text")]
        bands = [band_hashes(signature(s)) if len(s) else np.empty(0, np.uint64) for s in sets]
        prints = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.string()), _lists(bands)],
            names=["doc_id", "n_shingles", "fingerprint", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = [shingle_hashes(t) for t in raw_texts(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(sets)], names=["id", "shingles"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, ends = [], []
        for side in ("x", "y"):
            column = batch.column(side)
            flat.append(column.values.to_numpy().view(np.uint64))
            ends.append(column.offsets.to_numpy())
        linked = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x = flat[0][ends[0][i] : ends[0][i + 1]]
            y = flat[1][ends[1][i] : ends[1][i + 1]]
            if len(x) > len(y):
                x, y = y, x
            if 100 * len(x) < PERCENT * len(y):
                continue
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            linked[i] = 100 * common >= PERCENT * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"]
        )


def _confirmed(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The pairs whose full sets are similar enough, stored."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    kind = pairs.schema["a"].dataType.simpleString()
    tested = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    tested = tested.mapInArrow(_verify, f"a {kind}, b {kind}, linked boolean")
    return materialize(tested.filter("linked").select("a", "b"), name)


def _labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    joined = members.join(components.withColumnRenamed("id", "rep"), "rep", "left")
    return joined.withColumn("component", F.coalesce("component", "rep"))


def _several(labelled: DataFrame) -> DataFrame:
    """The rows whose bucket has several components."""
    spread = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return labelled.join(spread.filter("low < high").select("bucket"), "bucket")


def _prefix_groups(left: DataFrame, sets: DataFrame) -> DataFrame:
    """``(bucket, rep, n)``: groups of documents that share a shingle near the front of their sets.

    With sizes ``x >= y`` a similarity of PERCENT needs an overlap of ``PERCENT * (x + y) / (100 + PERCENT)``, so from the
    first common shingle on both sets must be that long. A document enters the group of (shingle, size class) for its own
    class and for each class of smaller sets for which this holds at the shingle's place.
    """
    share = PERCENT / (100 + PERCENT)
    chosen = sets.join(left.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    chosen = materialize(chosen.distinct(), "minhash-left")
    each = chosen.selectExpr("id", "explode(shingles) as shingle")
    counts = each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    common = each.join(counts, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("common"))
    size_class = f"cast(floor(ln({{}}) / ln({CLASS_RATIO}D)) as int)"
    own, least = size_class.format("size"), size_class.format(f"greatest(1, ceil(size * {PERCENT} / 100D))")
    placed = chosen.join(common, "id").selectExpr("id", "size(shingles) as size", "common")
    # Shingles of one document only come first and are in no group, but count as places.
    placed = placed.selectExpr("id", "size", "posexplode(common) as (at, c)", "size - size(common) as alone")
    placed = placed.selectExpr("id as rep", "size", "alone + at as at", "c.shingle as shingle")
    placed = placed.filter(f"size - at >= ceil({share!r}D * (size + ceil(size * {PERCENT} / 100D)) - 1e-6)")
    rows = placed.selectExpr("*", f"explode(sequence({least}, {own})) as class")
    smallest = f"greatest(ceil(size * {PERCENT} / 100D), floor(pow({CLASS_RATIO}D, class)))"
    rows = rows.filter(f"size - at >= ceil({share!r}D * (size + least(size, {smallest})) - 1e-6)")
    rows = rows.selectExpr("xxhash64(shingle, class) as bucket", "rep")
    counted = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(counted, "bucket")


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of all pairs of sets of two sides, by matching equal elements."""
    out = np.zeros(len(x) * len(y), np.int64)
    flat = np.concatenate([*y, np.empty(0, np.int64)])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(y)), [len(s) for s in y])[order]
    sizes = np.array([len(s) for s in x])
    each = np.concatenate([*x, np.empty(0, np.int64)])
    row = np.repeat(np.arange(len(x)), sizes)
    low, high = np.searchsorted(flat, each, "left"), np.searchsorted(flat, each, "right")
    keep = high > low
    row, low, n = row[keep], low[keep], (high - low)[keep]
    ends = np.cumsum(n)
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MATCHES, "right")))
        part = n[start:stop]
        at = np.repeat(low[start:stop] - (np.cumsum(part) - part), part) + np.arange(part.sum())
        out += np.bincount(np.repeat(row[start:stop], part) * len(y) + owner[at], minlength=len(out))
        start = stop
    return out.reshape(len(x), len(y))


def _forest(left: pa.Table, right: pa.Table) -> pa.Table:
    """Edges ``(a, b)`` of a spanning forest of the links between two blocks."""
    schema = pa.schema([("a", left.schema.field("rep").type), ("b", left.schema.field("rep").type)])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    ids, sets = [], []
    for table in (left, right):
        ids.append(table.column("rep").to_pylist())
        column = table.column("shingles").combine_chunks()
        flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
        sets.append([flat[i:j] for i, j in zip(ends[:-1], ends[1:])])
    common = common_counts(*sets)
    x, y = (np.array([len(s) for s in side]) for side in sets)
    linked = 100 * common >= PERCENT * (x[:, None] + y[None, :] - common)
    edges = [(ids[0][i], ids[1][j]) for i, j in forest(linked, np.arange(len(x)), np.arange(len(y)))]
    edges = [e for e in edges if e[0] != e[1]]
    return pa.Table.from_pydict({"a": [e[0] for e in edges], "b": [e[1] for e in edges]}, schema=schema)


def _block_links(groups: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """Links within the families that groups of documents form, stored."""
    least = groups.groupBy("bucket").agg(F.min("rep").alias("a"))
    families = connected(groups.join(least, "bucket").select("a", F.col("rep").alias("b")), "minhash-families")
    sizes = families.groupBy("component").agg(F.count("*").alias("n"))
    bins = max(1, families.count() // SIDE)
    # Small families share blocks: comparing more pairs than needed finds links only where there are any.
    dealt = families.join(sizes, "component").selectExpr(
        "id as rep",
        f"if(n <= {SMALL_FAMILY}, pmod(xxhash64(component), {bins}), 0) as bin",
        f"if(n <= {SMALL_FAMILY}, null, component) as family",
        f"if(n <= {SMALL_FAMILY}, 0L, (n - 1) div {SIDE}) as last",
    )
    dealt = dealt.withColumn("own", F.expr("pmod(xxhash64(rep), last + 1)"))
    dealt = dealt.join(sets.distinct().withColumnRenamed("id", "rep"), "rep")
    keys = ["bin", "family", "i", "j"]
    left = dealt.selectExpr("bin", "family", "own as i", "explode(sequence(own, last)) as j", "rep", "shingles")
    right = dealt.selectExpr("bin", "family", "explode(sequence(0L, own)) as i", "own as j", "rep", "shingles")
    right = right.toDF(*left.columns)  # columns of its own, as both sides come from one table
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_forest, f"a {kind}, b {kind}")
    return materialize(found, "minhash-links-1")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, fingerprint, rep, component_id, kept)``, one row per document row.

    ``rep`` is the smallest id with an equal set, ``component_id`` the smallest id reachable over links, itself
    included; documents with an empty set stand alone.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = docs.mapInArrow(_sketch, f"doc_id {kind}, n_shingles bigint, fingerprint string, bands array<bigint>")
    sketches = materialize(sketched, "minhash-sketches")

    classes = sketches.filter("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "minhash-classes")
    first = sketches.join(classes, "fingerprint").filter("doc_id = rep")
    banded = first.select("rep", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last"), F.count("*").alias("n"))
    shared = materialize(shared.filter("pivot < last"), "minhash-buckets")
    members = banded.join(shared, "bucket").select("bucket", "rep", "pivot", "n")
    members = materialize(members, "minhash-members")

    candidates = members.select("rep").distinct()
    involved = docs.join(candidates.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = materialize(involved.mapInArrow(_sets, f"id {kind}, shingles array<bigint>"), "minhash-sets")

    star = members.filter("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    links = _confirmed(star, sets, "minhash-links-0")
    components = connected(links, "minhash-0")

    # What is left: buckets with several components.
    left = _several(_labelled(members, components))
    groups = materialize(_prefix_groups(left, sets), "minhash-groups")
    groups = materialize(_several(_labelled(groups, components)).select("bucket", "rep"), "minhash-open")
    if not groups.isEmpty():
        links = links.unionAll(_block_links(groups, sets, kind))
        components = connected(links, "minhash-1")

    placed = classes.join(components.withColumnRenamed("id", "rep"), "rep", "left")
    placed = placed.select("fingerprint", "rep", F.coalesce("component", "rep").alias("component_id"))
    out = sketches.drop("bands").join(placed, "fingerprint", "left")
    return out.select(
        "doc_id",
        "n_shingles",
        "fingerprint",
        F.coalesce("rep", "doc_id").alias("rep"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component_id", "doc_id")).alias("kept"),
    )


def op2_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents over the whole table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
