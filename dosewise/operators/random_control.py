"""Random-direction control: many unit vectors scored on the same activations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from dosewise.functions import vectors as V
from dosewise.operators.evaluation import evaluate_scores

BLOCK_BYTES = 64 * 1024 * 1024
CHUNK_SCORES = 4_000_000
#: Vectors of a group for each range of its scores, and sampled vectors for each range when the ranges are cut.
RANGE_ROWS, SAMPLED = 1 << 20, 64


def _uniform(digest: Column, start: int) -> Column:
    """Eight hex digits of a digest as an integer below 2**32."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double")


def random_unit_directions(spark: SparkSession, n: int, dim: int, seed: int = 42, first: int = 0) -> DataFrame:
    """``(trial, direction)``: normal components from hashes of (seed, trial, dim), normalised.

    Every component depends on its own key only, so neither partitioning nor row order matters.
    """

    def component(trial: Column, i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), trial.cast("string"), i.cast("string")))
        u1, u2 = _uniform(digest, 1), _uniform(digest, 9)
        radius = F.sqrt(-2 * F.ln((u1 + 1) / 4294967297.0))
        return radius * F.cos(2 * F.pi() * u2 / 4294967296.0)

    trials = spark.range(first, first + n).withColumnRenamed("id", "trial")
    raw = trials.withColumn(
        "_raw", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: component(F.col("trial"), i))
    )
    return raw.withColumn("_norm", V.norm(F.col("_raw"))).select(
        "trial", V.scale(F.col("_raw"), 1 / F.col("_norm")).alias("direction")
    )


def _project_block(
    vectors: DataFrame, keep: Sequence[str], vec: str, first: int, block: np.ndarray, digits: int | None
) -> DataFrame:
    """Scores of each vector on all directions of a block, by matrix products over slices of the Arrow batches.

    A slice gives at most ``CHUNK_SCORES`` scores, whatever the number of directions. A vector of another dimension
    raises an error.
    """
    chunk_scores = CHUNK_SCORES
    shared = vectors.sparkSession.sparkContext.broadcast(block)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        step = max(1, chunk_scores // matrix.shape[0])
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                sizes = part.column(part.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False)
                if (sizes != matrix.shape[1]).any():
                    wrong = int(np.flatnonzero(sizes != matrix.shape[1])[0])
                    group = {c: part.column(i)[wrong].as_py() for i, c in enumerate(keep)}
                    raise ValueError(f"{group}: vector of {sizes[wrong]} components, directions of {matrix.shape[1]}")
                flat = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
                product = flat.astype(np.float64).reshape(-1, matrix.shape[1]) @ matrix.T
                if digits is not None:
                    product = np.round(product, digits)
                offsets = np.arange(0, product.size + 1, matrix.shape[0], dtype=np.int32)
                scores = pa.ListArray.from_arrays(pa.array(offsets), pa.array(product.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], scores], names=[*keep, "scores"])

    slim = vectors.filter(F.col(vec).isNotNull()).select(*keep, vec)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    scored = slim.mapInArrow(multiply, ", ".join([*fields, "scores array<double>"]))
    return scored.select(*keep, F.posexplode("scores").alias("_i", "score")).select(
        *keep, (F.lit(first).cast("long") + F.col("_i")).alias("trial"), "score"
    )


def project_random(
    activations: DataFrame,
    n: int,
    dim: int | None = None,
    seed: int = 42,
    keep: Sequence[str] = ("model", "layer", "label"),
    vec: str = "vec",
    digits: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(keep..., trial, score)`` for ``n`` random directions of the vectors' dimension.

    Without ``dim`` the dimensions are found in the data, and there is a set of directions for each of them; the groups
    of ``keep`` may differ in dimension. With ``dim`` a vector of another dimension raises an error.

    The directions travel to the workers in blocks of at most ``block_bytes``; more directions mean more blocks, each
    reading the vectors once.
    """
    if dim is None:
        found = activations.filter(F.col(vec).isNotNull()).select(F.size(vec).alias("d")).distinct().orderBy("d").collect()
        parts = [
            project_random(activations.filter(F.size(vec) == r["d"]), n, r["d"], seed, keep, vec, digits, block_bytes)
            for r in found
        ]
        if not parts:
            return project_random(activations.filter(F.col(vec).isNotNull()), n, 1, seed, keep, vec, digits, block_bytes)
        return reduce(DataFrame.unionByName, parts)
    spark = activations.sparkSession
    per_block = max(1, block_bytes // (8 * dim))
    out = None
    for first in range(0, n, per_block):
        count = min(per_block, n - first)
        rows = random_unit_directions(spark, count, dim, seed, first).orderBy("trial").collect()
        block = np.array([r["direction"] for r in rows])
        part = _project_block(activations, keep, vec, first, block, digits)
        out = part if out is None else out.unionByName(part)
    return out


def _packed_steps(ordered: np.ndarray) -> bytes:
    """Whole numbers in order as their differences, byte plane by byte plane."""
    steps = np.diff(ordered, prepend=np.int64(0)).view(np.uint8).reshape(-1, 8)
    return zlib.compress(np.ascontiguousarray(steps.T).tobytes(), 1)


def _packed_scores(scores: np.ndarray, digits: int | None) -> bytes:
    """Distinct scores in order, as whole numbers: of units of the last digit, or else their bit patterns."""
    if digits is not None and 0 <= digits < 128 and (np.abs(scores) < 2.0**52 / 10.0**digits).all():
        units = np.rint(scores * 10.0**digits)
        if (units / 10.0**digits == scores).all():
            return bytes([digits]) + _packed_steps(units.astype(np.int64))
    bits = scores.view(np.int64)
    return bytes([255]) + _packed_steps(np.where(bits < 0, np.int64(-(2**63)) - bits, bits))


def _scores(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(8, -1)
    ordered = np.cumsum(np.ascontiguousarray(planes.T).view(np.int64).ravel())
    if data[0] < 128:
        return ordered / 10.0 ** data[0]
    return np.where(ordered < 0, np.int64(-(2**63)) - ordered, ordered).view(np.float64)


_COUNTS = ("<u1", "<u4", "<i8")


def _packed_counts(pos: np.ndarray, neg: np.ndarray) -> bytes:
    """Counts of both classes in the narrowest of three whole types, or as bits where each score is there once."""
    if (pos + neg == 1).all():
        return bytes([3, len(pos) % 8]) + np.packbits(pos == 1).tobytes()
    both = np.stack([pos, neg])
    kind = 0 if both.max() < 1 << 8 else 1 if both.max() < 1 << 32 else 2
    return bytes([kind]) + both.astype(_COUNTS[kind]).tobytes()


def _counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if data[0] == 3:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=2)).astype(np.int64)
        pos = bits[: len(bits) - (8 - data[1]) % 8]
        return pos, 1 - pos
    pos, neg = np.frombuffer(data, _COUNTS[data[0]], offset=1).astype(np.int64).reshape(2, -1)
    return pos, neg


def _merged(scores: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct scores in order, with the counts of both classes; NaN is one value, the greatest."""
    distinct, place = np.unique(scores, return_inverse=True)
    summed = [np.bincount(place, c, len(distinct)).astype(np.int64) for c in (pos, neg)]
    return distinct, *summed


def _trial_runs(
    activations: DataFrame, keys: Sequence[str], label: str, vec: str, first: int, block: np.ndarray, digits: int | None, cuts: dict
) -> DataFrame:
    """``(keys..., trial, range, scores, classes)``: sorted runs of the scores of a task, packed, for a block of trials."""
    shared = activations.sparkSession.sparkContext.broadcast((block, cuts))
    chunk, keys = CHUNK_SCORES, list(keys)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, splitters = shared.value
        held: dict[tuple, list] = {}
        waiting = 0
        step = max(1, chunk // matrix.shape[0])
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                table = pa.table([*part.columns[:-2], pa.array(np.arange(part.num_rows))], names=[*keys, "_row"])
                sizes = part.column(part.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False)
                if (sizes != matrix.shape[1]).any():
                    wrong = int(np.flatnonzero(sizes != matrix.shape[1])[0])
                    group = {c: part.column(i)[wrong].as_py() for i, c in enumerate(keys)}
                    raise ValueError(f"{group}: vector of {sizes[wrong]} components, directions of {matrix.shape[1]}")
                flat = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
                product = flat.astype(np.float64).reshape(-1, matrix.shape[1]) @ matrix.T
                if digits is not None:
                    product = np.round(product, digits)
                product += 0.0  # a negative zero is the same value
                label_of = part.column(part.num_columns - 2).to_numpy(zero_copy_only=False)
                for row in table.group_by(keys).aggregate([("_row", "list")]).to_pylist():
                    rows = np.array(row["_row_list"])
                    held.setdefault(tuple(row[k] for k in keys), []).append((product[rows], label_of[rows]))
                waiting += product.size
                if waiting >= chunk:
                    yield from flush(held, splitters)
                    held, waiting = {}, 0
        yield from flush(held, splitters)

    def flush(held: dict, splitters: dict) -> Iterator[pa.RecordBatch]:
        for key, blocks in held.items():
            product = np.concatenate([p for p, _ in blocks])
            labels = np.concatenate([b for _, b in blocks])
            out = []
            used = (labels == 0) | (labels == 1)
            is_pos = (labels == 1)[used]
            for i, column in enumerate(product[used].T):
                scores, pos, neg = _merged(column, is_pos, ~is_pos)
                edges = np.searchsorted(scores, splitters.get((*key, first + i), ()), "left")
                for number, (a, b) in enumerate(zip([0, *edges], [*edges, len(scores)])):
                    if a < b or not len(scores):  # a group without labels still has its row
                        out.append((first + i, number, _packed_scores(scores[a:b], digits), _packed_counts(pos[a:b], neg[a:b])))
            columns = [pa.array([v] * len(out), t) for v, t in zip(key, types)]
            rest = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*columns, *rest], names=[*keys, "trial", "range", "scores", "classes"])

    slim = activations.filter(F.col(vec).isNotNull()).select(*keys, label, vec)
    types = [f.type for f in to_arrow_schema(slim.select(*keys).schema)]
    fields = [f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys]
    return slim.mapInArrow(multiply, ", ".join([*fields, "trial long, range int, scores binary, classes binary"]))


def _merge_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.RecordBatch]:
    """Class counts, pairs won and zero-threshold hits of each ``(keys..., trial, range)``, whose runs come one after another."""
    names: list[str] = []
    types: list[pa.DataType] = []
    current, runs = None, []

    def result() -> pa.RecordBatch:
        scores, pos, neg = _merged(*(np.concatenate(x) for x in zip(*runs)))
        below = np.cumsum(neg) - neg
        wins = float((pos * (below + neg / 2)).sum())
        above = (scores > 0) | np.isnan(scores)
        hits = int(pos[above].sum() + neg[~above].sum())
        values = [*current, int(pos.sum()), int(neg.sum()), wins, hits]
        kinds = [*types, pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=[*names, "p", "n", "wins", "hits"])

    for batch in batches:
        names, types = batch.schema.names[: n_keys + 2], batch.schema.types[: n_keys + 2]
        for key, scores, classes in zip(zip(*(batch.column(i).to_pylist() for i in range(n_keys + 2))), *batch.columns[n_keys + 2 :]):
            if key != current:
                if runs:
                    yield result()
                current, runs = key, []
            runs.append((_scores(scores.as_py()), *_counts(classes.as_py())))
            if len(runs) >= 64:  # ties of many runs become one entry
                runs = [_merged(*(np.concatenate(x) for x in zip(*runs)))]
    if runs:
        yield result()


def _range_cuts(activations: DataFrame, keys: Sequence[str], vec: str, first: int, block: np.ndarray, digits: int | None) -> dict:
    """Cut points of the scores per (group, trial) for groups of more than ``RANGE_ROWS`` vectors, from a sample of those.

    They are as many as the group has ranges, whatever the points: any give the same exact result.
    """
    present = activations.filter(F.col(vec).isNotNull())
    large = present.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > RANGE_ROWS).collect()
    cuts = {}
    for group in large:
        ranges = 1 + group["_n"] // RANGE_ROWS
        rows = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(group[k])) for k in keys], F.lit(True))
        some = present.filter(rows & (F.rand(5) < SAMPLED * ranges / group["_n"]))
        scores = _project_block(some, list(keys), vec, first, block, digits)
        points = [i / ranges for i in range(1, ranges)]
        for r in scores.groupBy("trial").agg(F.percentile("score", F.array(*map(F.lit, points))).alias("cuts")).collect():
            cuts[(*(group[k] for k in keys), r["trial"])] = np.unique(r["cuts"])
    return cuts


def trial_metrics(
    activations: DataFrame,
    n: int,
    dim: int | None = None,
    keys: Sequence[str] = ("model", "layer"),
    seed: int = 42,
    label: str = "label",
    vec: str = "vec",
    digits: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(keys..., trial, auroc, accuracy)`` of ``n`` random directions, as ``random_metrics`` of ``project_random`` gives.

    No row is made per vector and trial: each task packs its scores of a group and trial as a sorted run of distinct values
    with the counts of both classes. A range of a group's scores is merged by one reducer; pairs of different ranges follow
    from the ranges' counts. Rows whose label is neither 1 nor 0 count nowhere.
    """
    keys = list(keys)
    if dim is None:
        found = activations.filter(F.col(vec).isNotNull()).select(F.size(vec).alias("d")).distinct().orderBy("d").collect()
        if len(found) != 1:
            parts = [
                trial_metrics(activations.filter(F.size(vec) == r["d"]), n, r["d"], keys, seed, label, vec, digits, block_bytes)
                for r in found
            ]
            empty = activations.limit(0).select(*keys, *[F.lit(0).cast(t).alias(c) for c, t in (("trial", "long"), ("auroc", "double"), ("accuracy", "double"))])
            return reduce(DataFrame.unionByName, parts, empty)
        dim = found[0]["d"]
    runs, per_block = [], max(1, block_bytes // (8 * dim))
    for first in range(0, n, per_block):
        rows = random_unit_directions(activations.sparkSession, min(per_block, n - first), dim, seed, first).orderBy("trial").collect()
        block = np.array([r["direction"] for r in rows])
        cuts = _range_cuts(activations, keys, vec, first, block, digits)
        runs.append(_trial_runs(activations, keys, label, vec, first, block, digits, cuts))
    places = [*keys, "trial", "range"]
    dealt = reduce(DataFrame.unionByName, runs).repartition(*places).sortWithinPartitions(*places)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[: len(places)])
    n_keys = len(keys)
    merged = dealt.mapInArrow(lambda batches: _merge_runs(batches, n_keys), f"{fields}, p long, n long, wins double, hits long")
    by = ", ".join(f"`{k}`" for k in [*keys, "trial"])
    below = f"coalesce(sum(n) over (partition by {by} order by `range` rows between unbounded preceding and 1 preceding), 0)"
    return (
        merged.selectExpr(*keys, "trial", "p", "n", "hits", f"wins + cast(p as double) * {below} as wins")
        .groupBy(*keys, "trial")
        .agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("wins").alias("wins"))
        .selectExpr(
            *keys,
            "trial",
            "if(p = 0 or n = 0, 0.5D, try_divide(wins, cast(p as double) * n)) as auroc",
            "try_divide(hits, cast(p + n as double)) as accuracy",
        )
    )


def random_metrics(scores: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """AUROC and zero-threshold accuracy of every trial."""
    return evaluate_scores(scores, [*keys, "trial"], label, "score").select(
        *keys, "trial", "auroc", F.col("accuracy_zero").alias("accuracy")
    )


def random_summary(trials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distribution of the trial AUROCs per group: at most one value per trial, so the list stays short."""
    a = F.col("auroc")
    return trials.groupBy(*keys).agg(
        F.count("*").alias("num_trials"),
        F.avg(a).alias("mean_auroc"),
        F.percentile(a, F.lit(0.5)).alias("median_auroc"),
        F.stddev_pop(a).alias("std_auroc"),
        F.min(a).alias("min_auroc"),
        F.max(a).alias("max_auroc"),
        F.percentile(a, F.lit(0.95)).alias("p95_auroc"),
        F.avg("accuracy").alias("mean_accuracy"),
        F.array_sort(F.collect_list(a)).alias("all_aurocs"),
    )


def compare_with_random(metrics: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """z-score, differences and significance of a fitted direction against the random ones."""
    auroc = F.col("auroc")
    return (
        metrics.select(*keys, "auroc")
        .join(summary, list(keys))
        .select(
            *keys,
            "auroc",
            "mean_auroc",
            "std_auroc",
            "p95_auroc",
            ((auroc - F.col("mean_auroc")) / (F.col("std_auroc") + 1e-10)).alias("z_score"),
            (auroc - F.col("mean_auroc")).alias("difference_from_mean"),
            (auroc - F.col("median_auroc")).alias("difference_from_median"),
            (auroc - F.col("p95_auroc")).alias("difference_from_p95"),
            (auroc > F.col("p95_auroc")).alias("significant_at_95"),
        )
    )
