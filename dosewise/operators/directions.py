"""Pooling, class means, contrast directions and projections, grouped by (model, layer)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from dosewise.functions import vectors as V
from dosewise.session import BROADCAST_LIMIT_BYTES, join_vectors

FANOUT = 64


def pool_mean(states: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Mean vector over the positions of each text."""
    return states.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vec)))).alias(vec), F.count("*").alias("n_positions")
    )


def pool_last(states: DataFrame, keys: Sequence[str], vec: str = "vec", pos: str = "pos") -> DataFrame:
    """Vector of the last position of each text."""
    return states.groupBy(*keys).agg(F.max_by(vec, pos).alias(vec), F.max(pos).alias("last_pos"))


def truncate_positions(states: DataFrame, limit: int = 512, pos: str = "pos") -> DataFrame:
    """First ``limit`` positions of each text."""
    return states.filter(F.col(pos) < limit)


def class_means(activations: DataFrame, keys: Sequence[str], vec: str = "vec", fanout: int = FANOUT) -> DataFrame:
    """Mean vector and row count per group, in two levels.

    Every map task contributes one buffer per group; the first level spreads the buffers of a hot group over
    ``fanout`` reducers and the second combines their means with row counts as weights.
    """
    present = activations.filter(F.col(vec).isNotNull())
    salted = present.withColumn("_salt", F.spark_partition_id() % fanout)
    partial = salted.groupBy(*keys, "_salt").agg(
        Summarizer.mean(array_to_vector(F.col(vec))).alias("_mean"), F.count("*").alias("_n")
    )
    return partial.groupBy(*keys).agg(
        vector_to_array(Summarizer.mean(F.col("_mean"), F.col("_n").cast("double"))).alias("mean"),
        F.sum("_n").alias("n"),
    )


def fit_directions(
    activations: DataFrame, keys: Sequence[str], label: str = "label", vec: str = "vec"
) -> DataFrame:
    """Unit vector from the mean of label 0 to the mean of label 1, per group.

    ``direction`` is NULL and ``degenerate`` true when the means coincide or a class is missing.
    """
    means = class_means(activations, [*keys, label], vec)
    sides = means.groupBy(*keys).agg(
        F.max(F.when(F.col(label) == 1, F.col("mean"))).alias("pos_mean"),
        F.max(F.when(F.col(label) == 0, F.col("mean"))).alias("neg_mean"),
        F.coalesce(F.max(F.when(F.col(label) == 1, F.col("n"))), F.lit(0)).alias("n_pos"),
        F.coalesce(F.max(F.when(F.col(label) == 0, F.col("n"))), F.lit(0)).alias("n_neg"),
    )
    return (
        sides.withColumn("_diff", V.subtract(F.col("pos_mean"), F.col("neg_mean")))
        .withColumn("norm", V.norm(F.col("_diff")))
        .withColumn("direction", F.when(F.col("norm") > 0, V.scale(F.col("_diff"), 1 / F.col("norm"))))
        .withColumn("degenerate", F.col("direction").isNull())
        .drop("_diff")
    )


def project(
    activations: DataFrame,
    directions: DataFrame,
    keys: Sequence[str],
    vec: str = "vec",
    digits: int | None = None,
    keep: Sequence[str] = ("text_id", "label"),
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Score of every vector on the direction of its group.

    ``directions`` should be a stored table: it is measured and broadcast, in blocks of at most ``limit`` bytes.
    Groups without a direction are dropped by the inner join; a vector of another dimension raises an error. Only ``keys``, ``keep`` and ``score`` leave the operator.
    """
    usable = directions.filter(F.col("direction").isNotNull()).select(*keys, "direction")
    score: Column = V.same_size(F.col(vec), F.col("direction"), V.dot(F.col(vec), F.col("direction")))
    if digits is not None:
        score = F.round(score, digits)
    slim = activations.select(*dict.fromkeys([*keys, *keep, vec]))
    return join_vectors(slim, usable, keys, limit=limit).select(*keys, *keep, score.alias("score"))


def shift_vectors(
    activations: DataFrame,
    directions: DataFrame,
    keys: Sequence[str],
    alpha: Column,
    vec: str = "vec",
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Vectors moved by ``alpha`` along the direction of their group; directions are broadcast as in ``project``."""
    usable = directions.filter(F.col("direction").isNotNull()).select(*keys, "direction")
    return (
        join_vectors(activations, usable, keys, limit=limit)
        .withColumn("alpha", alpha.cast("double"))
        .withColumn(
            vec, V.same_size(F.col(vec), F.col("direction"), V.shift(F.col(vec), F.col("direction"), F.col("alpha")))
        )
        .drop("direction")
    )


def direction_stats(directions: DataFrame, keys: Sequence[str], vec: str = "direction") -> DataFrame:
    """Dimension, norm, mean and population standard deviation of the components; no shuffle."""
    v = F.col(vec)
    return directions.select(
        *keys,
        F.size(v).alias("dim"),
        V.norm(v).alias("norm"),
        V.mean(v).alias("mean"),
        V.stddev_pop(v).alias("std"),
    )


def top_components(directions: DataFrame, keys: Sequence[str], k: int = 20, vec: str = "direction") -> DataFrame:
    """The ``k`` components of greatest magnitude per direction, one row each; sorted inside the row."""
    return directions.select(*keys, F.inline(V.top_components(F.col(vec), k)))


def dimension_check(activations: DataFrame, keys: Sequence[str], vec: str = "vec") -> DataFrame:
    """Dimension found per group and whether all vectors of the group agree."""
    return (
        activations.select(*keys, F.size(vec).alias("_dim"))
        .groupBy(*keys)
        .agg(
            F.min("_dim").alias("dim"),
            F.count("*").alias("n_vectors"),
            (F.min("_dim") == F.max("_dim")).alias("uniform"),
        )
    )


def missing_directions(wanted: DataFrame, directions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups asked for without a stored (usable) direction."""
    present = directions.filter(F.col("direction").isNotNull()).select(*keys)
    return wanted.select(*keys).distinct().join(present, list(keys), "left_anti")
