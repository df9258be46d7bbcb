"""Distribution of output formats: shares, diversity, change across doses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from dosewise import lexicons as L
from dosewise.functions import rules
from dosewise.functions.text import detect_format, preview


Terms = Mapping[str, Sequence[str]]


def format_counts(generations: DataFrame, keys: Sequence[str], terms: Terms = L.FORMAT_TERMS) -> DataFrame:
    """Texts per (group, format): at most seven rows per group, input of everything below."""
    return (
        generations.select(*keys, detect_format(F.col("text"), terms).alias("format"))
        .groupBy(*keys, "format")
        .agg(F.count("*").alias("n"))
    )


def format_share(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("percent", 100 * F.col("n") / total)


def format_distinct(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct formats per text."""
    return (
        counts.groupBy(*keys)
        .agg(F.count("*").alias("n_formats"), F.sum("n").alias("n_texts"))
        .withColumn("distinct_share", F.col("n_formats") / F.col("n_texts"))
    )


def format_diversity(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shannon entropy normalised by the number of formats found, Gini-Simpson index and a verdict on the entropy."""
    shares = counts.withColumn("_p", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
    return (
        shares.groupBy(*keys)
        .agg(
            F.count("*").alias("n_formats"),
            (-F.sum(F.col("_p") * F.ln("_p"))).alias("_entropy"),
            (1 - F.sum(F.col("_p") * F.col("_p"))).alias("gini_simpson"),
        )
        .withColumn(
            "entropy", F.when(F.col("n_formats") == 1, 0.0).otherwise(F.col("_entropy") / F.ln("n_formats"))
        )
        .withColumn("verdict", rules.variance_verdict(F.round("entropy", 9)))
        .drop("_entropy")
    )


def most_common_format(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most frequent format per group, ties by name."""
    order = F.struct((-F.col("n")).alias("neg_n"), F.col("format"))
    return (
        counts.groupBy(*keys)
        .agg(F.min(order).alias("_first"))
        .select(*keys, F.col("_first.format").alias("format"), (-F.col("_first.neg_n")).alias("n"))
    )


def format_set_change(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Set of formats per dose, whether it equals the zero-dose set, and whether all doses do."""
    series = Window.partitionBy(*keys)
    sets = counts.groupBy(*keys, "alpha").agg(F.array_sort(F.collect_set("format")).alias("formats"))
    base = F.coalesce(F.max(F.when(F.col("alpha") == 0, F.col("formats"))).over(series), F.array().cast("array<string>"))
    same = F.col("formats") == base
    return sets.select(
        *keys,
        "alpha",
        "formats",
        same.alias("same_as_baseline"),
        F.min(F.when(F.col("alpha") != 0, same).otherwise(F.lit(True))).over(series).alias("all_same"),
    )


def format_examples(
    generations: DataFrame,
    keys: Sequence[str],
    order: str = "sample",
    n: int = 150,
    terms: Terms = L.FORMAT_TERMS,
) -> DataFrame:
    """Preview of the first text of each format."""
    return (
        generations.select(*keys, order, "text", detect_format(F.col("text"), terms).alias("format"))
        .groupBy(*keys, "format")
        .agg(F.min_by(preview(F.col("text"), n), order).alias("example"))
    )
