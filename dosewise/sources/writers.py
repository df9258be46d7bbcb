"""Writers; every one is a plain distributed write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dosewise.schemas import NEGATIVE_FIELDS, POSITIVE_FIELDS


def write_pairs(pairs: DataFrame, path: str) -> None:
    """JSON lines, one folder per split, with the texts under their file field names."""
    (
        pairs.withColumnsRenamed({"positive_text": POSITIVE_FIELDS[0], "negative_text": NEGATIVE_FIELDS[0]})
        .write.mode("overwrite")
        .partitionBy("split")
        .json(path)
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def nested_metrics(metrics: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(model, doc)``: one JSON document per model mapping layer to metrics; a model has few layers."""
    entry = F.struct(F.col("layer").cast("string"), F.struct(*fields))
    nested = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return metrics.groupBy("model").agg(nested.alias("_layers")).select(
        "model",
        F.to_json(
            F.create_map(F.col("model"), F.struct(F.col("model").alias("model"), F.col("_layers").alias("layers")))
        ).alias("doc"),
    )


def write_by_model(table: DataFrame, path: str) -> None:
    """One folder per model; the combined result is the same table read whole."""
    table.write.mode("overwrite").partitionBy("model").parquet(path)


def write_layers(table: DataFrame, path: str) -> None:
    """Intermediate save: replaces the layers present in ``table`` and leaves the others."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(path)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").option("header", True).csv(path)


def write_directions(directions: DataFrame, path: str) -> None:
    """All columns, whatever the keys are, so that the stored table is the fitted one."""
    directions.write.mode("overwrite").parquet(path)


def write_ablated_pairs(pairs: DataFrame, path: str) -> None:
    """JSON lines including the per-row statistics struct."""
    pairs.withColumnsRenamed(
        {"positive_text": POSITIVE_FIELDS[0], "negative_text": NEGATIVE_FIELDS[0]}
    ).write.mode("overwrite").json(path)
