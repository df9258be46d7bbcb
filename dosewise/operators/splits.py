"""Pairs to labelled rows, reproducible splits, dataset summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dosewise.functions.text import strip


def to_long(
    pairs: DataFrame, keep: Sequence[str], positive: str = "positive_text", negative: str = "negative_text"
) -> DataFrame:
    """Two rows per pair: label 1 with the positive text, label 0 with the negative one."""
    return pairs.select(*keep, F.expr(f"stack(2, 1, `{positive}`, 0, `{negative}`) as (label, text)"))


def drop_blank_pairs(
    pairs: DataFrame, positive: str = "positive_text", negative: str = "negative_text"
) -> DataFrame:
    """Pairs whose both texts are non-empty after stripping."""
    return pairs.filter((F.length(strip(F.col(positive))) > 0) & (F.length(strip(F.col(negative))) > 0))


def shuffle_key(row_id: Column, seed: int) -> Column:
    """Position of a row in the seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")))


#: Counts that one window over the hash order may see.
WINDOW_COUNTS = 65_536


def hash_split(df: DataFrame, row_id: str, fraction: float = 0.7, seed: int = 42, digits: int = 4) -> DataFrame:
    """Adds ``split``: exactly ``floor(fraction * n)`` rows of a seeded shuffle are train, the rest test.

    The shuffle position is a hash, so its cut-off value can be found by counting: first per leading hex digits (at
    most ``16**digits`` counts, whose sum is the number of rows), then, among the rows of the one group that holds the cut-off, per ``digits`` more, until
    that group has at most ``WINDOW_COUNTS`` different keys. The rows themselves are never sorted or moved, and no
    window sees more counts than that. ``row_id`` must be unique; equal ids go to the same side.
    """
    key = shuffle_key(F.col(row_id), seed)
    keyed = df.select(key.alias("_key"))
    running = Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, 0)

    def located(counts: DataFrame, target: int | None) -> tuple[str, int, int] | None:
        """Group that holds the cut-off, its rows, and how many of them are train; a first target comes from the total."""
        wanted = F.floor(F.lit(fraction) * F.sum("_n").over(Window.partitionBy())) if target is None else F.lit(target)
        upto = counts.withColumns({"_upto": F.sum("_n").over(running), "_target": wanted})
        hit = upto.filter(F.col("_upto") > F.col("_target")).orderBy("_head").first()
        return None if hit is None else (hit["_head"], hit["_n"], hit["_target"] - (hit["_upto"] - hit["_n"]))

    head, rows, target, length = "", None, None, 0
    while True:
        length = min(32, length + digits)
        left = keyed.filter(F.col("_key").startswith(head)) if head else keyed
        counts = left.groupBy(F.substring("_key", 1, length).alias("_head")).agg(F.count("*").alias("_n"))
        found = located(counts, target)
        if found is None:  # everything is train
            train = F.lit(True)
            break
        head, rows, target = found
        if length == 32 or target == 0:  # the whole group is test
            train = key < head
            break
        if rows <= WINDOW_COUNTS:
            length = 32 - digits  # the next level counts whole keys
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def first_n_split(df: DataFrame, row_id: str, n: int = 35) -> DataFrame:
    """The first ``n`` rows by id."""
    return df.orderBy(row_id).limit(n)


def dataset_summary(
    pairs: DataFrame, scenario: str = "scenario_id", model: str = "source_model", generated_at: Column | None = None
) -> DataFrame:
    """One record: totals per split, the scenarios, the models, the runs of each model, and when it was made.

    ``runs_per_model`` maps a model to its greatest number of distinct runs in one scenario. The table has a row per
    (model, scenario) before the last step, as a dataset has few of both. ``generated_at`` defaults to the current time.
    """
    runs = pairs.groupBy(model, scenario).agg(
        F.count("*").alias("_n"),
        F.count_if(F.col("split") == "train").alias("_train"),
        F.count_if(F.col("split") == "test").alias("_test"),
        F.count_distinct("run_id").alias("_runs"),
    )
    by_model = runs.groupBy(model).agg(
        F.sum("_n").alias("_n"),
        F.sum("_train").alias("_train"),
        F.sum("_test").alias("_test"),
        F.max("_runs").alias("_runs"),
        F.collect_set(scenario).alias("_scenarios"),
    )
    made = F.current_timestamp() if generated_at is None else generated_at
    return by_model.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_pairs"),
        F.coalesce(F.sum("_train"), F.lit(0)).alias("train_pairs"),
        F.coalesce(F.sum("_test"), F.lit(0)).alias("test_pairs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_scenarios")))).alias("scenarios"),
        F.array_sort(F.collect_set(model)).alias("models_used"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(model, "_runs")))).alias("runs_per_model"),
    ).withColumn("generated_at", made)
