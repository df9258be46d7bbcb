"""The analysis inputs (activations, texts under a dose, ratings, pairs) as views of the test tables.

The matching SQL views are in ``workload/registry.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ALPHAS = [-20.0, -10.0, -5.0, 0.0, 5.0, 10.0, 20.0]
GROUP = ["model", "layer"]
CELL = ["model", "layer", "scenario", "alpha"]
DIGITS = 9  # scores are rounded to this before they are ranked, in both engines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, scanned as its files are.

    Only if the session asks for it with ``spark.workload.partitions`` (the benchmark does, as its tables are single files
    of one row group) the rows are dealt to that many tasks first.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    wanted = spark.conf.get("spark.workload.partitions", None)
    return rows.repartition(int(wanted)) if wanted else rows


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector once per concept 0..9: model = concept div 5, layer = concept mod 5, label = one against the rest."""
    concepts = table(spark, sf_dir, "embeddings").selectExpr("*", "explode(sequence(0, 9)) as concept")
    return concepts.selectExpr(
        "concat('m', concept div 5) as model",
        "concept % 5 as layer",
        "vec_id as text_id",
        "cast(label = concept as int) as label",
        "if(vec_id % 10 < 7, 'train', 'test') as split",
        "embedding as vec",
    )


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activations(spark, sf_dir).filter(F.col("split") == "train")


def test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activations(spark, sf_dir).filter(F.col("split") == "test")


def token_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive vectors are the positions of one text."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 5").alias("text_id"),
        (F.col("vec_id") % 5).alias("pos"),
        F.col("embedding").alias("vec"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("text_id"), (F.col("label") % 3).alias("true_score")
    )


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per document: model = language, dose from a cycle of seven values."""
    alphas = F.array(*[F.lit(a) for a in ALPHAS])
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("model"),
        (F.col("doc_id") % 2).cast("int").alias("layer"),
        F.concat(F.lit("s"), (F.substring("source", 4, 9).cast("int") % 3).cast("string")).alias("scenario"),
        F.get(alphas, F.expr("cast((doc_id div 2) % 7 as int)")).alias("alpha"),
        F.col("doc_id").alias("sample"),
        "text",
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it as the two sides of a pair."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("negative_text"))
    reply = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positive_text")
    )
    return user.join(reply, ["conv_id", "turn"]).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"),
        F.concat(F.lit("s"), (F.col("conv_id") % 5).cast("string")).alias("scenario_id"),
        F.concat(F.lit("m"), (F.col("turn") % 2).cast("string")).alias("source_model"),
        F.col("turn").cast("int").alias("run_id"),
        "positive_text",
        "negative_text",
    )


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label; the label is the contrast class."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a scenario description."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("id"),
        F.concat(F.lit("Title "), "source").alias("title"),
        F.col("text").alias("description"),
        F.concat(F.lit("Objective of "), "source").alias("objective"),
        F.concat(F.lit("Written in "), "lang").alias("pressure"),
    )
