"""Readers: JSON arrays, JSON lines with alternative field names, nested experiment files, metric maps, directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dosewise import schemas as S
from dosewise.functions.text import first_non_empty, strip
from dosewise.sources.split_json import split_documents


#: Bytes up to which a document can be parsed as a variant.
VARIANT_BYTES = 128 << 20


def _is_json(doc: str) -> Column:
    """Whether a text is JSON, of any size: larger ones than a variant may have are only gone through."""
    gone_through = F.json_array_length(doc).isNotNull() | F.json_object_keys(doc).isNotNull()
    return F.try_parse_json(F.col(doc)).isNotNull() | ((F.octet_length(doc) > VARIANT_BYTES) & gone_through)


def _is_blank(doc: str) -> Column:
    return F.col(doc).isNull() | (F.length(strip(F.col(doc))) == 0)


def rejected_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """The documents, or parts of documents, that are neither blank nor JSON, e.g. truncated files."""
    return docs.filter(~_is_blank(doc) & ~_is_json(doc))


def _checked(parsed: DataFrame, failed: Column, errors: str, doc: str = "_doc", out: str = "_parsed") -> DataFrame:
    """The parsed documents. One that is no JSON raises an error, or is left to ``rejected_documents`` ("reject").

    Only a document whose one parse has ``failed`` is looked at again: it may be JSON of another layout.
    """
    if errors not in ("raise", "reject"):
        raise ValueError("errors must be 'raise' or 'reject'")
    broken = failed & ~_is_blank(doc) & ~_is_json(doc)
    if errors == "reject":
        return parsed.filter(~broken)
    message = F.raise_error(F.concat(F.lit("not a JSON document: "), F.substring(doc, 1, 80)))
    return parsed.withColumn(out, F.when(broken, message).otherwise(F.col(out)))


def parse_scenarios(docs: DataFrame, doc: str = "doc", errors: str = "raise") -> DataFrame:
    """Scenario records of JSON documents that each hold an array of them."""
    parsed = docs.select(F.col(doc).alias("_doc"), F.from_json(F.col(doc), f"array<struct<{S.SCENARIO}>>").alias("_parsed"))
    checked = _checked(parsed, F.col("_parsed").isNull(), errors)
    # The outer form of a generator has no inferred filter on its input, which would parse every document twice.
    return checked.select(F.inline_outer("_parsed")).filter(F.col("id").isNotNull())


def read_scenarios(
    spark: SparkSession, path: str, lines: bool = False, errors: str = "raise", split: bool = False
) -> DataFrame:
    """Scenario records of files holding a JSON array, or an array per line, or a large array to be ``split``."""
    return parse_scenarios(read_documents(spark, path, lines, split), errors=errors)


def read_pair_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw pair lines with the text of malformed ones in ``_corrupt``.

    The split comes from a partition folder ``split=...`` or else from the file name ``{split}_pairs``.
    """
    lines = spark.read.text(path)
    if "split" not in lines.columns:
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(\w+?)_pairs", 1)
        lines = lines.withColumn("split", F.nullif(name, F.lit("")))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return (
        lines.filter(F.length(strip(F.col("value"))) > 0)
        .withColumn("_pair", F.from_json("value", f"{S.PAIR}, _corrupt string", options))
        .select("_pair.*", "split")
    )


def normalise_pairs(
    lines: DataFrame,
    positive: Sequence[str] = S.POSITIVE_FIELDS,
    negative: Sequence[str] = S.NEGATIVE_FIELDS,
) -> DataFrame:
    """Pairs with the first non-empty alternative of each text field, stripped; pairs with a blank side are dropped."""
    return (
        lines.withColumn("positive_text", first_non_empty(*[F.col(c) for c in positive]))
        .withColumn("negative_text", first_non_empty(*[F.col(c) for c in negative]))
        .withColumn("generated_at", F.try_to_timestamp("generated_at"))
        .drop(*positive, *negative)
        .filter(F.col("positive_text").isNotNull() & F.col("negative_text").isNotNull())
    )


def read_pairs(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Valid pairs of the ``{split}_pairs.jsonl`` files under a folder; blank and malformed lines are skipped."""
    target = path if split is None else f"{path.rstrip('/')}/{split}_pairs.jsonl"
    lines = read_pair_lines(spark, target)
    return normalise_pairs(lines.filter(F.col("_corrupt").isNull()).drop("_corrupt"))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """Malformed lines with the split of their file."""
    return lines.select("split", "_corrupt").filter(F.col("_corrupt").isNotNull())


def read_documents(
    spark: SparkSession, path: str, lines: bool = False, split: bool = False, wrapper: str | None = None
) -> DataFrame:
    """JSON documents as text: one per file, or with ``lines`` one per line.

    With ``split`` a file's array or map comes as many documents of the same layout, with ``file``, ``part`` and the byte
    ``offset`` of each, so that it need not fit one task; see ``split_documents``.
    """
    if split and lines:
        raise ValueError("a file has either a document per line or one document to be split")
    if split:
        return split_documents(spark, path, wrapper)
    texts = spark.read.text(path, wholetext=not lines)
    marked = F.col("value").startswith("\ufeff")  # a byte order mark is no part of the document
    return texts.select(F.when(marked, F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("doc"))


def _all_experiments(run: Column) -> Column:
    """Experiments of one run as ``(layer, scenario, title, conditions)``, whichever layout the file has."""
    condition = S.CONDITION

    def dosed(e: Column) -> Column:
        zero = F.struct(
            F.lit(0.0).alias("alpha"),
            F.lit("baseline").alias("condition_name"),
            F.coalesce(e["baseline_samples"], F.array(e["baseline"])).alias("samples"),
        )
        steered = F.transform(
            e["steered_completions"],
            lambda c: F.struct(
                c["alpha"].alias("alpha"),
                F.lit(None).cast("string").alias("condition_name"),
                F.coalesce(c["samples"], F.array(c["completion"])).alias("samples"),
            ),
        )
        return F.coalesce(e["conditions"], F.concat(F.array(zero), steered).cast(f"array<{condition}>"))

    def entry(e: Column, layer: Column) -> Column:
        return F.struct(
            layer.alias("layer"), e["scenario"].alias("scenario"), e["title"].alias("title"), dosed(e).alias("conditions")
        )

    by_layer = F.flatten(
        F.transform(run["layer_results"], lambda lr: F.transform(lr["experiments"], lambda e: entry(e, lr["layer"])))
    )
    direct = F.transform(run["experiments"], lambda e: entry(e, F.coalesce(e["layer"], run["target_layer"])))
    return F.coalesce(by_layer, direct)


def flatten_runs(runs: DataFrame, model: str = "model_key", run: str = "run") -> DataFrame:
    """One row per generated text from nested run structs, in a single pass over the input."""
    return (
        runs.select(F.col(model).alias("model"), F.explode_outer(_all_experiments(F.col(run))).alias("e"))
        .select("model", "e.layer", "e.scenario", "e.title", F.explode("e.conditions").alias("c"))
        .select(
            "model",
            "layer",
            "scenario",
            "title",
            F.col("c.alpha").alias("alpha"),
            F.posexplode("c.samples").alias("sample", "text"),
        )
    )


def parse_model_map(docs: DataFrame, doc: str = "doc", errors: str = "raise") -> DataFrame:
    """``(model_key, run)`` rows of JSON documents holding a map by model, with or without a top key ``models``."""
    wrapped = F.from_json(F.col(doc), f"models map<string,{S.RUN}>")["models"]
    plain = F.from_json(F.col(doc), f"map<string,{S.RUN}>")
    # The text's beginning mostly tells the layout; only a wrapper behind other keys is found by a second parse.
    begins = F.col(doc).rlike(r'\A\s*\{\s*"models"\s*:')
    parsed = docs.select(F.col(doc).alias("_doc"), F.when(begins, F.coalesce(wrapped, plain)).otherwise(plain).alias("_parsed"))
    hidden = F.map_contains_key("_parsed", F.lit("models"))
    late = F.from_json(F.col("_doc"), f"models map<string,{S.RUN}>")["models"]
    parsed = parsed.select("_doc", F.when(hidden, F.coalesce(late, "_parsed")).otherwise(F.col("_parsed")).alias("_parsed"))
    checked = _checked(parsed, F.col("_parsed").isNull(), errors)
    return checked.select(F.explode_outer("_parsed").alias("model_key", "run")).filter(F.col("model_key").isNotNull())


def parse_single_run(docs: DataFrame, doc: str = "doc", errors: str = "raise") -> DataFrame:
    """``(model_key, run)`` rows of JSON documents that each hold one run."""
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    run = F.from_json(F.col(doc), S.RUN.removesuffix(">") + ",_corrupt:string>", options)
    parsed = docs.select(F.col(doc).alias("_doc"), run.alias("_parsed"))
    checked = _checked(parsed, F.col("_parsed._corrupt").isNotNull(), errors)
    return checked.select(
        F.coalesce("_parsed.model_key", "_parsed.model").alias("model_key"), F.col("_parsed").dropFields("_corrupt").alias("run")
    )


def read_generations(
    spark: SparkSession, path: str, lines: bool = False, errors: str = "raise", split: bool = False
) -> DataFrame:
    """Texts of files that map models to runs; with ``split`` each model's run is a task's work, not each file."""
    return flatten_runs(parse_model_map(read_documents(spark, path, lines, split, "models"), errors=errors))


def read_single_run(spark: SparkSession, path: str, lines: bool = False, errors: str = "raise") -> DataFrame:
    """Texts of files with one run: conditions, layer on the experiment, or baseline plus steered completions."""
    return flatten_runs(parse_single_run(read_documents(spark, path, lines), errors=errors))


def _layer_rows(df: DataFrame, layers: Column) -> DataFrame:
    return df.select("model", F.explode(layers).alias("_key", "m")).select(
        "model", F.col("_key").cast("int").alias("layer"), *[F.col(f"m.{c}").alias(c) for c in METRIC_FIELDS]
    )


METRIC_FIELDS = [f.split(":")[0] for f in S.LAYER_METRICS.split(",")][1:]


def read_validation(spark: SparkSession, path: str, model: str) -> DataFrame:
    """Metric rows of a single-model file, whose map keys are layers as strings."""
    df = spark.read.schema(S.VALIDATION).json(path, multiLine=True).withColumn("model", F.lit(model))
    return _layer_rows(df, F.col("layer_results"))


def parse_model_metrics(docs: DataFrame, doc: str = "doc", errors: str = "raise") -> DataFrame:
    """Metric rows of JSON documents that map models to maps of layers."""
    parsed = docs.select(F.col(doc).alias("_doc"), F.from_json(F.col(doc), S.MODEL_METRICS).alias("_parsed"))
    models = _checked(parsed, F.col("_parsed").isNull(), errors).select(F.explode_outer("_parsed").alias("model", "v"))
    return _layer_rows(models.filter(F.col("model").isNotNull()), F.col("v.layers"))


def read_model_metrics(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    return parse_model_metrics(read_documents(spark, path, split=split))


def merge_metrics(single: DataFrame, multi: DataFrame) -> DataFrame:
    """One table from both layouts; models may have different layers."""
    return single.unionByName(multi)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Rated texts of a correlation result file."""
    nested = spark.read.schema(f"layer_used int, detailed_results array<struct<{S.RATING}>>").json(
        path, multiLine=True
    )
    return nested.select("layer_used", F.inline("detailed_results"))


def read_success_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.SUMMARY_CSV).csv(path, header=True)


def read_directions(spark: SparkSession, path: str) -> DataFrame:
    """Stored directions; groups without one are simply absent and drop out of later inner joins."""
    return spark.read.parquet(path)
