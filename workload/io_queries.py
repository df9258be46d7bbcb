"""Queries through files and JSON documents: every reader meets the output of a writer or of ``to_json``.

Files go to the session's shared scratch folder. Nested documents are built per row, so nothing is collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dosewise.functions import text as T
from dosewise.operators import ablation as B, conditions as C, directions as D, splits as S
from dosewise.plans import analyses as A
from dosewise.session import scratch_dir
from dosewise.sources import readers as R, writers as W
from workload import views as v
from workload.dose_queries import RATES, analysis
from workload.registry import SCORE_VIEWS, query, r, rounded, sql_strip, with_views
from workload.text_queries import PAIRS_ABLATED, SPLIT, SYNONYMS, TOTAL, N
from workload.vector_queries import stored_directions


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/io/{name}-{uuid.uuid4().hex}"


# --- nested experiment documents ---


def run_struct() -> Column:
    condition = F.struct("alpha", F.array("text", "scenario").alias("samples"))
    experiment = F.struct("scenario", F.lit("t").alias("title"), F.array(condition).alias("conditions"))
    return F.struct(
        F.col("model"),
        F.array(F.struct("layer", F.array(experiment).alias("experiments"))).alias("layer_results"),
    )


def run_documents(spark, sf_dir, wrapped: bool, change=lambda doc: doc) -> DataFrame:
    """One document per text: model -> run -> layer -> experiment -> condition -> two samples."""
    by_model = F.create_map(F.col("model"), run_struct())
    doc = F.to_json(by_model)
    if wrapped:
        doc = F.when(F.col("sample") % 2 == 0, F.to_json(F.struct(by_model.alias("models")))).otherwise(doc)
    return v.generations(spark, sf_dir).select(change(doc).alias("doc"))


FLAT_SQL = with_views("gen") + """
    SELECT model, layer, scenario, alpha, 0 AS sample, md5(text) AS text_md5 FROM gen
    UNION ALL SELECT model, layer, scenario, alpha, 1, md5(scenario) FROM gen"""


def flat(texts: DataFrame) -> DataFrame:
    return texts.select(*v.CELL, "sample", F.md5("text").alias("text_md5"))


@query(FLAT_SQL)
def nested_json_roundtrip(spark, sf_dir):
    return flat(R.flatten_runs(R.parse_model_map(run_documents(spark, sf_dir, wrapped=False))))


@query(FLAT_SQL)
def wrapped_json_variants(spark, sf_dir):
    return flat(R.flatten_runs(R.parse_model_map(run_documents(spark, sf_dir, wrapped=True))))


@query(FLAT_SQL)
def layer_on_experiment(spark, sf_dir):
    condition = F.struct("alpha", F.array("text", "scenario").alias("samples"))
    experiment = F.struct("layer", "scenario", F.array(condition).alias("conditions"))
    docs = v.generations(spark, sf_dir).select(
        F.to_json(F.struct("model", F.array(experiment).alias("experiments"))).alias("doc")
    )
    return flat(R.flatten_runs(R.parse_single_run(docs)))


@query(
    with_views("gen")
    + """
    SELECT model, layer, scenario, 0.0::DOUBLE AS alpha, 0 AS sample, md5(text) AS text_md5 FROM gen
    UNION ALL
    SELECT model, layer, scenario, alpha + 0.5, 0, md5(scenario) FROM gen
    UNION ALL
    SELECT model, layer, scenario, alpha + 0.5, 1, md5(model) FROM gen WHERE sample % 2 = 0"""
)
def baseline_and_steered(spark, sf_dir):
    """Even rows use the form with several samples, odd rows the older one with a single completion."""
    many = F.col("sample") % 2 == 0
    steered = F.struct(
        (F.col("alpha") + 0.5).alias("alpha"),
        F.when(~many, F.col("scenario")).alias("completion"),
        F.when(many, F.array("scenario", "model")).alias("samples"),
    )
    experiment = F.struct(
        "scenario",
        F.when(~many, F.col("text")).alias("baseline"),
        F.when(many, F.array("text")).alias("baseline_samples"),
        F.array(steered).alias("steered_completions"),
    )
    docs = v.generations(spark, sf_dir).select(
        F.to_json(
            F.struct("model", F.col("layer").alias("target_layer"), F.array(experiment).alias("experiments"))
        ).alias("doc")
    )
    return flat(R.flatten_runs(R.parse_single_run(docs)))


@query(
    """SELECT 's' || doc_id AS id, md5(text) AS description_md5, 'low ' || lang AS rubric_low FROM documents"""
)
def scenario_documents(spark, sf_dir):
    record = F.struct(
        "id",
        "title",
        "description",
        "objective",
        F.col("pressure").alias("empathy_pressure"),
        F.create_map(F.lit("0"), F.concat(F.lit("low "), F.substring("pressure", 12, 9))).alias("rubric"),
    )
    docs = v.scenarios(spark, sf_dir).select(F.to_json(F.array(record)).alias("doc"))
    return R.parse_scenarios(docs).select(
        "id", F.md5("description").alias("description_md5"), F.col("rubric")["0"].alias("rubric_low")
    )


# --- metric maps ---

METRICS_SQL = (
    with_views("gen")
    + """, m AS (SELECT model, layer, avg((length(text) > 300)::INT) AS auroc, avg(length(text)) AS accuracy
                 FROM gen GROUP BY ALL)"""
)


def layer_metrics(spark, sf_dir) -> DataFrame:
    return v.generations(spark, sf_dir).groupBy("model", "layer").agg(
        F.avg((F.length("text") > 300).cast("int")).alias("auroc"), F.avg(F.length("text")).alias("accuracy")
    )


@query(METRICS_SQL + f" SELECT model, layer, {r('auroc')} AS auroc, {r('accuracy')} AS accuracy FROM m")
def metrics_map_explode(spark, sf_dir):
    docs = W.nested_metrics(layer_metrics(spark, sf_dir), ["auroc", "accuracy"])
    return rounded(R.parse_model_metrics(docs).select("model", "layer", "auroc", "accuracy"))


@query(
    METRICS_SQL
    + f""" SELECT model, layer, {r('auroc')} AS auroc FROM m
           UNION ALL SELECT 'single', layer, {r('max(auroc)')} FROM m GROUP BY layer"""
)
def merged_metrics(spark, sf_dir):
    """Single-model file merged with the multi-model map."""
    metrics = layer_metrics(spark, sf_dir)
    path = fresh_path(spark, "validation")
    entry = F.struct(F.col("layer").cast("string"), F.struct(F.col("layer"), F.col("auroc")))
    top = metrics.groupBy("layer").agg(F.max("auroc").alias("auroc"))
    top.agg(F.map_from_entries(F.collect_list(entry)).alias("layer_results")).write.json(path)  # one entry per layer
    single = R.read_validation(spark, path, "single")
    multi = R.parse_model_metrics(W.nested_metrics(metrics, ["auroc", "accuracy"]))
    return rounded(R.merge_metrics(single, multi).select("model", "layer", "auroc"))


# --- pair lines ---


@query(
    with_views("pairs")
    + SPLIT
    + f""" SELECT scenario_id, run_id, split, md5({sql_strip('positive_text')}) AS positive_md5,
                  md5({sql_strip('negative_text')}) AS negative_md5 FROM numbered
           WHERE {sql_strip('positive_text')} <> '' AND {sql_strip('negative_text')} <> ''"""
)
def jsonl_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "pairs")
    W.write_pairs(S.hash_split(v.pairs(spark, sf_dir), "pair_id"), path)
    return R.read_pairs(spark, path).select(
        "scenario_id",
        "run_id",
        "split",
        F.md5("positive_text").alias("positive_md5"),
        F.md5("negative_text").alias("negative_md5"),
    )


@query(
    with_views("pairs")
    + """ SELECT count(*) AS total_pairs, floor(0.7 * count(*))::BIGINT AS train_pairs,
                 count(*) - floor(0.7 * count(*))::BIGINT AS test_pairs FROM pairs"""
)
def make_split(spark, sf_dir):
    summary = A.make_split(v.pairs(spark, sf_dir), fresh_path(spark, "split"))
    return summary.select("total_pairs", "train_pairs", "test_pairs")


@query(
    with_views("pairs")
    + f""" SELECT pair_id AS scenario_id, md5({sql_strip('positive_text')}) AS positive_md5 FROM pairs
           WHERE {sql_strip('positive_text')} <> '' AND {sql_strip('negative_text')} <> ''"""
)
def field_fallback(spark, sf_dir):
    """Positive text under one of three names by row, with blank earlier names."""
    way = F.col("run_id") % 3
    blank = F.lit(" ")
    named = v.pairs(spark, sf_dir).select(
        F.col("pair_id").alias("scenario_id"),
        F.when(way == 0, F.col("positive_text")).otherwise(blank).alias("empathic_text"),
        F.when(way == 1, F.col("positive_text")).otherwise(blank).alias("empathetic"),
        F.when(way == 2, F.col("positive_text")).otherwise(blank).alias("empathic"),
        F.col("negative_text").alias("non_empathic_text"),
    )
    path = fresh_path(spark, "aliases")
    named.write.json(path)
    return R.read_pairs(spark, path).select("scenario_id", F.md5("positive_text").alias("positive_md5"))


@query(
    with_views("pairs")
    + """ SELECT count(*) FILTER (run_id % 4 = 0) AS rejected, count(*) FILTER (run_id % 4 <> 0) AS accepted
          FROM pairs"""
)
def malformed_lines(spark, sf_dir):
    record = F.to_json(
        F.struct(F.col("positive_text").alias("empathic_text"), F.col("negative_text").alias("non_empathic_text"))
    )
    broken = F.when(F.col("run_id") % 4 == 0, F.concat(F.lit("{\"empathic_text\": "), F.lit("\"cut"))).otherwise(record)
    path = fresh_path(spark, "lines")
    v.pairs(spark, sf_dir).select(broken.alias("value")).write.text(path)
    return R.read_pair_lines(spark, path).agg(
        F.count_if(F.col("_corrupt").isNotNull()).alias("rejected"),
        F.count_if(F.col("_corrupt").isNull()).alias("accepted"),
    )


@query(
    PAIRS_ABLATED
    + f""" SELECT md5(t) AS positive_md5, ({TOTAL})::BIGINT AS total_replacements FROM step{N}"""
)
def ablated_json(spark, sf_dir):
    path = fresh_path(spark, "ablated")
    W.write_ablated_pairs(B.ablate_pairs(v.pairs(spark, sf_dir), SYNONYMS, with_log=True), path)
    stats = "struct<total_replacements:bigint,unique_keywords:int,keyword_counts:map<string,int>>"
    back = spark.read.schema(f"empathic_text string, ablation_stats {stats}").json(path)
    return back.select(
        F.md5("empathic_text").alias("positive_md5"), F.col("ablation_stats.total_replacements")
    )


# --- result tables ---


@query(
    RATES
    + f""" SELECT model, layer, scenario, {r('success_rate')} AS steering_success_rate,
                  {r('baseline_rate')} AS baseline_empathy_rate, num_alphas::INT AS num_alphas FROM summary"""
)
def csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "summary")
    summary = analysis(spark, sf_dir)["summary"].select(
        "model",
        "layer",
        "scenario",
        F.col("success_rate").alias("steering_success_rate"),
        F.col("baseline_rate").alias("baseline_empathy_rate"),
        "num_alphas",
    )
    W.write_summary_csv(summary, path)
    return rounded(R.read_success_csv(spark, path))


@query(
    RATES
    + f""" SELECT model, layer, scenario, alpha, {r('positive_rate')} AS positive_rate, num_samples FROM rates"""
)
def by_model_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "rates")
    W.write_by_model(analysis(spark, sf_dir)["rates"], path)
    return rounded(spark.read.parquet(path).select(*v.CELL, "positive_rate", "num_samples"))


@query(
    RATES
    + """ SELECT layer, count(*) AS cells, sum(num_samples)::BIGINT AS texts FROM rates GROUP BY layer"""
)
def layer_save(spark, sf_dir):
    """Layers are saved one after the other; saving layer 1 again leaves layer 0 in place."""
    path = fresh_path(spark, "layers")
    rates = analysis(spark, sf_dir)["rates"]
    for layer in (0, 1, 1):
        W.write_layers(rates.filter(F.col("layer") == layer), path)
    return spark.read.parquet(path).groupBy("layer").agg(
        F.count("*").alias("cells"), F.sum("num_samples").alias("texts")
    )


@query(
    RATES + f" SELECT model, layer, scenario, alpha, {r('coherent_rate')} AS coherent_rate FROM rates"
)
def metrics_json(spark, sf_dir):
    path = fresh_path(spark, "metrics")
    W.write_metrics(analysis(spark, sf_dir)["rates"], path)
    schema = "model string, layer int, scenario string, alpha double, coherent_rate double"
    return rounded(spark.read.schema(schema).json(path))


@query(
    with_views(*SCORE_VIEWS)
    + f" SELECT model, layer, count(*) AS n, {r('avg(score)')} AS mean_score FROM scores GROUP BY ALL"
)
def directions_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "directions")
    W.write_directions(stored_directions(spark, sf_dir), path)
    scores = D.project(v.test(spark, sf_dir), R.read_directions(spark, path), v.GROUP, digits=v.DIGITS)
    return rounded(scores.groupBy(*v.GROUP).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")))


def broken(doc):
    """Every tenth document cut in the middle."""
    return F.when(F.col("sample") % 10 == 3, F.substring(doc, 1, 20)).otherwise(doc)


@query(
    with_views("gen")
    + """ SELECT count(*) FILTER (sample % 10 <> 3) AS accepted, count(*) FILTER (sample % 10 = 3) AS rejected,
          2 * count(*) FILTER (sample % 10 <> 3) AS texts FROM gen"""
)
def malformed_documents(spark, sf_dir):
    """Truncated run documents in files: none gets lost, each is accepted or rejected."""
    path = fresh_path(spark, "truncated")
    run_documents(spark, sf_dir, wrapped=True, change=broken).write.text(path)
    docs = R.read_documents(spark, path, lines=True)
    runs = R.parse_model_map(docs, errors="reject")
    return runs.agg(F.count("*").alias("accepted")).crossJoin(  # three tables of one row
        R.rejected_documents(docs).agg(F.count("*").alias("rejected"))
    ).crossJoin(R.flatten_runs(runs).agg(F.count("*").alias("texts")))


@query(FLAT_SQL)
def generation_files(spark, sf_dir):
    """Run documents, one per line, through files."""
    path = fresh_path(spark, "runs")
    run_documents(spark, sf_dir, wrapped=True).write.text(path)
    return flat(R.read_generations(spark, path, lines=True))


def document_files(items: DataFrame, opens: str, closes: str, path: str) -> None:
    """Files of one document each, with the ``item`` of up to 500 rows: a number of files that grows with the table."""
    in_file = Window.partitionBy("file_no").orderBy("sample")
    value = F.concat(
        F.when(F.row_number().over(in_file) == 1, opens).otherwise(","),
        "item",
        F.when(F.lead("item").over(in_file).isNull(), closes).otherwise(""),
    )
    rows = items.withColumn("file_no", F.expr("sample div 500")).select("file_no", "sample", value.alias("value"))
    rows.repartition("file_no").sortWithinPartitions("file_no", "sample").drop("sample").write.partitionBy("file_no").text(path)


@query(
    with_views("gen")
    + """ SELECT model || sample AS model, layer, scenario, alpha, 0 AS sample, md5(text) AS text_md5 FROM gen
    UNION ALL SELECT model || sample, layer, scenario, alpha, 1, md5(scenario) FROM gen"""
)
def split_generation_files(spark, sf_dir):
    """Wrapped run documents of many models, each file dealt to tasks by its models."""
    path = fresh_path(spark, "large-runs")
    runs = v.generations(spark, sf_dir).withColumn("model", F.concat("model", F.col("sample").cast("string")))
    document = F.to_json(F.create_map("model", run_struct()))
    items = runs.select("sample", F.substring(document, F.lit(2), F.length(document) - 2).alias("item"))
    document_files(items, '{"models": {', "}, \"note\": {}}", path)
    return flat(R.read_generations(spark, path, split=True))


@query(
    """SELECT 's' || doc_id AS id, md5(text) AS description_md5, doc_id // 500 AS file_no, doc_id % 100 = 7 AS is_cut
       FROM documents WHERE doc_id % 100 <> 7
       UNION ALL SELECT NULL, NULL, doc_id // 500, true FROM documents WHERE doc_id % 100 = 7"""
)
def split_scenario_files(spark, sf_dir):
    """Large scenario arrays with elements that are no JSON: the others are read, those are reported with their file."""
    path = fresh_path(spark, "large-scenarios")
    rows = v.scenarios(spark, sf_dir).withColumn("sample", F.substring("id", 2, 20).cast("bigint"))
    item = F.to_json(F.struct("id", "title", "description", "objective"))
    cut = F.when(F.col("sample") % 100 == 7, F.lit('{"id": "cut", "title": }')).otherwise(item)
    document_files(rows.select("sample", cut.alias("item")), "[", "]", path)
    parts = R.read_documents(spark, path, split=True).withColumn("file_no", F.regexp_extract("file", "file_no=([0-9]+)", 1).cast("bigint"))
    good = R.parse_scenarios(parts, errors="reject").select(
        "id", F.md5("description").alias("description_md5"), F.expr("cast(substring(id, 2) as bigint) div 500").alias("file_no"),
        F.lit(False).alias("is_cut"),
    )
    none = F.lit(None).cast("string")
    return good.unionByName(
        R.rejected_documents(parts).select(none.alias("id"), none.alias("description_md5"), "file_no", F.lit(True).alias("is_cut"))
    )


@query("SELECT 's' || doc_id AS id, md5(text) AS description_md5 FROM documents")
def scenario_files(spark, sf_dir):
    """Scenario arrays, one per line, through files."""
    path = fresh_path(spark, "scenarios")
    fields = F.struct("id", "title", "description", "objective")
    v.scenarios(spark, sf_dir).select(F.to_json(F.array(fields))).write.text(path)
    read = R.read_scenarios(spark, path, lines=True)
    return read.select("id", F.md5("description").alias("description_md5"))
