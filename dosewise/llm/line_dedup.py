"""Removal of repeated passages by overlapping three-line windows.

Method. Every three consecutive lines of a text form a window, hashed with 128 bits. Windows that occur more than once in
the whole table are found by a global count with the first occurrence, in order of (doc_id, text hash, line). All later
occurrences are removed: the lines they cover are merged into one set per document, and the other lines joined again.

A removed line always has an earlier copy in the same window, so no line is lost from the corpus: its first occurrence is
never covered by a later occurrence. Windows without any word (blank lines) are ignored, so layout is left alone.

A null text stays null; texts of fewer than three lines are unchanged. Rows of equal id and text are one document and
treated alike; rows of equal id and different text are different documents. A null id sorts first. An empty table gives
an empty result. Other columns are kept, whatever their names: if one is called as a count here, the count gets an underscore
more. Lines end at a line feed only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dosewise.llm.common import free
from dosewise.session import materialize

WINDOW = 3
KEY = ["_id", "_hash"]
_WORD = "[^\\x20\\x09-\\x0D]"


def _windows(docs: DataFrame) -> DataFrame:
    """``(_id, _hash, at, h1, h2)``: each window with a word in it, at its first line (from 0)."""
    lines = docs.select(*KEY, F.split("text", "\n").alias("lines"))
    window = "concat_ws('\\n', lines[i], lines[i + 1], lines[i + 2])"
    starts = f"if(size(lines) >= {WINDOW}, sequence(0, size(lines) - {WINDOW}), cast(array() as array<int>))"
    spread = lines.selectExpr(*KEY, f"posexplode(transform({starts}, i -> {window})) as (at, passage)")
    hashed = spread.select(
        *KEY, "at", F.xxhash64("passage").alias("h1"), F.xxhash64(F.lit(3), "passage").alias("h2"), F.col("passage").rlike(_WORD).alias("used")
    )
    return hashed.filter("used").drop("used")


def covered_lines(docs: DataFrame) -> DataFrame:
    """``(_id, _hash, covered)``: the lines (from 0) of each document that later occurrences cover."""
    windows = _windows(docs)
    place = F.struct(*KEY, "at")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = materialize(first.filter("first < last").select("h1", "h2", "first"), "lines-repeated")
    later = windows.join(repeated, ["h1", "h2"]).filter(place > F.col("first"))
    starts = later.groupBy(*KEY).agg(F.collect_set("at").alias("starts"))  # as many as one text has lines
    steps = f"transform(starts, s -> sequence(s, s + {WINDOW - 1}))"
    return starts.selectExpr(*KEY, f"array_distinct(flatten({steps})) as covered")


def cut_lines(docs: DataFrame) -> DataFrame:
    """``(row, text, n_lines, n_removed)``: each row of ``docs`` as it was, and its text without later occurrences."""
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    covered = covered_lines(keyed.select(*KEY, "text")).withColumnsRenamed({"_id": "_id2", "_hash": "_hash2"})
    same = F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_hash") == F.col("_hash2"))
    marked = keyed.join(covered, same, "left").withColumn("_split", F.split("text", "\n"))
    kept = "transform(array_except(sequence(0, size(_split) - 1), covered), i -> _split[i])"
    return marked.select(
        "row",
        F.expr(f"if(covered is null, text, array_join({kept}, '\\n'))").alias("text"),
        F.expr("if(text is null, 0, size(_split))").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("bigint").alias("n_removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with later occurrences cut from ``text``, and with ``_lines`` and ``_removed`` counted."""
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c != "text"]
    counts = [F.col(f"n{name}").alias(free(name, docs.columns)) for name in ("_lines", "_removed")]
    return cut_lines(docs).select(*others, "text", *counts)


def op5_line_windows(spark, sf_dir: str) -> DataFrame:
    """All documents without repeated passages, with the number of lines before and of lines removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).withColumnsRenamed({"_lines": "n_lines", "_removed": "n_removed"})


OP5_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
w AS (SELECT doc_id, a, lines[a + 1] || chr(10) || lines[a + 2] || chr(10) || lines[a + 3] AS passage
      FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 2)) AS a FROM d)),
later AS (
  SELECT doc_id, a FROM (
    SELECT doc_id, a, row_number() OVER (PARTITION BY passage ORDER BY doc_id, a) AS nth
    FROM w WHERE regexp_matches(passage, '[^\\x20\\x09-\\x0D]')) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, a + unnest([0, 1, 2]) AS line FROM later),
gone AS (SELECT doc_id, count(*) AS n_removed, list(line) AS covered FROM covered GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN g.doc_id IS NULL THEN d.text ELSE coalesce(array_to_string(
         [d.lines[i + 1] FOR i IN range(0, len(d.lines)) IF NOT list_contains(g.covered, i)], chr(10)), '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(d.lines) END AS n_lines,
       coalesce(g.n_removed, 0)::BIGINT AS n_removed
FROM d LEFT JOIN gone g ON d.doc_id = g.doc_id
"""
