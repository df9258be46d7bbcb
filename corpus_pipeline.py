"""Corpus pipeline over the documents table: five stages, each written as Parquet and read again by the next.

1. Language ID: documents without a letter go, and those whose words have no sure language, whichever each word has. If no
   row has a language to learn from, all documents with a letter stay.
2. Line dedup: later occurrences of three-line passages are cut from the texts; a document with no word left goes.
3. MinHash near-dedup: of each group of near-duplicates the document with the smallest id stays. Rows of equal id and
   different text are documents of their own; of those that are near-duplicates, the one with the smallest hash stays.
4. Mixing: each document comes as often as the mix takes it, the last time perhaps in part; so ids may repeat or be absent.
5. BPE: one row per document of the mix with its ids, and the text that they decode to.

Null ids and texts, repeated rows and empty tables are treated as the operators' docstrings say. A stage returns the columns
that it was given, whatever they are beyond ``doc_id``, ``text``, ``lang`` and ``source``; the last adds its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dosewise.llm import bpe, language, line_dedup, minhash, mixing
from dosewise.llm.common import documents, free
from dosewise.session import materialize

#: Least mean, over a document's words, of the posterior of each word's best language.
LEAST_SHARE = 0.5
_WORD = "[^\\x20\\x09-\\x0D]"


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose words' languages the model is sure of, a single one or several."""
    model = language.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike("\\p{L}"))
    found = language.labelled(docs, model, by_word=True)
    predicted, score = found.columns[-2:]
    sure = (F.col(f"`{predicted}`") != language.UNKNOWN) & (F.col(f"`{score}`") >= LEAST_SHARE)
    return found.filter(sure).drop(predicted, score)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later occurrences of passages; ``n_chars``, if present, is counted again."""
    cut = line_dedup.cut_lines(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(_WORD))
    values = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in values:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(F.col("n_removed") > 0, changed).otherwise(values["n_chars"])
    return cut.select(*[value.alias(c) for c, value in values.items()])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near-duplicates, and those without an id."""
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("hash")))
    found = minhash.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    name = free("_key", docs.columns)
    dropped = found.filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.withColumn(name, key).join(dropped, name, "left_anti").drop(name)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of sources takes them, in the order of its schedule."""
    return mixing.mixed_documents(docs)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and their number, and the decoded text."""
    return bpe.with_tokens(docs)


STAGES = [
    ("language_id", in_a_language),
    ("line_dedup", without_repeated_passages),
    ("minhash_near_dedup", one_of_each_group),
    ("source_mix", mixed),
    ("bpe", tokenised),
]

#: The stages use a trained model and hash orders that SQL does not have; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on the whole documents table."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
