"""Mixing of sources to target weights by a low-discrepancy schedule.

Method. The mix is a row of slots. Slot ``i`` of ``n`` has the golden-ratio point ``(i * a mod n) / n``, where ``a`` is the
whole number next to ``n / g`` without a common factor with ``n``; the points are those of the golden-ratio sequence put
on a grid, so each grid point occurs once. The source whose interval of cumulative weights holds the point gets the slot.
A slot's rank within its source gives the pass over the source and the block of words it takes. Blocks have ``BLOCK`` words
(the last of a source fewer) and are cut from the source's documents laid end to end in a seeded hash order. Slots joined
with blocks give the spans of the mix.

Targets. Source weights are 5, 2, 1, repeating in the order of source names, null last. The sources share
``SHARE`` = 150 % of all words by weight; no target exceeds ``REPEAT`` = 2 times the words of its source, and what is above
goes to the others by weight until none is above. A source's interval holds as many slots as its target needs: all blocks
of each full pass and those of the last, partial one, whose last block may be cut. So a source's words equal its target
rounded down, and no document is taken more than ``REPEAT`` times.

Ranks and running sums never put a source into one task: slots are numbered within ranges of ``RANGE`` slots, documents
within shares of the hash space of about ``RANGE`` documents, and only the totals of ranges are summed per source. The
table of sources has one row per source name.

A null text has no words and is never taken. A table without words gives targets of 0. Null sources are one source. Rows
that repeat an id are documents of their own. Extra columns do not matter. Reruns give the same mix.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dosewise.llm.common import raw_texts, slices
from dosewise.session import materialize

WEIGHTS = (5, 2, 1)
SHARE, REPEAT = 1.5, 2
#: Words of a block.
BLOCK = 1024
#: Slots, or about as many documents, that one window sees.
RANGE = 16_384
SEED = 10

_BEFORE = (Window.unboundedPreceding, -1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sizes = [len(t.split()) if t else 0 for t in raw_texts(batch, "text")]
        columns = [batch.column(c) for c in ("doc_id", "source", "order")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=["doc_id", "source", "order", "size"])


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, order, size)``, stored: the place in the hash order and the number of words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "source", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("order"), "text")
    counted = rows.mapInArrow(_count, f"doc_id {kind}, source string, order bigint, size bigint")
    return materialize(counted, "mix-sizes")


def targets(sizes: DataFrame) -> DataFrame:
    """One stored row per source: its number, words, target, blocks, and its slots from ``first_slot`` on."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(order) - 1
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("source_no", number)
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.col("source_no") % len(WEIGHTS))
    sources = sources.withColumn("weight", weight).withColumn("most", F.col("source_size") * REPEAT)

    # In order of the level at which a source is full: is it full at the level that the rest would share?
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    everything = Window.partitionBy()
    to_share = SHARE * F.sum("source_size").over(everything)
    full_words = F.coalesce(F.sum("most").over(by_level.rowsBetween(*_BEFORE)), F.lit(0))
    weights_left = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    sources = sources.withColumn("level", (to_share - full_words) / weights_left)
    sources = sources.withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "source_no", "level")))
    sources = sources.withColumn("shared", level.over(everything)["level"])
    sources = sources.withColumn(
        "target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("shared"))
    )

    words = F.floor(F.col("target"))
    sources = sources.select(
        "source",
        "source_no",
        "source_size",
        "target",
        F.expr(f"cast(ceil(source_size / {BLOCK}.0D) as bigint)").alias("blocks"),
        F.coalesce(F.try_divide(words - words % F.col("source_size"), F.col("source_size")), F.lit(0)).cast("bigint").alias("passes"),
        words.alias("words"),
    )
    sources = sources.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    sources = sources.withColumn(
        "slots", F.expr(f"passes * blocks + cast(ceil(rest / {BLOCK}.0D) as bigint)")
    )
    placed = sources.withColumn(
        "first_slot", F.coalesce(F.sum("slots").over(Window.orderBy("source_no").rowsBetween(*_BEFORE)), F.lit(0))
    )
    return materialize(placed, "mix-targets")


def golden_step(n: int) -> int:
    """The whole number next to ``n`` divided by the golden ratio that has no common factor with ``n``."""
    near = round(n * (math.sqrt(5) - 1) / 2)
    for distance in range(n):
        for step in (near - distance, near + distance):
            if 0 < step and math.gcd(step, n) == 1:
                return step
    return 1


def schedule(sources: DataFrame) -> DataFrame:
    """``(slot, source_no, pass, block, start, end)``: the words of its source's row of documents that each slot takes."""
    n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    inverse = pow(golden_step(n), -1, n) if n > 1 else 0
    chunks = sources.filter("slots > 0").selectExpr(
        "source_no", "first_slot", "slots", f"explode(sequence(first_slot, first_slot + slots - 1, {RANGE}L)) as low"
    )
    points = chunks.repartition("source_no", "low").selectExpr(
        "source_no", f"explode(sequence(low, least(low + {RANGE - 1}L, first_slot + slots - 1))) as point"
    )
    slot = f"cast(pmod(cast(point as decimal(19,0)) * cast({inverse} as decimal(19,0)), {max(n, 1)}) as bigint)"
    slots = points.selectExpr("source_no", f"{slot} as slot").withColumn("range", F.expr(f"slot div {RANGE}"))
    totals = slots.groupBy("source_no", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("range").rowsBetween(*_BEFORE)  # one row per range
    totals = totals.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = F.row_number().over(Window.partitionBy("source_no", "range").orderBy("slot")) - 1
    ranked = slots.withColumn("within", within).join(totals, ["source_no", "range"])
    ranked = ranked.join(sources.select("source_no", "source_size", "blocks", "passes", "rest"), "source_no")
    ranked = ranked.withColumn("rank", F.col("within") + F.col("earlier"))
    return ranked.selectExpr(
        "slot",
        "source_no",
        "rank div blocks as pass",
        "rank % blocks as block",
        f"(rank % blocks) * {BLOCK} as start",
        f"least((rank % blocks + 1) * {BLOCK}, if(rank div blocks < passes, source_size, rest)) as end",
    )


def laid_out(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """The documents with words, each with ``source_no`` and the first word ``start`` in its source's row."""
    shares = max(1, sizes.count() // RANGE)
    named = sources.select(F.col("source").alias("_source"), "source_no")
    # One row per source meets all documents; the join splits a source with many of them.
    docs = sizes.filter("size > 0").join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    docs = docs.withColumn("share", F.pmod("order", F.lit(shares)))
    totals = docs.groupBy("source_no", "share").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("share").rowsBetween(*_BEFORE)  # one row per share
    totals = totals.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    within = Window.partitionBy("source_no", "share").orderBy("order", "doc_id", "size").rowsBetween(*_BEFORE)
    docs = docs.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return docs.join(totals, ["source_no", "share"]).selectExpr(
        "doc_id", "order", "size", "source_no", "earlier + within as start"
    )


def spans(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """Blocks joined with slots: the columns of ``docs`` with ``slot``, ``pass`` and the words ``from_word`` to ``to_word``.

    A document that no slot takes has one row with nulls.
    """
    pieces = docs.withColumn("block", F.expr(f"explode(sequence(start div {BLOCK}, (start + size - 1) div {BLOCK}))"))
    takes = slots.select("slot", "source_no", "pass", "block", F.col("start").alias("_start"), F.col("end").alias("_end"))
    joined = pieces.join(takes, ["source_no", "block"], "left")
    return joined.selectExpr(
        *docs.columns,
        "slot",
        "pass",
        "if(slot is null, null, greatest(start, _start) - start) as from_word",
        "if(slot is null, null, least(start + size, _end) - start) as to_word",
    )


def mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes of the documents, targets of the sources, and the spans of the mix (see ``spans``)."""
    sizes = sized(docs)
    sources = targets(sizes)
    return sizes, sources, spans(laid_out(sizes, sources), schedule(sources))


def _cut(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The words ``_from`` to ``_to`` of each text; a whole text keeps its white space."""
    import re

    word = re.compile("[^\x20\x09-\x0d]+")
    for batch in slices(batches, text):
        out = []
        for whole, size, low, high in zip(*(batch.column(c).to_pylist() for c in (text, "_size", "_from", "_to"))):
            if high - low < size:
                places = [m.span() for m in word.finditer(whole)]
                whole = whole[places[low][0] : places[high - 1][1]]
            out.append(whole)
        at = batch.schema.get_field_index(text)
        yield batch.set_column(at, text, pa.array(out, pa.string()))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents with the columns of ``docs``: each as often as it is taken, the last time perhaps in part.

    The rows come in the order of the schedule: a document stands where its first block has its slot, so the sources of any
    stretch of rows are mixed as the schedule mixes them. ``n_chars``, if there is such a column, is counted again.
    """
    _, sources, taken = mix(docs)
    copies = taken.filter("from_word < to_word").groupBy("doc_id", "order", "size", "start", "source_no", "pass")
    copies = copies.agg(F.min("from_word").alias("from_word"), F.max("to_word").alias("to_word"), F.min("slot").alias("slot"))
    copies = copies.join(sources.select("source_no", F.col("source").alias("_source")), "source_no").selectExpr(
        "struct(doc_id, _source as source, order) as _key", "size as _size", "from_word as _from", "to_word as _to", "slot as _slot"
    )
    # The caller's columns go under names that none of these has.
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    doc_id, text, source = inner["doc_id"], inner["text"], inner["source"]
    order = F.xxhash64(F.lit(SEED), doc_id, text).alias("order")
    # Structs of equal fields are equal, nulls too. One key, of one type, for both steps: the texts are shuffled once for them.
    key = F.struct(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), order).cast(copies.schema["_key"].dataType)
    rows = docs.toDF(*inner.values()).withColumn("_key", key)
    joined = rows.dropDuplicates(["_key"]).join(copies, "_key").select(*inner.values(), "_size", "_from", "_to", "_slot")
    # Slots are numbers without gaps, so equal stretches of them are equal partitions.
    slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.expr(f"cast(_slot div {max(1, -(-slots // parts))} as int)")
    ordered = joined.repartitionById(parts, stretch).sortWithinPartitions("_slot", "_from", doc_id)
    cut = ordered.mapInArrow(partial(_cut, text=text), ordered.schema).select(*inner.values())
    if "n_chars" in inner:
        cut = cut.withColumn(inner["n_chars"], F.length(text).cast("bigint"))
    return cut.toDF(*docs.columns)


def op10_golden_ratio_mix(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and the first slot of the schedule that takes some."""
    sizes, sources, taken = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    words = F.coalesce(F.sum(F.greatest(F.col("to_word") - F.col("from_word"), F.lit(0))), F.lit(0))
    with_words = taken.groupBy("doc_id", "size", "source_no", "start").agg(words.alias("taken"), F.min("slot").alias("first_slot"))
    with_words = with_words.select("doc_id", "size", "source_no", "taken", "first_slot")
    without = sizes.filter("size = 0").join(
        sources.select(F.col("source").alias("_source"), "source_no"), F.col("source").eqNullSafe(F.col("_source"))
    )
    rows = with_words.unionAll(without.selectExpr("doc_id", "size", "source_no", "0L", "cast(null as bigint)"))
    return rows.join(sources.select("source_no", "source_size", "target"), "source_no").select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot"
    )
