"""Large JSON documents as many small ones, each with one part of the whole.

A file that holds one array, or one map, is read in pieces that end at a closing brace; Spark deals the pieces of one file to
many tasks. Whether a piece begins inside a string, and how deep its end lies, follows from the quotes and brackets of all
pieces before it: these are counted for both cases in each block of the file, and summed up over its blocks. A part goes from
one brace that closes an element of the array, or an entry of the map, to the next. It is wrapped as a document of the same
layout, so the readers of whole documents read it too, and together the parts give the rows of the whole.

An element has to fit one row (2 GB), a document does not. Strings are in double quotes, as the JSON standard has it. A file
that is cut off, or has something wrong between two elements, gives a part that is no JSON; ``offset`` says where it begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dosewise.session import broadcast_rows, materialize

#: Ends of names of files that are read decompressed, so their size on disk says nothing about the text.
COMPRESSED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".xz")
#: A part of more bytes is not put together; its beginning is reported as malformed.
PART_BYTES = 1 << 30


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _pieces(spark: SparkSession, path: str, wrapper: str | None) -> DataFrame:
    """The text between closing braces, with its quotes, and the change of depth in it if it begins outside a string or in one."""
    meta = F.col("_metadata")
    raw = spark.read.option("lineSep", "}").text(path).select(
        meta["file_path"].alias("file"),
        meta["file_size"].alias("file_size"),
        meta["file_block_start"].alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    strings = r'"[^"]*("|\z)'
    outside = F.regexp_replace(plain, strings, "")
    inside = F.regexp_replace(F.regexp_replace(plain, r'\A[^"]*("|\z)', ""), strings, "")
    wrapped = F.lit(False) if wrapper is None else F.col("value").rlike(_opening(wrapper))
    return raw.select(
        "*",
        (F.octet_length("value") + 1).cast("long").alias("bytes"),
        _count(plain, '"').alias("quotes"),
        (_count(outside, "{[") - _count(outside, "]")).alias("step_outside"),
        (_count(inside, "{[") - _count(inside, "]")).alias("step_inside"),
        F.when(wrapped, "w").when(F.col("value").rlike(r"\A\s*\["), "a").otherwise("m").alias("layout"),
    )


def _opening(wrapper: str) -> str:
    return rf'\A\s*\{{\s*"{wrapper}"\s*:\s*\{{'


def _over(order: str, keys: Sequence[str] = ("file",), inclusive: bool = False) -> str:
    end = "current row" if inclusive else "1 preceding"
    return f"over (partition by {', '.join(keys)} order by {order} rows between unbounded preceding and {end})"


def _depths(pieces: DataFrame) -> DataFrame:
    """Where each piece lies, how deep its end is, and whether a brace there closes something."""
    slim = pieces.drop("value")
    in_block = _over("seq", ("file", "block"))
    both = slim.selectExpr("*", f"coalesce(sum(quotes) {in_block}, 0) % 2 as odd")
    for begins in (0, 1):
        # The brace that ended the piece closes something if the piece does not end in a string.
        both = both.withColumn(
            f"change{begins}",
            F.expr(
                f"if((odd + {begins}) % 2 = 1, step_inside, step_outside) - if((odd + quotes + {begins}) % 2 = 0, 1, 0)"
            ),
        )
    blocks = both.groupBy("file", "block").agg(
        F.sum("quotes").alias("quotes"),
        F.sum("bytes").alias("bytes"),
        F.sum("change0").alias("change0"),
        F.sum("change1").alias("change1"),
        F.min_by("layout", "seq").alias("layout"),
    )
    earlier, every = _over("block"), "over (partition by file)"
    starts = blocks.selectExpr(
        "*",
        f"coalesce(sum(quotes) {earlier}, 0) % 2 as begins",
        f"coalesce(sum(bytes) {earlier}, 0) as block_offset",
        f"sum(bytes) {every} as file_bytes",
        f"min_by(layout, block) {every} as file_layout",
    ).selectExpr(
        "file as _file",
        "block as _block",
        "begins",
        "block_offset",
        "file_bytes",
        "file_layout",
        f"coalesce(sum(if(begins = 0, change0, change1)) {earlier}, 0) as block_depth",
    )
    starts = broadcast_rows(materialize(starts, "json-blocks"))
    same = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    placed = both.join(starts, same).selectExpr(
        "file",
        "block",
        "seq",
        "file_layout as layout",
        f"block_offset + coalesce(sum(bytes) {in_block}, 0) as offset",
        f"block_depth + sum(if(begins = 0, change0, change1)) {_over('seq', ('file', 'block'), inclusive=True)} as depth",
        "(odd + quotes + begins) % 2 = 0 as closes",
        "bytes",
        "file_bytes",
        "file_size",
    )
    # Only the last piece may have no brace after it: then the braces counted make one byte more than the file has, but for a
    # byte order mark, which is not read. The size of a compressed file says nothing: the brace is there if it closes the whole.
    compressed = F.lower("file").rlike("(" + "|".join(e.replace(".", r"\.") for e in COMPRESSED) + r")\z")
    whole = F.when(compressed, F.col("closes") & (F.col("depth") == 0)).otherwise(
        F.col("file_bytes").isin(F.col("file_size"), F.col("file_size") - 3)
    )
    is_last = F.col("offset") + F.col("bytes") == F.col("file_bytes")
    braced = ~is_last | whole
    return placed.select(
        "file", "block", "seq", "layout", "offset", "bytes", "depth",
        (F.col("closes") & braced).alias("closes"),
        braced.alias("braced"), is_last.alias("is_last"),
    )


def _numbered(depths: DataFrame) -> DataFrame:
    """``(file, block, seq, layout, offset, bytes, braced, part, ends)``: the part that each piece belongs to, or ends."""
    # A part ends where a brace closes one of its level; a file that ends there lacks its closing brackets, so that part is open.
    # In a wrapped map the parts lie one level deeper, and end with it; what follows belongs to the last part.
    level = F.when(F.col("layout") == "w", 2).otherwise(1)
    marked = depths.withColumn("hit", (F.col("closes") & (F.col("depth") == level)).cast("int")).withColumn(
        "out", (F.col("closes") & (F.col("depth") < level)).cast("int")
    )
    in_block, earlier = _over("seq", ("file", "block")), _over("block")
    marked = marked.selectExpr("*", f"coalesce(sum(out) {in_block}, 0) as outs").withColumn("hit", F.expr("if(outs = 0, hit, 0)"))
    blocks = marked.groupBy("file", "block").agg(F.sum("hit").alias("hits"), F.sum("out").alias("outs"))
    blocks = blocks.selectExpr("*", f"coalesce(sum(outs) {earlier}, 0) as outs_before").selectExpr(
        "file as _file", "block as _block", "outs_before",
        f"coalesce(sum(if(outs_before = 0, hits, 0)) {earlier}, 0) as hits_before",
    )
    blocks = broadcast_rows(materialize(blocks, "json-parts"))
    same = (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))
    return marked.join(blocks, same).selectExpr(
        "file", "block", "seq", "layout", "offset", "bytes", "braced",
        f"hits_before + coalesce(sum(if(outs_before = 0, hit, 0)) {in_block}, 0) as part",
        "hit = 1 and outs_before = 0 and not is_last as ends",
    )


def split_documents(spark: SparkSession, path: str, wrapper: str | None = None) -> DataFrame:
    """``(file, part, offset, doc)``: the files' documents, one to a file, in small documents of the same layout.

    With ``wrapper`` a map whose first key has that name and holds a map is parted by the entries of the latter.
    """
    pieces = materialize(_pieces(spark, path, wrapper), "json-pieces")
    places = _numbered(_depths(pieces))
    text = pieces.select("file", "block", "seq", "value")
    joined = text.join(places, ["file", "block", "seq"]).withColumn(
        "value", F.when(F.col("braced"), F.concat("value", F.lit("}"))).otherwise(F.col("value"))
    )
    # Without an end in sight (a quote too many, say) a part would grow with the file: only its beginning is kept.
    before = "over (partition by file, part order by block, seq rows between unbounded preceding and current row)"
    joined = joined.withColumn("_far", F.expr(f"sum(bytes) {before}")).filter(
        (F.col("_far") <= PART_BYTES) | (F.col("_far") == F.col("bytes"))
    )
    parts = joined.groupBy("file", "part").agg(
        F.min("offset").alias("offset"),
        F.first("layout").alias("layout"),
        F.max("ends").alias("ends"),
        F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("_pieces"),
    )
    body = F.array_join(F.col("_pieces.value"), "")
    opens = F.when(F.col("layout") == "a", "[").when(F.col("layout") == "w", f'{{"{wrapper}":{{').otherwise("{")
    closes = F.when(F.col("layout") == "a", "]").when(F.col("layout") == "w", "}}").otherwise("}")
    lead = F.when(F.col("part") > 0, r"\A\s*,(?!\s*[\]}])").when(F.col("layout") == "w", _opening(wrapper or "")).otherwise(r"\A\s*[\[{]")
    closing = F.col("body").rlike(r"\A\s*[\]}]")
    whole_tail = ~F.col("ends") & (F.col("part") > 0) & closing
    inner = F.regexp_replace("body", F.col("lead"), "")
    doc = (
        F.when((F.col("part") == 0) & ~F.col("ends"), F.col("body"))
        .when(whole_tail, F.concat("opens", "body"))  # nothing but the closing brackets
        .when(~F.regexp_like("body", F.col("lead")), F.concat(F.lit("]"), F.col("body")))  # no comma, or no opening
        .when(F.col("ends"), F.concat("opens", inner, "closes"))
        .otherwise(F.concat("opens", inner))
    )
    named = parts.select(
        "file", "part", "offset", "ends", body.alias("body"), opens.alias("opens"), closes.alias("closes"), lead.alias("lead")
    )
    return named.select("file", "part", "offset", doc.alias("doc"))
