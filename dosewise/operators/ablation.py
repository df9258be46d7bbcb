"""Controlled keyword replacement: ordered, cascading, case-preserving, with reproducible random synonyms."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from dosewise import lexicons as L
from dosewise.functions.rules import drop_verdict

LOG_TYPE = "array<struct<keyword:string,original:string,replacement:string,position:int>>"


def _literal(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Replacement of each match ``w`` (the ``k``-th) of rule ``e``: a synonym by the hash of (row, keyword, occurrence, seed),
# so that it depends neither on row order nor on partitioning, in the case of the match.
_CHOSEN = """transform(m, (w, k) -> transform(
    array(e.options[cast(pmod(cast(conv(substring(md5(
        concat_ws(':', cast({row_id} as string), e.keyword, cast(k as string), '{seed}')), 1, 8), 16, 10) as bigint),
        size(e.options)) as int)]),
    s -> case
        when substring(w, 1, 1) = lower(substring(w, 1, 1)) then lower(s)
        when substring(w, 2, 1) = lower(substring(w, 2, 1)) then concat(upper(left(s, 1)), lower(substring(s, 2)))
        else upper(s) end)[0])"""

# Text pieces between the matches, interleaved with the replacements.
_REBUILT = "array_join(flatten(zip_with(p.pieces, p.chosen, (x, y) -> array_compact(array(x, y)))), '')"

# 0-based start of each match in the text the pieces were cut from.
_STARTS = """aggregate(
    zip_with(slice(p.pieces, 1, size(m)), m, (x, w) -> named_struct('gap', length(x), 'len', length(w))),
    named_struct('at', 0, 'starts', cast(array() as array<int>)),
    (a, x) -> named_struct('at', a.at + x.gap + x.len, 'starts', array_append(a.starts, a.at + x.gap)),
    a -> a.starts)"""

_LOG = f"""concat(acc.log, zip_with(
    zip_with(m, p.chosen, (w, y) -> named_struct('original', w, 'replacement', y)), {_STARTS},
    (w, at) -> named_struct(
        'keyword', e.keyword, 'original', w.original, 'replacement', w.replacement, 'position', at)))"""

# One pass per rule over the text so far. A one-element ``transform`` names an intermediate value. The pattern, which is
# compiled for each text, is only tried where the folded text has the keyword: ``lower(upper())`` folds all letters that
# a case-insensitive pattern takes for ASCII ones (long s, the Kelvin sign), and the folded text is kept between passes.
_FOLD = """aggregate({rules}, {start}, (acc, e) -> if(not contains(acc.folded, e.folded),
    named_struct('text', acc.text, 'folded', acc.folded, 'counts', array_append(acc.counts, 0), 'log', acc.log),
    transform(
        array(regexp_extract_all(acc.text, e.pattern, 0)),
        m -> if(size(m) = 0,
            named_struct('text', acc.text, 'folded', acc.folded, 'counts', array_append(acc.counts, 0), 'log', acc.log),
            transform(
                array(named_struct('chosen', {chosen}, 'pieces', split(acc.text, e.pattern, -1))),
                p -> transform(
                    array({rebuilt}),
                    t -> named_struct('text', t, 'folded', lower(upper(t)), 'counts',
                        array_append(acc.counts, size(m)), 'log', {log}))[0])[0]))[0]))"""


def _rule(keyword: str, synonyms: Sequence[str]) -> str:
    options = ", ".join(_literal(s) for s in synonyms)
    pattern = _literal(rf"(?iU)\b{re.escape(keyword)}\b")
    return f"named_struct('keyword', {_literal(keyword)}, 'folded', lower(upper({_literal(keyword)})), 'pattern', {pattern}, 'options', array({options}))"


def ablate_text(
    df: DataFrame,
    text: str,
    row_id: str,
    synonyms: Mapping[str, Sequence[str]] = L.SYNONYMS,
    seed: int = 42,
    with_log: bool = False,
) -> DataFrame:
    """Adds ``ablated`` and ``keyword_counts`` (and ``replacements``) for a text column.

    Keywords are applied in the order given, each to the result of the ones before, so a replacement can be replaced
    again; both are counted. ``replacements`` lists keyword, original, replacement and the 0-based position in the
    text as it was before that keyword's pass. The whole fold is one expression: a later filter on its result can
    repeat it once, but never once per keyword.
    """
    # Without any keyword in the original text no pass can ever match.
    any_keyword = _literal(rf"(?iU)\b(?:{'|'.join(re.escape(k) for k in synonyms)})\b")
    start = f"""named_struct('text', `{text}`, 'folded', lower(upper(`{text}`)), 'counts', cast(array() as array<int>),
        'log', cast(array() as {LOG_TYPE}))"""
    fold = _FOLD.format(
        rules=f"array({', '.join(_rule(k, s) for k, s in synonyms.items())})",
        start=start,
        chosen=_CHOSEN.format(row_id=f"`{row_id}`", seed=seed),
        rebuilt=_REBUILT,
        log=_LOG if with_log else "acc.log",
    )
    names = ", ".join(_literal(k) for k in synonyms)
    columns = [
        "_fold.text as ablated",
        f"map_filter(map_from_arrays(array({names}), _fold.counts), (k, n) -> n > 0) as keyword_counts",
    ]
    if with_log:
        columns.append("_fold.log as replacements")
    untouched = f"""named_struct('text', `{text}`, 'folded', '', 'counts', array_repeat(0, {len(synonyms)}),
        'log', cast(array() as {LOG_TYPE}))"""
    return df.withColumn("_fold", F.expr(f"if(regexp_like(`{text}`, {any_keyword}), {fold}, {untouched})")).selectExpr(
        *[f"`{c}`" for c in df.columns], *columns
    )


def replace_word(
    df: DataFrame, text: str, row_id: str, keyword: str, choices: Sequence[str], seed: int = 42
) -> DataFrame:
    """One keyword only: adds ``ablated`` and ``replaced`` (its number of occurrences)."""
    out = ablate_text(df, text, row_id, {keyword: choices}, seed)
    return out.withColumn("replaced", F.coalesce(F.get(F.map_values("keyword_counts"), F.lit(0)), F.lit(0))).drop(
        "keyword_counts"
    )


def ablation_stats(ablated: DataFrame) -> DataFrame:
    """Adds total replacements and the number of distinct keywords found."""
    total = F.aggregate(F.map_values("keyword_counts"), F.lit(0), lambda acc, n: acc + n)
    return ablated.withColumns(
        {"total_replacements": total, "unique_keywords": F.size(F.map_values("keyword_counts"))}
    )


def ablate_pairs(
    pairs: DataFrame,
    synonyms: Mapping[str, Sequence[str]] = L.SYNONYMS,
    seed: int = 42,
    positive: str = "positive_text",
    row_id: str = "pair_id",
    with_log: bool = False,
) -> DataFrame:
    """Pairs with the positive text replaced by its ablated form and a struct of statistics; negatives unchanged."""
    done = ablation_stats(ablate_text(pairs, positive, row_id, synonyms, seed, with_log))
    fields = ["total_replacements", "unique_keywords", "keyword_counts"] + (["replacements"] if with_log else [])
    return (
        done.withColumn(positive, F.col("ablated"))
        .withColumn("ablation_stats", F.struct(*fields))
        .drop("ablated", *fields)
    )


def ablation_totals(ablated_pairs: DataFrame) -> DataFrame:
    n = F.col("ablation_stats.total_replacements")
    return ablated_pairs.agg(
        F.count("*").alias("total_pairs"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_replacements"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_replacements_per_pair"),
        F.count_if(n > 0).alias("pairs_with_replacements"),
    )


def keyword_totals(ablated: DataFrame) -> DataFrame:
    """Replacements and affected rows per keyword."""
    return (
        ablated.select(F.explode_outer("keyword_counts").alias("keyword", "n"))
        .filter(F.col("keyword").isNotNull())
        .groupBy("keyword")
        .agg(F.sum("n").alias("replacements"), F.count("*").alias("texts"))
    )


def metric_drop(original: DataFrame, ablated: DataFrame, keys: Sequence[str], accuracy: str) -> DataFrame:
    """AUROC and accuracy before and after ablation, absolute and relative drop, verdict."""
    before = original.select(*keys, F.col("auroc").alias("auroc_original"), F.col(accuracy).alias("accuracy_original"))
    after = ablated.select(*keys, F.col("auroc").alias("auroc_ablated"), F.col(accuracy).alias("accuracy_ablated"))
    drop = F.col("auroc_original") - F.col("auroc_ablated")
    return before.join(after, list(keys)).select(
        *keys,
        "auroc_original",
        "auroc_ablated",
        drop.alias("auroc_drop"),
        (F.try_divide(drop, F.col("auroc_original")) * 100).alias("auroc_drop_percent"),
        (F.col("accuracy_original") - F.col("accuracy_ablated")).alias("accuracy_drop"),
        drop_verdict(drop).alias("verdict"),
    )


def metrics_long(original: DataFrame, ablated: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(metric, variant, value) rows of the original and the ablated metrics."""

    def long(df: DataFrame, variant: str) -> DataFrame:
        slim = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
        return slim.unpivot(list(keys), list(metrics), "metric", "value").withColumn("variant", F.lit(variant))

    return long(original, "original").unionByName(long(ablated, "ablated"))
