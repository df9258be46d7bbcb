"""Exact rank statistics without sorting a whole group in one task.

Rows are first reduced to distinct ``(group, value)`` pairs with counts, so a heavy tie is one row. The pairs are then
cut into value ranges ("buckets") of about equal size; a window only ever sees one bucket of one group. What lies
below a bucket is known from the bucket totals (a row per bucket and group) and enters the window as one extra row that
sorts before all values. The number of buckets follows the number of pairs, so they stay small however many there are. Any
cut points give the same exact result; they only balance the work.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

#: Mean number of pairs in a value range, and how many sampled values lie in one: the more, the more even the ranges.
RANGE_PAIRS, PER_RANGE = 16_384, 8


def _cut_points(pairs: DataFrame, value: str, range_pairs: int) -> DataFrame:
    """One row with the sorted cut points and the steps of a binary search among them, for ranges of ``range_pairs`` on average.

    Values whose hash falls into one slot are the sample, so their number follows that of the pairs; every eighth is a cut
    point, by which ranges of four times the mean are as good as excluded. The sample depends only on the data, so a
    recomputed partition sees the same cut points. Hashing every column keeps the reduced rows identical to those of the
    main branch, whose exchange is then reused.
    """
    slots = max(1, range_pairs // PER_RANGE)
    sample = pairs.select(value, F.xxhash64(*pairs.columns).alias("_hash")).filter(F.pmod("_hash", F.lit(slots)) == 0)
    cuts = sample.agg(F.array_sort(F.collect_list(value)).alias("_sample")).selectExpr(
        f"filter(_sample, (v, i) -> i % {PER_RANGE} = {PER_RANGE - 1}) as points"
    )
    steps = "if(size(points) = 0, array(), transform(sequence(cast(floor(log2(size(points))) as int), 0, -1), e -> shiftleft(1, e)))"
    return cuts.select(F.struct("points", F.expr(steps).alias("steps")).alias("_cuts"))


def _bucket_of(value: str, cuts: str) -> str:
    """Number of cut points below the value, by binary search."""
    points = f"{cuts}.points"
    deeper = f"pos + step <= size({points}) and {points}[least(pos + step, size({points})) - 1] < `{value}`"
    return f"aggregate({cuts}.steps, 0, (pos, step) -> if({deeper}, pos + step, pos))"


def rank_counts(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    counts: Mapping[str, str],
    sums: Mapping[str, str] | None = None,
    range_pairs: int = RANGE_PAIRS,
) -> DataFrame:
    """Distinct ``(keys, value)`` rows with, for each count ``c``: ``c``, ``c_below`` and ``c_total`` of the group.

    ``counts`` maps names to row-level integer SQL expressions. ``sums`` maps names to SQL expressions over the reduced
    rows (value and counts) whose group-wide sum is wanted on every row. Rows with a NULL value are left out.
    """
    keys, sums = list(keys), dict(sums or {})
    names = list(counts)
    # NULL values are dropped after the reduction by a condition on an aggregate: a filter on the value itself would be
    # pushed below it, where it repeats the whole expression that computes the value.
    pairs = (
        df.groupBy(*keys, value)
        .agg(
            *[F.expr(f"sum(cast({expr} as bigint)) as `{c}`") for c, expr in counts.items()],
            F.expr(f"count(`{value}`) as _present"),
        )
        .filter("_present > 0")
        .select(*keys, value, *names)
    )
    placed = pairs.withColumn("_cuts", _cut_points(pairs, value, range_pairs).scalar()).selectExpr(
        *keys, value, *names, f"{_bucket_of(value, '_cuts')} as _bucket"
    )

    by_key = ", ".join(f"`{k}`" for k in keys) or "1"
    before = f"over (partition by {by_key} order by _bucket rows between unbounded preceding and 1 preceding)"
    group = f"over (partition by {by_key})"
    marks = (
        placed.groupBy(*keys, "_bucket")
        .agg(
            *[F.expr(f"sum({c}) as {c}") for c in names],
            *[F.expr(f"sum({e}) as _{n}") for n, e in sums.items()],
        )
        .selectExpr(
            *keys,
            f"cast(null as {df.schema[value].dataType.simpleString()}) as `{value}`",
            "_bucket",
            *[f"coalesce(sum({c}) {before}, 0) as {c}" for c in names],
            *[f"sum({c}) {group} as {c}_total" for c in names],
            *[f"sum(_{n}) {group} as {n}" for n in sums],
        )
    )

    bucket = f"partition by {by_key}, _bucket"
    earlier = f"over ({bucket} order by `{value}` nulls first rows between unbounded preceding and 1 preceding)"
    carried = [f"{c}_total" for c in names] + list(sums)
    return (
        placed.unionByName(marks, allowMissingColumns=True)
        .selectExpr(
            *keys,
            value,
            *names,
            *[f"sum({c}) {earlier} as {c}_below" for c in names],
            *[f"max({c}) over ({bucket}) as {c}" for c in carried],
        )
        .filter(F.col(value).isNotNull())
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str, weight: str = "1") -> DataFrame:
    """``(keys, value, rank, n_total)``: 1-based rank of each distinct value, ties getting their mean rank."""
    ranked = rank_counts(df, keys, value, {"n": weight})
    return ranked.selectExpr(*keys, value, f"n_below + (n + 1) / 2.0D as {rank}", "n_total")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per name."""
    ranked = rank_counts(df, keys, value, {"n": "1"})
    parts = []
    for name, p in probabilities.items():
        target = f"({float(p)!r}D * (n_total - 1))"
        for side, position in (("lo", f"floor({target})"), ("hi", f"ceil({target})")):
            hit = f"n_below <= {position} and {position} < n_below + n"
            parts.append(F.expr(f"max(case when {hit} then `{value}` end) as _{name}_{side}"))
        parts.append(F.expr(f"max({target} - floor({target})) as _{name}_w"))
    return (
        ranked.groupBy(*keys)
        .agg(*parts)
        .selectExpr(*keys, *[f"_{n}_lo + _{n}_w * (_{n}_hi - _{n}_lo) as {n}" for n in probabilities])
    )
