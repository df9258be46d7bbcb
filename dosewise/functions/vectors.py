"""Scalar expressions on ``ARRAY<FLOAT|DOUBLE>`` columns; sums are kept in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def same_size(a: Column, b: Column, result: Column) -> Column:
    """``result``, or an error where both vectors are there but differ in dimension."""
    message = F.concat(F.lit("vector of "), F.size(a), F.lit(" components meets a direction of "), F.size(b))
    return F.when(a.isNull() | b.isNull() | (F.size(a) == F.size(b)), result).otherwise(F.raise_error(message))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def scale(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * factor)


def unit(v: Column) -> Column:
    """``v`` divided by its norm; NULL for a zero vector."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def shift(v: Column, direction: Column, alpha: Column) -> Column:
    """``v + alpha * direction``."""
    return F.zip_with(v, direction, lambda x, d: x.cast("double") + alpha * d)


def mean(v: Column) -> Column:
    return F.try_divide(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.size(v))


def stddev_pop(v: Column) -> Column:
    centre = mean(v)
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x.cast("double") - centre) * (x.cast("double") - centre))
    return F.sqrt(F.try_divide(squares, F.size(v)))


def round_all(v: Column, digits: int) -> Column:
    return F.transform(v, lambda x: F.round(x.cast("double"), digits))


def top_components(v: Column, k: int) -> Column:
    """The ``k`` components largest by absolute value as ``ARRAY<STRUCT<rank,dim,value,sign>>``, ties by dimension."""
    keyed = F.transform(
        v, lambda x, i: F.struct((-F.abs(x)).alias("neg_abs"), i.alias("dim"), x.cast("double").alias("value"))
    )
    best = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(
        best,
        lambda e, i: F.struct(
            (i + 1).alias("rank"),
            e["dim"].alias("dim"),
            e["value"].alias("value"),
            F.when(e["value"] < 0, "negative").otherwise("positive").alias("sign"),
        ),
    )
