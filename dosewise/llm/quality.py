"""Quality classifier by positive-unlabelled learning.

Method. Trusted positives are the documents labelled 1 outside the held-out third; all documents are the unlabelled sample.
Labels of 0 are never used. The class prior is estimated first: a classifier of positives against unlabelled is fitted,
and the prior is the share of all documents above a score divided by that of positives, at the quantile of the score where
this ratio has the least upper bound. Then the non-negative risk ``prior * E_p[loss(z)] + max(0, E_u[loss(-z)] - prior * E_p[loss(-z)])`` with
logistic loss and a small quadratic penalty is minimised over a linear model ``z`` by damped Newton steps.

Features are shares of kinds of characters and words, of repetitions and of lines, each also as capped ramps; ids, labels,
languages and sources are no inputs. They are computed once from whole texts and stored; each Newton step is one pass
over that small table, whose sums (features squared) are added by Spark. Nothing is sampled.

A null text counts as empty; empty texts have features (all shares 0, and a mark) and a score. Without positives every
score is 0.5. Several labels of a document: it is positive only if all of them are 1. Repeated rows come out once per row;
an empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dosewise.llm.common import raw_texts, slices
from dosewise.session import materialize

FOLDS, HELD_OUT = 3, 1
STEPS, PENALTY = 12, 1e-4
#: Quantiles of the positives' scores at which the prior is estimated.
QUANTILES = 20
#: Few positives need a larger penalty: it grows by this over their number.
FEW = 0.2
#: Standard errors by which a ratio of few documents counts as greater.
CAUTION = 2.0
#: Positives above a quantile for it to count; the lowest one always does.
ENOUGH = 30

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_UPPER, _DIGITS, _SPACE = bytes(range(65, 91)), bytes(range(48, 58)), b" \t\n\x0b\x0c\r"
_MARKS = b".,;:'\"-()"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _MARKS)
_SHARES = 12
RAMPS = (4.0, 20.0)
N_FEATURES = _SHARES * (1 + len(RAMPS)) + 3


def shares(text: bytes) -> list[float]:
    """Shares of a text between 0 and 1."""
    n = max(1, len(text))

    def part(kind: bytes) -> int:
        return len(text) - len(text.translate(None, kind))

    found = text.split()
    words = max(1, len(found))
    lines = text.split(b"\n")
    letters, upper, symbols = part(_LETTERS), part(_UPPER), part(_SYMBOLS)
    distinct = len(set(found))
    return [
        upper / max(1, letters),
        part(_DIGITS) / n,
        symbols / n,
        min(1.0, symbols / words),
        part(_MARKS) / n,
        1 - letters / max(1, n - part(_SPACE)),
        1 - distinct / words if found else 0.0,
        sum(map(eq, found, found[1:])) / words,
        1 - len(set(lines)) / len(lines),
        text.count(b"|") / words if text.count(b"|") < words else 1.0,
        min(1.0, text.count(b"!") / words),
        min(1.0, len(lines) / words) if found else 0.0,
    ]


def features(text: bytes | None) -> np.ndarray:
    text = text or b""
    base = np.array(shares(text))
    ramps = [np.minimum(1.0, base * r) for r in RAMPS]
    size = min(1.0, np.log1p(len(text)) / 12)
    return np.concatenate([base, *ramps, [1.0, size, float(not text.strip())]])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = np.array([features(t) for t in raw_texts(batch, "text")])
        lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "features"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("features").flatten().to_numpy().reshape(-1, N_FEATURES)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0.0, -z))


def _moments(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of a task over positives (side 0) and over all rows (side 1)."""
    total = np.zeros((2, 3 + 2 * N_FEATURES + N_FEATURES**2))
    for batch in batches:
        x = _matrix(batch)
        positive = np.asarray(batch.column("positive"), dtype=bool)
        for side, rows in ((0, x[positive]), (1, x)):
            z = rows @ weights
            s = _sigmoid(z)
            parts = [len(rows), _softplus(-z).sum(), _softplus(z).sum()]
            curve = (rows * (s * (1 - s))[:, None]).T @ rows
            total[side] += np.concatenate([parts, rows.sum(axis=0), s @ rows, curve.ravel()])
    yield pa.RecordBatch.from_pydict({"sums": [total.ravel().tolist()]})


def _summed(table: DataFrame, weights: np.ndarray) -> list[tuple]:
    """For positives and for all rows: count, sums of both losses, of features, of scored features, and the curvature."""
    parts = table.select("features", "positive").mapInArrow(partial(_moments, weights=weights), "sums array<double>")
    rows = parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("total")).collect()
    flat = np.zeros(2 * (3 + 2 * N_FEATURES + N_FEATURES**2))
    for r in rows:  # as many rows as there are sums, whatever the size of the table
        flat[r["pos"]] = r["total"]
    d = N_FEATURES
    return [
        (s[0], s[1], s[2], s[3 : 3 + d], s[3 + d : 3 + 2 * d], s[3 + 2 * d :].reshape(d, d)) for s in flat.reshape(2, -1)
    ]


def minimise(table: DataFrame, prior: float) -> np.ndarray:
    """Weights of the least non-negative risk found."""
    weights, best, least = np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.inf
    step = np.zeros(N_FEATURES)
    for _ in range(STEPS):
        (n_p, hit, miss, x_p, s_p, h_p), (n_u, _, wrong, _, s_u, h_u) = _summed(table, weights)
        if not n_p:
            break
        penalty = PENALTY + FEW / n_p
        negative = wrong / n_u - prior * miss / n_p
        risk = prior * hit / n_p + max(0.0, negative) + penalty * weights @ weights
        if risk > least + 1e-12:  # the step went too far
            step = step / 2
            weights = best + step
            continue
        least, best = risk, weights
        if negative >= 0:
            slope, curve = s_u / n_u - prior * x_p / n_p, h_u / n_u
        else:  # the estimate of the negatives' risk is below 0: only the positives' part is followed
            slope, curve = -prior * (x_p - s_p) / n_p, prior * h_p / n_p
        curve = curve + 2 * penalty * np.eye(N_FEATURES)
        step = -np.linalg.solve(curve, slope + 2 * penalty * weights)
        weights = best + step
    return best


def class_prior(table: DataFrame, weights: np.ndarray) -> float:
    """Share of positives among all rows, from the ratio of both above a score (at most 1)."""
    scored = score(table, weights, keep=["positive"])
    steps = [k / QUANTILES for k in range(1, QUANTILES)]
    cuts = scored.filter("positive").agg(F.percentile_approx("score", F.lit(steps), F.lit(10_000)).alias("c")).first()["c"]
    cuts = sorted(set(cuts or []))
    counts = scored.agg(
        F.count(F.lit(1)).alias("u"),
        F.count_if("positive").alias("p"),
        *[F.count_if(F.col("score") >= c).alias(f"u{i}") for i, c in enumerate(cuts)],
        *[F.count_if(F.col("positive") & (F.col("score") >= c)).alias(f"p{i}") for i, c in enumerate(cuts)],
    ).first()
    bounded = [(1.0, 1.0)]
    for i in range(len(cuts)):
        above_u, above_p = counts[f"u{i}"], counts[f"p{i}"]
        if above_p >= ENOUGH or i == 0 and above_p:
            ratio = above_u / counts["u"] / (above_p / counts["p"])
            bounded.append((ratio * (1 + CAUTION * (1 / above_p + 1 / above_u) ** 0.5), ratio))
    return float(min(1.0, min(bounded)[1]))


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "features"]
        scores = pa.array(_sigmoid(_matrix(batch) @ weights))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), scores], names=[*kept, "score"])


def score(table: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    schema = ", ".join(f"{c} {table.schema[c].dataType.simpleString()}" for c in keep)
    return table.select(*keep, "features").mapInArrow(partial(_score, weights=weights), f"{schema}, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs``; ``labels`` has ``doc_id`` and ``quality``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(_features, f"doc_id {kind}, features array<double>")
    trusted = labels.filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    trusted = trusted.select("doc_id", F.lit(True).alias("positive"))
    joined = materialize(rows, "quality-features").join(trusted, "doc_id", "left")
    table = materialize(joined.withColumn("positive", F.coalesce("positive", F.lit(False))), "quality-table")
    weights = np.zeros(N_FEATURES)
    if not table.filter("positive").isEmpty():
        # The prior is read off positives that its classifier has not seen.
        second = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
        seen = table.withColumn("positive", F.col("positive") & ~second)
        unseen = table.withColumn("positive", F.col("positive") & second)
        prior = class_prior(unseen, minimise(seen, 0.5))
        weights = minimise(table, prior)
    scored = score(table, weights, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_pu_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
