"""Near-duplicate embeddings by an inverted multi-index.

Method. Vectors are scaled to length 1 and cut into halves. Each half has a codebook of ``k`` centroids, fitted by k-means on
a bounded sample; the pairs of centroids are the cells of a grid, and every vector is indexed in the cell of its nearest
centroids. A query visits cells in ascending order of the sum of its halves' squared distances to the centroids (the
multi-sequence order) and is compared in double precision with all vectors there; links need a cosine of ``COSINE``.

Number of cells visited: one in ``HELD_OUT`` sample rows has no part in the codebooks; these rows, turned by exactly the
angle of ``COSINE`` in random directions, must be in the first cells visited by the row they came from, for a share
``RECALL`` of them, however many cells that takes. Closer pairs are found more often. A sample too small to hold a row out has all cells visited. All
rows are queries and all are indexed. ``k`` is the square root of a 32nd of the number of vectors, at least 4.

Scale. The vectors of a cell and the queries that visit it are dealt to blocks of about ``SIDE`` rows, so a hot cell is many
groups of two blocks each. A group gives the number of links of each query, and of each indexed vector that does not itself
visit the query's cell, so a link counts once at each end, whichever of the two found it. It also gives the edges of a
spanning forest of its links, which keeps all connections and is never longer than its two sides; no pairs are emitted.

Vectors that are null, empty, of length 0 or with null or non-finite components link with nothing and stand alone; so do
those of another dimension than most of the sample. Rows that repeat an id are one vector (the least), which comes out
once per row. An empty table gives an empty result. Extra columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dosewise.llm.common import connected
from dosewise.session import materialize

COSINE, RECALL = 0.95, 0.99
#: Vectors per cell on average, sample rows per centroid and at most.
PER_CELL, SAMPLE_PER_CENTROID, SAMPLE = 32, 64, 40_000
#: For the number of cells: of the sample, one row in so many; turns per row, and at least in all.
HELD_OUT, TURNS, LEAST_TURNS = 8, 4, 2000
#: First cells of all rows that are traversed at once, which bounds the memory.
FIRST_CELLS = 1 << 16
ROUNDS = 8
SIDE = 2048


def clean(vectors: list, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of the usable vectors, scaled to length 1, and their places in the list.

    Usable ones have ``dimension`` components, all of them finite, and a length above 0.
    """
    rows, places = [], []
    for i, v in enumerate(vectors):
        if not v or len(v) != dimension or None in v:
            continue
        x = np.array(v, np.float64)
        scale = np.abs(x).max()
        if np.isfinite(x).all() and scale > 0:
            x = x / scale
            rows.append(x / math.sqrt(x @ x))
            places.append(i)
    return (np.array(rows) if rows else np.empty((0, 0))), np.array(places, np.int64)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids by Lloyd's steps from evenly spaced rows; an empty one keeps its place."""
    centroids = x[np.arange(k) * len(x) // k].copy()
    for _ in range(ROUNDS):
        near = distances(x, centroids).argmin(axis=1)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centroids


@dataclass
class Grid:
    left: np.ndarray
    right: np.ndarray
    visits: int = 1

    @property
    def dimension(self) -> int:
        return self.left.shape[1] + self.right.shape[1]

    def traverse(self, x: np.ndarray, visits: int) -> np.ndarray:
        """Cells in the multi-sequence order, the first ``visits`` of each row.

        With both lists of distances sorted, a pair of places (a, b) comes after at least (a + 1)(b + 1) - 1 others, so
        only pairs with a product of at most ``visits`` can be among the first.
        """
        h, k = self.left.shape[1], len(self.right)
        visits = min(visits, len(self.left) * k)
        d = [distances(x[:, :h], self.left), distances(x[:, h:], self.right)]
        order = [np.argsort(m, axis=1, kind="stable")[:, :visits] for m in d]
        d = [np.take_along_axis(m, o, axis=1) for m, o in zip(d, order)]
        a, b = np.meshgrid(np.arange(order[0].shape[1]), np.arange(order[1].shape[1]), indexing="ij")
        possible = (a + 1) * (b + 1) <= visits
        a, b = a[possible], b[possible]
        total = d[0][:, a] + d[1][:, b]
        first = np.argsort(total, axis=1, kind="stable")[:, :visits]
        cells = order[0][:, a].astype(np.int64) * k + order[1][:, b]
        return np.take_along_axis(cells, first, axis=1)


def visits_needed(grid: Grid, x: np.ndarray, homes: np.ndarray) -> int:
    """Cells to visit so that a share ``RECALL`` of the rows meets its cell in ``homes``; all cells at most.

    The first cells of the rows that have not met theirs are doubled until enough have.
    """
    every = len(grid.left) * len(grid.right)
    ranks = np.full(len(x), every)
    wanted = math.ceil(RECALL * (len(x) - 1))  # place in the ascending ranks
    open_ = np.arange(len(x))
    visits = min(64, every)
    while True:
        for rows in np.array_split(open_, math.ceil(len(open_) * visits / FIRST_CELLS)):
            seen = grid.traverse(x[rows], visits) == homes[rows]
            ranks[rows[seen.any(axis=1)]] = seen.argmax(axis=1)[seen.any(axis=1)] + 1
        open_ = np.flatnonzero(ranks > visits)
        if len(x) - len(open_) > wanted or visits == every:
            return int(np.sort(ranks)[wanted])
        visits = min(2 * visits, every)


def fit(x: np.ndarray, n: int) -> Grid:
    """The grid of a sample of the ``n`` vectors, in an order that has nothing to do with them, with the number of cells to visit."""
    held = x[HELD_OUT - 1 :: HELD_OUT]
    x = x[np.arange(len(x)) % HELD_OUT != HELD_OUT - 1]
    k = max(1, min(len(x), max(4, math.ceil(math.sqrt(n / PER_CELL)))))
    half = x.shape[1] // 2
    grid = Grid(k_means(x[:, :half], k), k_means(x[:, half:], k))
    if not len(held):
        grid.visits = k * k
        return grid
    rng = np.random.Generator(np.random.PCG64(6))
    chosen = held[:: max(1, len(held) // 500)]
    starts, homes = [], []
    for _ in range(max(TURNS, math.ceil(LEAST_TURNS / len(chosen)))):
        side = rng.normal(size=chosen.shape)
        side -= (side * chosen).sum(axis=1)[:, None] * chosen
        norm = np.sqrt((side * side).sum(axis=1))[:, None]
        turned = COSINE * chosen + math.sqrt(1 - COSINE**2) * side / np.maximum(norm, 1e-300)
        starts.append(chosen)
        homes.append(grid.traverse(turned, 1))
    grid.visits = visits_needed(grid, np.concatenate(starts), np.concatenate(homes))
    return grid


def _assign(batches: Iterator[pa.RecordBatch], grid: Grid) -> Iterator[pa.RecordBatch]:
    """The usable vectors with the cells that they visit; they are indexed in the first."""
    rows = max(1, min(1024, FIRST_CELLS // grid.visits))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            x, places = clean(part.column("embedding").to_pylist(), grid.dimension)
            if not len(x):
                continue
            cells = grid.traverse(x, grid.visits)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(places)),
                    pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())),
                    pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), cells.shape[1]).cast(pa.list_(pa.int64())),
                ],
                names=["vec_id", "unit", "cells"],
            )


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between two sides, as ids."""
    edges: list[tuple[int, int]] = []
    free_rows, free_columns = linked.any(axis=1), linked.any(axis=0)
    for seed in np.flatnonzero(free_rows).tolist():
        if not free_rows[seed]:
            continue
        free_rows[seed] = False
        waiting = [seed]
        while waiting:
            i = waiting.pop()
            found = np.flatnonzero(linked[i] & free_columns)
            free_columns[found] = False
            for j in found.tolist():
                edges.append((int(rows[i]), int(columns[j])))
                others = np.flatnonzero(linked[:, j] & free_rows)
                free_rows[others] = False
                edges += [(int(rows[o]), int(columns[j])) for o in others.tolist()]
                waiting += others.tolist()
    return edges


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _compare(queries: pa.Table, indexed: pa.Table) -> pa.Table:
    """``(a, null, number of links)`` of queries, and of indexed vectors with queries they do not visit; edges ``(a, b, 0)``."""
    if not queries.num_rows or not indexed.num_rows:
        return _FOUND.empty_table()
    sides = []
    for table in (queries, indexed):
        flat = table.column("unit").combine_chunks().flatten().to_numpy()
        sides.append((table.column("vec_id").to_numpy(), flat.reshape(table.num_rows, -1)))
    (q, x), (i, y) = sides
    linked = (x @ y.T >= COSINE) & (q[:, None] != i[None, :])
    if not linked.any():
        return _FOUND.empty_table()
    homes, home = np.unique(queries.column("home").to_numpy(), return_inverse=True)
    cells = indexed.column("cells").combine_chunks().flatten().to_numpy().reshape(indexed.num_rows, -1)
    place = np.minimum(np.searchsorted(homes, cells), len(homes) - 1)
    row, column = np.nonzero(homes[place] == cells)
    visited = np.zeros((len(i), len(homes)), bool)
    visited[row, place[row, column]] = True
    ids = np.concatenate([q, i])
    n = np.concatenate([linked.sum(axis=1), (linked & ~visited[:, home].T).sum(axis=0)])
    edges = forest(linked, q, i)
    a = np.concatenate([ids[n > 0], np.array([e[0] for e in edges], np.int64)])
    b = pa.array([None] * int((n > 0).sum()) + [e[1] for e in edges], pa.int64())
    counts = np.concatenate([n[n > 0], np.zeros(len(edges), np.int64)])
    return pa.Table.from_arrays([pa.array(a), b, pa.array(counts)], schema=_FOUND)


def sample(vectors: DataFrame, n: int) -> np.ndarray:
    """At most ``SAMPLE`` usable unit vectors, chosen by a hash of the id."""
    wanted = min(SAMPLE, SAMPLE_PER_CENTROID * max(4, math.ceil(math.sqrt(n / PER_CELL))))
    share = min(1.0, 1.2 * wanted / n)
    place = F.xxhash64(F.lit(6), "vec_id")
    rows = vectors.filter(F.pmod(place, F.lit(1_000_000)) < 1_000_000 * share).select("embedding", place.alias("place"))
    found = sorted(rows.collect(), key=lambda r: r["place"])[:SAMPLE]
    lengths = [len(r["embedding"]) for r in found if r["embedding"]]
    usual = max(sorted(set(lengths)), key=lengths.count) if lengths else 0
    return clean([r["embedding"] for r in found], usual)[0]


def linked_vectors(table: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``table(vec_id, embedding)``."""
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    vectors = rows.filter("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n = rows.count()
    x = sample(vectors, n) if n else np.empty((0, 0))
    if x.size:
        # A sample of one row, or of vectors of one component, has a grid too: an empty left half has distance 0.
        grid = fit(x, n)
    else:
        grid = Grid(np.zeros((1, 0)), np.zeros((1, 0)))  # no vector has this dimension
    schema = "vec_id bigint, unit array<double>, cells array<bigint>"
    placed = materialize(vectors.mapInArrow(partial(_assign, grid=grid), schema), "index-cells")
    indexed = placed.selectExpr("cells[0] as cell", "vec_id", "unit", "cells")
    visiting = placed.selectExpr("explode(cells) as cell", "vec_id", "unit", "cells[0] as home")

    inside = indexed.groupBy("cell").agg(F.count("*").alias("n"))
    visits = visiting.groupBy("cell").agg(F.count("*").alias("m"))
    blocks = inside.join(visits, "cell").selectExpr("cell", f"(n - 1) div {SIDE} as last_i", f"(m - 1) div {SIDE} as last_q")
    blocks = materialize(blocks, "index-blocks")
    own = "pmod(xxhash64(vec_id), {} + 1)"
    keys = ["cell", "i", "q"]
    left = visiting.join(blocks, "cell").selectExpr(
        "cell", "explode(sequence(0L, last_i)) as i", own.format("last_q") + " as q", "vec_id", "unit", "home"
    )
    right = indexed.join(blocks, "cell").selectExpr(
        "cell", own.format("last_i") + " as i", "explode(sequence(0L, last_q)) as q", "vec_id", "unit", "cells"
    ).toDF("cell", "i", "q", "vec_id", "unit", "cells")  # columns of its own, as both sides come from one table
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compare, "a bigint, b bigint, n bigint")
    found = materialize(found, "index-found")
    counts = found.filter("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    components = connected(found.filter("b is not null").select("a", "b"), "index")
    placed = rows.drop("embedding").join(counts, "vec_id", "left")
    placed = placed.join(components.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return placed.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"),
    )


def op6_inverted_multi_index(spark, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return linked_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
