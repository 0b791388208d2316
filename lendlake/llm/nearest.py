"""Nearest neighbours through low-dimensional stable projections in a kd-tree.

Vectors are projected on a few Gaussian directions. Squared projected distance over squared true
distance follows a chi-square law with as many degrees of freedom, whatever the data. So neighbours
are met in order of projected distance and verified by their true one, until the next projected
distance r passes the test: a vector as near as the k-th best, d, would lie within r with
probability ``certainty``, that is r >= d * sqrt(quantile). Each true neighbour is found with at
least that probability.

The upper kd-tree is fitted on a bounded sample and cuts the projected space into cells; every vector
is indexed in its cell, and cells with many rows, also rows all alike, are split by hash. A query
first searches one part of its own cell, which bounds d, then every part of each cell within the
radius that d allows. Inside a part a kd-tree of small leaves gives the order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendlake.llm.shared import stored

LEAF_ROWS = 32


@dataclass(frozen=True)
class Search:
    """``sample_rows``: rows, about, that the upper tree is fitted on. ``part_rows``: rows of a
    part of a cell, about. ``axes`` must be even."""

    k: int = 10
    axes: int = 8
    certainty: float = 0.97
    sample_rows: int = 20_000
    part_rows: int = 8_192
    seed: int = 7


def chi_square_quantile(p: float, freedom: int) -> float:
    """The quantile for an even number of degrees of freedom, where the law has a finite sum."""
    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, freedom // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total
    low, high = 0.0, 10.0 * freedom + 100
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


class Cells:
    """The upper kd-tree: splits of a sample at medians of the widest axis."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        axes = points.shape[1]
        self.nodes: list[tuple[int, float, int, int]] = []  # axis, cut, below, above; leaf: -1, 0, cell
        self.low, self.high = [], []
        self._grow(points, np.full(axes, -np.inf), np.full(axes, np.inf), cells)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _grow(self, points: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, len(self.low), 0))
        widths = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(len(low))
        axis = int(np.argmax(widths))
        if cells < 2 or len(points) < 2 or widths[axis] == 0:
            self.low.append(low)
            self.high.append(high)
            return at
        cut = float(np.median(points[:, axis]))
        below = points[:, axis] < cut
        if not below.any():
            cut = float(points[points[:, axis] > cut, axis].min())
            below = points[:, axis] < cut
        upto, beyond = high.copy(), low.copy()
        upto[axis] = beyond[axis] = cut
        one = self._grow(points[below], low, upto, cells // 2)
        two = self._grow(points[~below], beyond, high, cells - cells // 2)
        self.nodes[at] = (axis, cut, one, two)
        return at

    def cell_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            axis, cut, one, two = self.nodes[node]
            if axis < 0:
                out[rows] = one
                continue
            below = points[rows, axis] < cut
            todo += [(one, rows[below]), (two, rows[~below])]
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """From a projected point to each cell."""
        away = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return np.sqrt((away ** 2).sum(axis=1))


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree over the points of a part."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF_ROWS:
            out.append(rows)
            continue
        here = points[rows]
        axis = int(np.argmax(here.max(axis=0) - here.min(axis=0)))
        half = len(rows) // 2
        order = np.argpartition(here[:, axis], half)
        todo += [rows[order[:half]], rows[order[half:]]]
    return out


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(-1, width)


def _searched(queries: pd.DataFrame, part: pd.DataFrame, size: int, search: Search) -> pd.DataFrame:
    """The k nearest of a part for each query, within what its bound allows."""
    quantile = chi_square_quantile(search.certainty, search.axes)
    vectors, points = _matrix(part["vector"], size), _matrix(part["point"], search.axes)
    ids = part["vec_id"].to_numpy()
    leaves = _leaves(points)
    low = np.array([points[r].min(axis=0) for r in leaves])
    high = np.array([points[r].max(axis=0) for r in leaves])
    wanted, places = _matrix(queries["vector"], size), _matrix(queries["point"], search.axes)
    out = []
    for query, vector, point, bound in zip(queries["vec_id"], wanted, places, queries["bound"]):
        away = np.maximum(0, np.maximum(low - point, point - high))
        away = (away ** 2).sum(axis=1)
        order = np.argsort(away)
        best_d, best_id = np.zeros(0), np.zeros(0, dtype=np.int64)
        step, at = 4, 0
        while at < len(order):
            reach = bound ** 2 * quantile * (1 + 1e-9) + 1e-12  # the test; rounding never fails it
            if away[order[at]] > reach:
                break
            met = np.concatenate([leaves[x] for x in order[at:at + step]])
            met = met[ids[met] != query]
            met = met[((points[met] - point) ** 2).sum(axis=1) <= reach]
            true = np.sqrt(((vectors[met] - vector) ** 2).sum(axis=1))
            best_d, best_id = np.concatenate([best_d, true]), np.concatenate([best_id, ids[met]])
            kept = np.lexsort((best_id, best_d))[:search.k]
            best_d, best_id = best_d[kept], best_id[kept]
            if len(kept) == search.k:
                bound = min(bound, best_d[-1])
            at += step
            step = min(64, step * 2)
        out.append(pd.DataFrame({"query_id": query, "vec_id": best_id, "score": best_d}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest_neighbours(vectors: DataFrame, is_query: Column, search: Search = Search(),
                       id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance in double precision) of each
    query's k nearest rows found, nearest first, ties to the smaller id.

    Queries are rows for which ``is_query`` holds; rows with a query's own id are no candidates of
    it. With fewer than k candidates all are returned. Vectors that are null, zero, hold null or
    non-finite components or have another length than most, and rows with null ids, take no part.
    Of rows that repeat a query's id one is searched for, by a hash of its vector; as candidates
    repeated rows count each. Other columns play no part. An empty table gives an empty result.
    """
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    spark = vectors.sparkSession
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], empty)
    size, total = int(lengths[0]), int(lengths[1])
    rows = rows.where(F.size("vector") == size)
    directions = np.random.default_rng(search.seed).standard_normal((size, search.axes))

    share = min(1.0, search.sample_rows / total)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.lit(share * (1 << 40))).select(
        "vector").toPandas()["vector"]
    points = np.array(sample.to_list(), dtype=np.float64).reshape(-1, size) @ directions
    cells = Cells(points, max(1, min(-(-total // search.part_rows), len(points) // 16)))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            wide = wide.reshape(-1, size)
            # Sums in a fixed order, so that equal vectors have equal projections.
            points = np.einsum("ij,jk->ik", wide, directions)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in wide], type=pa.binary()),
                 batch.column(2), pa.array([x.tobytes() for x in points], type=pa.binary()),
                 pa.array(cells.cell_of(points))], ["vec_id", "vector", "asks", "point", "cell"])

    index = stored(rows.mapInArrow(
        indexed, "vec_id bigint, vector binary, asks boolean, point binary, cell bigint"), "vectors")
    sizes = {r[0]: r[1] for r in index.groupBy("cell").count().collect()}
    parts = {c: -(-n // search.part_rows) for c, n in sizes.items()}
    n_parts = F.element_at(F.array(*[F.lit(parts.get(c, 1)) for c in range(len(cells.low))]),
                           F.col("cell").cast("int") + 1)
    index = index.withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), n_parts))
    once = Window.partitionBy("vec_id").orderBy(F.xxhash64("vector"), "vector")
    queries = index.where("asks").withColumn("i", F.row_number().over(once)).where("i = 1").select(
        "vec_id", "vector", "point", "cell", "part", F.lit(float("inf")).alias("bound"))

    def searched(asked: DataFrame) -> DataFrame:
        def run(asked: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(part):
                return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
            return _searched(asked, part, size, search)

        keys = ("cell", "part")
        return asked.groupBy(*keys).cogroup(
            index.select("vec_id", "vector", "point", *keys).groupBy(*keys)).applyInPandas(
            run, "query_id bigint, vec_id bigint, score double")

    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    first = stored(searched(queries), "near-home")
    bounds = first.withColumn("i", F.row_number().over(by_query)).where(F.col("i") == search.k).select(
        "query_id", F.col("score").alias("at_home"))
    reach = math.sqrt(chi_square_quantile(search.certainty, search.axes))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = batch.column(5).to_numpy(zero_copy_only=False)
            home, at = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            row, cell, part = [], [], []
            for i, point in enumerate(batch.column(2).to_pylist()):
                away = cells.distances(np.frombuffer(point))
                for c in np.flatnonzero(away <= bound[i] * reach * (1 + 1e-9) + 1e-6):
                    for p in range(parts.get(int(c), 0)):
                        if (c, p) != (home[i], at[i]):
                            row.append(i)
                            cell.append(int(c))
                            part.append(p)
            taken = pa.array(row, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(taken), batch.column(1).take(taken),
                 batch.column(2).take(taken), pa.array(cell, type=pa.int64()),
                 pa.array(part, type=pa.int64()), batch.column(5).take(taken)],
                ["vec_id", "vector", "point", "cell", "part", "bound"])

    outward = queries.drop("bound").join(bounds, F.col("vec_id") == F.col("query_id"), "left").select(
        "vec_id", "vector", "point", "cell", "part",
        F.coalesce("at_home", F.lit(float("inf"))).alias("bound")).mapInArrow(
        visits, "vec_id bigint, vector binary, point binary, cell bigint, part bigint, bound double")
    found = first.unionByName(searched(outward))
    return found.withColumn("rank", F.row_number().over(by_query)).where(
        F.col("rank") <= search.k).select("query_id", F.col("rank").cast("int").alias("rank"),
                                          "vec_id", "score")
