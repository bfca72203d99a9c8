"""Exact top-k search by inner product as a Voronoi join.

Components become floor(scale * x). Data vectors get one more component, sqrt(longest**2 - |x|**2), and queries a zero, so
that the largest inner product is the smallest distance. Pivots, drawn from the data by a hash of their id, split both sides
into cells by the nearest pivot. Each data cell is summed up by its size, smallest and largest distance to the pivot and its
k + 1 smallest distances. From these summaries alone every query gets a bound that its k-th neighbour cannot exceed, and
each query cell the largest bound of its queries. A data vector is sent to the cells whose bound it may meet, by the
triangle inequality and the border plane between two cells; nothing else moves. Cells with much work are dealt to several
tasks, by blocks of queries times slices of data; each solves its share, and the best k of all shares are kept.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Shorter vectors count
as padded with zeros. Rows that repeat an id are each a candidate; a query's own id is none. Ties go to the smaller id.
Sums are exact: in floating point while they stay below 2**53, else in 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import only
from weftline.session import written

#: Queries of one block and data vectors of one slice that a task solves at a time.
BLOCK, SLICE = 1024, 8192
#: Distances carry rounding; bounds are widened by this share.
SLACK = 1e-9


def _vectors(column: pa.Array) -> list[np.ndarray]:
    values = np.asarray(column.values if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().values)
    offsets = column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for row, v in zip(out, _vectors(column)):
        row[: len(v)] = v
    return out


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id and the whole numbers of each vector that takes part, with its squared length."""
    v = F.col("v")
    whole = (
        only(rows, id_col, vector_col)
        .select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
        .filter(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    )
    q = whole.select("id", F.transform("v", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")).alias("v"))
    return q.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


class Cells:
    """The pivots and what the summaries say of the data cells."""

    def __init__(self, pivots: np.ndarray, longest2: float, dim: int):
        self.pivots, self.longest2, self.dim = pivots, longest2, dim  # pivots with their extra component
        self.norms = (pivots**2).sum(axis=1)
        self.apart = np.sqrt(np.maximum(self.norms[:, None] + self.norms[None] - 2 * pivots @ pivots.T, 0))
        self.wide = SLACK * (1 + float(np.sqrt(4 * longest2)))

    def lift(self, x: np.ndarray, norm2: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest2 - norm2, 0))
        return np.concatenate([x, extra[:, None]], axis=1)

    def distances(self, x: np.ndarray, norm2: np.ndarray, query: bool) -> np.ndarray:
        own = norm2 if query else np.full(len(x), self.longest2)
        return np.sqrt(np.maximum(own[:, None] + self.norms[None] - 2 * self.lift(x, norm2, query) @ self.pivots.T, 0))

    def bounds(self, d: np.ndarray, near: list[np.ndarray], k: int) -> np.ndarray:
        """For each query, with distances d to the pivots, a distance within which k + 1 data vectors surely lie (infinite if there are fewer)."""
        out = np.full(len(d), np.inf)
        cell = np.concatenate([np.full(len(x), j) for j, x in enumerate(near)]).astype(int)
        far = np.concatenate(near)
        for a in range(0, len(d), 256):
            reach = d[a : a + 256][:, cell] + far
            if reach.shape[1] > k:
                out[a : a + 256] = np.partition(reach, k, axis=1)[:, k]
        return out


def top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, pivots: int = 128, block: int = BLOCK, slice_: int = SLICE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of ``rows`` for each of ``queries``, which has the same columns."""
    data = written(quantised(rows, id_col, vector_col, scale), "knn-data")
    asked = written(quantised(queries, id_col, vector_col, scale), "knn-queries")
    empty = data.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = data.unionByName(asked).agg(F.max(F.size("v")).alias("dim"), F.max("norm2").alias("longest2"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).first()
    drawn = data.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(pivots).select("v", "norm2").toArrow()
    if not drawn.num_rows or not size.dim:
        return empty
    dim, exact = size.dim, size.dim * size.largest**2 < 2.0**53
    centre = Cells(np.zeros((1, dim + 1)), size.longest2, dim)
    column = drawn["v"].combine_chunks()
    points = np.unique(centre.lift(_matrix(column, dim), drawn["norm2"].to_numpy(), False), axis=0)
    plain = (points, float(size.longest2), dim)

    def dealt(query: bool):
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = Cells(*plain)
            for part in parts:
                d = cells.distances(_matrix(part.column(1), dim), part.column(2).to_numpy(), query)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "v", "norm2", "cell", "far"])

        return run

    ddl = "id long, v array<double>, norm2 double, cell int, far double"
    data = written(data.mapInArrow(dealt(False), ddl), "knn-cells")
    asked = written(asked.mapInArrow(dealt(True), ddl), "knn-asked")

    def nearest(frame: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k + 1 smallest distances of each cell in this task's rows."""
        best: dict[int, np.ndarray] = {}
        for part in frame:
            cell, far = part.column(0).to_numpy(), part.column(1).to_numpy()
            for c in np.unique(cell).tolist():
                best[c] = np.sort(np.concatenate([best.get(c, np.empty(0)), far[cell == c]]))[: k + 1]
        if best:
            cells = np.concatenate([np.full(len(v), c, np.int32) for c, v in best.items()])
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.concatenate([*best.values()]))], ["cell", "far"])

    summary = {r.cell: r for r in data.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect()}
    by_far = Window.partitionBy("cell").orderBy("far")
    few = data.select("cell", "far").mapInArrow(nearest, "cell int, far double").withColumn("r", F.row_number().over(by_far)).filter(F.col("r") <= k + 1)
    near: dict[int, list[float]] = {}
    for r in few.select("cell", "far").collect():  # k + 1 rows a cell
        near.setdefault(r.cell, []).append(r.far)
    count = len(points)
    close = [np.array(sorted(near.get(j, []))) for j in range(count)]
    high = np.array([summary[j].high if j in summary else -np.inf for j in range(count)])
    rows_in = np.array([summary[j].n if j in summary else 0 for j in range(count)])

    def bounded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(*plain)
        for part in parts:
            d = cells.distances(_matrix(part.column(1), dim), part.column(2).to_numpy(), True)
            theta = cells.bounds(d, close, k)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(theta)], ["id", "v", "norm2", "cell", "far", "theta"])

    asked = written(asked.mapInArrow(bounded, f"{ddl}, theta double"), "knn-bounds")
    groups = {r.cell: r for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("high"), F.max("theta").alias("theta")).collect()}
    own = np.array(sorted(groups))
    if not len(own):
        return empty
    radius = np.array([groups[g].high for g in own])
    theta = np.array([groups[g].theta for g in own])
    blocks = np.array([-(-groups[g].n // block) for g in own])

    def reaches(cells: Cells, cell: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Which query cells each data vector (its cell, its distances to the pivots) may hold neighbours for.

        A query q of a cell with pivot p lies within ``radius`` of it, so |o - q| >= |o - p| - radius; and if o's own pivot is
        another one, o lies beyond the border plane or as far from q as the plane is from o.
        """
        direct = d[:, own] - radius
        apart = np.maximum(cells.apart[cell][:, own], 1e-300)
        plane = np.where(cell[:, None] == own, 0, (d[:, own] ** 2 - d[np.arange(len(d)), cell][:, None] ** 2) / (2 * apart))
        return np.maximum(direct, plane) <= theta + cells.wide

    # Slices by what a cell can receive at most: the data of all cells that touch its bound.
    cells = Cells(*plain)
    may = cells.apart[:, own] - high[:, None] - radius <= theta + cells.wide
    slices = np.maximum(1, -(-(rows_in @ may) // slice_)).astype(int)

    def sent(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(*plain)
        for part in parts:
            for a in range(0, part.num_rows, 2048):
                p = part.slice(a, 2048)
                d = cells.distances(_matrix(p.column(1), dim), p.column(2).to_numpy(), False)
                row, group = np.nonzero(reaches(cells, p.column(3).to_numpy(), d))
                slot = (p.column(0).to_numpy()[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % slices[group]
                times = blocks[group]
                row, group, slot = np.repeat(row, times), np.repeat(group, times), np.repeat(slot, times)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                taken = p.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (group, nth, slot)] + [taken.column(0), taken.column(1)], ["g", "b", "s", "id", "v"])

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(g): i for i, g in enumerate(own)}
        for part in parts:
            group = np.array([place[c] for c in part.column(3).to_pylist()], np.int64)
            nth = (part.column(0).to_numpy().astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(33)).astype(np.int64) % blocks[group] if part.num_rows else group
            times = slices[group]
            row = np.repeat(np.arange(part.num_rows), times)
            slot = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            taken = part.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (group[row], nth[row], slot)] + [taken.column(0), taken.column(1)], ["g", "b", "s", "id", "v"])

    def solve(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks) and len(held):
            kind = np.float64 if exact else np.int64
            matrix = lambda frame: np.stack([np.pad(v, (0, dim - len(v))) for v in frame["v"]]).astype(kind)
            order = np.argsort(held["id"].to_numpy(), kind="stable")
            ids, x = held["id"].to_numpy()[order], matrix(held)[order]
            for a in range(0, len(asks), 256):
                part = asks.iloc[a : a + 256]
                scores = matrix(part) @ x.T
                for q, score in zip(part["id"].to_numpy(), scores):
                    other = np.flatnonzero(ids != q)
                    score = score[other]
                    if len(other) > k:
                        least = np.partition(score, len(score) - k)[len(score) - k]
                        pick = np.flatnonzero(score >= least)
                    else:
                        pick = np.arange(len(other))
                    pick = pick[np.argsort(-score[pick], kind="stable")][:k]
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids[other[pick]], "score": score[pick].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    where = "g int, b int, s int, id long, v array<double>"
    held = data.mapInArrow(sent, where).groupBy("g", "b", "s")
    found = asked.select("id", "v", "norm2", "cell").mapInArrow(spread, where).groupBy("g", "b", "s").cogroup(held).applyInPandas(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
