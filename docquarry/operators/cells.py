"""Exact cosine top-k that scores only the cells of an index which can hold a result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.operators.search import _FOUND, QUERY_BLOCK, QUERY_BYTES, TOP_K, _local_top, _unit
from docquarry.sources.scratch import materialize, shared_dir

#: Cells at most, points that the pivots are fitted on at most, and rounds of fitting.
CELLS, SAMPLE, ROUNDS = 1024, 16384, 5
#: What floating point may do to an angle.
_SLACK = 1e-6


class CellIndex(NamedTuple):
    """``points`` (cell, point_id, _p, angle to the cell's pivot) in a folder a cell; of each cell pivot, least and greatest angle, rows."""

    points: DataFrame
    pivots: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray
    rows: np.ndarray


def _angles(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(left @ right.T, -1.0, 1.0))


def _fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Pivots of a sample of unit vectors: spherical means, from evenly spread members."""
    pivots = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        own = (sample @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), pivots)
    return pivots


def cell_index(points: DataFrame, dim: int, *, cells: int | None = None, sample: int = SAMPLE) -> CellIndex:
    """An index over the vectors of ``dim`` components of ``points`` (point_id, embedding); all of them are in it.

    Pivots (about the root of the number of points, CELLS at most) are fitted on ``sample`` points at most, chosen
    by a hash of the id: they decide how much is skipped and never what is found. Each point goes to the cell of
    the nearest pivot with its angle to it, and points are written by cells once, so that searches read only
    the cells they look into. A few numbers a cell reach the driver. Zero vectors are a cell of their own (the last).
    """
    fitting = points.where(F.size("embedding") == dim).select("point_id", F.col("embedding").alias("_p"))
    held = fitting.orderBy(F.xxhash64("point_id")).limit(sample).toPandas()["_p"]
    unit = _unit(held) if len(held) else np.zeros((0, dim))
    unit = unit[np.linalg.norm(unit, axis=1) > 0]
    wanted = cells or min(CELLS, max(1, int(np.sqrt(fitting.count()))))
    pivots = _fitted(unit, min(wanted, len(unit))) if len(unit) else np.zeros((0, dim))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = _unit(frame["_p"]) if len(frame) else np.zeros((0, dim))
            zero = np.linalg.norm(vectors, axis=1) == 0
            angles = _angles(vectors, pivots) if len(pivots) else np.zeros((len(frame), 1))
            cell = np.where(zero, len(pivots), angles.argmin(axis=1))
            yield frame.assign(angle=np.where(zero, 0.0, angles.min(axis=1)), cell=cell.astype(np.int32))

    placed = fitting.mapInPandas(place, "point_id string, _p array<float>, angle double, cell int")
    path = f"{shared_dir(points.sparkSession)}/cells-{uuid.uuid4().hex}"
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(path)
    written = points.sparkSession.read.schema(placed.schema).parquet(path)
    n = len(pivots) + 1
    near, far, rows = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n, np.int64)
    for r in written.groupBy("cell").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count(F.lit(1)).alias("n")).collect():
        near[r["cell"]], far[r["cell"]], rows[r["cell"]] = r["lo"], r["hi"], r["n"]
    return CellIndex(written, pivots, near, far, rows)


class _Asked(NamedTuple):
    """A block of queries: ids, unit vectors, angles to the pivots, and the highest cosine that each cell can hold."""

    ids: np.ndarray
    unit: np.ndarray
    angles: np.ndarray
    bound: np.ndarray


def _asked(held: pd.DataFrame, index: CellIndex) -> _Asked:
    unit = _unit(held["embedding"])
    angles = _angles(unit, index.pivots) if len(index.pivots) else np.zeros((len(unit), 0))
    # Triangle inequality of angles: a point of the cell is at least so far from the query.
    least = np.maximum(np.maximum(angles - index.farthest[:-1], index.nearest[:-1] - angles), 0.0)
    bound = np.cos(np.maximum(least - _SLACK, 0.0))
    bound[np.linalg.norm(unit, axis=1) == 0] = 0.0  # a zero query has cosine 0 with all
    bound = np.concatenate((bound, np.zeros((len(unit), 1))), axis=1)
    bound[:, index.rows == 0] = -np.inf
    return _Asked(held["query_id"].to_numpy(np.int64), unit, angles, bound)


def _looked_into(index: CellIndex, asked: _Asked, visits: np.ndarray, k: int, floor: np.ndarray) -> DataFrame:
    """The k best of each query in the cells it visits; points whose angle to the pivot rules out a score of ``floor`` are passed over."""
    wanted = np.flatnonzero(visits.any(axis=0)).tolist()
    spark = index.points.sparkSession
    if not wanted:
        return spark.createDataFrame([], _FOUND)
    reach = np.arccos(np.clip(floor, -1.0, 1.0)) + _SLACK
    whole = np.linalg.norm(asked.unit, axis=1) == 0
    last = len(index.pivots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell, part in frame.groupby("cell"):
                queries = np.flatnonzero(visits[:, cell])
                if cell < last:
                    apart = np.abs(asked.angles[queries, cell][:, None] - part["angle"].to_numpy()[None, :])
                    inside = (apart <= reach[queries][:, None]) | whole[queries][:, None]
                    part, queries = part[inside.any(axis=0)], queries[inside.any(axis=1)]
                if not len(part) or not len(queries):
                    continue
                scores = np.round(asked.unit[queries] @ _unit(part["_p"]).T, 12)
                rows, cols = _local_top(asked.ids[queries], part["point_id"].to_numpy(str), scores, k)
                yield pd.DataFrame({"query_id": asked.ids[queries][rows], "point_id": part["point_id"].to_numpy()[cols], "score": scores[rows, cols]})

    return index.points.where(F.col("cell").isin(wanted)).mapInPandas(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("point_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cell_top_k(queries: DataFrame, index: CellIndex, k: int = TOP_K, *, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, float]:
    """The k points of highest cosine for each query (query_id, rank, point_id, score), as ``search.top_k`` gives them, and the share of pairs looked at.

    First each query looks into the nearest cells that hold k points together. Its k-th score there bounds the
    result: by the triangle inequality of angles to the pivots, only cells whose bound reaches that score can
    hold better ones (or ties), and of these only points whose own angle allows it are scored. Cells that no
    query needs are not read. Queries go along with the tasks in blocks of ``query_block`` (and QUERY_BYTES); points are
    never copied or shuffled for a block. Null queries and those of another size than the index's find nothing.
    """
    dim = index.pivots.shape[1]
    block = max(1, min(query_block, QUERY_BYTES // (8 * max(1, dim + 2 * len(index.rows)))))
    wanted = queries.where(F.size("embedding") == dim).select("query_id", "embedding")
    n = wanted.count()
    blocks = max(1, -(-n // block))
    dealt = materialize(wanted.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "cell-queries")
    found, looked = [], 0
    for b in range(blocks):
        held = dealt.where(F.col("_b") == b).toPandas()
        if not len(held):
            continue
        asked = _asked(held, index)
        order = np.argsort(-asked.bound, axis=1, kind="stable")
        before = np.cumsum(index.rows[order], axis=1) - index.rows[order]
        first = np.zeros(asked.bound.shape, bool)
        np.put_along_axis(first, order, before < k, axis=1)
        near = materialize(_best(_looked_into(index, asked, first, k, np.full(len(held), -1.0)), k), "cell-first")
        floor = pd.Series(-1.0, index=asked.ids)
        for r in near.where(F.col("rank") == k).select("query_id", "score").collect():
            floor[r["query_id"]] = r["score"]
        then = (asked.bound >= floor.to_numpy()[:, None] - 1e-9) & ~first & np.isfinite(asked.bound)
        found += [near.drop("rank"), _looked_into(index, asked, then, k, floor.to_numpy())]
        looked += int(((first | then) * index.rows).sum())
    spark = queries.sparkSession
    every = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _FOUND)
    return _best(every, k).select("query_id", "rank", "point_id", "score"), looked / max(1, n * int(index.rows.sum()))
