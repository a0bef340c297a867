"""Bulk retrieval: exact cosine top-k of a query table over a points table, and answers made of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Results a query, what joins their texts, and the answer without results.
TOP_K = 5
JOINER = "\n---\n"
NO_MATCH = "No wiki chunks matched the query."
#: Queries whose vectors may go along with a task; more are dealt out in blocks of this size.
QUERY_BLOCK = 2048
#: Bytes of query vectors that may go along with a task.
QUERY_BYTES = 32 << 20


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles, 0 if either vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot / (norm(a) * norm(b)))


def similarity_join(queries: DataFrame, points: DataFrame, *, query_block: int = 0) -> DataFrame:
    """All (query_id, point_id, score) of vectors of one size: no threshold, so as many rows as pairs, by its nature.

    Points are dealt into blocks once and each block meets every block of queries in one task, which multiplies them
    as matrices and hands on PAIR_ROWS pairs or so at a time: a task holds two blocks and one such batch, however
    many pairs there are.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("_v"))
    narrow = points.where(F.col("embedding").isNotNull()).select("point_id", F.col("embedding").alias("_v"))
    query_blocks, n = max(1, -(-asked.count() // (query_block or QUERY_BLOCK))), narrow.count()
    point_blocks = max(1, -(-n // PAIR_POINTS), min(4 * points.sparkSession.sparkContext.defaultParallelism, -(-n // 256)))
    block = lambda key, of: F.pmod(F.xxhash64(key, "_v"), F.lit(of)).cast("int")
    held = narrow.withColumn("_b", block("point_id", point_blocks)).repartition(point_blocks, "_b")
    held = held.groupBy("_b").agg(F.collect_list(F.struct("point_id", "_v")).alias("_points"))
    packed = asked.groupBy(block("query_id", query_blocks).alias("_q")).agg(F.collect_list(F.struct("query_id", "_v")).alias("_asked"))
    every = packed.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(point_blocks - 1)))).repartition(point_blocks, "_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, p in zip(batch.column(0), batch.column(1), strict=True):
                yield from _pairs(*q.values.flatten(), *p.values.flatten())

    return every.join(held, "_b").select("_asked", "_points").mapInArrow(run, _FOUND)


#: Points of one block where every pair is asked for, and pairs of one batch of results.
PAIR_POINTS, PAIR_ROWS = 4096, 1 << 18


def _pairs(query_ids: pa.Array, queries: pa.Array, point_ids: pa.Array, points: pa.Array, rows: int = PAIR_ROWS) -> Iterator[pa.RecordBatch]:
    """Every pair of vectors of one size, at most ``rows`` pairs or one query's in a batch."""
    sizes, lengths = (np.asarray(pc.list_value_length(v)) for v in (queries, points))
    for n in np.intersect1d(sizes, lengths):
        own, found = np.flatnonzero(sizes == n), np.flatnonzero(lengths == n)
        asked, held = (_normed(np.asarray(v.take(pa.array(at)).flatten(), np.float64).reshape(len(at), n)) for v, at in ((queries, own), (points, found)))
        ids, step = np.asarray(query_ids, np.int64)[own], max(1, rows // len(found))
        for begin in range(0, len(own), step):
            scores = np.round(asked[begin : begin + step] @ held.T, 12)
            columns = [pa.array(np.repeat(ids[begin : begin + step], len(found))), point_ids.take(pa.array(np.tile(found, len(scores)))), pa.array(scores.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "point_id", "score"])


def _unit(rows: pd.Series) -> np.ndarray:
    return _normed(np.stack([np.asarray(r, np.float64) for r in rows]))


def _normed(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _local_top(ids: np.ndarray, keys: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best of each row of ``scores``; ties at the border by key."""
    n = scores.shape[1]
    if n <= k:
        return np.repeat(np.arange(len(ids)), n), np.tile(np.arange(n), len(ids))
    border = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    rows, cols = np.nonzero(scores >= border)
    order = np.lexsort((keys[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[rank < k], cols[rank < k]


def top_k(queries: DataFrame, points: DataFrame, k: int = TOP_K, *, payload: bool = True, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k points of highest cosine for each query: query_id, rank, point_id, score (and source_path, text).

    ``queries``: query_id (long, unique), embedding; ``points``: point_id, embedding, source_path, text. Ties go
    to the smaller point_id. Vectors that are null or of another size than the query's do not match.

    Up to ``query_block`` queries of up to QUERY_BYTES together (both are counted first) go along with the
    tasks, and the points stay where they are. More queries and the points are both dealt into blocks by a hash, and each pair of blocks
    meets in one task. Either way blocks are multiplied as matrices, k rows a query and block go on to one
    window per query, and texts join at the end, for the k rows a query that are left.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding")
    narrow = points.where(F.col("embedding").isNotNull()).select("point_id", F.col("embedding").alias("_p"))
    n, components = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    blocks = max(-(-n // query_block), -(-8 * components // QUERY_BYTES))
    found = _meet_together(asked, narrow, k) if blocks <= 1 else _meet_in_blocks(asked, narrow, k, blocks)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("point_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if not payload:
        return ranked.select("query_id", "rank", "point_id", "score")
    return ranked.join(points.select("point_id", "source_path", "text"), "point_id").select("query_id", "rank", "point_id", "score", "source_path", "text")


_FOUND = "query_id long, point_id string, score double"
#: Points of one block, where blocks of queries and points meet.
POINT_BLOCK = 16384


def _matched(ids: np.ndarray, vectors: pd.Series, points: pd.DataFrame, k: int) -> Iterator[pd.DataFrame]:
    sizes, lengths = vectors.map(len).to_numpy(), points["_p"].map(len).to_numpy()
    for n in np.intersect1d(sizes, lengths):
        own, part = ids[sizes == n], points[lengths == n]
        scores = np.round(_unit(vectors[sizes == n]) @ _unit(part["_p"]).T, 12)
        rows, cols = _local_top(own, part["point_id"].to_numpy(str), scores, k)
        yield pd.DataFrame({"query_id": own[rows], "point_id": part["point_id"].to_numpy()[cols], "score": scores[rows, cols]})


def _meet_together(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    held = queries.toPandas()
    ids, vectors = held["query_id"].to_numpy(np.int64), held["embedding"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield from _matched(ids, vectors, frame, k)

    return points.mapInPandas(run, _FOUND)


def _meet_in_blocks(queries: DataFrame, points: DataFrame, k: int, query_blocks: int) -> DataFrame:
    point_blocks = max(1, -(-points.count() // POINT_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("_b", every(point_blocks))
    held = points.withColumn("_b", F.pmod(F.xxhash64("point_id"), F.lit(point_blocks)).cast("int")).withColumn("_q", every(query_blocks))

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        found = list(_matched(q["query_id"].to_numpy(np.int64), q["embedding"], p, k)) if len(q) and len(p) else []
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "point_id": np.empty(0, str), "score": np.empty(0)})
        return pd.concat(found) if found else empty

    return asked.groupBy("_q", "_b").cogroup(held.groupBy("_q", "_b")).applyInPandas(run, _FOUND)


def answer_texts(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id and answer: the ranked texts joined, or the note that nothing matched."""
    joined = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_t"))
    answer = F.array_join(F.col("_t.text"), JOINER)
    return queries.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce(answer, F.lit(NO_MATCH)).alias("answer"))


def search(queries: DataFrame, points: DataFrame, k: int = TOP_K) -> DataFrame:
    """Answers of a query table (query_id, embedding)."""
    return answer_texts(queries, top_k(queries, points, k))


#: Answers (query_id, answer) of a table of missed queries (query_id, query).
SearchProvider = Callable[[DataFrame], DataFrame]
