"""Exact top-k search (operator 5) on a bit-sliced index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.llm.common import materialize

#: Rows of an index block, and queries of a query block.
INDEX_ROWS, QUERY_ROWS = 8192, 512
_DIGIT = 6
_LOW = (1 << _DIGIT) - 1


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a long, x as double; null if the vector takes no part. What is no long is an error."""
    usable = (F.size(vector) > 0) & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    )
    scaled = lambda x: x.cast("double") * F.lit(float(scale))
    too_large = F.raise_error(F.lit(f"a component times {scale} is no 64-bit integer")).cast("long")
    return F.when(usable, F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < F.lit(float(1 << 63)), F.floor(scaled(x)).cast("long")).otherwise(too_large)))


def slices_of(values: np.ndarray) -> np.ndarray:
    """Bit slices [columns, bits, words] of integers [rows, columns] in two's complement, least bit first."""
    rows, columns = values.shape
    top = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1, 0)
    bits = top.bit_length() + 1
    words = (rows + 63) // 64
    padded = np.zeros((words * 64, columns), np.int64)
    padded[:rows] = values
    planes = (padded.T[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.ascontiguousarray(np.packbits(planes.astype(np.uint8), axis=-1, bitorder="little")).view(np.uint64)


def _sum_into(out: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """out = a + b of bit-sliced [..., bits, words] with as many bits, by ripple carry."""
    carry = np.zeros((*a.shape[:-2], a.shape[-1]), np.uint64)
    for k in range(a.shape[-2]):
        x, y = a[..., k, :], b[..., k, :]
        half = x ^ y
        both = x & y
        np.bitwise_xor(half, carry, out=out[..., k, :])
        carry &= half
        carry |= both


def _multiples(sliced: np.ndarray, most: int, width: int) -> np.ndarray:
    """0 to ``most`` times each column: [most + 1, columns, width, words]."""
    columns, bits, words = sliced.shape
    wide = np.concatenate((sliced, np.repeat(sliced[:, -1:], width - bits, axis=1)), axis=1)  # the sign slice repeats
    table = np.zeros((most + 1, columns, width, words), np.uint64)
    for f in range(1, most + 1):
        _sum_into(table[f], table[f - 1], wide)
    return table


def block_scores(sliced: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Bit-sliced inner products of all rows with each query: slices [bits, words], and a number to add to all.

    The digits (base 64) of a query's component pick a multiple of the column's slices, which goes into a
    carry-save pair of bit-sliced numbers, at the digit's place; a negative component adds the inverse,
    which is one too low. The pair is summed at the end.
    """
    columns, bits, words = sliced.shape
    size = np.abs(queries)
    digits = max(1, -(-int(size.max(initial=0)).bit_length() // _DIGIT))
    width = bits + max((sum(row).bit_length() for row in size.tolist()), default=0) + 2
    table = _multiples(sliced, int(((size[:, :, None] >> (_DIGIT * np.arange(digits))) & _LOW).max(initial=0)), width)
    s, t, u, x = (np.empty((width, words), np.uint64) for _ in range(4))
    carries = np.zeros((width + 1, words), np.uint64)  # row k + 1 takes the carry of row k
    for query, magnitude in zip(queries.tolist(), size.tolist(), strict=True):
        s[:] = 0
        carries[:] = 0
        below = 0
        for column, (factor, left) in enumerate(zip(query, magnitude, strict=True)):
            place = 0
            while left:
                digit, left = left & _LOW, left >> _DIGIT
                if digit:
                    at = place * _DIGIT
                    operand = table[digit, column, : width - at]
                    if factor < 0:
                        operand = np.invert(operand, out=x[: width - at])
                        below += 1 << at
                    sa, ca, ta, ua = s[at:], carries[at:-1], t[at:], u[at:]
                    np.bitwise_xor(sa, ca, out=ta)
                    np.bitwise_and(sa, ca, out=ua)
                    np.bitwise_xor(ta, operand, out=sa)
                    np.bitwise_and(ta, operand, out=ta)
                    np.bitwise_or(ua, ta, out=carries[at + 1 :])
                    carries[at] = 0
                place += 1
        total = np.empty((width, words), np.uint64)
        _sum_into(total, s, carries[:-1])
        yield total, below


def top_rows(score: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Rows (bitmap) that can be among the k highest scores, from the most significant slice downward.

    ``score`` is [bits, words] in two's complement; ``valid`` marks the rows that take part. ``sure`` holds
    rows known to be in; ``open_`` those equal to the boundary so far. Rows that end equal to the k-th
    score all stay, so that ties are settled exactly afterwards.
    """
    sure, open_ = np.zeros_like(valid), valid.copy()
    for bit in range(len(score) - 1, -1, -1):
        ones = ~score[bit] if bit == len(score) - 1 else score[bit]  # the sign slice counts reversed
        high = open_ & ones
        n = int(np.bitwise_count(sure | high).sum())
        if n > k:
            open_ = high
        elif n == k:
            return sure | high
        else:
            sure |= high
            open_ &= ~ones
    return sure | open_


def _scores_at(score: np.ndarray, rows: np.ndarray, below: int = 0) -> np.ndarray:
    """The numbers at ``rows``, plus ``below``; an error if one is no 64-bit integer."""
    bits = (score[:, rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)
    n = len(bits)
    if n <= 62:
        weight = np.left_shift(np.int64(1), np.arange(n, dtype=np.int64))
        weight[-1] = -weight[-1]
        return (bits.astype(np.int64) * weight[:, None]).sum(axis=0) + below
    whole = [sum(1 << k for k, bit in enumerate(column[:-1]) if bit) - (column[-1] << (n - 1)) + below for column in bits.T.tolist()]
    if any(not -(1 << 63) <= x < 1 << 63 for x in whole):
        raise OverflowError("an inner product among the highest of a block is no 64-bit integer")
    return np.array(whole, np.int64)


def _index_block(group: pd.DataFrame) -> pd.DataFrame:
    values = np.stack(group["values"].to_numpy()).astype(np.int64)
    sliced = slices_of(values)
    return pd.DataFrame(
        {"dim": [values.shape[1]], "ib": [int(group["ib"].iloc[0])], "ids": [group["id"].to_numpy(np.int64).tobytes()], "bits": [sliced.shape[1]], "slices": [sliced.tobytes()]}
    )


def _search(k: int):
    def search(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "query_no": [], "vec_id": [], "score": []}).astype("int64")
        if not len(index) or not len(queries):
            return empty
        ids = np.frombuffer(index["ids"].iloc[0], np.int64)
        bits = int(index["bits"].iloc[0])
        words = (len(ids) + 63) // 64
        sliced = np.frombuffer(index["slices"].iloc[0], np.uint64).reshape(-1, bits, words)
        valid = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64)
        wanted = np.stack(queries["values"].to_numpy()).astype(np.int64)
        query_ids, numbers = queries["id"].to_numpy(np.int64), queries["query_no"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        sorted_ids = ids[order]
        out = []
        for i, (score, below) in enumerate(block_scores(sliced, wanted)):
            own = order[np.searchsorted(sorted_ids, query_ids[i]) : np.searchsorted(sorted_ids, query_ids[i], side="right")]
            mask = valid
            if len(own):
                mask = valid.copy()
                np.bitwise_and.at(mask, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
            rows = np.flatnonzero(np.unpackbits(top_rows(score, mask, k).view(np.uint8), bitorder="little"))
            found = _scores_at(score, rows, below)
            best = np.lexsort((ids[rows], -found))[:k]  # boundary rows: smaller id first
            out.append((np.full(len(best), query_ids[i]), np.full(len(best), numbers[i]), ids[rows][best], found[best]))
        return pd.DataFrame(dict(zip(empty.columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return search


def top_k(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    k: int = 20,
    scale: int = 64,
) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows whose id is not the
    query's. Components become floor(scale * x). Ties go to the smaller id.

    Index blocks of about INDEX_ROWS candidates hold their components as bit slices. A block meets each
    block of about QUERY_ROWS queries in one task: multiples of the slices are added as bitmaps into
    bit-sliced scores, the top rows are selected from the most significant slice downward, and rows at
    the boundary are settled on (score, id). k rows a query and block go on to one window per query.
    Both sides come in blocks dealt by a hash of the row's place, so blocks are even whatever repeats;
    the work is queries x candidates, as asked for, in units that fit a core's cache, and spreads over
    (index blocks x query blocks) tasks. Nothing is collected; one count for each number of components is made.

    Vectors null, without components, or holding null, NaN or infinite components take no part, nor do rows
    with a null id. Vectors meet those with as many components; with others there is no inner product.
    Rows that repeat an id are candidates one by one; queries that repeat id and vector are answered
    once, and a query id with different vectors is answered for each. Sums have as many slices as their
    block needs, so components of any size are added exactly; a component, or a
    score among the highest of a block, that is no 64-bit integer is an error. An empty table gives no rows.
    """
    ready = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("values"))
    ready = ready.where("id is not null and values is not null").withColumn("dim", F.size("values"))
    ready = materialize(ready, "quantised")
    asked = F.count_if(F.col("id") % every == 0)
    blocks = ready.groupBy(F.col("dim").alias("d")).agg(
        F.ceil(F.count(F.lit(1)) / INDEX_ROWS).cast("int").alias("index_blocks"), F.greatest(F.lit(1), F.ceil(asked / QUERY_ROWS)).cast("int").alias("query_blocks"),
    )
    blocks = materialize(blocks, "topk-blocks")  # a row for each number of components
    placed = ready.join(blocks, F.col("dim") == F.col("d")).drop("d")
    place = F.xxhash64(F.monotonically_increasing_id())
    index = (
        placed.withColumn("ib", F.pmod(place, F.col("index_blocks")).cast("int"))
        .select("dim", "ib", "id", "values").groupBy("dim", "ib")
        .applyInPandas(_index_block, "dim int, ib int, ids binary, bits int, slices binary")
    )
    index = materialize(index, "slices")
    queries = placed.where(F.col("id") % every == 0).distinct()
    queries = queries.withColumn("query_no", F.xxhash64("values")).withColumn("qb", F.pmod(F.xxhash64("id", "values"), F.col("query_blocks")).cast("int"))
    every_query_block = index.join(blocks.select("d", "query_blocks"), F.col("dim") == F.col("d")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    cells = every_query_block.select("dim", "ib", "qb", "ids", "bits", "slices").groupBy("dim", "ib", "qb")
    visits = queries.withColumn("ib", F.explode(F.sequence(F.lit(0), F.col("index_blocks") - 1))).select("dim", "ib", "qb", "id", "values", "query_no")
    found = cells.cogroup(visits.groupBy("dim", "ib", "qb")).applyInPandas(_search(k), "query_id long, query_no long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
