"""Vector functions: deterministic embeddings, 8-bit quantization, projection hashes, base64 vectors."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Least magnitude that is scaled, bits and seed of the projection hash, default dimension.
EPSILON = float(np.finfo(np.float32).eps)
LSH_BITS = 64
LSH_SEED = 0x00C0FFEE
DIMENSION = 1024

FLOATS = T.ArrayType(T.FloatType())
QUANTIZED = T.StructType(
    [T.StructField("values", T.ArrayType(T.ByteType())), T.StructField("scale", T.FloatType()), T.StructField("norm", T.DoubleType())]
)


def bytes_vector(text: str, dim: int, signed: bool) -> np.ndarray:
    """The text's bytes dealt round the dimensions and summed, as a unit vector (zero for an empty text).

    Unsigned (chunks) a byte adds b/255, signed (queries) 2b/255 - 1: two spaces that do not compare.
    Sums are in doubles and the unit vector is rounded once, so a component depends on no order of adding.
    """
    raw = np.frombuffer(text.encode(), np.uint8) / 255.0
    if signed:
        raw = raw * 2 - 1
    padded = np.zeros(-(-max(len(raw), 1) // dim) * dim)
    padded[: len(raw)] = raw
    vector = padded.reshape(-1, dim).sum(axis=0)
    norm = np.sqrt((vector * vector).sum())
    return (vector / norm if norm > 0 else vector).astype(np.float32)


def _embedder(dim: int, signed: bool):
    dim = max(1, dim)

    @F.pandas_udf(FLOATS)
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else bytes_vector(t, dim, signed))

    return embed


def embed_chunk(text: Column, dim: int = DIMENSION) -> Column:
    """Deterministic vector of a chunk."""
    return _embedder(dim, False)(text)


def embed_query(text: Column, dim: int = DIMENSION) -> Column:
    """Deterministic vector of a query."""
    return _embedder(dim, True)(text)


def with_fallback(embedding: Column, text: Column, dim: int, space: str = "chunk") -> Column:
    """The embedding if it has ``dim`` components, else the deterministic vector of the text.

    The helper is handed a null text where nothing is missing, so it works on mismatches only.
    """
    fits = F.coalesce(F.size(embedding) == dim, F.lit(False))
    needed = F.when(~fits, text)
    return F.when(fits, embedding).otherwise(_embedder(dim, space == "query")(needed))


def quantize_expression(vector: Column) -> Column:
    """``quantize`` in plain expressions, over doubles; for small tables and cross-checks."""
    largest = F.greatest(F.coalesce(F.array_max(F.transform(vector, lambda x: F.abs(x))), F.lit(0.0)), F.lit(EPSILON))
    scale = (largest.cast("float") / F.lit(127.0).cast("float")).cast("float")
    values = F.transform(
        vector, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round((x.cast("float") / scale).cast("float")).cast("int"))).cast("byte")
    )
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.struct(values.alias("values"), scale.alias("scale"), norm.alias("norm"))


def quantized(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (int8), scale and norm (a double) of each row of a float32 matrix; halves round away from zero."""
    scale = np.maximum(np.abs(matrix).max(axis=1, initial=0), np.float32(EPSILON)) / np.float32(127)
    scaled = matrix / scale[:, None]
    values = np.clip(np.sign(scaled) * np.floor(np.abs(scaled).astype(np.float64) + 0.5), -127, 127).astype(np.int8)
    wide = matrix.astype(np.float64)
    return values, scale, np.sqrt((wide * wide).sum(axis=1))


def _matrix(rows: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(r, np.float32) for r in rows])


@F.pandas_udf(QUANTIZED)
def quantize(vectors: pd.Series) -> pd.DataFrame:
    """8-bit values with their scale, and the norm of the vector before; null for null. Lengths may differ."""
    made = [np.empty(len(vectors), object), np.full(len(vectors), np.nan, object), np.full(len(vectors), np.nan, object)]
    sizes = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        values, scale, norm = quantized(_matrix([vectors.iloc[i] for i in rows]))
        made[0][rows] = list(values) if size else [np.empty(0, np.int8) for _ in rows]
        made[1][rows], made[2][rows] = scale, norm
    out = pd.DataFrame(dict(zip(("values", "scale", "norm"), made, strict=True)), dtype=object)
    return out.where(out.notna(), None)


def quantized_cosine(a: Column, b: Column) -> Column:
    """Cosine of two quantized vectors, in doubles: 0 if either norm is 0; the shorter length counts."""
    n = F.least(F.size(a["values"]), F.size(b["values"]))
    products = F.zip_with(F.slice(a["values"], 1, n), F.slice(b["values"], 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    dot = F.aggregate(products, F.lit(0.0), lambda s, x: s + x) * a["scale"] * b["scale"]
    return F.when((a["norm"] == 0) | (b["norm"] == 0), F.lit(0.0)).otherwise(dot / (a["norm"] * b["norm"]))


@lru_cache(maxsize=16)
def projection_signs(dim: int, bits: int, seed: int) -> np.ndarray:
    """The +1/-1 matrix [bits, dim], drawn bit by bit from a splitmix64 sequence that feeds on its own output."""
    mask, state = (1 << 64) - 1, seed
    signs = np.empty(bits * dim, np.int32)
    for i in range(bits * dim):
        state = (state + 0x9E3779B97F4A7C15) & mask
        x = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        state = x ^ (x >> 31)
        signs[i] = 1 if state & 1 else -1
    return signs.reshape(bits, dim)


def buckets(values: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """Codes of int8 rows: bit i is set where the i-th projection is not negative."""
    hits = values.astype(np.int32) @ projection_signs(values.shape[1], bits, seed).T >= 0
    return (hits.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def lsh_bucket(values: Column, num_bits: int = LSH_BITS, seed: int = LSH_SEED) -> Column:
    """Projection code of quantized values, as 64 bits in a long (all ones is -1); null for null."""

    @F.pandas_udf(T.LongType())
    def code(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype="Int64")
        sizes = vectors.map(lambda v: -1 if v is None else len(v)).to_numpy()
        for size in np.unique(sizes[sizes >= 0]):
            rows = np.flatnonzero(sizes == size)
            out.iloc[rows] = buckets(np.stack([np.asarray(vectors.iloc[i], np.int8) for i in rows]), num_bits, seed)
        return out

    return code(values)


def decode_f32_base64(text: Column) -> Column:
    """Little-endian float32 values of a standard base64 text; null if it is none or no multiple of 4 bytes."""

    @F.pandas_udf(FLOATS)
    def floats(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    valid = text.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
    return floats(F.when(valid, F.unbase64(text)))
