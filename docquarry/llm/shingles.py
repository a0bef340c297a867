"""Sets of shingles, filters on keys, and the check of pairs on their whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import bounded_batches, discard, materialize
from docquarry.llm.simhash import shingles_hashes

#: Jaccard bound as a fraction.
LEAST = (4, 5)
#: Bits of the filter that spares rows a shuffle.
_FILTER = 1 << 27


def maybe_among(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: false only where the column ``key`` is none of ``keys`` (one long column).

    The keys are hashed into a bitmap of fixed size, 4096 pieces of 4 KB, which is broadcast; with so many
    keys that it is full it spares nothing, and what is built on ``_maybe`` has to look exactly.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(_FILTER)) + 1
    pieces = keys.groupBy(F.bitmap_bucket_number(place(keys.columns[0])).alias("_piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(keys.columns[0]))).alias("_bits"))
    pieces = materialize(pieces, "similar-filter")
    placed = df.withColumn("_at", F.bitmap_bit_position(place(key))).withColumn("_in", F.bitmap_bucket_number(place(key)))
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_at div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    joined = placed.join(F.broadcast(pieces), F.col("_in") == F.col("_piece"), "left")
    return joined.select(*df.columns, hit.alias("_maybe"))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    return np.sort(np.unique(shingles_hashes(text, width)).view(np.int64))


def set_key(members: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(members.tobytes())


def texts_of(needed: DataFrame, sets: DataFrame, narrow: DataFrame) -> DataFrame:
    """(_set, _text): one text of each set in ``needed`` (_set); ``sets`` (_set, _row) and ``narrow`` (_row, _text) say where."""
    chosen = maybe_among(sets.select("_set", "_row"), "_set", needed).where("_maybe")
    chosen = materialize(chosen.groupBy("_set").agg(F.min("_row").alias("_row")).join(needed, "_set", "left_semi"), "similar-chosen")
    near = maybe_among(narrow.select("_row", "_text"), "_row", chosen.select("_row")).where("_maybe").drop("_maybe")
    found = materialize(near.join(chosen, "_row").select("_set", "_text").dropDuplicates(["_set"]), "similar-texts")
    discard(chosen)
    return found


def verified(pairs: DataFrame, sets: DataFrame, narrow: DataFrame, width: int) -> DataFrame:
    """Links (u, v) of ``pairs`` (u, v) whose sets have the Jaccard asked for, by all their shingles.

    One text of each set is fetched (``texts_of``; texts take less room than the hashes of their shingles), and each
    pair is worked out where its two texts have met.
    """
    pairs = materialize(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "similar-pairs")
    needed = pairs.select(F.col("u").alias("_set")).union(pairs.select("v")).distinct()
    members = texts_of(needed, sets, narrow)
    both = pairs.join(members.toDF("u", "tu"), "u").join(members.toDF("v", "tv"), "v")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, right = None, np.empty(0, np.int64)  # pairs come with equal v together
        for batch in bounded_batches(batches):
            hold = np.zeros(batch.num_rows, bool)
            u, v, tu, tv = (batch.column(i) for i in range(4))
            for i, (key, text) in enumerate(zip(v.to_pylist(), tu.to_pylist(), strict=True)):
                if key != known:
                    known, right = key, shingle_set(tv[i].as_py(), width)
                left = shingle_set(text, width)
                common = len(np.intersect1d(left, right, assume_unique=True))
                hold[i] = LEAST[1] * common >= LEAST[0] * (len(left) + len(right) - common)
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(hold))

    links = materialize(both.select("u", "v", "tu", "tv").mapInArrow(judge, "u long, v long"), "similar-links")
    discard(pairs, members)
    return links
