"""What the operators of this subpackage share: tokens, batches, and the library's written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.sources.scratch import discard, materialize, spread, tidy

__all__ = ["LOWER_ASCII", "bounded_batches", "discard", "materialize", "n_words", "split_words", "spread", "tidy", "unit_interval", "with_columns_free"]

#: Word separators of the corpus contracts: space, tab, LF, VT, FF, CR.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: bytes.translate table: separators become a space, A-Z lower case, all else stays.
LOWER_ASCII = bytes(
    0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)
)


def bounded_batches(batches: Iterator[pa.RecordBatch], records: int = 1000, n_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``records`` rows and about ``n_bytes`` (a row that is longer stands by itself).

    What comes in is bounded by Spark itself (spark.sql.execution.arrow.maxBytesPerBatch, 64 MB); parts
    bound what is worked out of it, without a change of the caller's session. Behind each batch Arrow's pool gives back
    what it holds free: workers wait for their next task, or for another operator's, beside the executor's heap.
    """
    for batch in batches:
        size = max(1, min(records, batch.num_rows * n_bytes // max(1, batch.nbytes)))
        for begin in range(0, batch.num_rows, size):
            yield batch.slice(begin, size)
        del batch
        pa.default_memory_pool().release_unused()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` (null: none), and where each text's begin and end."""
    parts = pc.ascii_split_whitespace(texts.fill_null(""))
    words, ends = parts.flatten(), np.asarray(parts.offsets)
    real = np.asarray(pc.not_equal(words, ""), bool)
    total = np.concatenate(([0], np.cumsum(real)))
    return words.filter(pa.array(real)), total[ends - ends[0]]


def n_words(text: Column) -> Column:
    """Words between separators; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_columns_free(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add: its own result replaces them."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken]) if taken else df


def unit_interval(value: Column, salt: str) -> Column:
    """A number in [0, 1) from md5 of salt and value: the same on every engine and every rerun."""
    digest = F.md5(F.concat(F.lit(salt + ":"), F.coalesce(value, F.lit("\x00null"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
