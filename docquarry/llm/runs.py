"""Periodic runs of words (operator 11): sparse diagonals met word by word."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import SPACES, bounded_batches, split_words, spread, with_columns_free

#: Words that a run has at least.
LEAST = 12
_RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
ADDED = ("n_words", "runs", "collapsed")
#: Words in the windows of the first level, and the lag up to which it goes: a run of lag q below 8 repeats max(q, 12 - q) >= 6 words.
_FIRST, _FIRST_END = 6, 8


class Level(NamedTuple):
    """Places of one document batch whose window of ``width`` words stood before, for lags from ``least`` up to below ``end``."""

    width: int
    least: int
    end: int
    at: np.ndarray
    """Last word of each window that occurs more than once, rising."""
    rank: np.ndarray
    """Place of each window among the occurrences."""
    occurrences: np.ndarray
    """``at``, equal windows together and rising."""
    first: np.ndarray
    """Where in ``occurrences`` each window's equals begin."""


def _named(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows ending ``at`` with ``keys`` those that repeat: places, names, ranks, occurrences, firsts."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    often = np.zeros(len(at), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    order = order[often[order]]
    fresh = np.concatenate(([True], keys[order[1:]] != keys[order[:-1]])) if len(order) else np.empty(0, bool)
    name = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)[name] if len(order) else np.empty(0, np.int64)
    back = np.empty(len(at), np.int64)
    back[order] = np.arange(len(order))
    rank = back[often]
    return at[often], name[rank], rank, at[order], begin[rank]


def _longer(n: int, at: np.ndarray, names: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``step`` more words than those ``at``: both ends must repeat for the whole to repeat."""
    dense = np.full(n, -1, np.int64)
    dense[at] = names
    before = np.where(at >= step, dense[np.maximum(at - step, 0)], -1)
    there = before >= 0
    return at[there], before[there] * (int(names.max(initial=0)) + 1) + names[there]


def levels(words: np.ndarray) -> list[Level]:
    """Levels that have a window less than its ``end`` behind its equal, of ``words`` (equal numbers, equal words).

    A run of lag q repeats at least q words (and 12 in all), so the earlier occurrences of a word count for
    lags of a level only where that many words before it are the same too. Widths double, and only windows
    whose both halves repeat go on, so plain text leaves after the first levels.
    """
    out: list[Level] = []
    n = len(words)
    at, names, *_ = _named(np.arange(n), words)
    for step in (1, 2):
        at, names, *_ = _named(*_longer(n, at, names, step))
    four = (at, names)
    width, least, end, step, base = _FIRST, 1, _FIRST_END, _FIRST - 4, four
    while len(base[0]):
        at, names, rank, occurrences, first = _named(*_longer(n, *base, step))
        if len(at):
            earlier = np.where(rank > first, occurrences[np.maximum(rank - 1, 0)], -end)
            if (at - earlier < end).any():
                out.append(Level(width, least, end, at, rank, occurrences, first))
        if width == _FIRST:
            width, least, end, step, base = 8, 8, 16, 4, four
        else:
            width, least, end, step, base = 2 * width, 2 * width, 4 * width, width, (at, names)
    return out


def _near(level: Level) -> np.ndarray:
    """Windows less than ``end`` behind their nearest equal; without those deep in a stretch of a smaller lag, which have no others that count."""
    lag = level.at - np.where(level.rank > level.first, level.occurrences[np.maximum(level.rank - 1, 0)], -level.end)
    steady = np.concatenate(([False], (np.diff(level.at) == 1) & (lag[1:] == lag[:-1])))
    index = np.arange(len(lag))
    streak = index - np.maximum.accumulate(np.where(steady, 0, index))
    deep = (lag < level.least) & (streak + level.width >= level.end)
    return np.flatnonzero((lag < level.end) & ~deep)


def _width_of(lag: int) -> int:
    return _FIRST if lag < _FIRST_END else 1 << (lag.bit_length() - 1)


def diagonals(words: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, lag) of each stretch with a period, as its diagonal ends: length at least 12 and two lags.

    Words come in order. At each, its earlier occurrences lengthen the diagonals of their lags; those that
    were there at the word before and are not met again have ended. ``met`` holds only diagonals that are
    alive. Where the nearest occurrence is part of a stretch of lag d, those of its inside are multiples of
    d and belong to that stretch: they are passed over, so a text of one word costs as much as any other.
    """
    found = levels(words)
    if not found:
        return
    at, which, index = [], [], []
    for k, level in enumerate(found):
        near = _near(level)
        at.append(level.at[near])
        which.append(np.full(len(near), k))
        index.append(near)
    place, kind, row = (np.concatenate(x) for x in (at, which, index))
    order = np.lexsort((kind, place))
    ranks = [level.rank.tolist() for level in found]
    firsts = [level.first.tolist() for level in found]
    lists = [level.occurrences.tolist() for level in found]
    bounds = [(level.width, level.least, level.end) for level in found]
    active: dict[int, int] = {}  # lag to the word at which its window was first met, at the word before
    met: dict[int, int] = {}
    now = -2

    def ended(lags: dict[int, int], still: dict[int, int], last: int) -> Iterator[tuple[int, int, int]]:
        for lag, begin in lags.items():
            if lag not in still:
                start = begin - _width_of(lag) + 1 - lag
                length = last - start + 1
                if length >= LEAST and length >= 2 * lag:
                    yield start, length, lag

    for i, k, t in zip(place[order].tolist(), kind[order].tolist(), row[order].tolist(), strict=True):
        if i != now:
            yield from ended(active, met, now - 1)
            if i != now + 1:
                yield from ended(met, {}, now)
                met = {}
            active, met, now = met, {}, i
        width, least, end = bounds[k]
        places, begin, r = lists[k], firsts[k][t], ranks[k][t] - 1
        lag = i - places[r]
        if lag >= least:
            met[lag] = active.get(lag, i)
        if lag <= width and lag in met:
            inside = met[lag] - _width_of(lag) + 1  # the stretch's start and one lag
            r = min(r, bisect_left(places, inside, begin, r + 1))
        r -= 1
        while r >= begin and (lag := i - places[r]) < end:
            if lag >= least:
                met[lag] = active.get(lag, i)
            r -= 1
    yield from ended(active, met, now - 1)
    yield from ended(met, {}, now)


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of ``words`` by start and period; a stretch counts with its smallest period only."""
    n, best = len(words), {}
    for start, length, lag in diagonals(words):
        end = start + length
        whole = (start == 0 or words[start - 1] != words[start - 1 + lag]) and (end == n or words[end] != words[end - lag])
        if whole and lag < best.get((start, length), n + 1):
            best[start, length] = lag
    return sorted((start, length, lag) for (start, length), lag in best.items())


def _found(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Words, runs and collapsed text of each text."""
    words, ends = split_words(texts)
    size = np.diff(ends)
    coded = words.dictionary_encode()
    codes = np.asarray(coded.indices).astype(np.int64) + np.repeat(np.arange(len(size)), size) * max(1, len(coded.dictionary))
    runs = runs_of(codes)  # words of two texts are never equal here
    owner = np.searchsorted(ends, [r[0] for r in runs], side="right") - 1
    table = np.array(runs, np.int64).reshape(-1, 3)
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, table[:, 0] + table[:, 2], 1)
    np.add.at(change, table[:, 0] + table[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    offsets = np.concatenate(([0], np.cumsum(kept)))[ends]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words.filter(pa.array(kept))), " ")
    fields = [pa.array(table[:, 0] - ends[owner]), pa.array(table[:, 1]), pa.array(table[:, 2])]
    spans = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
    starts = np.searchsorted(owner, np.arange(len(size) + 1)).astype(np.int32)
    return size, pa.ListArray.from_arrays(pa.array(starts), spans), collapsed


def detect_runs(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with n_words, runs (array of start, length, period; by start, then period) and collapsed.

    A run is a stretch of words of smallest period q, 12 words and two periods long at least, that no
    neighbouring word extends with that period; overlapping runs all count. collapsed is the text's words,
    joined by one space, without those that a run holds after its first period. Words are what stands
    between space, tab, LF, VT, FF and CR.

    Each text is worked out in its task, with no shuffle. Null and empty texts: no words, no runs, empty
    collapsed. Repeated rows and rows without id are rows like others. Very long texts are read whole; what
    is held is some hundred bytes a word of a batch's part. Clashing columns are replaced. No rows: no rows.
    """
    rows = with_columns_free(docs, *[c for c in ADDED if c != text_col])
    columns = [c for c in rows.columns if c != text_col]
    schema = rows.select(*columns).schema.add("n_words", "long").add("runs", T.ArrayType(_RUN)).add("collapsed", "string")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches, n_bytes=2 << 20):
            size, runs, collapsed = _found(batch.column(len(columns)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(size, pa.int64()), runs, collapsed], names=[*columns, *ADDED])

    return rows.select(*columns, F.col(text_col).cast("string")).mapInArrow(make, schema)


def with_planted_runs(text: Column, key: Column) -> Column:
    """``text`` with a repeating end where the checksum of ``key`` says so: of words a, a + 1, ... the first p come again and again."""
    checksum = F.crc32(key.cast("string"))
    g = F.floor(checksum / 10)
    words = F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return F.when((checksum % 10 == 0) & (F.regexp_count(text, F.lit(rf"^{SPACES}*[^\x20\x09-\x0D]")) > 0), planted).otherwise(text)


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of what ``detect_runs`` gives."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("_best", longest)
    length, start, period = (F.col("_best")[c] for c in ("length", "col2", "col3"))
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-start).alias("start"), length.alias("length"), (-period).alias("period"),
        F.floor(1000 * length / -period).cast("long").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return digest_columns(detect_runs(docs.select("doc_id", with_planted_runs(F.col("text"), F.col("doc_id")).alias("text"))))


def brute_force(words: Sequence[str]) -> list[tuple[int, int, int]]:
    """All runs, by every period and every start."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(LEAST, 2 * q):
                best.setdefault((start, end - start), q)
            start = max(start + 1, end - q + 1)
    return sorted((s, length, q) for (s, length), q in best.items())
