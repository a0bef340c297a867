"""Streams with keyed state: the semantic cache entry by entry, and runs of changes whose open part can be read back.

Both need Spark's RocksDB state store (``spark.sql.streaming.stateStore.providerClass``), which the caller's session sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docquarry.functions.vectors import DIMENSION, LSH_BITS, LSH_SEED
from docquarry.operators.cache import MAX_ENTRIES, REPLAY, ShardCache, _Entry

_STORE = "spark.sql.streaming.stateStore.providerClass"


def _checked(df: DataFrame) -> None:
    if "RocksDB" not in (df.sparkSession.conf.get(_STORE, None) or ""):
        raise ValueError(f"set {_STORE} to Spark's RocksDBStateStoreProvider for streams with keyed state")


class _CacheState(StatefulProcessor):
    """State of a shard: one row an entry, with the number of the query that added it and that used it last."""

    def __init__(self, max_entries: int, dim: int, num_bits: int, seed: int, ttl_ms: int | None):
        self.settings, self.ttl_ms = (max_entries, dim, num_bits, seed), ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "query string", "value string, bucket long, added long, used long, scale float, norm float, components binary", self.ttl_ms)
        self.clock = handle.getValueState("clock", "n long")

    def _loaded(self) -> tuple[ShardCache, dict[str, tuple[int, int]]]:
        cache = ShardCache(*self.settings)
        found = [(key[0], *row) for key, row in self.entries.iterator()]
        for query, value, bucket, _, _, scale, norm, components in sorted(found, key=lambda e: e[4]):
            cache.entries[query] = _Entry(np.frombuffer(bytes(components), np.int8), np.float32(scale), np.float32(norm), bucket, value)
        for query, _, bucket, *_ in sorted(found, key=lambda e: e[3]):
            cache.by_bucket.setdefault(bucket, {})[query] = None
        return cache, {e[0]: (e[3], e[4]) for e in found}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cache, before = self._loaded()
        marks = dict(before)
        n = self.clock.get()[0] if self.clock.exists() else 0
        out = []
        for _, seq, query, value in pd.concat(list(rows)).sort_values(["seq", "query"], kind="stable").itertuples(index=False, name=None):
            n += 1
            found = cache.ask(query, value)
            if found[0] == "Miss":
                marks[query] = (n, n)
            else:
                marks[found[1]] = (marks[found[1]][0], n)
            out.append((key[0], seq, query, *found))
        for query in before:
            if query not in cache.entries:
                self.entries.removeKey((query,))
        for query, e in cache.entries.items():
            if marks[query] != before.get(query):
                self.entries.updateValue((query,), (e.value, e.bucket, *marks[query], float(e.scale), float(e.norm), e.values.astype(np.int8).tobytes()))
        self.clock.update((n,))
        columns = [c.split()[0] for c in REPLAY.split(", ")]
        yield pd.DataFrame({c: pd.Series(list(v), dtype="int64" if c == "seq" else "float32" if c == "score" else object) for c, v in zip(columns, zip(*out, strict=True), strict=True)})

    def close(self) -> None:
        pass


def stream_cache(
    log: DataFrame, shard_col: str, order_col: str, *, max_entries: int = MAX_ENTRIES, dim: int = DIMENSION, num_bits: int = LSH_BITS, seed: int = LSH_SEED,
    ttl_ms: int | None = None,
) -> DataFrame:
    """``replay_cache`` of a stream: the state of a shard is its cache, of ``max_entries`` at most.

    A micro-batch reads the entries of the shards that it has queries of and writes those it has added, used or
    dropped, each by itself; with ``ttl_ms`` an entry also ends so long after it was last written. Within a
    micro-batch a shard's queries run in the order of ``order_col``, for which a task holds that shard's part
    of the micro-batch: bound it by the source's rate limit. Null queries are passed over.
    """
    _checked(log)
    rows = log.select(F.col(shard_col).cast("string").alias("shard"), F.col(order_col).cast("long").alias("seq"), "query", "value").where("query is not null")
    return rows.groupBy("shard").transformWithStateInPandas(_CacheState(max_entries, dim, num_bits, seed, ttl_ms), REPLAY, "append", "None")


class _OpenRuns(StatefulProcessor):
    """State of a root: its changes that no run handed over holds, and a timer where a run that ends with one would end."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "at long, path string", "there boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = set()
        for frame in rows:
            for at, path in zip(frame["at"].tolist(), frame["path"].tolist(), strict=True):
                self.open.updateValue((at, path), (True,))
                ends.add(-(-(at + self.gap_us) // 1000))
        for end in ends:
            self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        runs: list[list[tuple[int, str]]] = []
        for at, path in sorted(tuple(k) for k in self.open.keys()):
            if not runs or at - runs[-1][-1][0] > self.gap_us:
                runs.append([])
            runs[-1].append((at, path))
        closed = [r for r in runs if r[-1][0] + self.gap_us <= limit]
        for run in closed:
            for change in run:
                self.open.removeKey(change)
        if closed:
            columns = {
                "root": [key[0]] * len(closed), "started": [r[0][0] for r in closed], "ended": [r[-1][0] + self.gap_us for r in closed],
                "paths": [sorted({p for _, p in r}) for r in closed],
            }
            yield pd.DataFrame({c: pd.Series(v, dtype="int64" if c in ("started", "ended") else object) for c, v in columns.items()})

    def close(self) -> None:
        pass


_RUN = "root string, started long, ended long, paths array<string>"


def _timed(runs: DataFrame) -> DataFrame:
    return runs.select("root", F.timestamp_micros("started").alias("started"), F.timestamp_micros("ended").alias("ended"), "paths")


def _micros(gap: str) -> int:
    from pandas import Timedelta

    return int(Timedelta(gap).value // 1000)


def debounce_stream(changes: DataFrame, *, gap: str = "2 seconds", delay: str = "0 seconds") -> DataFrame:
    """``debounce`` of a stream (root, path, ts): root, started, ended, paths of each run of changes without a pause longer than ``gap``.

    A run comes out once the watermark, ``delay`` behind the latest change, has passed its end. What has not come
    out when the stream stops is its state, which ``open_runs`` reads. A change later than the watermark is
    dropped, as in every stream; it touches no run that has come out.
    """
    _checked(changes)
    rows = changes.withWatermark("ts", delay).where("root is not null and path is not null").select("root", "path", F.unix_micros("ts").alias("at"), "ts")
    return _timed(rows.groupBy("root").transformWithStateInPandas(_OpenRuns(_micros(gap)), _RUN, "append", "EventTime"))


def open_runs(spark: SparkSession, checkpoint: str, *, gap: str = "2 seconds") -> DataFrame:
    """The runs that a stopped ``debounce_stream`` leaves open, out of its checkpoint: with what it has emitted, every run once.

    Only the state of the open runs is read, none of the changes that have been handed over.
    """
    state = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    changes = state.select(F.col("key.root").alias("root"), F.col("user_map_key.path").alias("path"), F.timestamp_micros("user_map_key.at").alias("ts"))
    from docquarry.streaming.stream import debounce

    return debounce(changes, gap=gap)
