"""The semantic cache as data: probing a cache table, replaying a query log, searching through a cache."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import jaccard, trigrams
from docquarry.functions.vectors import DIMENSION, LSH_BITS, LSH_SEED, buckets, bytes_vector, embed_query, lsh_bucket, quantize, quantized, quantized_cosine
from docquarry.sources.scratch import materialize

# Cosine of a sure hit and of the grey zone, trigram overlap asked for in it, cache size.
SURE = 0.95
GREY = 0.85
GREY_JACCARD = 0.25
MAX_ENTRIES = 128
REPLAY = "shard string, seq long, query string, outcome string, matched_query string, score float, value string"


def cache_entries(df: DataFrame, *, dim: int = DIMENSION, num_bits: int = LSH_BITS, seed: int = LSH_SEED, vector_col: str | None = None) -> DataFrame:
    """``df`` (query, ...) with q (its quantized vector) and bucket.

    The vector is the deterministic one of the text, or ``vector_col``; entries with equal text have equal codes.
    """
    vector = F.col(vector_col) if vector_col else embed_query(F.col("query"), dim)
    return df.withColumn("q", quantize(vector)).withColumn("bucket", lsh_bucket(F.col("q.values"), num_bits, seed))


def lsh_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of the same bucket, columns of the right side marked ``c_``.

    Vectors of norm 0 share one bucket but score 0 with all, so they stay out and make no hot key.
    """
    other = right.where(F.col("q.norm") > 0).select(*[F.col(c).alias(f"c_{c}") for c in right.columns])
    return left.where(F.col("q.norm") > 0).join(other, F.col("bucket") == F.col("c_bucket"))


def probe_cache(
    queries: DataFrame, cache: DataFrame, *, sure: float = SURE, grey: float = GREY, min_jaccard: float = GREY_JACCARD
) -> DataFrame:
    """query_id, query, outcome (SureHit, GreyZone, Miss), matched_query, score, value for each query.

    ``queries``: query_id, query, q, bucket; ``cache``: query, q, bucket, value, seq (place in insertion
    order). Of the entries in a query's bucket the most similar one counts, the earliest of equals (scores are
    doubles, and equal where they are in single precision, as copies of a vector are); from
    ``sure`` on it is a hit, from ``grey`` on only if the texts' trigrams overlap enough, which is looked at
    for that one entry alone. Equal query texts are looked up once.
    """
    asked = queries.groupBy("query").agg(F.any_value("q").alias("q"), F.any_value("bucket").alias("bucket"))
    entries = cache.select("query", "q", "bucket", "value", "seq")
    # Vectors and codes are written, so that the helpers behind them run once and not for each filter on them.
    asked, entries = materialize(asked, "asked"), materialize(entries, "entries")
    pairs = lsh_candidates(asked, entries).select(
        "query", F.col("c_query").alias("matched_query"), F.col("c_value").alias("value"), F.col("c_seq").alias("_seq"),
        quantized_cosine(F.col("q"), F.col("c_q")).alias("score"),
    )
    best = pairs.groupBy("query").agg(
        F.max_by(F.struct("matched_query", "value", "score"), F.struct(F.col("score").cast("float"), -F.col("_seq"))).alias("b")
    )
    scored = best.select("query", "b.*")
    score = F.col("score")
    sure_, grey_ = F.lit(float(sure)), F.lit(float(grey))
    overlap = jaccard(trigrams(F.col("query")), trigrams(F.col("matched_query")))
    in_grey = (score >= grey_) & (score < sure_)
    outcome = F.when(score >= sure_, "SureHit").when(in_grey & (overlap >= F.lit(min_jaccard).cast("float")), "GreyZone").otherwise("Miss")
    judged = scored.withColumn("outcome", outcome)
    found = queries.select("query_id", "query").join(judged, "query", "left")
    hit = F.coalesce(F.col("outcome"), F.lit("Miss"))
    return found.select(
        "query_id",
        "query",
        hit.alias("outcome"),
        F.when(hit != "Miss", F.col("matched_query")).alias("matched_query"),
        F.when(hit != "Miss", F.col("score")).alias("score"),
        F.when(hit != "Miss", F.col("value")).alias("value"),
    )


class _Entry(NamedTuple):
    values: np.ndarray
    scale: np.float32
    norm: np.float32
    bucket: int
    value: str


def _windows(text: str) -> frozenset[bytes]:
    raw = text.encode()
    return frozenset(raw[i : i + 3] for i in range(len(raw) - 2))


def _overlap(a: frozenset[bytes], b: frozenset[bytes]) -> float:
    both = len(a & b)
    return 1.0 if not a and not b else both / (len(a) + len(b) - both)


class ShardCache:
    """One bounded cache: entries by recency, and the queries of each bucket in order of insertion."""

    def __init__(self, max_entries: int, dim: int, num_bits: int, seed: int):
        self.max_entries, self.dim, self.num_bits, self.seed = max_entries, dim, num_bits, seed
        self.entries: OrderedDict[str, _Entry] = OrderedDict()
        self.by_bucket: dict[int, dict[str, None]] = {}

    def described(self, query: str, value: str) -> _Entry:
        values, scale, norm = quantized(bytes_vector(query, self.dim, True)[None, :])
        return _Entry(values[0], scale[0], np.float32(norm[0]), int(buckets(values, self.num_bits, self.seed)[0]), value)

    def ask(self, query: str, fresh: str, own: _Entry | None = None) -> tuple[str, str | None, float | None, str]:
        """outcome, matched query, score and value; a miss stores ``fresh`` under the query. ``own``: what ``described`` gives, if it is at hand."""
        own = own or self.described(query, fresh)
        best, best_score = None, np.float32(-np.inf)
        wide = own.values.astype(np.int64)
        for key in self.by_bucket.get(own.bucket, ()):
            e = self.entries[key]
            zero = own.norm == 0 or e.norm == 0
            score = np.float32(0) if zero else np.float32(np.float32(int(wide @ e.values)) * own.scale * e.scale) / (own.norm * e.norm)
            if score > best_score:
                best, best_score = key, score
        if best is not None:
            sure = best_score >= np.float32(SURE)
            grey = np.float32(GREY) <= best_score and _overlap(_windows(query), _windows(best)) >= GREY_JACCARD
            if sure or grey:
                self.entries.move_to_end(best)
                return "SureHit" if sure else "GreyZone", best, float(best_score), self.entries[best].value
        self.put(query, own)
        return "Miss", None, None, fresh

    def put(self, query: str, entry: _Entry) -> None:
        if query in self.entries:
            self.drop(query)
        self.entries[query] = entry
        self.by_bucket.setdefault(entry.bucket, {})[query] = None
        while len(self.entries) > self.max_entries:
            self.drop(next(iter(self.entries)))

    def drop(self, query: str) -> None:
        bucket = self.entries.pop(query).bucket
        del self.by_bucket[bucket][query]
        if not self.by_bucket[bucket]:
            del self.by_bucket[bucket]


def replay_cache(
    log: DataFrame,
    shard_col: str,
    order_col: str,
    *,
    max_entries: int = MAX_ENTRIES,
    dim: int = DIMENSION,
    num_bits: int = LSH_BITS,
    seed: int = LSH_SEED,
) -> DataFrame:
    """What one cache a shard would have answered: shard, seq, query, outcome, matched_query, score, value.

    ``log`` has query and value (the answer a fresh search gives); the queries of a shard run in order. First
    the rows are coded where they lie (vector, codes), whatever their shard. Then the log is dealt out by
    shard and sorted, and each task streams its shards through, holding one cache of ``max_entries`` at a
    time, so a long shard costs time and no memory: what is sequential by its nature, which entry answers and
    which one goes, is all that is done there.
    """
    rows = log.select(F.col(shard_col).cast("string").alias("shard"), F.col(order_col).cast("long").alias("seq"), "query", "value").where("query is not null")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                values, scale, norm = quantized(np.stack([bytes_vector(q, dim, True) for q in part.column(2).to_pylist()]))
                made = [pa.array([v.tobytes() for v in values], pa.binary()), pa.array(scale), pa.array(norm, pa.float32()), pa.array(buckets(values, num_bits, seed))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "v", "scale", "norm", "bucket"])

    coded = rows.mapInArrow(code, "shard string, seq long, query string, value string, v binary, scale float, norm float, bucket long")
    ordered = coded.repartition("shard").sortWithinPartitions("shard", "seq", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, shard, begun = None, None, False
        for batch in batches:
            out = []
            scales, norms = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            texts = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4, 7)), strict=True)
            for i, (s, seq, query, value, v, bucket) in enumerate(texts):
                if not begun or s != shard:
                    cache, shard, begun = ShardCache(max_entries, dim, num_bits, seed), s, True
                out.append((s, seq, query, *cache.ask(query, value, _Entry(np.frombuffer(v, np.int8), scales[i], norms[i], bucket, value))))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float32(), pa.string())
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in REPLAY.split(", ")])

    return ordered.mapInArrow(run, REPLAY)


def answer_queries(queries: DataFrame, cache: DataFrame, search, *, dim: int = DIMENSION, num_bits: int = LSH_BITS, seed: int = LSH_SEED) -> tuple[DataFrame, DataFrame]:
    """Answers (query_id, query, outcome, answer) of a query table, and the cache with the new entries.

    Hits take the cached value; misses go to ``search`` (query_id, query -> query_id, answer), each different
    text once. An answer that says nothing matched is cached too. Outcomes and fresh answers are written once,
    as several results rest on them.
    """
    coded = cache_entries(queries.select("query_id", "query"), dim=dim, num_bits=num_bits, seed=seed)
    probed = materialize(probe_cache(coded, cache), "probed")
    missed = probed.where("outcome = 'Miss'").groupBy("query").agg(F.min("query_id").alias("query_id"))
    fresh = missed.join(search(missed.select("query_id", "query")), "query_id").select("query", F.col("answer").alias("_fresh"))
    fresh = materialize(fresh, "fresh")
    answers = probed.join(fresh, "query", "left").select("query_id", "query", "outcome", F.coalesce("value", "_fresh").alias("answer"))
    last = cache.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))
    new = cache_entries(fresh, dim=dim, num_bits=num_bits, seed=seed).join(F.broadcast(last))
    new = new.select("query", "q", "bucket", F.col("_fresh").alias("value"), (F.col("_last") + 1 + F.monotonically_increasing_id()).alias("seq"))
    kept = cache.select("query", "q", "bucket", "value", "seq").join(new.select("query"), "query", "left_anti")
    return answers, kept.unionByName(new)
