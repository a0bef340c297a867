"""Toxicity (operator 10): non-negative positive-unlabelled learning over words and word beginnings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import bounded_batches, materialize, spread, with_columns_free
from docquarry.llm.licenses import words_of

ADDED = ("held_out", "score", "predicted")


#: Word beginnings of these many characters are features besides the words themselves.
STEMS = (4, 5, 6, 7)
_CACHED_WORDS = 200_000


#: A beginning that 2 or 3 different words of a text share is a feature of its own.
SHARED = (2, 3)


def beginnings(word: bytes) -> list[bytes]:
    """The word's beginnings, marked by a hyphen (which no word holds)."""
    text = word.decode()
    return [text[:n].encode() + b"-" for n in STEMS if len(text) > n]


def features_of(text: str | None) -> list[bytes]:
    """Features of a whole text: its distinct words, their beginnings, and beginnings shared by several."""
    words = set(words_of(text))
    stems = Counter(b for w in words for b in beginnings(w))
    return sorted([*words, *stems, *(b + b"%d" % n for b, k in stems.items() for n in SHARED if k >= n)])


class Features(dict):
    """Word to the chosen features it adds to, as numbers; filled as words come, emptied when it is full."""

    def __init__(self, place: dict[bytes, int]):
        super().__init__()
        self.whole = {f: i for f, i in place.items() if b"-" not in f}
        self.stems: dict[bytes, list[tuple[int, int]]] = {}  # beginning: least number of words, feature
        for f, i in place.items():
            if b"-" in f:
                stem, _, least = f.partition(b"-")
                self.stems.setdefault(stem + b"-", []).append((int(least or 1), i))

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        found = [b for b in beginnings(word) if b in self.stems] + [word] * (word in self.whole)
        self[word] = found = tuple(found)
        return found

    def of(self, text: str | None) -> list[int]:
        seen = Counter(f for fs in map(self.__getitem__, set(words_of(text))) for f in fs)
        return sorted([i for f, k in seen.items() for n, i in self.stems.get(f, ()) if k >= n] + [self.whole[f] for f in seen if f in self.whole])


class ToxicityModel(NamedTuple):
    """Weights of features, the bias, and the class prior they were trained with."""

    place: dict[bytes, int]
    weights: np.ndarray
    bias: float
    prior: float


def is_held_out(id_col: Column, folds: int = 4, fold: int = 2) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(True))


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, *, rounds: int = 400, rate: float = 0.05, l2: float = 3e-4
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier over 0/1 features, by the non-negative PU risk.

    The risk of the positive class comes from the positives; that of the negative class is the
    unlabelled risk less the share the positives explain, E_U[l(-f)] - prior * E_P[l(-f)]. Where that
    falls below zero the classifier has begun to fit single rows, and the step goes back up instead.
    The loss is logistic, so sigmoid(f) estimates the class probability. Full-batch Adam; no randomness.
    """

    def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([*rows, np.empty(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    p_index, p_row = packed(positive)
    u_index, u_row = packed(unlabelled)
    w = np.zeros(size + 1)
    w[size] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def scores(index: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, w[index], minlength=n) + w[size]

    def back(index: np.ndarray, row: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.bincount(index, g[row], minlength=size + 1)
        out[size] = g.sum()
        return out

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    n_p, n_u = len(positive), len(unlabelled)
    for step in range(1, rounds + 1):
        fp, fu = scores(p_index, p_row, n_p), scores(u_index, u_row, n_u)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_negative = back(u_index, u_row, sigmoid(fu) / n_u) - back(p_index, p_row, prior * sigmoid(fp) / n_p)
        if negative >= 0:
            gradient = back(p_index, p_row, -prior * sigmoid(-fp) / n_p) + g_negative
        else:
            gradient = -g_negative
        gradient[:size] += l2 * w[:size]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient * gradient
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:size], float(w[size])


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "toxic",
    max_positive: int = 3000,
    max_unlabelled: int = 9000,
    vocabulary: int = 1000,
    least_rows: int = 5,
) -> ToxicityModel:
    """Train from confirmed toxic rows of the training folds plus texts whose labels are not looked at.

    The fit is on a bounded sample: at most ``max_positive`` toxic rows and ``max_unlabelled`` labelled
    rows of any label, those of smallest md5 of the id, so reruns agree. Only their ids (a proven bound)
    are broadcast to find their texts in one scan. Features are words and word beginnings, present or
    not: the ``vocabulary`` of them whose share of toxic rows differs most from their share of the
    unlabelled rows, in standard deviations, among those in at least ``least_rows``. The class prior is the toxic share of all training labels.
    Without a toxic row (or labels, or documents) the model is empty and scores everything at its prior,
    held between 0.0001 and 0.5. Of rows that repeat an id one (of the smallest hash of the text) is learnt
    from. Null and empty texts have no features. Very long texts are read whole.
    """
    spark = docs.sparkSession
    known = (
        labels.where(~is_held_out(F.col(id_col)) & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_toxic"))
    )
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.sum("_toxic").alias("k")).first()
    prior = min(0.5, max(1e-4, (counts["k"] or 0) / counts["n"])) if counts["n"] else 1e-4
    empty = ToxicityModel({}, np.empty(0), float(np.log(prior / (1 - prior))), prior)
    if not counts["k"]:
        return empty
    order = [F.md5(F.col("_id").cast("string")), F.col("_id")]
    positive = known.where("_toxic = 1").orderBy(*order).limit(max_positive).select("_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    unlabelled = known.orderBy(*order).limit(max_unlabelled).select("_id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    sample = positive.union(unlabelled).groupBy("_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches):
            found = [features_of(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["p", "u", "f"])

    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(sample), F.col("_doc") == F.col("_id"))
    # An id that stands in many rows counts once, so the sample's bound is one of rows.
    one = F.min(F.struct(F.xxhash64("_text").alias("h"), "_text")).alias("r")
    rows = rows.groupBy("_id", "p", "u").agg(one).select("p", "u", "r._text")
    bag = materialize(rows.mapInArrow(bags, "p int, u int, f array<binary>"), "toxicity-sample")
    n = bag.agg(F.sum("p").alias("p"), F.sum("u").alias("u")).first()
    if not n["p"] or not n["u"]:
        return empty
    seen = bag.select("p", "u", F.explode("f").alias("f")).groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share_p, share_u = F.col("p") / n["p"], (F.col("u") + 1) / (n["u"] + 2)
    contrast = F.abs(share_p - share_u) / F.sqrt(share_u * (1 - share_u))
    chosen = seen.where((F.col("p") >= least_rows) | (F.col("u") >= 4 * least_rows)).orderBy(F.desc(F.round(contrast, 9)), "f").limit(vocabulary)
    words = [bytes(r["f"]) for r in chosen.select("f").collect()]
    place = {w: i for i, w in enumerate(words)}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches):
            found = [sorted(place[w] for w in ws if w in place) for ws in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["p", "u", "i"])

    features = bag.mapInArrow(index, "p int, u int, i array<int>").collect()
    rows_of = {k: sorted((np.array(r["i"], np.int64) for r in features if r[k]), key=lambda x: (len(x), x.tolist())) for k in ("p", "u")}
    weights, bias = fit_nnpu(rows_of["p"], rows_of["u"], len(words), prior)
    return ToxicityModel(place, weights, bias, prior)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.3
) -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from ``threshold`` on).

    Only the text enters a score: the features of the whole text's distinct words. Null and empty texts get the
    score of the bias alone. Very long texts are scored whole. Null ids count as held out. Repeated rows get equal scores; no rows: no
    rows. Clashing columns are replaced. The model has at most as many words as its vocabulary bound;
    there is no shuffle.
    """
    base = with_columns_free(docs, *ADDED).withColumn("held_out", is_held_out(F.col(id_col)))
    columns = base.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Features(model.place), model.weights
        for batch in bounded_batches(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            logits = np.clip([model.bias + float(weights[features.of(t)].sum()) for t in texts], -40, 40)
            score = 1 / (1 + np.exp(-logits))
            predicted = pa.array((score >= threshold).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), predicted], names=[*columns, *ADDED[1:]])

    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return base.mapInArrow(judge, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", *ADDED)
