"""The corpus pipeline: each stage takes the documents that its predecessor kept, written as Parquet.

Toxic documents go; repeated runs of lines are deleted; one document of each near-duplicate group stays;
sources are mixed to their target weights; the mix is encoded in pieces. All but the last stage return
the columns of documents, n_chars being the length of the text as it is then.

In all stages: null texts count as empty and stay null where the text is kept, very long texts are worked on
whole, rows with null ids take part, no rows give no rows, and other columns come through as they are.
Repeated rows (and ties) are stated with each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.common import discard, materialize
from docquarry.llm.lines import dedup_lines
from docquarry.llm.mixing import emit_mix
from docquarry.llm.pieces import encode_pieces
from docquarry.llm.similar import keep_one_of_each
from docquarry.llm.toxicity import score_toxicity, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, does not call toxic; equal rows share their fate.

    Without labels, or without a toxic one, the score is the prior and all stay.
    """
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines of 50 words or more; emptied ones stay as empty texts.

    Rows that repeat id and text are one document and are treated alike.
    """
    found = dedup_lines(docs)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of smallest id.

    Operator 3 on five-word shingles, each link checked for 0.8 or more of them in common, and completed
    by the pairs of that bound which lie too far apart for fingerprints. Repeated rows become one, empty texts too.
    """
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as their source's target takes them, 0 to 2 times; repeated rows count one by one."""
    return emit_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and sources with the sampled pieces of each text; copies in the mix have equal pieces."""
    return encode_pieces(docs.select("doc_id", "text", "source", "n_chars"), keep_text=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Hashes, a trained model and sampling have no SQL form; tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs, made = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*made)
        made = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
