"""Structured Streaming forms: document source, debounce, micro-batch ingest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from docquarry.operators.ingest import ingest
from docquarry.sources.corpus import FILES, _plain_path

#: Fixed value: the quiet time that ends a batch of changes.
DEBOUNCE = "2 seconds"


def stream_markdown(spark: SparkSession, root: str, *, max_files: int = 1024) -> DataFrame:
    """New ``.md`` files below ``root`` as a stream: the first trigger gives all that are there.

    ``max_files`` a trigger holds back the rest. A file that is written anew is not read again by this
    source: ``files.watch_markdown`` is the one that does. A file deleted before it is read is passed over.
    """
    files = (
        spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
        .option("ignoreMissingFiles", True).option("maxFilesPerTrigger", max_files).load(root)
    )
    return files.where(F.col("path").rlike(r"[^/]\.md$")).select(_plain_path(F.col("path")).alias("source_path"), "content", "length", "modificationTime")


def debounce(changes: DataFrame, *, gap: str = DEBOUNCE, delay: str | None = None) -> DataFrame:
    """root, started, ended, paths: the different paths of each run of changes without a pause longer than ``gap``.

    For a stream give the watermark ``delay``; a run then comes out when the watermark has passed its end.
    On a batch (and for what a drained stream leaves open) all runs come out.
    """
    timed = changes.withWatermark("ts", delay) if delay and changes.isStreaming else changes
    runs = timed.groupBy("root", F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return runs.select("root", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "paths")


def drained(changes: DataFrame, emitted: DataFrame, *, gap: str = DEBOUNCE) -> DataFrame:
    """The runs of ``changes`` (all changes of a stopped stream, as a table) that are not among the ``emitted`` ones.

    A stream in append mode closes a run when its watermark passes the run's end, so it stops with the last
    ones open. A change counts as handed over if an emitted run holds its path at its time; what is left is
    debounced by itself, so late changes that the stream dropped come out too, without those they would have
    been with. All changes are met with all runs by (root, path): ``stateful.open_runs`` reads just what is open.
    """
    held = emitted.select("root", F.explode("paths").alias("path"), F.col("started").alias("_from"), F.col("ended").alias("_to"))
    same = (changes["root"] == held["root"]) & (changes["path"] == held["path"]) & (changes["ts"] >= held["_from"]) & (changes["ts"] <= held["_to"])
    return debounce(changes.join(held, same, "left_anti"), gap=gap)


def ingest_stream(
    files: DataFrame, *, points_path: str, ledger_path: str, checkpoint: str, available_now: bool = True, relist: Callable[[], DataFrame] | None = None, **options
) -> StreamingQuery:
    """Each micro-batch of ``files`` brings the points table and the ledger up to date; replays change nothing.

    A micro-batch is known by the query's id, which its checkpoint keeps, and its number.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        name = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        ingest(spark, df, points_path=points_path, ledger_path=ledger_path, relist=relist, snapshot=name, batch=number, **options)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
