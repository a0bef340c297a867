"""Sources and sinks: Markdown trees, document tables, the ledger of content hashes, the points table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.text import normalized_lines

FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)
LEDGER = "source_path string, content_hash string"
_PREFIX = "points_prefix"


def points_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("point_id", T.StringType()),
            T.StructField("source_path", T.StringType()),
            T.StructField("chunk_index", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
        ]
    )


def _plain_path(path):
    return F.regexp_replace(path, "^file:(?://)?(?=/)", "")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root`` whose extension is exactly ``md``: source_path, content, length, modificationTime.

    A file called just ``.md`` has no extension. Like all of Spark's file sources, names that start with
    an underscore or a dot are passed over.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").option("ignoreMissingFiles", True).load(root)
    )
    return files.where(F.col("path").rlike(r"[^/]\.md$")).select(_plain_path(F.col("path")).alias("source_path"), "content", "length", "modificationTime")


def from_table(df: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """A table of documents: source_path (string) and text."""
    return df.select(F.col(path_col).cast("string").alias("source_path"), F.col(text_col).alias("text"))


def decode_documents(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` (with ``content``) into documents with their text and rejects whose bytes are not UTF-8.

    Line ends become LF and a text ends with one. A rejected document is never half read.
    """
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    texts = df.where(valid).withColumn("text", normalized_lines(F.col("content").cast("string"))).drop("content")
    return texts, df.where(~valid)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's snapshot; an empty one if there is none to read."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def write_ledger(df: DataFrame, path: str) -> None:
    df.select("source_path", "content_hash").write.mode("overwrite").parquet(path)


def import_ledger_json(texts: DataFrame) -> DataFrame:
    """Ledger rows from JSON texts (``value``) of the form {"files": {path: hash}}; unreadable ones give none."""
    files = F.from_json("value", "files map<string,string>")["files"]
    return texts.select(F.explode(files).alias("source_path", "content_hash"))


def export_ledger_json(ledger: DataFrame, per_value: int = 100_000) -> DataFrame:
    """The ledger as JSON texts (``value``) that ``import_ledger_json`` reads back.

    A ledger of up to ``per_value`` rows is one text; larger ones come as several, dealt by a hash of the
    path, so no text or task grows with the ledger.
    """
    shards = max(1, -(-ledger.count() // per_value))
    shard = F.pmod(F.xxhash64("source_path"), F.lit(shards)).alias("_shard")
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_path", "content_hash"))))
    return ledger.groupBy(shard).agg(F.to_json(F.struct(entries.alias("files"))).alias("value")).select("value")


def ensure_points_table(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """The points table at ``path``, made empty if there is none; an existing table is left alone.

    It is partitioned by the first two hex digits of the id, so that an upsert rewrites what it touches.
    """
    try:
        return read_points(spark, path)
    except AnalysisException:
        empty = spark.createDataFrame([], points_schema())
        write_points(empty, path, dim)
        return empty


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(points_schema().add(_PREFIX, "string")).parquet(path).drop(_PREFIX)


def checked_dimension(points: DataFrame, dim: int) -> DataFrame:
    """``points``; a row whose vector has another size than ``dim`` fails the job that reads it."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    wrong = F.raise_error(F.concat(F.lit(f"expected {dim} components, found "), size.cast("string")))
    return points.withColumn("embedding", F.when(size == dim, F.col("embedding")).otherwise(wrong))


def write_points(points: DataFrame, path: str, dim: int, mode: str = "overwrite", *, partitioned: bool = True) -> None:
    """Write a snapshot, or replace just the partitions that ``points`` has rows in (mode ``touched``).

    Rows are dealt out by the id's first digits and rebalanced by size, so a prefix that is large is written
    by several tasks. Not ``partitioned`` (for small versions) they are written as they come.
    """
    rows = checked_dimension(points.select(*points_schema().names), dim)
    if not partitioned:
        rows.write.mode("overwrite").parquet(path)
        return
    writer = rows.withColumn(_PREFIX, F.substring("point_id", 1, 2)).hint("rebalance", _PREFIX).write.partitionBy(_PREFIX)
    if mode == "touched":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").parquet(path)


def latest_points(updates: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row of ``updates`` for each id: that of the greatest ``order_col``, then of the greatest (path, index, text)."""
    first = [F.desc(order_col)] if order_col else []
    order = Window.partitionBy("point_id").orderBy(*first, F.desc("source_path"), F.desc("chunk_index"), F.desc("text"))
    return updates.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*points_schema().names)


def upsert_points(existing: DataFrame, updates: DataFrame, *, delete_stale: bool = False, documents: DataFrame | None = None, order_col: str | None = None) -> DataFrame:
    """``existing`` with each row of ``updates`` in place of the one with its id.

    Rows of a longer older version of a document stay unless ``delete_stale`` asks for whole documents
    to be replaced: those of ``documents`` (source_path), else those that have rows in ``updates``, by which a
    document that has become empty keeps its old rows. Of updates with one id that of the greatest
    ``order_col`` counts, then the greatest (path, index, text). Both sides are dealt out once, by id; nothing
    else is shuffled.
    """
    names = points_schema().names
    latest = latest_points(updates, order_col)
    kept = existing.select(*names)
    if delete_stale:
        whole = updates if documents is None else documents
        kept = kept.join(whole.select("source_path").distinct(), "source_path", "left_anti")
    return kept.join(latest, "point_id", "left_anti").select(*names).unionByName(latest)
