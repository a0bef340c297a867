"""Incremental ingest: changed documents, chunks, embeddings, points, commit, ledger."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.chunking import MAX_BYTES, chunk_documents
from docquarry.functions.text import content_hash, point_id
from docquarry.functions.vectors import DIMENSION, FLOATS, embed_chunk, with_fallback
from docquarry.sources import corpus, versions as log
from docquarry.sources.scratch import discard, materialize

# Texts a request, retries, and the first wait in seconds, which doubles.
BATCH_SIZE = 16
RETRIES = 3
FIRST_WAIT = 2.0

Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def markdown_changes(changes: DataFrame) -> DataFrame:
    """Create and Modify events of ``.md`` files; deletes and other files are passed over."""
    return changes.where(F.col("kind").isin("Create", "Modify") & F.col("path").rlike(r"[^/]\.md$"))


def changed_documents(docs: DataFrame, ledger: DataFrame, *, keep_unchanged: bool = False) -> DataFrame:
    """``docs`` (source_path, content_hash, ...) that the ledger does not hold as they are, with ``status``.

    status: new, changed, or unchanged (only with ``keep_unchanged``). Hand in narrow rows: the join
    deals both sides out by path.
    """
    known = ledger.select("source_path", F.col("content_hash").alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(F.col("_known") != F.col("content_hash"), "changed").otherwise("unchanged")
    found = docs.join(known, "source_path", "left").withColumn("status", status).drop("_known")
    return found if keep_unchanged else found.where("status <> 'unchanged'")


def update_ledger(ledger: DataFrame, committed: DataFrame, *, order_col: str | None = None) -> DataFrame:
    """The ledger with the committed documents' hashes in place of their old ones; one row a path.

    Of a path that ``committed`` has more than once the row of the greatest ``order_col`` counts (a time or a
    batch number), else and among equals the greatest hash.
    """
    order = F.struct(F.col(order_col), F.col("content_hash")) if order_col else F.col("content_hash")
    latest = committed.groupBy("source_path").agg(F.max_by("content_hash", order).alias("content_hash"))
    kept = ledger.select("source_path", "content_hash").join(latest, "source_path", "left_anti")
    return kept.unionByName(latest)


def stable_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of the second listing whose size is that of the first; others wait for a later run."""
    before = first.select("source_path", F.col("length").alias("_before"))
    return second.join(before, "source_path").where("length = _before").drop("_before")


def commit_unchanged(processed: DataFrame, relisted: DataFrame) -> DataFrame:
    """Processed rows whose file has the same time and size as before, or cannot be listed any more."""
    now = relisted.select("source_path", F.col("modificationTime").alias("_time"), F.col("length").alias("_length"), F.lit(True).alias("_there"))
    same = (F.col("_time") == F.col("modificationTime")) & (F.col("_length") == F.col("length"))
    return processed.join(now, "source_path", "left").where(F.col("_there").isNull() | same).drop("_time", "_length", "_there")


class Kept:
    """Answers of a provider by the hash of what was asked, in a folder that all tasks reach (a URI that pyarrow opens)."""

    def __init__(self, uri: str, model: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.model = model

    def _path(self, texts: Sequence[str]) -> str:
        digest = hashlib.sha256(self.model.encode())
        for text in texts:
            raw = text.encode()
            digest.update(b"%d:" % len(raw) + raw)
        return f"{self.root.rstrip('/')}/{digest.hexdigest()}.arrow"

    def get(self, texts: Sequence[str]) -> list | None:
        path = self._path(texts)
        if self.fs.get_file_info(path).type != pafs.FileType.File:
            return None
        with self.fs.open_input_file(path) as f:
            found = pa.ipc.open_file(f).read_all().column(0).combine_chunks()
        ends = np.asarray(found.offsets)
        return np.split(np.asarray(found.flatten()), (ends - ends[0])[1:-1]) if len(found) else []

    def put(self, texts: Sequence[str], vectors: Sequence[np.ndarray]) -> None:
        path = self._path(texts)
        beside = f"{path}.{uuid.uuid4().hex}"
        table = pa.table({"v": pa.array(list(vectors), pa.list_(pa.float32()))})
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(beside) as f, pa.ipc.new_file(f, table.schema) as writer:
            writer.write_table(table)
        self.fs.move(beside, path)


def embed_with(
    df: DataFrame,
    embed: Embedder,
    *,
    text_col: str = "text",
    batch_size: int = BATCH_SIZE,
    retries: int = RETRIES,
    first_wait: float = FIRST_WAIT,
    on_error: str = "fail",
    in_flight: int = 1,
    kept_in: str | None = None,
    model: str = "",
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """``df`` with ``embedding``: what ``embed`` gives for batches of texts, called in the tasks.

    A call that raises, or gives another number of vectors than texts, is tried again after 2, 4 and 8
    seconds; then the task fails, or with on_error="column" the batch gets null vectors and ``error``.
    A task has ``in_flight`` calls under way at most and takes their answers in order. ``kept_in`` names a
    folder that all tasks reach, where answers are kept by the hash of ``model`` and the batch's texts: a task
    that is run again, or a later run, repeats no call that was answered.
    """
    batch_size = max(1, batch_size)
    keep_error = on_error == "column"

    def call(texts: list[str], kept: Kept | None) -> tuple[list | None, str | None]:
        if kept and (found := kept.get(texts)) is not None:
            return found, None
        for attempt in range(retries + 1):
            try:
                vectors = [np.asarray(v, np.float32) for v in embed(texts)]
                if len(vectors) != len(texts):
                    raise ValueError(f"embedding count mismatch: request has {len(texts)} item(s) but response has {len(vectors)} item(s)")
            except Exception as error:  # noqa: BLE001  any failure of the provider counts
                if attempt == retries:
                    if keep_error:
                        return None, str(error)
                    raise
                sleep(first_wait * 2**attempt)
            else:
                if kept:
                    kept.put(texts, vectors)
                return vectors, None
        raise AssertionError

    def answers(batches: list[list[str]], kept: Kept | None) -> Iterator[tuple[list | None, str | None]]:
        if in_flight <= 1:
            yield from (call(texts, kept) for texts in batches)
            return
        with ThreadPoolExecutor(in_flight) as pool:
            waiting: deque = deque()
            for texts in batches:
                if len(waiting) == in_flight:
                    yield waiting.popleft().result()
                waiting.append(pool.submit(call, texts, kept))
            while waiting:
                yield waiting.popleft().result()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = Kept(kept_in, model) if kept_in else None
        for frame in frames:
            vectors: list = []
            errors: list = []
            texts = frame[text_col].tolist()
            batches = [texts[at : at + batch_size] for at in range(0, len(texts), batch_size)]
            for part, (found, error) in zip(batches, answers(batches, kept), strict=True):
                vectors += found if found is not None else [None] * len(part)
                errors += [error] * len(part)
            out = frame.assign(embedding=vectors)
            yield out.assign(error=errors) if keep_error else out

    schema = T.StructType([f for f in df.schema.fields if f.name not in ("embedding", "error")] + [T.StructField("embedding", FLOATS)])
    if keep_error:
        schema = schema.add("error", "string")
    return df.drop("embedding", "error").mapInPandas(run, schema)


def points_of(chunks: DataFrame, *, dim: int = DIMENSION, embed: Embedder | None = None, **options) -> DataFrame:
    """Points of chunk rows: id, place, text, vector of ``dim`` components (deterministic where a provider's has another size).

    With on_error="column" among the ``options`` of ``embed_with``, ``error`` says why a chunk has no vector.
    """
    if embed is None:
        embedded = chunks.withColumn("embedding", embed_chunk(F.col("text"), dim)).withColumn("error", F.lit(None).cast("string"))
    else:
        embedded = embed_with(chunks, embed, **options)
        embedded = embedded if "error" in embedded.columns else embedded.withColumn("error", F.lit(None).cast("string"))
        fitting = with_fallback(F.col("embedding"), F.when(F.col("error").isNull(), F.col("text")), dim)
        embedded = embedded.withColumn("embedding", F.when(F.col("error").isNull(), fitting))
    error = ["error"] if options.get("on_error") == "column" else []
    return embedded.select(point_id(F.col("source_path"), F.col("chunk_index")).alias("point_id"), "source_path", "chunk_index", "text", "embedding", *error)


#: Bytes of paths, and rows of ids, that may go along with the tasks.
_SMALL, _SMALL_ROWS = 16 << 20, 1 << 20
#: Seconds that replaced rows are kept for readers that have begun.
GRACE = 3600.0


def _one_of_each(held: DataFrame) -> DataFrame:
    """Of a path that is there more than once the file written last (then the longest, then the greatest hash)."""
    repeated = held.groupBy("source_path").count().where("count > 1").select("source_path")
    if repeated.isEmpty():
        return held
    order = Window.partitionBy("source_path").orderBy(F.desc("modificationTime"), F.desc("length"), F.desc("content_hash"))
    twice = held.join(repeated, "source_path", "left_semi").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")
    return held.join(repeated, "source_path", "left_anti").unionByName(twice)


def ingest(
    spark: SparkSession,
    files: DataFrame,
    *,
    points_path: str,
    ledger_path: str,
    relist: Callable[[], DataFrame] | None = None,
    dim: int = DIMENSION,
    max_bytes: int = MAX_BYTES,
    embed: Embedder | None = None,
    delete_stale: bool = False,
    snapshot: str,
    batch: int = 0,
    compact_after: int = 32,
    grace: float = GRACE,
    **embedding,
) -> dict[str, int]:
    """Bring the points table and the ledger up to date with ``files``; safe to run again.

    ``files`` is a listing as from ``read_markdown``; of a path that it has twice the file written last counts.
    Only (path, hash) rows meet the ledger. The changed files are then read once into a table of their own
    (bytes, hash of these bytes, time, size), and everything after rests on it: what is chunked is what the
    ledger's hash is of. A file that was written anew in the meantime (its time or size in ``relist`` is
    another) is not committed and comes up again; so is one whose embedding fails (``embed_with`` with the
    options ``embedding``), of which no point is written either.

    A run is known by ``snapshot`` and ``batch`` (streams: one name and rising numbers). Its rows are written
    under fresh names, then one entry in the points table's log publishes points and ledger rows together.
    What is published already is not done again and its counts are returned; a run that failed before leaves
    nothing that readers see. The ledger's own log follows the points' log, here or at the next run. ``dim``
    must be the table's, or nothing is written. ``delete_stale``: all documents of this run, empty ones too,
    replace all their older points.

    Readers take the newest row of each key (``current_points``, ``current_ledger``). After ``compact_after``
    versions, or when their ids are too many to go along with tasks, they are written together, and what is
    replaced is deleted ``grace`` seconds later. Returns the numbers of changed, rejected and committed
    documents, and of failed ones if there are some.
    """
    entries = log.log(spark, points_path)
    log.check_contract(entries, points_path, dim)
    _follow(spark, points_path, ledger_path, entries)
    if (stands := log.published(entries, snapshot, batch)) is not None:
        return stands["counts"]
    hashed = materialize(files.select("source_path", content_hash(F.col("content")).alias("content_hash")), "hashed")
    size = hashed.agg(F.sum(F.octet_length("source_path"))).first()[0] or 0
    known = current_ledger(spark, ledger_path, among=hashed.select("source_path") if size <= _SMALL else None)
    changed = materialize(changed_documents(hashed, known).select("source_path").distinct(), "changed")
    wanted = F.broadcast(changed) if size <= _SMALL else changed  # else the contents are dealt out by path
    held = files.join(wanted, "source_path", "left_semi").withColumn("content_hash", content_hash(F.col("content")))
    held = materialize(_one_of_each(materialize(held.withColumn("_valid", F.is_valid_utf8(F.col("content").cast("string"))), "read")), "held")
    texts, _ = corpus.decode_documents(held.where("_valid"))
    options = {"on_error": "column", **embedding} if embed else {}
    points = points_of(chunk_documents(texts, max_bytes), dim=dim, embed=embed, **options)
    done = held.where("_valid").select("source_path", "length", "modificationTime", "content_hash")
    failed = None
    if "error" in points.columns:
        points = materialize(points, "embedded")
        failed = materialize(points.where("error is not null").select("source_path").distinct(), "failed")
        n_failed = failed.count()
        points = points.drop("error")
        if n_failed:
            points, done = points.join(failed, "source_path", "left_anti"), done.join(failed, "source_path", "left_anti")
    counts = {"changed": held.count(), "rejected": held.where("not _valid").count()}
    data, ledger = log.fresh(points_path), log.fresh(ledger_path)
    corpus.write_points(points, data, dim, partitioned=False)
    replaced = None
    if delete_stale:
        replaced = log.fresh(points_path)
        done.select("source_path").write.parquet(replaced)
    committed = commit_unchanged(done, relist()) if relist else done
    corpus.write_ledger(committed, ledger)
    counts["committed"] = corpus.read_ledger(spark, ledger).count()
    if failed is not None and n_failed:
        counts["failed"] = n_failed
    stands, _ = log.publish(
        spark, points_path, writer=snapshot, batch=batch, data=data, dim=dim, rows=corpus.read_points(spark, data).count(), counts=counts,
        ledger=ledger.removeprefix(f"{ledger_path}/"), replaced=replaced and replaced.removeprefix(f"{points_path}/"),
    )
    _follow(spark, points_path, ledger_path, [stands])
    discard(hashed, changed, held)
    live = log.live(log.log(spark, points_path))
    if len(live) > compact_after or sum(e["rows"] for e in live[1:]) > _SMALL_ROWS:
        compact(spark, points_path, ledger_path, dim=dim, grace=grace)
    return stands["counts"]


def _follow(spark: SparkSession, points_path: str, ledger_path: str, entries: list[log.Entry]) -> None:
    """Publish in the ledger's log what ``entries`` of the points' log say of it and it does not have yet."""
    pending = [e for e in entries if e["upto"] is None and e.get("ledger")]
    if not pending:
        return
    there = log.log(spark, ledger_path)
    for entry in pending:
        if log.published(there, entry["writer"], entry["batch"]) is None:
            log.publish(spark, ledger_path, writer=entry["writer"], batch=entry["batch"], data=f"{ledger_path}/{entry['ledger']}", rows=entry["counts"]["committed"], counts=entry["counts"])


class Version(NamedTuple):
    """One version of a table: its folder, its rows, and the folder of the documents whose older rows it replaces."""

    folder: str
    rows: int
    replaced: str | None


def versions(spark: SparkSession, path: str) -> list[Version]:
    """What makes up the table, oldest first."""
    full = lambda name: f"{path}/{name}" if name else None
    return [Version(full(e["data"]), e["rows"], full(e.get("replaced"))) for e in log.live(log.log(spark, path))]


def current_points(spark: SparkSession, path: str) -> DataFrame:
    """The points table at ``path``; an empty one if nothing was ingested.

    Of an id in several versions the newest row counts; documents that a version replaces have none of
    their older rows. Only ids and paths of the versions after the first are worked on: up to a million of them
    go along with the tasks and no vector is shuffled; with more, rows meet them by a join on the id.
    """
    found = versions(spark, path)
    if not found:
        return spark.createDataFrame([], corpus.points_schema())
    if len(found) == 1:
        return corpus.read_points(spark, found[0].folder)
    parts = [corpus.read_points(spark, v.folder).withColumn("_version", F.lit(i)) for i, v in enumerate(found)]
    rows = reduce(DataFrame.unionByName, parts)
    ids = reduce(DataFrame.unionByName, [p.select("point_id", "_version") for p in parts[1:]])
    newest = ids.groupBy("point_id").agg(F.max("_version").alias("_newest"))
    small = sum(v.rows for v in found[1:]) <= _SMALL_ROWS
    rows = rows.join(F.broadcast(newest) if small else newest, "point_id", "left").where("_newest is null or _newest = _version")
    if gone := [spark.read.schema("source_path string").parquet(v.replaced).withColumn("_at", F.lit(i)) for i, v in enumerate(found) if v.replaced]:
        since = reduce(DataFrame.unionByName, gone).groupBy("source_path").agg(F.max("_at").alias("_since"))
        since = F.broadcast(since) if small and since.count() <= _SMALL_ROWS else since
        rows = rows.join(since, "source_path", "left").where("_since is null or _since <= _version")
    return rows.select(*corpus.points_schema().names)


def current_ledger(spark: SparkSession, path: str, among: DataFrame | None = None) -> DataFrame:
    """The ledger at ``path``; an empty one if there is none. ``among`` (source_path, few enough to go along) asks for these paths only."""
    found = versions(spark, path)
    if not found:
        return spark.createDataFrame([], corpus.LEDGER)
    rows = reduce(DataFrame.unionByName, [corpus.read_ledger(spark, v.folder).withColumn("_version", F.lit(i)) for i, v in enumerate(found)])
    if among is not None:
        rows = rows.join(F.broadcast(among.distinct()), "source_path", "left_semi")
    if len(found) == 1:
        return rows.drop("_version")
    return rows.groupBy("source_path").agg(F.max_by("content_hash", "_version").alias("content_hash"))


def compact(spark: SparkSession, points_path: str, ledger_path: str, *, dim: int, grace: float = GRACE) -> None:
    """Write all versions of each table together as its base, and delete what earlier bases have replaced."""
    for path, current in ((points_path, current_points), (ledger_path, current_ledger)):
        entries = log.log(spark, path)
        if len(log.live(entries)) > 1:
            folder = log.fresh(path)
            rows = current(spark, path)
            if path == points_path:
                corpus.write_points(rows, folder, dim)
                n, size = corpus.read_points(spark, folder).count(), dim
            else:
                corpus.write_ledger(rows, folder)
                n, size = corpus.read_ledger(spark, folder).count(), None
            log.publish(spark, path, writer=f"base-{uuid.uuid4().hex}", data=folder, dim=size, rows=n, upto=entries[-1]["number"])
        log.vacuum(spark, path, grace)
