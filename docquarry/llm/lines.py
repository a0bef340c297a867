"""Line dedup (operator 1): winnowing over line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.llm.common import LOWER_ASCII, bounded_batches, materialize, spread, with_columns_free

MIN_WORDS = 50
ADDED = ("n_lines", "n_removed", "removed_words", "removed")
_WINDOW = ("k", "start", "end", "anchor", "blank", "more", "anchor_hash", "content_a", "content_b")
_KINDS = ("int",) * 6 + ("bigint",) * 3


def line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line)


def line_windows(text: str | None, min_words: int) -> tuple[np.ndarray, dict[str, np.ndarray]] | None:
    """Hashes of all lines of a text and its windows, None if it has none.

    From each line with a word on, a window is the least run of lines that holds ``min_words`` words. Its
    anchor is the line with the smallest hash, the last of equals: the same run elsewhere has the same
    anchor, so every repeated run of that length is sure to share a fingerprint. The content is a 128-bit
    hash of the window's bytes. ``blank`` lines without a word stand just before the window; ``more`` lines
    behind it hold less than ``min_words`` words together.
    """
    whole = (text or "").encode()
    raw = whole.split(b"\n")
    words = np.fromiter((len(x.translate(LOWER_ASCII).split()) for x in raw), np.int64, len(raw))
    total = np.concatenate(([0], np.cumsum(words)))
    if total[-1] < min_words:
        return None
    hashes = np.fromiter(map(line_hash, raw), np.uint64, len(raw)).view(np.int64)
    start = np.flatnonzero(words > 0)
    blank = np.diff(start, prepend=-1) - 1
    end = np.searchsorted(total, total[start] + min_words)
    fits = end <= len(raw)
    start, end, blank = start[fits], end[fits], blank[fits]
    more = np.searchsorted(total, total[end] + min_words) - 1 - end
    anchor = np.empty(len(start), np.int64)
    queue: list[int] = []  # lines of the window with rising hashes
    head, reached = 0, 0
    for k, (s, e) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
        for i in range(max(reached, s), e):
            while len(queue) > head and hashes[queue[-1]] >= hashes[i]:
                queue.pop()
            queue.append(i)
        reached = max(reached, e)
        while queue[head] < s:
            head += 1
        anchor[k] = queue[head]
    place = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1))).tolist()
    digests = b"".join(xxhash.xxh3_128_digest(whole[place[s] : place[e] - 1]) for s, e in zip(start.tolist(), end.tolist(), strict=True))
    content = np.frombuffer(digests, np.int64).reshape(-1, 2)
    made = (np.arange(len(start)), start, end, anchor, blank, more, hashes[anchor], content[:, 0], content[:, 1])
    return hashes, dict(zip(_WINDOW, made, strict=True))


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def lines_of(docs: DataFrame, text_col: str, id_col: str, min_words: int) -> DataFrame:
    """doc, row (hash of the text), hashes of its lines, and its windows as an array for each column, for texts with windows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches):
            found = [line_windows(t, min_words) for t in batch.column(2).to_pylist()]
            keep = pa.array([f is not None for f in found])
            parts = [f for f in found if f is not None]
            arrays = [_lists([h for h, _ in parts], pa.int64())]
            for name, kind in zip(_WINDOW, _KINDS, strict=True):
                arrays.append(_lists([w[name] for _, w in parts], pa.int32() if kind == "int" else pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), *arrays], names=["doc", "row", "hashes", *_WINDOW])

    source = docs.select(F.col(id_col).cast("long"), _row_key(F.col(text_col)), F.col(text_col))
    return source.mapInArrow(make, "doc long, row long, hashes array<bigint>, " + ", ".join(f"{n} array<{k}>" for n, k in zip(_WINDOW, _KINDS, strict=True)))


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays]), kind, safe=False))


def repeated_runs(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """Runs to delete: doc, row (hash of the text), runs (start, end, head, tail), one row per document with any.

    Fingerprints (anchor hashes of windows) are counted by place; the windows around those met at two
    places or more are candidates. Of the places with one content the earliest, in order of (id, text hash,
    line), stays; each later one is joined to it, and brings along the line hashes that stand around the
    earliest place, so that the match is extended both ways where the later text is at hand. Nothing is
    paired but a later place with its earliest one: fingerprints and contents are aggregated with map-side
    combine, so a line that stands everywhere costs its own places and no more.
    """
    written = materialize(lines_of(docs, text_col, id_col, min_words).withColumn("_copy", F.monotonically_increasing_id()), "lines")
    # Of rows that repeat id and text one counts; only ids and hashes are dealt out to find them.
    copies = written.groupBy("doc", "row").agg(F.count(F.lit(1)).alias("n"), F.min("_copy").alias("_one")).where("n > 1")
    copies = materialize(copies.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), "_one"), "line-copies")
    lines = written
    if not copies.isEmpty():
        met = written.join(copies, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")), "left")
        lines = materialize(met.where("_one is null or _one = _copy").drop("_doc", "_row", "_one"), "lines-once")
    found = lines.select("doc", "row", F.inline(F.arrays_zip(*_WINDOW)))
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "row", F.col("anchor").alias("at"))
    # The small tables are written, so the joins below stand on plain exchanges and a hot key is split.
    places = found.groupBy("anchor_hash").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi")
    fingerprints = materialize(places.select("anchor_hash"), "line-fingerprints")
    candidates = materialize(found.join(fingerprints, "anchor_hash", "left_semi"), "line-candidates")
    at = F.struct(F.col("doc").isNull().alias("last"), "doc", "row", "start")
    around = F.struct(*at_fields(), "end", "blank", "more")
    content = ["content_a", "content_b"]
    repeated = candidates.groupBy(*content).agg(F.min(around).alias("lo"), F.max(at).alias("hi")).where("lo.doc is distinct from hi.doc or lo.row <> hi.row or lo.start <> hi.start")
    first = materialize(repeated.select(*content, "lo.*"), "line-first")
    own = lines.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), "hashes")
    near = first.join(own.dropDuplicates(["_doc", "_row"]), F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")))
    head, tail = F.slice("hashes", F.col("start") - F.col("blank") + 1, F.col("blank")), F.slice("hashes", F.col("end") + 1, F.col("more"))
    near = near.select(*content, F.struct(*at_fields()).alias("lo"), head.alias("head"), tail.alias("tail"))
    near = materialize(near, "line-near")
    later = candidates.join(near, content).where(at > F.col("lo")).withColumn("shift", F.col("start") - F.col("lo.start"))
    # Where the next window of the text lies along the same two places, it goes further than this one's lines behind.
    order = Window.partitionBy("doc", "row").orderBy("k")
    same = lambda move, by: F.coalesce(
        (move("k").over(order) == F.col("k") + by) & (move("shift").over(order) == F.col("shift"))
        & move("lo.doc").over(order).eqNullSafe(F.col("lo.doc")) & (move("lo.row").over(order) == F.col("lo.row")), F.lit(False)
    )
    none = F.array().cast("array<bigint>")
    later = later.withColumns({"_before": same(F.lag, -1), "_behind": same(F.lead, 1)})
    run = F.struct("start", "end", F.when(F.col("_before"), none).otherwise(F.col("head")).alias("head"), F.when(F.col("_behind"), none).otherwise(F.col("tail")).alias("tail"))
    return later.groupBy("doc", "row").agg(F.array_sort(F.collect_set(run)).alias("runs"))


def at_fields() -> list[Column]:
    """The order of places: null ids last, then id, text hash and line."""
    return [F.col("doc").isNull().alias("last"), F.col("doc"), F.col("row"), F.col("start")]


def extended(lines: list[str], runs: list[dict]) -> np.ndarray:
    """Which lines go: each run with the lines before and behind it that are those around the earliest place."""
    gone = np.zeros(len(lines) + 1, np.int64)
    for run in runs:
        s, e = run["start"], run["end"]
        for wanted in reversed(run["head"]):
            if s == 0 or np.int64(np.uint64(line_hash(lines[s - 1].encode()))) != wanted:
                break
            s -= 1
        for wanted in run["tail"]:
            if e == len(lines) or np.int64(np.uint64(line_hash(lines[e].encode()))) != wanted:
                break
            e += 1
        gone[s] += 1
        gone[e] -= 1
    return np.cumsum(gone)[:-1] > 0


def dedup_lines(
    docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS
) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from the text, and n_lines, n_removed, removed_words, removed.

    A match begins with a window (the least run of consecutive lines from a line on that holds
    ``min_words`` words) that stands, byte for byte, at an earlier place too: in a document of smaller id
    (null ids last), or higher up in the same text. It is extended line by line, both ways, as far as the
    text goes on like the earliest place of that window, and all its lines go. (Behind it at most
    ``min_words`` words are looked at: a run that goes on longer holds the next windows.) Of each deleted
    line an equal one is left somewhere earlier. ``removed`` lists the deleted line numbers from 0; a text
    that loses all its lines becomes empty, its row stays. Windows are equal by a 128-bit hash of their
    bytes, the lines around them by 64 bits each.

    Null text stays null; empty and short texts, and lines outside such runs, stay. Rows that repeat both
    id and text are one document and are treated alike. Texts of any length work; a text is handled in one
    task, in time in proportion to its length. No rows: no rows. Clashing columns are replaced. Windows
    (about one a line) are shuffled, and the texts once, to meet their deletions.
    """
    base = with_columns_free(docs, *ADDED, "_doc", "_row", "_r", "_runs")
    columns = base.columns
    runs = repeated_runs(base, text_col=text_col, id_col=id_col, min_words=min_words).toDF("_doc", "_r", "_runs")
    keyed = base.withColumn("_row", _row_key(F.col(text_col)))
    joined = keyed.join(runs, (F.col("_row") == F.col("_r")) & F.col(id_col).cast("long").eqNullSafe(F.col("_doc")), "left")
    joined = joined.drop("_doc", "_r", "_row")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded_batches(batches):
            at = batch.schema.get_field_index
            kept, n_lines, removed, words = [], [], [], []
            for text, found in zip(batch.column(at(text_col)).to_pylist(), batch.column(at("_runs")).to_pylist(), strict=True):
                n_lines.append(0 if text is None else text.count("\n") + 1)
                if not found:
                    kept.append(text)
                    removed.append([])
                    words.append(0)
                    continue
                lines = text.split("\n")
                gone = extended(lines, found)
                kept.append("\n".join(x for x, g in zip(lines, gone, strict=True) if not g))
                removed.append(np.flatnonzero(gone).tolist())
                words.append(sum(len(x.encode().translate(LOWER_ASCII).split()) for x, g in zip(lines, gone, strict=True) if g))
            made = {
                text_col: pa.array(kept, pa.string()),
                "n_lines": pa.array(n_lines, pa.int64()),
                "n_removed": pa.array(map(len, removed), pa.int64()),
                "removed_words": pa.array(words, pa.int64()),
                "removed": pa.array(removed, pa.list_(pa.int32())),
            }
            names = [*columns, *ADDED]
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(at(c)) for c in names], names=names)

    schema = T.StructType(
        [*base.schema.fields, *[T.StructField(c, T.LongType()) for c in ADDED[:3]], T.StructField("removed", T.ArrayType(T.IntegerType()))]
    )
    return joined.mapInArrow(strip, schema)


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "removed_words", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
c AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
         sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM l),
w AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e
  FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c - (a.c - a.w) >= 50
  WHERE a.w > 0 GROUP BY a.doc_id, a.i),
h AS (
  SELECT w.doc_id, s, e, md5(list_aggregate(d.lines[s:e], 'string_agg', chr(10))) AS g FROM w JOIN d ON w.doc_id = d.doc_id),
n AS (
  SELECT *, first_value({'doc': doc_id, 's': s, 'e': e}) OVER (PARTITION BY g ORDER BY doc_id, s) AS q,
         row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS n FROM h),
reach AS (
  SELECT q.doc AS doc_id, q.s AS s, q.e AS e,
         (SELECT count(*) FROM c WHERE c.doc_id = q.doc AND c.i > q.e AND c.c - z.c < 50) AS more,
         q.s - 1 - coalesce((SELECT max(i) FROM c WHERE c.doc_id = q.doc AND c.i < q.s AND c.w > 0), 0) AS blank
  FROM (SELECT DISTINCT q FROM n WHERE n > 1) JOIN c z ON z.doc_id = q.doc AND z.i = q.e),
later AS (
  SELECT n.doc_id, n.s, n.e, r.more, r.blank,
         list_position(list_transform(range(1, r.more + 1), lambda k: a.lines[n.e + k] IS DISTINCT FROM b.lines[r.e + k]), true) AS stop,
         list_position(list_transform(range(1, r.blank + 1), lambda k: n.s - k < 1 OR a.lines[n.s - k] IS DISTINCT FROM b.lines[r.s - k]), true) AS halt
  FROM n JOIN reach r ON r.doc_id = q.doc AND r.s = q.s JOIN d a ON a.doc_id = n.doc_id JOIN d b ON b.doc_id = r.doc_id WHERE n > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s - CASE WHEN coalesce(halt, 0) > 0 THEN halt - 1 ELSE blank END,
                                       e + CASE WHEN coalesce(stop, 0) > 0 THEN stop - 1 ELSE more END + 1)) AS i FROM later),
k AS (
  SELECT c.doc_id, count(g.i) AS n_removed, coalesce(sum(CASE WHEN g.i IS NOT NULL THEN w END), 0)::BIGINT AS removed_words,
         coalesce(string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY c.i), '') AS kept
  FROM c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.i = g.i GROUP BY c.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(lines) END::BIGINT AS n_lines, n_removed, removed_words, md5(kept) AS text_md5
FROM d JOIN k ON d.doc_id = k.doc_id
"""
