import pytest
from pyspark.sql import functions as F

from docquarry.streaming.stateful import debounce_stream, open_runs, stream_cache
from docquarry.streaming.stream import debounce, drained
from tests.test_search import query_log


def changes(spark, rows):
    return spark.createDataFrame([(*r[:2], float(r[2])) for r in rows], "root string, path string, sec double").select("root", "path", F.expr("timestamp_millis(cast(1000 * sec as long))").alias("ts"))


def told(runs):
    return sorted((r["root"], r["started"].timestamp(), r["ended"].timestamp(), tuple(r["paths"])) for r in runs.collect())


ROWS = [
    [("r", "a.md", 100), ("r", "b.md", 102), ("r", "a.md", 105), ("s", "c.md", 101)],
    [("r", "late.md", 106.5), ("s", "d.md", 130), ("s", "d.md", 131.5)],
    [("z", "e.md", 160), ("r", "dropped.md", 101), ("r", "f.md", 159), (None, "g.md", 160)],
]


def test_runs_and_what_a_stopped_stream_leaves_open(spark, tmp_path, rocksdb):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    for k, rows in enumerate(ROWS):
        changes(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = debounce_stream(spark.readStream.schema("root string, path string, ts timestamp").parquet(source), delay="1 second")
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        emitted, left = told(spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))), told(open_runs(spark, checkpoint))
        taken = [r for part in ROWS[: k + 1] for r in part if r[0] and r[1] != "dropped.md"]
        assert sorted(emitted + left) == told(debounce(changes(spark, taken)))
    assert left == [("r", 159.0, 161.0, ("f.md",)), ("z", 160.0, 162.0, ("e.md",))]


def test_late_change_hands_nothing_over_again(spark):
    rows = [("r", "a", 10), ("r", "b", 11)]
    emitted = debounce(changes(spark, rows))
    left = drained(changes(spark, [*rows, ("r", "late", 9), ("r", "a", 40)]), emitted)
    assert [x[1:2] + x[3:] for x in told(left)] == [(9.0, ("late",)), (40.0, ("a",))]


def test_state_written_follows_what_is_touched(spark, tmp_path, rocksdb):
    frame = spark.createDataFrame([r for r in query_log() if r[0] == "u1"], "user string, n long, query string, value string")
    frame.where("n < 39").coalesce(1).write.parquet(str(tmp_path / "in"))
    written = []
    for _ in range(2):
        out = stream_cache(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "user", "n", max_entries=30, dim=16, num_bits=4)
        query = out.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert query.awaitTermination(120) and query.exception() is None
        written.append([p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]])
        frame.where("n = 39").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = spark.read.format("statestore").option("stateVarName", "entries").load(str(tmp_path / "cp"))
    assert state.count() > 5 and sum(written[1]) <= 3 < sum(written[0])


def test_needs_the_right_store(spark):
    stream = spark.readStream.format("rate").load().selectExpr("'u' as user", "value as n", "'q' as query", "'v' as value")
    with pytest.raises(ValueError, match="RocksDB"):
        stream_cache(stream, "user", "n")
