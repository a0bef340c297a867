import os
import time

import pytest
from pyspark.sql import functions as F

from docquarry.operators import ingest as ig
from docquarry.sources import corpus as co
from docquarry.streaming.stream import debounce, drained, ingest_stream, stream_markdown


def put(root, name, content):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "notes")
    put(root, "a.md", b"# A\r\n\r\nOne. Two.\r\n")
    put(root, "deep/b.md", "Grüße.\n\nZwei Absätze.".encode())
    put(root, "bad.md", b"\xff\xfe broken")
    put(root, "blank.md", b"  \n")
    put(root, "c.MD", b"no")
    put(root, "d.txt", b"no")
    return root


def test_tree_ledger_points(spark, tree, tmp_path):
    points, ledger = str(tmp_path / "points"), str(tmp_path / "ledger")
    run = lambda n, **x: ig.ingest(spark, co.read_markdown(spark, tree), points_path=points, ledger_path=ledger, dim=8, snapshot=f"s{n}", **x)
    assert run(1) == {"changed": 4, "rejected": 1, "committed": 3}
    first = {r["point_id"]: r["text"] for r in ig.current_points(spark, points).collect()}
    assert sorted(first.values()) == ["AOne. Two.", "Grüße.", "Zwei Absätze."]
    assert run(2) == {"changed": 1, "rejected": 1, "committed": 0}
    assert {r["point_id"]: r["text"] for r in ig.current_points(spark, points).collect()} == first
    time.sleep(0.01)
    put(tree, "deep/b.md", b"Changed.")
    assert run(3)["changed"] == 2
    texts = sorted(r["text"] for r in ig.current_points(spark, points).collect())
    assert texts == ["AOne. Two.", "Changed.", "Zwei Absätze."]  # the rest of the longer version stays
    put(tree, "deep/b.md", b"Changed again.")
    run(4, delete_stale=True)
    texts = sorted(r["text"] for r in ig.current_points(spark, points).collect())
    assert texts == ["AOne. Two.", "Changed again."]


def test_commit_check_blocks_changed_files(spark, tree, tmp_path):
    moved = lambda: co.read_markdown(spark, tree).withColumn("length", F.when(F.col("source_path").endswith("a.md"), F.col("length") + 1).otherwise(F.col("length")))
    got = ig.ingest(spark, co.read_markdown(spark, tree), points_path=str(tmp_path / "p"), ledger_path=str(tmp_path / "l"), dim=4, relist=moved, snapshot="x")
    assert got == {"changed": 4, "rejected": 1, "committed": 2}


def test_file_rewritten_while_it_is_embedded_comes_up_again(spark, tmp_path):
    root, points, ledger = str(tmp_path / "notes"), str(tmp_path / "p"), str(tmp_path / "l")
    put(root, "a.md", b"Old content here.")
    path = os.path.join(root, "a.md")

    def rewriting(texts):
        if "Old" in texts[0]:
            with open(path, "wb") as f:
                f.write(b"New content stands here.")
        return [[1.0, 0.0]] * len(texts)

    run = lambda n: ig.ingest(
        spark, co.read_markdown(spark, root), points_path=points, ledger_path=ledger, dim=2, embed=rewriting, relist=lambda: co.read_markdown(spark, root), snapshot=n
    )
    assert run("one") == {"changed": 1, "rejected": 0, "committed": 0}
    assert [r["text"] for r in ig.current_points(spark, points).collect()] == ["Old content here."]
    assert run("two") == {"changed": 1, "rejected": 0, "committed": 1}
    assert [r["text"] for r in ig.current_points(spark, points).collect()] == ["New content stands here."]
    assert run("three") == {"changed": 0, "rejected": 0, "committed": 0}


def test_versions_are_written_together(spark, tmp_path):
    root, points, ledger = str(tmp_path / "notes"), str(tmp_path / "p"), str(tmp_path / "l")
    for n in range(4):
        put(root, f"f{n % 3}.md", f"Text {n}.".encode())
        ig.ingest(spark, co.read_markdown(spark, root), points_path=points, ledger_path=ledger, dim=2, snapshot=f"v{n}", compact_after=2)
        assert len(ig.versions(spark, points)) <= 2
    assert sorted(r["text"] for r in ig.current_points(spark, points).collect()) == ["Text 1.", "Text 2.", "Text 3."]
    assert ig.current_ledger(spark, ledger).count() == 3
    assert ig.current_points(spark, str(tmp_path / "none")).count() == 0 == ig.current_ledger(spark, str(tmp_path / "none")).count()


def test_ledger_json_and_missing(spark, tmp_path):
    assert co.read_ledger(spark, str(tmp_path / "none")).count() == 0
    rows = [("a", "1"), ("b", "2")]
    ledger = spark.createDataFrame(rows, co.LEDGER)
    co.write_ledger(ledger, str(tmp_path / "l"))
    assert sorted(map(tuple, co.read_ledger(spark, str(tmp_path / "l")).collect())) == rows
    text = co.export_ledger_json(ledger)
    assert text.first()["value"] == '{"files":{"a":"1","b":"2"}}'
    assert co.export_ledger_json(ledger, per_value=1).count() <= 2
    assert sorted(map(tuple, co.import_ledger_json(co.export_ledger_json(ledger, per_value=1)).collect())) == rows
    bad = spark.createDataFrame([("{broken",), ('{"files":{"q":"9"}}',)], "value string")
    assert sorted(map(tuple, co.import_ledger_json(text.union(bad)).collect())) == [*rows, ("q", "9")]


def test_points_table_checks_dimension(spark, tmp_path):
    path = str(tmp_path / "points")
    assert co.ensure_points_table(spark, path, 3).count() == 0
    rows = spark.createDataFrame([("00x", "a", 0, "t", [1.0, 2.0, 3.0]), ("11y", "b", 0, "u", [1.0, 2.0, 3.0])], co.points_schema())
    co.write_points(rows, path, 3, mode="touched")
    co.write_points(rows.where("point_id = '11y'").withColumn("text", F.lit("v")), path, 3, mode="touched")
    assert {r["point_id"]: r["text"] for r in co.ensure_points_table(spark, path, 3).collect()} == {"00x": "t", "11y": "v"}
    with pytest.raises(Exception, match="expected 4 components"):
        co.write_points(rows, str(tmp_path / "other"), 4)


def test_embedding_provider(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "i int, text string").coalesce(1)
    got = ig.embed_with(frame, lambda texts: [[float(len(texts))]] * len(texts), batch_size=2).collect()
    assert [r["embedding"] for r in got] == [[2.0], [2.0], [2.0], [2.0], [1.0]]
    log = str(tmp_path / "waits")

    def note(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds} ")

    def fails(texts):
        raise OSError("down")

    failed = ig.embed_with(frame.limit(1), fails, on_error="column", sleep=note).collect()
    assert failed[0]["embedding"] is None and failed[0]["error"] == "down"
    assert open(log).read().split() == ["2.0", "4.0", "8.0"]
    short = ig.embed_with(frame.limit(1), lambda texts: [], on_error="column", sleep=lambda s: None).first()
    assert "count mismatch" in short["error"]
    with pytest.raises(Exception, match="down"):
        ig.embed_with(frame.limit(1), fails, sleep=lambda s: None).collect()
    fixed = ig.points_of(spark.createDataFrame([("p", 0, "ab")], "source_path string, chunk_index long, text string"), dim=2, embed=lambda t: [[1.0]] * len(t)).first()
    assert len(fixed["embedding"]) == 2


def test_listings(spark):
    listing = lambda rows: spark.createDataFrame(rows, "source_path string, length long")
    assert [r["source_path"] for r in ig.stable_files(listing([("a", 1), ("b", 2)]), listing([("a", 1), ("b", 3), ("c", 1)])).collect()] == ["a"]
    events = spark.createDataFrame([("Create", "x/a.md"), ("Remove", "x/a.md"), ("Modify", ".md"), ("Modify", "b.MD"), ("Modify", "b.md")], "kind string, path string")
    assert sorted(r["path"] for r in ig.markdown_changes(events).collect()) == ["b.md", "x/a.md"]


def test_stream_of_files(spark, tree, tmp_path):
    points, ledger = str(tmp_path / "points"), str(tmp_path / "ledger")
    for _ in range(2):
        query = ingest_stream(stream_markdown(spark, tree), points_path=points, ledger_path=ledger, checkpoint=str(tmp_path / "cp"), dim=4)
        assert query.awaitTermination(120)
        texts = sorted(r["text"] for r in ig.current_points(spark, points).collect())
        assert texts == ["AOne. Two.", "Grüße.", "Zwei Absätze."]
        put(tree, "ignored.txt", b"x")


def test_debounce_batch_and_stream(spark, tmp_path):
    rows = [("r", "a.md", 0), ("r", "b.md", 2), ("r", "a.md", 5), ("s", "c.md", 1), ("z", "late.md", 60)]
    frame = spark.createDataFrame(rows, "root string, path string, sec long").select("root", "path", F.timestamp_seconds("sec").alias("ts"))
    got = sorted((r["root"], list(r["paths"])) for r in debounce(frame).collect())
    assert got == [("r", ["a.md"]), ("r", ["a.md", "b.md"]), ("s", ["c.md"]), ("z", ["late.md"])]
    frame.write.parquet(str(tmp_path / "in"))
    stream = debounce(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), delay="1 second")
    query = stream.writeStream.format("memory").queryName("runs").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted((r["root"], list(r["paths"])) for r in spark.table("runs").collect()) == got[:3]
    left = drained(frame, spark.table("runs"))
    assert [(r["root"], list(r["paths"])) for r in left.collect()] == got[3:]
    assert drained(frame, debounce(frame)).count() == 0
