import glob
import json
import os
import shutil

import pytest

from docquarry.operators import ingest as ig
from docquarry.sources import corpus as co
from docquarry.sources import versions as log
from docquarry.streaming.stream import ingest_stream, stream_markdown
from tests.test_ingest import put


class Place:
    def __init__(self, spark, tmp_path, name="t"):
        self.spark, self.root = spark, str(tmp_path / "notes")
        self.points, self.ledger = str(tmp_path / f"{name}-points"), str(tmp_path / f"{name}-ledger")

    def run(self, name, **x):
        return ig.ingest(self.spark, co.read_markdown(self.spark, self.root), points_path=self.points, ledger_path=self.ledger, **{"dim": 4, "snapshot": name, **x})

    def rows(self):
        return sorted((r["source_path"], r["chunk_index"], r["text"]) for r in ig.current_points(self.spark, self.points).collect())

    def known(self):
        return sorted(map(tuple, ig.current_ledger(self.spark, self.ledger).collect()))


@pytest.fixture
def place(spark, tmp_path):
    for i in range(3):
        put(str(tmp_path / "notes"), f"f{i}.md", f"Text {i}.\n\nMore {i}.".encode())
    return Place(spark, tmp_path)


def test_second_run_under_one_name_changes_nothing(place):
    counts = place.run("one")
    before = place.rows(), place.known()
    assert (len(before[0]), len(before[1])) == (6, 3)
    put(place.root, "f1.md", b"Other.")
    assert place.run("one") == counts and (place.rows(), place.known()) == before
    assert place.run("two")["changed"] == 1 and len(place.rows()) == 6
    assert place.run("one") == counts  # behind a later version too


STEPS = [(co, "write_points"), (co, "write_ledger"), (log, "_put"), (log, "publish"), (ig, "_follow"), (ig, "compact")]


@pytest.mark.parametrize("after", [False, True])
@pytest.mark.parametrize("step", range(len(STEPS)))
def test_crash_and_replay_equal_a_clean_run(spark, place, tmp_path, monkeypatch, step, after):
    place.run("one")
    clean = Place(spark, tmp_path, "clean")
    for x in ("points", "ledger"):
        shutil.copytree(getattr(place, x), getattr(clean, x))
    put(place.root, "f0.md", b"New.")
    put(place.root, "f3.md", b"Added.")
    clean.run("two", compact_after=1)
    module, name = STEPS[step]
    whole = getattr(module, name)

    def broken(*a, **b):
        if after:
            whole(*a, **b)
        raise RuntimeError("lost")

    monkeypatch.setattr(module, name, broken)
    with pytest.raises(RuntimeError, match="lost"):
        place.run("two", compact_after=1)
    monkeypatch.undo()
    place.run("two", compact_after=1)
    assert (place.rows(), place.known()) == (clean.rows(), clean.known())
    assert place.run("three")["changed"] == 0


def test_emptied_document_vanishes(place):
    place.run("one")
    put(place.root, "f1.md", b" \n")
    place.run("two")
    assert len(place.rows()) == 6
    put(place.root, "f1.md", b"\n")
    place.run("three", delete_stale=True)
    assert [r[2] for r in place.rows()] == ["Text 0.", "More 0.", "Text 2.", "More 2."]
    put(place.root, "f1.md", b"Back.")
    place.run("four", delete_stale=True)
    assert len(place.rows()) == 5 and len(place.known()) == 3


def test_failed_embedding_keeps_its_document_out(place):
    def embed(texts):
        if any("1" in t for t in texts):
            raise OSError("down")
        return [[1.0, 0.0, 0.0, 0.0]] * len(texts)

    quick = {"retries": 0, "batch_size": 1}
    assert place.run("one", embed=embed, **quick) == {"changed": 3, "rejected": 0, "committed": 2, "failed": 1}
    assert [r[2] for r in place.rows()] == ["Text 0.", "More 0.", "Text 2.", "More 2."] and len(place.known()) == 2
    with pytest.raises(Exception, match="down"):
        place.run("two", embed=embed, on_error="fail", **quick)
    assert place.run("two", embed=lambda texts: [[0.0, 1.0]] * len(texts), **quick)["committed"] == 1
    assert len(place.rows()) == 6  # vectors of another size give way to the deterministic one


def test_dimension_is_the_tables(place):
    place.run("one")
    before = sorted(os.listdir(f"{place.points}/data"))
    with pytest.raises(ValueError, match="holds vectors of 4 components, not 8"):
        place.run("two", dim=8)
    assert sorted(os.listdir(f"{place.points}/data")) == before
    with pytest.raises(ValueError, match="holds vectors of 4"):
        log.publish(place.spark, place.points, writer="other", data="x", dim=8)


def test_reading_shuffles_no_vector(place, monkeypatch):
    place.run("one")
    put(place.root, "f0.md", b"New.")
    place.run("two", delete_stale=True)
    plan = ig.current_points(place.spark, place.points)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan
    assert not any("embedding" in line for line in plan.splitlines() if "Exchange" in line)
    rows = place.rows()
    monkeypatch.setattr(ig, "_SMALL_ROWS", -1)
    assert place.rows() == rows and len(rows) == 5


def test_many_runs_leave_few_files(place):
    for n in range(7):
        put(place.root, "f0.md", f"Text {n}.".encode())
        place.run(f"r{n}", compact_after=2, grace=0)
        assert len(ig.versions(place.spark, place.points)) <= 2
    assert len(os.listdir(f"{place.points}/data")) <= 3 and len(glob.glob(f"{place.points}/_log/*.json")) <= 4
    assert place.run("r0") == {"changed": 3, "rejected": 0, "committed": 3}  # the base remembers
    assert place.rows()[0][2] == "Text 6." and len(place.known()) == 3


def test_two_writers(spark, place, monkeypatch):
    place.run("one")
    entries = log.log(spark, place.points)
    real = log.log

    def stale(spark_, path):  # what the slower writer has read
        monkeypatch.setattr(log, "log", real)
        return entries

    log.publish(spark, place.points, writer="fast", data=f"{place.points}/data/x", dim=4, rows=0)
    monkeypatch.setattr(log, "log", stale)
    entry, own = log.publish(spark, place.points, writer="slow", data=f"{place.points}/data/y", dim=4, rows=0)
    assert own and entry["number"] == 2
    assert log.publish(spark, place.points, writer="slow", data=f"{place.points}/data/z", dim=4)[1] is False


def test_path_listed_twice(spark, place):
    files = co.read_markdown(spark, place.root)
    twice = files.union(files).union(files.selectExpr("source_path", "cast('Older.' as binary)", "length", "modificationTime - interval 1 day"))
    ig.ingest(spark, twice, points_path=place.points, ledger_path=place.ledger, dim=4, snapshot="x")
    assert len(place.rows()) == 6 and len(place.known()) == 3 and "Older." not in {r[2] for r in place.rows()}


def test_answers_are_kept_and_come_in_order(spark, tmp_path):
    calls = str(tmp_path / "calls")
    frame = spark.createDataFrame([(i, f"t{i}") for i in range(23)], "i int, text string").coalesce(1)

    def embed(texts):
        with open(calls, "a") as f:
            f.write("x")
        return [[float(t[1:]), 1.0] for t in texts]

    def killed(texts):
        if "t16" in texts:
            raise OSError("killed")
        return embed(texts)

    kept = f"file://{tmp_path}/kept"
    with pytest.raises(Exception, match="killed"):
        ig.embed_with(frame, killed, batch_size=4, retries=0, kept_in=kept, model="m").collect()
    done = os.path.getsize(calls)
    assert done == 4
    for in_flight in (1, 3):
        got = ig.embed_with(frame, embed, batch_size=4, in_flight=in_flight, kept_in=kept, model="m").collect()
        assert [r["embedding"] for r in got] == [[float(i), 1.0] for i in range(23)]
    assert os.path.getsize(calls) == 6  # each of the six batches once
    ig.embed_with(frame, embed, batch_size=4, in_flight=3, kept_in=kept, model="other").collect()
    assert os.path.getsize(calls) == 12


def test_stream_runs_a_batch_again(spark, place, tmp_path):
    checkpoint = str(tmp_path / "cp")

    def go():
        query = ingest_stream(stream_markdown(spark, place.root), points_path=place.points, ledger_path=place.ledger, checkpoint=checkpoint, dim=4)
        assert query.awaitTermination(120)

    go()
    before = place.rows(), place.known()
    assert len(before[0]) == 6
    for name in glob.glob(f"{checkpoint}/commits/*") + glob.glob(f"{checkpoint}/commits/.*"):
        os.remove(name)  # as if the driver had died before the batch was noted
    go()
    assert (place.rows(), place.known()) == before and len(ig.versions(spark, place.points)) == 1
    name = json.load(open(f"{checkpoint}/metadata"))["id"]
    assert log.published(log.log(spark, place.ledger), name, 0)
