import os
import time

import pytest

from docquarry.operators import ingest as ig
from docquarry.streaming import files as fl
from docquarry.streaming.files import MarkdownReader, watch_markdown
from docquarry.streaming.stream import ingest_stream
from tests.test_ingest import put


def aged(root, name, seconds):
    path = os.path.join(root, name)
    os.utime(path, (time.time() - seconds,) * 2)
    return path


def contents(reader, start, end):
    return sorted((os.path.basename(r[0]), r[1]) for part in reader.partitions(start, end) for r in reader.read(part))


@pytest.fixture
def root(tmp_path):
    root = str(tmp_path / "notes")
    for i, name in enumerate(["a.md", "deep/b.md", "c.md", "d.txt", ".md", "_x/e.md", "f.MD", ".g/h.md"]):
        put(root, name, b"text %d" % i)
        aged(root, name, 100 - i)
    return root


def test_offsets(root):
    reader = MarkdownReader({"path": root})
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert contents(reader, start, end) == [("a.md", b"text 0"), ("b.md", b"text 1"), ("c.md", b"text 2")]
    assert reader.latestOffset() == end and reader.partitions(end, end) == []
    put(root, "a.md", b"new")
    later = MarkdownReader({"path": root, "settle": "0"})  # as after a restart
    assert contents(later, end, later.latestOffset()) == [("a.md", b"new")]
    assert contents(later, start, end) == [("b.md", b"text 1"), ("c.md", b"text 2")]  # the old text of a.md is gone


def test_growing_file_waits(root):
    reader = MarkdownReader({"path": root, "settle": "5"})
    start = reader.initialOffset()
    end = reader.latestOffset()
    for n in range(3):
        put(root, "grows.md", b"x" * n)
        assert reader.latestOffset() == end
    aged(root, "grows.md", 6)
    assert contents(reader, end, reader.latestOffset()) == [("grows.md", b"xx")] and start != end


def test_files_that_change_between_listing_and_reading(root):
    reader = MarkdownReader({"path": root})
    start = reader.initialOffset()
    parts = reader.partitions(start, reader.latestOffset())
    os.remove(os.path.join(root, "a.md"))
    put(root, "c.md", b"other")
    assert [r[1] for p in parts for r in reader.read(p)] == [b"text 1"]


def test_limits(root, monkeypatch):
    for options, sizes in (({"maxFilesPerTrigger": "2"}, [2, 1]), ({"maxBytesPerTrigger": "1"}, [1, 1, 1]), ({"maxBytesPerTrigger": "13"}, [2, 1])):
        reader = MarkdownReader({"path": root, **options})
        at, found = reader.initialOffset(), []
        while (end := reader.latestOffset()) != at:
            found.append(len(contents(reader, at, end)))
            at = end
        assert found == sizes
    monkeypatch.setattr(fl, "_TASK_FILES", 2)
    reader = MarkdownReader({"path": root})
    assert [len(p.files) for p in reader.partitions(reader.initialOffset(), reader.latestOffset())] == [2, 1]
    gone = MarkdownReader({"path": root + "/none"})
    assert gone.initialOffset() == gone.latestOffset()


def test_rewritten_file_arrives_at_the_next_trigger(spark, root, tmp_path):
    points, ledger = str(tmp_path / "points"), str(tmp_path / "ledger")

    def go():
        query = ingest_stream(watch_markdown(spark, root), points_path=points, ledger_path=ledger, checkpoint=str(tmp_path / "cp"), dim=4, delete_stale=True)
        assert query.awaitTermination(120)
        return sorted(r["text"] for r in ig.current_points(spark, points).collect())

    assert go() == ["text 0", "text 1", "text 2"]
    put(root, "a.md", b"new text")
    aged(root, "a.md", 1)
    os.remove(os.path.join(root, "deep/b.md"))
    assert go() == ["new text", "text 1", "text 2"]
    assert ig.current_ledger(spark, ledger).count() == 3 and go() == ["new text", "text 1", "text 2"]
