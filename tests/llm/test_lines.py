import random

import pytest

from docquarry.llm.lines import dedup_lines, line_windows

SCHEMA = "doc_id long, text string, n_lines string, x int"


def plain(rows, least):
    """Every window of every document, in order; what came earlier goes, and what stands around it in both places."""
    unique = sorted({(i is None, i, t) for i, t in rows if t is not None}, key=str)
    unique.sort(key=lambda r: (r[0], r[1] or 0))
    seen, gone = {}, {}
    windows = []
    for last, i, text in unique:
        lines = text.split("\n")
        for s in range(len(lines)):
            if not lines[s].split():
                continue
            n, e = 0, s
            while e < len(lines) and n < least:
                n += len(lines[e].split())
                e += 1
            if n >= least:
                windows.append(((last, i or 0), text, s, e, tuple(lines[s:e])))
    windows.sort(key=lambda w: (w[0], w[2]))
    for place, text, s, e, content in windows:
        if content in seen:
            lines, (other, s0, e0) = text.split("\n"), seen[content]
            words = 0
            while e < len(lines) and e0 < len(other) and lines[e] == other[e0] and (words := words + len(other[e0].split())) < least:
                e, e0 = e + 1, e0 + 1
            while s and s0 and lines[s - 1] == other[s0 - 1] and not lines[s - 1].split():
                s, s0 = s - 1, s0 - 1
            gone.setdefault((place, text), set()).update(range(s, e))
        else:
            seen[content] = text.split("\n"), s, e
    out = []
    for i, text in rows:
        cut = gone.get(((i is None, i or 0), text), set())
        out.append((i, text if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in cut), sorted(cut)))
    return out


def corpus():
    rng = random.Random(5)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(40)] + ["", " ", "hot line"]
    passage = [" ".join(rng.choices("klmnop", k=6)) for _ in range(5)]
    rows = []
    for i in range(60):
        lines = rng.choices(pool, k=rng.randrange(1, 14))
        if rng.random() < 0.5:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = passage[: rng.choice([2, 3, 5])]
        rows.append((i, "\n".join(lines)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + "\nmore"), (102, None), (103, ""), (104, "\n\n"), (105, "same words here now\n" * 9), (7, rows[7][1]), (None, rows[9][1])]
    return rows + [(110, "only\n" * 3000)]


@pytest.mark.parametrize("least", [1, 7, 15])
def test_equals_all_windows(spark, least):
    rows = corpus()
    got = dedup_lines(spark.createDataFrame([(i, t, "z", 1) for i, t in rows], SCHEMA), min_words=least)
    found = [(r["doc_id"], r["text"], r["removed"]) for r in got.collect()]
    assert sorted(found, key=str) == sorted(plain(rows, least), key=str)
    for r in got.collect():
        assert r["n_removed"] == len(r["removed"]) and r["n_lines"] == (0 if dict(rows)[r["doc_id"]] is None else dict(rows)[r["doc_id"]].count("\n") + 1)


def test_anchor_is_the_smallest_line_of_each_window():
    rng = random.Random(2)
    text = "\n".join(" ".join(rng.choices("abc", k=rng.randrange(0, 5))) for _ in range(200))
    import numpy as np
    import xxhash

    hashes = np.array([xxhash.xxh64_intdigest(x.encode()) for x in text.split("\n")], np.uint64).view(np.int64)
    got, w = line_windows(text, 8)
    assert got.tolist() == hashes.tolist()
    for s, e, a, h in zip(w["start"], w["end"], w["anchor"], w["anchor_hash"], strict=True):
        assert h == hashes[s:e].min() == hashes[a] and s <= a < e
        assert a == s + max(np.flatnonzero(hashes[s:e] == h))


def test_clean_documents_stay(spark):
    rows = [(i, f"document {i} says " + " ".join(f"w{i}x{j}" for j in range(80)) + "\nThank you for reading.") for i in range(20)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows)
    passage = " ".join(f"p{j}" for j in range(60))
    more = [(i + 100, f"intro {i}\n{passage}\nend {i}") for i in range(4)]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
    assert got == dict(rows) | {100: more[0][1]} | {i + 100: f"intro {i}\nend {i}" for i in (1, 2, 3)}


def test_matches_are_extended(spark):
    line = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    run = ["", " ", line("a", 60), line("b", 40), "", line("c", 5)]
    rows = [(1, "\n".join(["first", *run, "one"])), (2, "\n".join(["second", *run, "two"])), (3, "\n".join(run[2:])), (4, "\n".join(["", *run, line("d", 60)])), (5, line("d", 60))]
    rows += [(6, "\n".join([line("e", 100), *[f"short {k}" for k in range(24)], "x"])), (7, "\n".join([line("e", 100), *[f"short {k}" for k in range(24)], "y"]))]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "second\ntwo", 3: "", 4: "\n" + line("d", 60), 5: "", 6: rows[5][1], 7: "y"}


def test_empty(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
