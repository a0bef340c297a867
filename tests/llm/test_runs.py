import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.llm.runs import brute_force, detect_runs, op11_runs, runs_of


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 30), st.integers(2, 6), st.integers(0, 60))
def test_equals_brute_force(words, period, times, cut):
    made = words + (words[:period] * times)[: max(0, len(words) * times - cut)] + words[::-1]
    assert runs_of(np.array(made, np.int64)) == brute_force(made)


def test_long_periods_and_nested_runs():
    rng = random.Random(5)
    block = [rng.randrange(40) for _ in range(137)]
    inner = [7, 8, 9] * 11
    words = [99, *(block[:50] + inner + block[50:]) * 5, 98, *[1] * 400, 97, *[1] * 399]
    assert runs_of(np.array(words, np.int64)) == brute_force(words)


def test_one_word_many_times_takes_no_square():
    assert runs_of(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def test_rows_of_every_kind(spark):
    same = "a b " * 9
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, same, "x"), (4, same, "x"), (None, "q " + same.replace(" ", "\x0b"), "x"), (5, "a b " * 12, "x"), (6, "k " * 11, "x"), (7, "k " * 12, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = detect_runs(frame).orderBy("doc_id").collect()
    found = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got]
    assert found == [
        (None, 19, [(1, 18, 2)], "q a b"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 18, [(0, 18, 2)], "a b"), (4, 18, [(0, 18, 2)], "a b"),
        (5, 12, [(0, 12, 1)], "a b"), (6, 11, [], " ".join("k" * 11)), (7, 12, [(0, 12, 1)], "k"),
    ]
    assert detect_runs(frame.where("false")).count() == 0


def digests(key, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), 0 if key is None else zlib.crc32(str(key).encode())
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_force(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    exponent = None if best[0] is None else 1000 * best[1] // best[2]
    return (key, len(runs), *best, exponent, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query_against_plain_words(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice(["\n", " ", "\t "]).join(f"w{rng.randrange(9 if i % 3 else 900)}" for _ in range(rng.randrange(90)))) for i in range(260)]
    rows += [(None, "a " * 20), (7, None), (20, " "), (21, "one"), (7, "Ä ä " * 15)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op11_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((digests(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 10
