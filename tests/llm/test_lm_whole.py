import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm.lm import is_held_out, score_texts


def texts():
    rng = random.Random(8)
    rows = [(i, " ".join(f"v{rng.randrange(900)}" for _ in range(rng.randrange(60)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "hot pair " * 800), (None, "v1 v2")]


def scores(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["score"] for r in score_texts(frame, **options).collect()}


def held_out(spark, ids):
    return {r["id"] for r in spark.createDataFrame([(i,) for i in ids], "id long").where(is_held_out(F.col("id"))).collect()}


def plain_scores(rows, held):
    """The model with all counts at hand, each replaced by the mean count of its octave."""
    tokens = {i: [*(t or "").split(), "\n"] for i, t in rows}
    words, pairs = Counter(), Counter()
    for i, t in tokens.items():
        if i not in held:
            words.update(t)
            pairs.update(zip(["\n", *t], t, strict=False))

    def quantised(counts):
        groups = {}
        for n in counts.values():
            groups.setdefault(n.bit_length(), []).append(n)
        return {k: sum(groups[n.bit_length()]) / len(groups[n.bit_length()]) for k, n in counts.items()}

    n, v = sum(words.values()), len(words)
    again = sum(c for c in pairs.values() if c > 1)
    bins = {}
    for c in words.values():
        bins.setdefault(math.floor(math.log2(c) * 8), []).append(c)
    low, high = 1e-6, 1e12
    for _ in range(200):
        k = math.sqrt(low * high)
        low, high = (k, high) if sum(sum(b) * (sum(b) / len(b)) / (sum(b) / len(b) + k) for b in bins.values()) > again else (low, k)
    w, p = quantised(words), quantised(pairs)
    out = {}
    for i, t in tokens.items():
        out[i] = 0.0
        for a, b in zip(["\n", *t], t, strict=False):
            c = w.get(a, 0.0)
            share = min(p.get((a, b), 0.0), c) / c if c else 0.0
            weight = c / (c + k) if c else 0.0
            out[i] += math.log10(weight * share + (1 - weight) * (w.get(b, 0.0) + 1) / (n + v + 1))
    return out


@pytest.mark.parametrize("options", [{}, {"part_bytes": 2000}, {"most_bytes": 0}, {"part_bytes": 500, "most_bytes": 0}])
def test_scores_equal_the_plain_model(spark, options):
    """With wide parts no probe hits by chance, and every n-gram of the training texts takes part, at any size and in any form."""
    rows = texts()
    held = held_out(spark, [i for i, _ in rows if i is not None]) | {None}
    got, want = scores(spark, rows, n_bits=400, **options), plain_scores(rows, held)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-6)


def test_chance_hits_are_few(spark):
    rows = texts()
    wide, narrow = scores(spark, rows, n_bits=400), scores(spark, rows)
    assert np.median([abs(wide[i] - narrow[i]) for i in wide]) < 1.0
    assert scores(spark, [], most_bytes=0) == {}


def test_pair_seen_once_counts(spark):
    ids = range(60)
    held = held_out(spark, ids)
    a, b = sorted(held)[:2]
    rows = [(i, f"left{i} right{i} " + "end of text " * 3) for i in ids if i not in held]
    x, y = rows[0][0], rows[1][0]
    rows += [(a, f"left{x} right{x}"), (b, f"left{x} right{y}")]
    found = scores(spark, rows)
    assert found[a] > found[b] + 0.1


def test_parts_apart_write_little(spark, monkeypatch):
    """Beside the texts once more, what the documents write while the filter stays apart is a byte an n-gram of a chunk."""
    import glob
    import os

    import docquarry.llm.lm as module

    rng, written = random.Random(9), []
    rows = [(i, " ".join(rng.choice("abcdef") * rng.randrange(1, 4) + f"{rng.randrange(4000)}" for _ in range(600))) for i in range(200)]
    whole = module.materialize

    def counting(df, name):
        made = whole(df, name)
        written.append((name, sum(os.path.getsize(f) for f in glob.glob(made.written_at.removeprefix("file:") + "/*.parquet"))))
        return made

    monkeypatch.setattr("docquarry.llm.lm.materialize", counting)
    apart = scores(spark, rows, most_bytes=0)
    several = sum(n for _, n in written)
    assert several < 2.5 * sum(len(t) for _, t in rows), written
    assert scores(spark, rows) == pytest.approx(apart, abs=1e-6)


def test_a_chunk_read_in_two_tasks(spark):
    """Each task asks for its rows of a chunk, and the answers meet their own."""
    from docquarry.llm.lm import in_chunks, levels_asked, materialize, ngram_parts

    frame = spark.createDataFrame([(i, f"w{i} w{i % 7} w{i % 5}") for i in range(400)], "doc_id long, text string").coalesce(1)
    chunked = in_chunks(frame, "text", 1 << 30)
    assert chunked.select("_chunk").distinct().count() == 1 and chunked.select("_uid").distinct().count() == 400
    parts = materialize(ngram_parts(frame, "text", 20), "test-parts")
    got = levels_asked(chunked.repartitionByRange(3, "_uid").sortWithinPartitions("_uid"), "text", parts, 20).collect()
    assert len({r["first"] for r in got}) > 1 and {r["by"] for r in got} == {0, 1, 2}
    assert all(level > 0 for r in got for level in bytes(r["levels"]))
