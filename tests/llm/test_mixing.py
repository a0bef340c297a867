import random
import re
from collections import Counter

import pytest

from docquarry.llm.mixing import emit_mix, mix_sources

WEIGHTS = (3, 1, 2)


def corpus():
    rng = random.Random(11)
    rows = [(i, "w " * rng.choice([0, 1, 5, 40, 400, 3000]), rng.choices(["a", "b", "c", "é", "Z", None], weights=[60, 10, 5, 20, 1, 4])[0], 1) for i in range(800)]
    rows += [(i, "same text", "a", 2) for i in range(1000, 1400)]  # one size in a hot source
    return rows + [(2000, None, "b", 0), (2001, "", "empty", 0), (2002, " \t", "empty", 0), (2003, "x y", "a", 0), (2003, "x y", "a", 0), (None, "q r s", "a", 0), (None, None, None, 0)]


def plain_targets(sizes):
    """Deal by weight, cut at the ceilings, deal the excess again, until none is above."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [n for n in sizes if n is None]
    weight = {n: WEIGHTS[i % 3] for i, n in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while left > 1e-6 and free:
        total = sum(weight[n] for n in free)
        share, left = left, 0.0
        for n in sorted(free, key=str):
            target[n] += share * weight[n] / total
            if target[n] >= 2 * sizes[n]:
                left += target[n] - 2 * sizes[n]
                target[n] = 2.0 * sizes[n]
                free.discard(n)
    return target


def test_targets_and_copies(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, SIZE int")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets, taken, largest = plain_targets(sizes), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 2 * largest[source] + 1
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)
    again = mix_sources(docs.repartition(7)).collect()
    key = lambda r: str((r["doc_id"], r["source"], r["copies"]))
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_copies_follow_the_running_position(spark):
    import hashlib
    import math

    rows = [(i, "w " * (1 + i % 9), "s", 0) for i in range(300)] + [(900 + i, "w", "t", 0) for i in range(2000)]
    got = {r["doc_id"]: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, x int")).collect()}
    for source in "st":
        u = int(hashlib.md5(f"mix:{source}".encode()).hexdigest()[:8], 16) / 2**32
        own = [i for i, _, s, _ in rows if s == source]
        own.sort(key=lambda i: (-got[i]["size"], hashlib.md5(str(i).encode()).hexdigest()[:2], i))
        rate = got[own[0]]["target"] / got[own[0]]["source_size"]
        for n, i in enumerate(own, 1):
            assert got[i]["copies"] == math.floor(u + n * rate) - math.floor(u + (n - 1) * rate)


def test_mix_repeats_rows(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string, copies int")
    want = Counter()
    for r in mix_sources(docs).collect():
        want[str((r["doc_id"], r["text"], r["source"]))] += r["copies"]
    mixed = emit_mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(str((r["doc_id"], r["text"], r["source"])) for r in mixed.collect()) == +want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(none).count() == 0 and emit_mix(none).count() == 0
    zero = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r["target"], r["taken"]) for r in mix_sources(zero).collect()] == [(0, 0.0, 0)]


def test_crowds_are_dealt_out(spark, monkeypatch):
    import docquarry.llm.mixing as module

    monkeypatch.setattr(module, "HOT", 64)
    rows = [(None, "q r s", "a", 0)] * 1500 + [(7, "x y z", "a", i % 3) for i in range(900)] + [(i, "u v w", "a", 0) for i in range(10, 300)] + [(None, "long " * 5000, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k int").repartition(6)
    seen = []
    deal = module._dealt_out

    def noted(*args):
        seen.append(deal(*args))
        return seen[-1]

    monkeypatch.setattr(module, "_dealt_out", noted)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows) and seen[0][1].agg({"_n": "max"}).first()[0] < 64
    for source, n in (("a", 3 * 2690), ("b", 5000)):
        of = [r for r in got if r["source"] == source]
        assert of[0]["source_size"] == n and abs(sum(r["taken"] for r in of) - of[0]["target"]) <= 2 * max(r["size"] for r in of)
        assert all(0 <= r["copies"] <= 2 for r in of)
    key = lambda r: str((r["doc_id"], r["source"], r["k"], r["copies"]))
    assert sorted(map(key, mix_sources(docs.repartition(3)).collect())) == sorted(map(key, got))
