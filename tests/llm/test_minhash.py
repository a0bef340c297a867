import random

import numpy as np
import pytest

from docquarry.llm import minhash
from docquarry.llm.minhash import band_keys, brute_force, estimated, minhash_near_duplicates, most_apart, odd_sketches, op13_minhash, samples
from docquarry.llm.simhash import shingles_hashes


def edited(rng, words, n):
    copy = list(words)
    for at in rng.sample(range(len(copy)), min(n, len(copy))):
        copy[at] = f"e{rng.randrange(10**6)}"
    return copy


def corpus(seed=4):
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        rows += [" ".join(words), *(" ".join(edited(rng, words, n)) for n in (1, 3, 5, 8, 12))]
    near = [f"n{i}" for i in range(120)]
    rows += [" ".join(edited(rng, near, 1)) for _ in range(40)]
    rows += [None, "", " \n", "one two", "ONE two", "one two three four", "One\ttwo three FOUR", rows[0].upper(), rows[0], "Öl ÖL öl ÖL"]
    return list(enumerate(rows))


def test_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in op13_minhash(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(brute_force(rows))


def test_full_slots_are_dealt_out_again(spark, monkeypatch):
    monkeypatch.setattr(minhash.similar_roots, "__kwdefaults__", {"full": 16})
    rows = corpus(9)
    got = [tuple(r) for r in minhash_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(brute_force(rows))


def test_sketches_tell_the_similarity():
    rng = np.random.default_rng(3)
    for share in (0.95, 0.9, 0.8, 0.6):
        apart = []
        for _ in range(60):
            n = 400
            both = round(2 * n * share / (1 + share))
            members = rng.integers(-(2**63), 2**63, 2 * n - both)
            drawn = np.stack([samples(members[:n]), samples(members[n - both :])])
            left, right = odd_sketches(drawn).view(np.uint64)
            apart.append(int(np.bitwise_count(left ^ right).sum()))
        assert estimated(round(np.mean(apart))) == pytest.approx(share, abs=0.03)
        assert share < 0.8 or max(apart) <= most_apart()


def test_bands_catch_pairs_of_the_bound():
    rng = np.random.default_rng(5)
    met = []
    for _ in range(300):
        members = rng.integers(-(2**63), 2**63, 100)
        drawn = np.stack([samples(members[:90]), samples(members[10:])])  # 80 of 100 in common
        a, b = band_keys(drawn)
        met.append((a == b).sum())
    assert min(met) > 0 and np.mean(met) == pytest.approx(32 * 0.8**4, rel=0.15)


def test_one_opening_makes_no_pairs(spark):
    rng = random.Random(2)
    opening = " ".join(f"o{i}" for i in range(44))
    rows = [(i, f"{opening} " + " ".join(f"x{rng.randrange(10**7)}" for _ in range(60))) for i in range(5000)]
    sets = minhash.sketched(spark.createDataFrame(rows, "_id long, _text string"), 5, ("_id",))
    slots = minhash.shared_slots(sets)
    nothing = spark.createDataFrame([], "node long, root long")
    left = minhash.open_slots(slots, nothing, sets, minhash.FULL)
    assert minhash.star_pairs(slots, most_apart()).count() + minhash.undecided(left, most_apart()).count() < 5000


def test_family_below_the_bound_makes_no_square(spark):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 9))) for i in range(400)]  # Jaccard of two some 0.55: near the bound, no links
    narrow = spark.createDataFrame(rows, "_id long, _text string").selectExpr("_id", "_text", "_id as _row")
    sets = minhash.sketched(narrow, 4, ("_id", "_row"))
    slots = minhash.shared_slots(sets)
    nothing = spark.createDataFrame([], "node long, root long")
    left = minhash.open_slots(slots, nothing, sets, minhash.FULL)
    assert minhash.undecided(left, most_apart()).count() <= slots.count()
    got = [tuple(r) for r in minhash_near_duplicates(narrow.selectExpr("_id as doc_id", "_text as text")).collect()]
    assert sorted(got) == sorted(brute_force(rows))


def test_nulls_repeats_and_clashes(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(3, text, "x", True), (3, text, "x", True), (2, text + " b", "x", False), (None, text, None, True), (None, "alone here", "z", True), (9, None, "x", False), (8, "", "x", False)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _set string, kept boolean")
    got = minhash_near_duplicates(frame)
    assert got.columns == ["doc_id", "_set", "n_shingles", "component_id", "kept"]
    want = [(3, "x", 27, 2, False)] * 2 + [(2, "x", 28, 2, True), (None, None, 27, 2, False), (None, "z", 1, None, False), (9, "x", 0, 9, True), (8, "x", 0, 8, True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert minhash_near_duplicates(frame.where("false")).count() == 0
    assert len(shingles_hashes("alone here", 4)) == 1
