import random

from docquarry.llm.shingles import maybe_among
from docquarry.llm.similar import keep_one_of_each
from docquarry.llm.simhash import shingles_hashes, simhash


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        rows.append(" ".join(words))
        for edits in (1, 2, 4, 7):
            copy = list(words)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = f"e{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    near = [f"n{i}" for i in range(120)]
    for i in range(40):  # one large group of near copies
        copy = list(near)
        copy[i] = f"x{i}"
        rows.append(" ".join(copy))
    rows += ["", None, " \n", "one two", "ONE two", "one two three", rows[0], "footer of every page here " + rows[5]]
    return list(enumerate(rows))


def kept_by_brute_force(rows):
    sets = [set(shingles_hashes(t, 5).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in pairs:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    return {i for i in range(len(rows)) if find(i) == i}, [(i, j, jaccard(sets[i], sets[j])) for i, j in pairs]


def test_equals_brute_force_in_every_band(spark):
    rows = corpus()
    want, pairs = kept_by_brute_force(rows)
    got = {r["doc_id"] for r in keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    band = [(i, j) for i, j, s in pairs if s < 0.9]
    far = [(i, j) for i, j in band if bin(simhash(rows[i][1]) ^ simhash(rows[j][1])).count("1") > 4]
    assert len(far) > 50  # pairs that fingerprints at 4 bits do not link


def test_no_rows_and_no_pairs(spark):
    assert keep_one_of_each(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert keep_one_of_each(spark.createDataFrame([(1, "a b"), (None, "c d"), (None, "c d")], "doc_id long, text string")).count() == 2


def test_rows_of_one_group(spark):
    rows = [(3, "a b c d e f", "x", 1), (3, "a b c d e f", "x", 1), (2, "A b c d e f", "y", 2), (None, "a b c d e f", "x", 1), (9, None, "x", 1), (8, " ", "x", 1), (5, "other", "z", 0), (None, "p q", "z", 0), (None, "p q", "z", 0)]
    names = "_set string, root int, _row string, _at int, _first string, _known int, _doc int, `a b.c` int"
    frame = spark.createDataFrame([(*r, "r", 7, "f", 8, 9, 1) for r in rows], f"doc_id long, text string, {names}")
    got = keep_one_of_each(frame)
    assert got.columns == frame.columns
    assert {tuple(r)[4:] for r in got.collect()} == {("r", 7, "f", 8, 9, 1)}
    assert_rows(got.select("doc_id", "text", "_set", "root"))


def assert_rows(got):
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, "A b c d e f", "y", 2), (8, " ", "x", 1), (5, "other", "z", 0), (None, "p q", "z", 0)], key=str)


def test_filter_is_never_wrong_about_members(spark):
    keys = spark.range(0, 3000, 7).toDF("k")
    got = {r["id"]: r["_maybe"] for r in maybe_among(spark.range(3000), "id", keys).collect()}
    assert all(got[i] for i in range(0, 3000, 7)) and sum(got.values()) < 450
