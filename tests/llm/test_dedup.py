import random

import pytest
import xxhash

from docquarry.llm.components import components
from docquarry.llm.simhash import brute_force, fingerprint_links, segment_plan, simhash, simhash_near_duplicates

SCHEMA = "doc_id long, text string, source string, fingerprint int, slot string"


def rows_of(texts):
    return [(i, t, "s", 7, "x") for i, t in texts]


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 40, 120])))) for i in range(60)]
    for i in range(60, 110):  # copies and near copies
        words = texts[rng.randrange(60)][1].split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append((i, " ".join(words)))
    texts += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (203, "one"), (None, texts[5][1]), (None, "only here without id " * 9)]
    return texts


def test_fingerprint_is_majority_of_shingle_hashes():
    words = "the Quick brown FOX jumps over the lazy dog".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash("the Quick  brown\tFOX jumps over the lazy dog") == want
    assert simhash("Ab cd") == xxhash.xxh64_intdigest(b"ab cd", 42)
    assert simhash("") == simhash(None) == simhash(" \n") == 0
    assert simhash("É x y z") == xxhash.xxh64_intdigest("É x y z".encode(), 42)


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    got = simhash_near_duplicates(spark.createDataFrame(rows_of(texts), SCHEMA)).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_force(texts), key=str)


@pytest.mark.parametrize("most", range(12))
def test_some_segment_is_always_near(most):
    for n in (0, 10**6, 10**12):
        bits, radii = segment_plan(most, n)
        assert sum(bits) == 64 and sum(r + 1 for r in radii) > most
    assert segment_plan(4, 10**6)[0] == (21, 21, 22) and segment_plan(4, 10**11)[0] == (32, 32)


@pytest.mark.parametrize("most,plan", [(0, None), (4, None), (8, None), (4, ((32, 32), (2, 1)))])
def test_links_connect_all_close_fingerprints(spark, most, plan, monkeypatch):
    if plan:  # as for a much larger table
        monkeypatch.setattr("docquarry.llm.simhash.segment_plan", lambda *_: plan)
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 7, 8, 9])):
                x ^= 1 << bit
            prints.add(x)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    links = fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), most)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    label = {x: x for x in signed}
    changed = True
    while changed:
        changed = False
        for x in signed:
            for y in signed:
                if ((x ^ y) & (2**64 - 1)).bit_count() <= most and label[x] != label[y]:
                    label[x] = label[y] = min(label[x], label[y])
                    changed = True
    assert {x: got.get(x, x) for x in signed} == label


@pytest.mark.parametrize("kind,tile", [("low", 8), ("high", 8), ("close", 3)])
def test_full_slots_are_cut_without_loss(spark, monkeypatch, kind, tile):
    import docquarry.llm.simhash as module

    monkeypatch.setattr(module, "TILE", tile)
    rng = random.Random(1)
    if kind == "close":  # inner slots are full too
        prints = sorted({sum(1 << b for b in rng.sample(range(60), rng.randrange(4))) for _ in range(60)})
    else:  # one value in two whole segments
        shift = {"low": 0, "middle": 21, "high": 42}[kind]
        prints = sorted({rng.getrandbits(21) << shift for _ in range(60)})
        prints = sorted({*prints, *(x ^ 1 << shift + 3 for x in prints[:20]), *(x ^ 1 << (shift + 25) % 64 for x in prints[:20])})
    prints = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = components(module.fingerprint_links(spark.createDataFrame([(x,) for x in prints], "fp long"))).collect()
    label = {x: x for x in prints}
    for _ in prints:
        for x in prints:
            for y in prints:
                if ((x ^ y) & (2**64 - 1)).bit_count() <= 4:
                    label[x] = label[y] = min(label[x], label[y])
    found = {r["node"]: r["root"] for r in got}
    assert {x: found.get(x, x) for x in prints} == label


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash_near_duplicates(docs).count() == 0
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("n,wide", [(2, 1 << 20), (50, 1 << 20), (50, 0)])
def test_components_of_chains_and_stars(spark, n, wide, monkeypatch):
    monkeypatch.setattr("docquarry.llm.components.WIDE", wide)
    chain = [(i, i + 1) for i in range(n)] + [(1000, 1000), (None, 5)]
    star = [(5000 + n, 5000 + i) for i in range(n)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {5000 + i: 5000 for i in range(n + 1)}
