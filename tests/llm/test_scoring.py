import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from docquarry.llm.lm import LogBloom, counted, level_of, ngram_parts, part_bits, score_texts
from docquarry.llm.topk import block_scores, slices_of, top_k, top_rows
from docquarry.llm.topk import _scores_at as scores_at
from docquarry.llm.toxicity import Features, features_of, fit_nnpu, score_toxicity, train_toxicity


def lm_texts():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(rng.choices(vocabulary, weights=range(1, 61), k=rng.randrange(40))).replace("w7 ", "W7\n")) for i in range(80)]
    return texts + [(90, None), (91, ""), (92, " \t\x0b"), (93, "never seen É words"), (94, "w59 " * 3000), (5, texts[5][1]), (None, "w1 w2")]


def plain_scores(texts):
    def tokens(t):
        return [w for w in "".join(c.lower() if c < "\x80" else c for c in t or "").replace("\x0b", " ").split(" ") for w in w.split()] + ["\n"]

    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
    count = Counter(w for (_, t), h in zip(texts, held, strict=True) if not h for w in tokens(t))
    n, v = sum(count.values()), len(count)
    return [
        (i, h, len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(t)))
        for (i, t), h in zip(texts, held, strict=True)
    ]


@pytest.mark.parametrize("frequent", [0, 10, 1 << 17])
def test_base_scores_equal_plain_counts(spark, frequent):
    texts = lm_texts()
    rows = [(i, t, 0.5, 1) for i, t in texts]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string, score double, _uid int"), frequent=frequent).collect()
    want = sorted(plain_scores(texts), key=str)
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=str)
    assert [x[:5] for x in found] == [x[:5] for x in want]
    assert [x[5] for x in found] == pytest.approx([x[5] for x in want])
    assert all(r["score"] < 0 for r in got)


def test_model_prefers_held_out_text_to_shuffled_text(spark):
    rng = random.Random(1)
    chain = {f"w{i}": [f"w{rng.randrange(50)}" for _ in range(3)] for i in range(50)}

    def walk():
        w, out = "w0", []
        for _ in range(40):
            out.append(w)
            w = rng.choice(chain[w])
        return out

    docs = [(i, " ".join(walk())) for i in range(400)]
    mixed = [(1000 + i, " ".join(rng.sample(t.split(), 40))) for i, t in docs if zlib.crc32(str(1000 + i).encode()) % 7 == 2]
    got = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(docs + mixed, "doc_id long, text string")).collect()}
    held = [r["score"] for i, r in got.items() if i < 1000 and r["held_out"]]
    assert np.mean(held) > np.mean([got[i]["score"] for i, _ in mixed]) + 10
    assert np.mean(held) > np.mean([r["base_score"] for i, r in got.items() if i < 1000 and r["held_out"]]) + 10


def test_filter_keeps_levels():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**64 - 1, 2000, dtype=np.uint64)
    level = level_of(rng.integers(1, 200, 2000))
    part = ((keys >> np.uint64(40)) % np.uint64(3)).astype(int)
    bloom = LogBloom(4, {p: part_bits(keys[part == p], level[part == p], 10) for p in range(3)})
    four = LogBloom(3, {p: part_bits(keys[part == p], level[part == p], 10) for p in range(3)})
    found = four.levels(keys)
    assert (found >= level).all() and (found == level).mean() > 0.95
    assert (four.levels(rng.integers(0, 2**63 - 1, 5000).astype(np.uint64)) == 0).mean() > 0.95
    assert len(bloom.bits) == len(four.bits) + 1  # a part without entries
    assert level_of(np.array([0, 1, 2, 3, 4, 7, 8, 2**40 - 1, 2**40])).tolist() == [0, 1, 2, 2, 3, 3, 4, 40, 41]


def test_parts_hold_every_ngram(spark):
    texts = [(t,) for _, t in lm_texts()]
    parts = ngram_parts(spark.createDataFrame(texts, "text string"), "text", 5).cache()
    words, pairs = Counter(), Counter()
    for (t,) in texts:
        tokens = [w for w in "".join(c.lower() if c < "\x80" else c for c in t or "").replace("\x0b", " ").split(" ") for w in w.split()] + ["\n"]
        words.update(tokens)
        pairs.update(zip(["^", *tokens], tokens, strict=False))
    sums = counted(parts)
    assert (sums.tokens, sums.distinct, sums.seen_again) == (sum(words.values()), len(words), sum(n for n in pairs.values() if n > 1))
    assert sorted(n for r in parts.collect() for n in r["counts"]) == sorted(words.values())
    for means, counts in ((sums.word_means, words), (sums.pair_means, pairs)):
        for q in range(1, 12):
            level = [n for n in counts.values() if n.bit_length() == q]
            assert not level or means[q] == pytest.approx(sum(level) / len(level))


def test_lm_empty(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = score_texts(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (only["n_tokens"], only["n_known"], only["train_tokens"], only["base_score"]) == (3, 0, 0, 0.0)


@pytest.mark.parametrize("low,high,rows,columns", [(-33, 33, 200, 64), (-5000, 4000, 70, 5), (-1, 2, 64, 3), (7, 8, 65, 2)])
def test_bitmap_arithmetic(low, high, rows, columns):
    rng = np.random.default_rng(3)
    v, q = rng.integers(low, high, (rows, columns)), rng.integers(low, high, (20, columns))
    valid = np.packbits(np.arange(-(-rows // 64) * 64) < rows, bitorder="little").view(np.uint64)
    for i, (score, add) in enumerate(block_scores(slices_of(v), q)):
        got = scores_at(score, np.arange(rows)) + add
        assert got.tolist() == (v @ q[i]).tolist()
        top = np.flatnonzero(np.unpackbits(top_rows(score, valid, 20).view(np.uint8), bitorder="little"))
        kth = np.sort(got)[::-1][:20][-1]
        assert top.tolist() == np.flatnonzero(got >= kth).tolist()


def vectors():
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)], 1) for i in range(150)]
    rows += [(i, [0.1] * 6, 2) for i in range(150, 260)]  # ties
    rows += [(300, None, 1), (320, [0.1, None] + [0.0] * 4, 1), (340, [math.nan] * 6, 1), (341, [math.inf] + [0.0] * 5, 1), (None, [0.5] * 6, 1)]
    return rows + [(40, rows[40][1], 1), (41, rows[41][1], 1), (60, [0.9] * 6, 1)]


def test_vectors_of_all_sizes(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(i % 3)]) for i in range(100)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect()
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    want = []
    for q in range(0, 100, 20):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]) > 0)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:3], 1)]
    assert sorted(map(tuple, got)) == sorted(want) and 0 < len(want) < 15
    big = spark.createDataFrame([(0, [1e3, 2e7]), (1, [2e7, 1.0])], "vec_id long, embedding array<double>")
    assert [r["score"] for r in top_k(big).collect()] == [64 * 64 * (2 * 10**10 + 2 * 10**7)]
    rows = [(i, [rng.uniform(-1, 1) * (5e6 if i == 3 else 1) for _ in range(64)]) for i in range(60)] + [(60, [5e6] * 64), (80, [-5e6] * 64)]
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect()}
    for q in (0, 20, 40, 60, 80):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:2]
        assert [got[q, n] for n in (1, 2)] == [(i, -s) for s, i in best]
    wide = [(0, [2e8] * 64), (1, [-2e8] * 64), (2, [1.0] * 64)]  # its lowest score is no long, and it is not among the highest
    assert [tuple(r)[2:] for r in top_k(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), k=1).collect()] == [(2, 64 * 64 * 64 * 2 * 10**8)]
    for far in (1e12, 1e300):
        with pytest.raises(Exception, match="no 64-bit integer"):
            top_k(spark.createDataFrame([(0, [far, 1.0]), (1, [far, 1.0])], "vec_id long, embedding array<double>")).collect()


def test_top_k_equals_brute_force(spark, monkeypatch):
    import docquarry.llm.topk as module

    monkeypatch.setattr(module, "INDEX_ROWS", 90)
    monkeypatch.setattr(module, "QUERY_ROWS", 4)
    rows = vectors()
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")).collect()
    quantised = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in quantised if i % 20 == 0}:
        scores = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in quantised if i != q))[:20]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 64 * 128)]


def toxic_corpus(n=600):
    rng = random.Random(12)
    clean = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = rng.choices(clean, k=rng.randrange(5, 40)) + (rng.choices(["vile", "scumbagish", "scumbagly"], k=3) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), 0.1))
        if rng.random() < 0.7:
            labels.append((i, int(toxic)))
    return rows, labels, {i: "vile" in t or "scumbag" in t for i, t, _ in rows}


def test_toxicity_on_held_out_rows(spark):
    rows, labels, truth = toxic_corpus()
    docs = spark.createDataFrame([*rows, (1000, None, 0.0), (1001, "", 0.0), (None, "vile " * 5000, 0.0)], "doc_id long, text string, score double")
    marks = spark.createDataFrame([*labels, (7, None), (None, 1), *labels[:3]], "doc_id long, toxic int")
    model = train_toxicity(docs, marks)
    got = {r["doc_id"]: r for r in score_toxicity(docs, model).collect()}
    assert len(got) == len(rows) + 3
    assert all(r["held_out"] == (i is None or zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [i for i in truth if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[1000]["score"] == got[1001]["score"] < 0.3


def test_toxicity_never_reads_held_out_labels(spark):
    rows, labels, _ = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    a, b = (train_toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert a.place == b.place and a.weights.tolist() == b.weights.tolist() and a.bias == b.bias


def test_toxicity_scores_equal_the_plain_sum(spark):
    docs, labels, _ = toxic_corpus(300)
    docs = [r[:2] for r in docs]
    docs += [(9000, None), (9001, ""), (9002, "idiot " * 5000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = train_toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int"))
    for r in score_toxicity(frame, model).collect():
        text = dict(docs)[r["doc_id"]]
        logit = model.bias + sum(model.weights[model.place[f]] for f in features_of(text) if f in model.place)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-logit))) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    docs, labels, _ = toxic_corpus(120)
    docs = [r[:2] for r in docs]
    seen = {}

    def counting(positive, unlabelled, size, prior):
        seen["rows"] = len(positive), len(unlabelled)
        return np.zeros(size), 0.0

    monkeypatch.setattr("docquarry.llm.toxicity.fit_nnpu", counting)
    frame = spark.createDataFrame([r for r in docs for _ in range(40)], "doc_id long, text string")
    train_toxicity(frame, spark.createDataFrame(labels * 3, "doc_id long, toxic int"), max_positive=5, max_unlabelled=10)
    assert seen["rows"] == (5, 10)


def test_toxicity_without_labels_or_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train_toxicity(empty, none)
    assert score_toxicity(empty, model).count() == 0
    assert score_toxicity(spark.createDataFrame([(1, "a")], "doc_id long, text string"), model).first()["predicted"] == 0
    assert train_toxicity(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).weights.size == 0


def test_features_match_between_training_and_scoring():
    text = "Running runner runs RUNNERS été-étés x"
    names = features_of(text)
    place = {f: i for i, f in enumerate(names)}
    assert Features(place).of(text) == list(range(len(names)))
    assert b"runn-3" in names and b"runn-" in names and b"runs" in names


def test_nnpu_separates():
    weights, bias = fit_nnpu([np.array([0])] * 50, [np.array([1])] * 160 + [np.array([0])] * 40, 2, 0.2)
    assert weights[0] + bias > 0 > weights[1] + bias


def test_training_equals_finite_differences():
    rng = np.random.default_rng(2)
    x_p, x_u = rng.random((12, 5)) < 0.5, rng.random((30, 5)) < 0.4
    x_p[:, 0], x_u[:, 0] = True, rng.random(30) < 0.2
    prior, l2, rate = 0.4, 3e-4, 0.05
    loss = lambda z: np.log1p(np.exp(-z))

    def parts(w):
        fp, fu = x_p @ w[:-1] + w[-1], x_u @ w[:-1] + w[-1]
        return prior * loss(fp).mean(), loss(-fu).mean() - prior * loss(-fp).mean()

    def slope(f, w):
        step = 1e-5 * np.eye(len(w))
        return np.array([(f(w + e) - f(w - e)) / 2e-5 for e in step])

    w = np.zeros(6)
    w[5] = np.log(prior / (1 - prior))
    m, v, turned = np.zeros(6), np.zeros(6), 0
    for n in range(1, 301):
        back = parts(w)[1] < 0
        turned += back
        g = slope(lambda x: -parts(x)[1], w) if back else slope(lambda x: sum(parts(x)), w)
        g[:5] += l2 * w[:5]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
        if n in (1, 40, 300):
            got, bias = fit_nnpu([np.flatnonzero(r) for r in x_p], [np.flatnonzero(r) for r in x_u], 5, prior, rounds=n, rate=rate, l2=l2)
            assert np.allclose([*got, bias], w, atol=1e-3), n
    assert 0 < turned < 300  # both steps of the risk were taken
