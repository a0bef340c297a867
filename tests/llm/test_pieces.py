import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest

import docquarry.llm.pieces as module
from docquarry.llm.pieces import _SPELT, MODEL, Encoder, Lattices, decode_pieces, encode_pieces, vocabulary

TEXTS = [
    "Hello  world\n x▁y ", "", None, " ", "   ", "\n", "\n\n a\n", "tab\there", "é ü 😀 漢字 \u0007 ▁▁", "a" * 500, "x" * 41 + " y", "word " * 4000,
    "internationalization", "  leading and trailing  ", "no break​", "﻿", "ab\x00c",
]


def segmentations(unit, vocab):
    if not unit:
        return {(): 0.0}
    out = {}
    for n in range(1, min(len(unit), vocab.longest) + 1):
        found = vocab.log_p.get(unit[:n])
        if found is None and n > 1:
            continue
        ids, score = ((found[0],), found[1]) if found else (tuple(vocab.spell(unit[0])), _SPELT)
        for rest, s in segmentations(unit[n:], vocab).items():
            out[ids + rest] = score + s
    return out


def test_round_trip_and_reruns(spark):
    rows = [(i, t, "p") for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, " ")]
    rows = [(*r, "p")[:3] for r in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, PIECES string")
    a = encode_pieces(docs)
    back = decode_pieces(a).collect()
    assert len(back) == len(rows)
    assert all(r["decoded"] == r["text"] for r in back)
    assert all((r["pieces"] is None) == (r["text"] is None) and r["n_pieces"] == len(r["pieces"] or []) for r in back)
    b = encode_pieces(docs.repartition(5).orderBy("text")).collect()
    assert sorted(str((r["doc_id"], r["text"], r["pieces"])) for r in back) == sorted(str((r["doc_id"], r["text"], r["pieces"])) for r in b)
    assert encode_pieces(docs.limit(0)).count() == 0


def encode_batch(texts, seeds, vocab):
    return Encoder(vocab).encode(texts, seeds)


def lattice(unit, vocab):
    chars = np.frombuffer(unit.encode("utf-32-le"), np.uint32)
    return Lattices(chars, np.array([len(chars)]), vocab)


def test_pieces_are_the_models_own():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocab = vocabulary(MODEL, 1.0)
    flat, sizes = encode_batch(["Hello world, plain text"], np.array([1], np.uint64), vocab)
    assert model.decode(flat.tolist()) == "Hello world, plain text" and sizes.tolist() == [len(flat)]


@pytest.mark.parametrize("unit", [" the", "nation", " é😀", " ▁a"])
def test_samples_follow_the_lattice(unit, monkeypatch):
    vocab = vocabulary(MODEL, 1.0)
    want = segmentations(unit, vocab)
    total = math.log(sum(math.exp(s) for s in want.values()))
    n = 20000
    if unit[0] == " ":
        flat, sizes = encode_batch([unit[1:]] * n, np.arange(n).astype(np.uint64), vocab)
        seen = Counter(tuple(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1]))
        assert set(seen) <= set(want)
        for ids, s in want.items():
            p = math.exp(s - total)
            assert abs(seen[ids] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
    together = lattice(unit, vocab)
    monkeypatch.setattr(module, "_LONG", 1)  # the pass of long units
    alone = lattice(unit, vocab)
    assert np.abs(together.bound.astype(float) - alone.bound).max() < 2**12
    for k in range(200):
        arcs, _ = alone.sample(np.zeros(1, np.int64), np.array([k], np.uint64), np.zeros(1, np.int64))
        assert alone.sample_one(k, 0).tolist() == arcs.tolist()


@pytest.mark.parametrize("long", [1, 3, 60])
def test_units_cut_where_no_piece_crosses_follow_the_lattice(long, monkeypatch):
    monkeypatch.setattr(module, "_LONG", long)
    vocab = vocabulary(MODEL, 1.0)
    unit, n = " a😀nation", 8000
    want = segmentations(unit, vocab)
    total = math.log(sum(math.exp(s) for s in want.values()))
    flat, sizes = encode_batch([unit[1:]] * n, np.arange(n).astype(np.uint64), vocab)
    seen = Counter(tuple(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1]))
    assert set(seen) <= set(want)
    for ids, s in want.items():
        p = math.exp(s - total)
        assert abs(seen[ids] / n - p) < 4.5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_long_units_and_characters_without_a_piece():
    vocab = vocabulary(MODEL, 1.0)
    texts = ["😀" * 60, "😀" * 5000, "漢字かな交じり文" * 5000, "ab" * 30, "abcdefghij" * 20000, "x" * 59 + "😀" * 30]
    flat, sizes = encode_batch(texts, np.arange(len(texts)).astype(np.uint64), vocab)
    raw = vocab.raw.to_pylist()
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert b"".join(raw[i] for i in ids)[1:].decode() == text


def test_kept_lattices_change_nothing(monkeypatch):
    vocab = vocabulary(MODEL, 1.0)
    texts = [t for t in TEXTS if t] + [f"word{i} of many words" for i in range(50)]
    seeds = np.arange(len(texts)).astype(np.uint64)
    want, sizes = encode_batch(texts, seeds, vocab)
    monkeypatch.setattr(module, "_KEPT", 30)
    encoder, got = Encoder(vocab), []
    for i in range(len(texts)):
        got.append(encoder.encode(texts[i : i + 1], seeds[i : i + 1])[0])
    assert np.concatenate(got).tolist() == want.tolist() and [len(x) for x in got] == sizes.tolist()


def test_encoding_stays_small_in_memory():
    rng = np.random.default_rng(5)
    words = ["".join(map(chr, w)) for w in rng.integers(97, 123, (130_000, 9))]
    texts = [" ".join(words[i : i + 200]) for i in range(0, len(words), 200)]  # 1.3 million characters, all units different
    seeds, encoder = np.arange(len(texts)).astype(np.uint64), Encoder(vocabulary(MODEL, 1.0))
    tracemalloc.start()
    n = sum(int(sizes.sum()) for _, sizes in module._in_parts(texts, seeds, encoder))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n > len(words) and peak < 100e6


def test_texts_may_stay_behind(spark):
    docs = spark.createDataFrame([(1, "one two", "a"), (2, None, "b")], "doc_id long, text string, source string")
    whole, narrow = encode_pieces(docs), encode_pieces(docs, keep_text=False)
    assert narrow.columns == ["doc_id", "source", "pieces", "n_pieces"]
    assert sorted(whole.drop("text").collect()) == sorted(narrow.collect())


def test_decoding_of_odd_lists(spark):
    vocab = vocabulary(MODEL, 1.0)
    lone = [vocab.byte_id[0x20], vocab.byte_id[0xFF], vocab.byte_id[0x41]]
    frame = spark.createDataFrame([(lone,), ([],), (None,)], "pieces array<int>")
    assert [r["decoded"] for r in decode_pieces(frame).collect()] == ["\ufffdA", "", None]
    with pytest.raises(Exception, match="(?i)out of bounds|index"):
        decode_pieces(spark.createDataFrame([([10**6],)], "pieces array<int>")).collect()
