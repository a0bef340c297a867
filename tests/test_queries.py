"""Registered queries without SQL against plain versions on small tables."""

import hashlib
import random
import uuid

import numpy as np
import pytest

from docquarry.functions.chunking import chunks_of
from docquarry.functions.vectors import buckets, bytes_vector, quantized
from docquarry.operators.search import JOINER, NO_MATCH
from docquarry.plans.registry import QUERIES
from tests.test_search import plain_replay


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    words = "river stone lamp garden über cloud paper winter salt".split()
    sentence = lambda n: " ".join(rng.choices(words, k=n)) + "."
    documents = [(i, " ".join(sentence(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 40)))) for i in range(25)] + [(90, ""), (91, None), (92, "# Head\n\n- one\n- two")]
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice([sentence(4), "what is a lamp", "", "what is a lamp?"])) for c in range(9) for t in range(4)]
    items = [(i, sentence(12)) for i in range(8)] + [(20, "what is a lamp"), (21, ""), (22, "what is a lamp")]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, documents, turns, items


def plain_search(documents, texts):
    points = []
    for key, text in documents:
        for i, chunk in enumerate(chunks_of("\n\n" + text) if text else []):
            points.append((str(uuid.uuid5(uuid.NAMESPACE_OID, f"{key}#{i}")), chunk, bytes_vector(chunk, 64, False).astype(np.float64)))
    out = {}
    for key, text in texts.items():
        v = bytes_vector(text, 64, False).astype(np.float64)
        scored = []
        for point, chunk, w in points:
            norm = np.linalg.norm(v) * np.linalg.norm(w)
            scored.append((-round(float(v @ w / norm), 12) if norm else 0.0, point, chunk))
        out[key] = JOINER.join(c for _, _, c in sorted(scored)[:5]) or NO_MATCH
    return out


def test_ingest_and_answer(spark, tables):
    folder, documents, _, items = tables
    got = {r["query_id"]: r["answer"] for r in QUERIES["ingest_and_answer"](spark, folder).collect()}
    assert got == plain_search(documents, dict(items))


def test_cached_search(spark, tables):
    folder, documents, turns, items = tables
    entries = {}
    for conv, turn, role, text in turns:
        if role == "user":
            entries[text] = min(entries.get(text, 10**12), conv * 1000000 + turn)

    def coded(text):
        v, s, n = quantized(bytes_vector(text, 64, True)[None, :])
        return v[0].astype(int), float(s[0]), float(n[0]), int(buckets(v, 64, 0xC0FFEE)[0])

    def grams(text):
        raw = text.encode()
        return {raw[i : i + 3] for i in range(len(raw) - 2)}

    fresh = plain_search(documents, dict(items))
    first = {}
    for key, text in items:  # each different text is searched for once
        first.setdefault(text, key)
    want = {}
    for key, text in items:
        v, s, n, b = coded(text)
        best = max(
            ((round(float(v @ w) * s * t / (n * m), 6), -entries[e], e) for e in entries for w, t, m, c in [coded(e)] if n and m and b == c), default=None
        )
        outcome = "Miss"
        if best and best[0] >= 0.95:
            outcome = "SureHit"
        elif best and best[0] >= 0.85:
            x, y = grams(text), grams(best[2])
            outcome = "GreyZone" if (len(x & y) / len(x | y) if x | y else 1.0) >= 0.25 else "Miss"
        want[key] = outcome, md5(fresh[first[text]] if outcome == "Miss" else md5(best[2]))
    got = {r["query_id"]: (r["outcome"], r["answer_md5"]) for r in QUERIES["cached_search"](spark, folder).collect()}
    assert got == want and {o for o, _ in got.values()} >= {"Miss", "SureHit"}


def test_replay_cache(spark, tables):
    folder, _, turns, _ = tables
    log = [(str(c), t, text, md5(text)) for c, t, _, text in turns]
    got = sorted((r["shard"], r["seq"], r["outcome"], r["matched_query"], r["value"]) for r in QUERIES["replay_cache"](spark, folder).collect())
    assert got == plain_replay(log, 128, 64, 8)
