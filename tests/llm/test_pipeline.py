import hashlib
import math
import random
from collections import Counter

import pytest

import corpus_pipeline
from docquarry.llm.pieces import decode_pieces
from docquarry.llm.toxicity import score_toxicity, train_toxicity
from tests.llm.test_lines import plain as plain_lines
from tests.llm.test_mixing import plain_targets
from tests.llm.test_similar import kept_by_brute_force

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra int"


def corpus():
    rng = random.Random(21)
    words = [f"word{i}" for i in range(200)]
    sentence = lambda n: " ".join(rng.choices(words, k=n))
    passage = sentence(60)
    rows, labels = [], []
    for i in range(160):
        lines = [sentence(rng.randrange(5, 30)) for _ in range(rng.randrange(1, 5))]
        toxic = rng.random() < 0.25
        if toxic:
            lines[0] += " vile scumbag vile rotter"
        if i % 9 == 0:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        rows.append((i, "\n".join(lines), toxic))
        labels.append((i, int(toxic)))
    rows += [(200, rows[1][1], rows[1][2]), (201, rows[2][1].replace("word1 ", "word2 ", 1), rows[2][2]), (202, None, False), (203, "", False), (204, "", False)]
    docs = [(i, t, "en", rng.choice(["a", "a", "b", None]), len(t or ""), 5) for i, t, _ in rows]
    return docs, labels


@pytest.fixture
def tables(spark, tmp_path):
    docs, labels = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), docs


def mixed(rows):
    """Systematic sampling of (id, text, source), stated plainly."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    targets, out = plain_targets(sizes), Counter()
    for source in sizes:
        u = int(hashlib.md5(("mix:" + ("\x00null" if source is None else source)).encode()).hexdigest()[:8], 16) / 2**32
        own = sorted((r for r in rows if r[2] == source), key=lambda r: (-len((r[1] or "").split()), hashlib.md5(str(r[0]).encode()).hexdigest()[:2], r[0]))
        rate = targets[source] / sizes[source] if sizes[source] else 0.0
        for n, (i, _, _) in enumerate(own, 1):
            out[i] += math.floor(u + n * rate + 1e-12) - math.floor(u + (n - 1) * rate + 1e-12)
    return +out


def test_run_equals_plain_stages(spark, tables):
    folder, docs = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = train_toxicity(frame, spark.read.parquet(f"{folder}/labels.parquet"))
    rejected = {r["doc_id"] for r in score_toxicity(frame, model).where("predicted = 1").collect()}
    assert 15 < len(rejected) < 70
    kept = [(i, t) for i, t, *_ in docs if i not in rejected]
    source = {d[0]: d[3] for d in docs}
    cleaned = [(i, t) for i, t, _ in plain_lines(kept, 50)]
    leaders, _ = kept_by_brute_force(cleaned)
    remaining = [(i, t, source[i]) for n, (i, t) in enumerate(cleaned) if n in leaders]
    assert len(remaining) < len(cleaned)
    got = decode_pieces(corpus_pipeline.run(spark, folder)).collect()
    text = {i: t for i, t, _ in remaining}
    assert Counter(r["doc_id"] for r in got) == mixed(remaining)
    assert all(r["decoded"] == text[r["doc_id"]] for r in got)


def test_stages_return_the_columns_of_documents(spark, tables):
    folder, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "encoding"]


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
