import base64
import struct
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions import text as tx
from docquarry.functions import vectors as vx


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<float>' if isinstance(v, list) else 'string'}" for n, v in values.items())).select(column).first()[0] if names else None


def test_point_id(spark):
    for path in ("", "notes/tide tables.md", "é/ü.md", "x" * 300):
        assert one(spark, tx.point_id(F.col("p"), F.lit(12)), p=path) == str(uuid.uuid5(uuid.NAMESPACE_OID, f"{path}#12"))


def test_text_functions(spark):
    dirty = "a ![x](data:image/png;base64,iVBOR/+=) b <!-- c\nd --> e <!-- open"
    assert one(spark, tx.clean_markdown(F.col("t")), t=dirty) == "a [IMAGE REMOVED] b  e <!-- open"
    assert one(spark, tx.reference_links(F.col("t")), t="[a]: b\n x [c]: d\n[^1]: note\n[]: no\n") == "[a]: b\n[^1]: note\n"
    assert one(spark, tx.split_sentences(F.col("t")), t=" One. 1.5\n\n two!　") == ["One.", "1.", "5", "two!"]
    assert one(spark, tx.normalized_lines(F.col("t")), t="a\r\nb") == "a\nb\n"
    assert len(one(spark, tx.trigrams(F.col("t")), t="éé")) == 2
    assert one(spark, tx.trigrams(F.col("t")), t="ab") == []


@pytest.mark.parametrize(("a", "b", "want"), [("abcd", "abcd", 1.0), ("a", "b", 1.0), ("abcd", "xyz", 0.0), ("abcd", "bcde", 1 / 3)])
def test_jaccard(spark, a, b, want):
    assert one(spark, tx.jaccard(tx.trigrams(F.col("a")), tx.trigrams(F.col("b"))), a=a, b=b) == pytest.approx(want)


def plain_bucket(values, bits):
    """Bit i is set where the i-th row of signs gives no negative sum; each sign is the low bit of the next state."""
    mask, state, out = 2**64 - 1, 0x00C0FFEE, 0
    for i in range(bits):
        total = 0
        for x in values:
            z = (state + 0x9E3779B97F4A7C15) & mask
            z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & mask
            z = ((z ^ z >> 27) * 0x94D049BB133111EB) & mask
            state = z ^ z >> 31
            total += x if state & 1 else -x
        out |= (total >= 0) << i
    return out - 2**64 if out >= 2**63 else out


def test_vectors(spark):
    vector = [0.5, -2.0, 1.25, 0.0, 0.02]
    q = one(spark, vx.quantize(F.col("v")), v=vector)
    assert (list(q["values"]), q["scale"], q["norm"]) == ([32, -127, 79, 0, 1], pytest.approx(2 / 127, rel=1e-5), pytest.approx(5.8129**0.5, rel=1e-5))
    halves = one(spark, vx.quantize(F.col("v")), v=[127.0, 2.5, -2.5, 0.5])
    assert list(halves["values"]) == [127, 3, -3, 1]  # halves go away from zero
    bucket = one(spark, vx.lsh_bucket(vx.quantize(F.col("v"))["values"]), v=vector)
    assert bucket == plain_bucket(list(q["values"]), 64)
    assert one(spark, vx.lsh_bucket(vx.quantize(F.col("v"))["values"], 7), v=vector) == plain_bucket(list(q["values"]), 7)
    assert one(spark, vx.lsh_bucket(vx.quantize(F.col("v"))["values"]), v=[0.0] * 4) == -1
    for embed, value in ((vx.embed_chunk, lambda b: b / 255), (vx.embed_query, lambda b: b / 255 * 2 - 1)):
        sums = [sum(value(b) for b in list("Zürich!".encode())[i::3]) for i in range(3)]
        norm = sum(x * x for x in sums) ** 0.5
        assert one(spark, embed(F.col("t"), 3), t="Zürich!") == pytest.approx([x / norm for x in sums], rel=1e-5)
    assert one(spark, vx.embed_chunk(F.col("t"), 3), t="") == [0, 0, 0]
    packed = base64.b64encode(struct.pack("<3f", 0.75, -8.0, 3e-5)).decode()
    assert one(spark, vx.decode_f32_base64(F.col("t")), t=packed) == pytest.approx([0.75, -8.0, 3e-5])
    assert one(spark, vx.decode_f32_base64(F.col("t")), t=base64.b64encode(b"12345").decode()) is None
    assert one(spark, vx.decode_f32_base64(F.col("t")), t="no base64!") is None


def test_quantized_cosine_is_near_cosine(spark):
    rng = np.random.default_rng(1)
    rows = [([float(x) for x in rng.normal(size=16)], [float(x) for x in rng.normal(size=16)]) for _ in range(20)] + [([0.0] * 16, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = frame.select("a", "b", vx.quantized_cosine(vx.quantize("a"), vx.quantize("b")).alias("c"), vx.quantize("a").alias("q"), vx.quantize_expression(F.col("a")).alias("e")).collect()
    for r in got:
        a, b = np.array(r["a"]), np.array(r["b"])
        norm = np.linalg.norm(a) * np.linalg.norm(b)
        assert r["c"] == pytest.approx(a @ b / norm if norm else 0, abs=0.02)
        assert list(r["q"]["values"]) == list(r["e"]["values"])


def test_fallback_only_where_sizes_differ(spark):
    frame = spark.createDataFrame([("ab", [1.0, 2.0]), ("ab", [1.0]), ("ab", None)], "t string, v array<float>")
    got = [list(r[0]) for r in frame.select(vx.with_fallback(F.col("v"), F.col("t"), 2)).collect()]
    own = vx.bytes_vector("ab", 2, False).tolist()
    assert got == [[1.0, 2.0], pytest.approx(own), pytest.approx(own)]
