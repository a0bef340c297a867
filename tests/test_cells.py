import numpy as np
import pytest

from docquarry.operators import search as se
from docquarry.operators.cells import cell_index, cell_top_k

SCHEMA = "point_id string, source_path string, text string, embedding array<float>"


def tables(spark, seed=1, spread=0.1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 12))
    vectors = [(centres[i % 30] + spread * rng.normal(size=12)).tolist() for i in range(900)]
    points = [(f"p{i:03d}", "s", "t", v) for i, v in enumerate(vectors)]
    points += [("dup1", "s", "t", vectors[4]), ("dup0", "s", "t", vectors[4]), ("zero", "s", "t", [0.0] * 12), ("none", "s", "t", None), ("other", "s", "t", [1.0])]
    asked = [(i, vectors[i]) for i in range(0, 900, 45)] + [(1001, vectors[4]), (1002, [0.0] * 12), (1003, None), (1004, [1.0]), (1005, (-centres[0]).tolist())]
    return spark.createDataFrame(asked, "query_id long, embedding array<float>"), spark.createDataFrame(points, SCHEMA)


@pytest.mark.parametrize("k", [1, 5, 40])
@pytest.mark.parametrize("spread", [0.1, 3.0])
def test_equals_brute_force(spark, k, spread):
    queries, points = tables(spark, spread=spread)
    fitting = points.where("size(embedding) = 12")
    want = sorted(map(tuple, se.top_k(queries, fitting, k, payload=False).collect()))
    found, share = cell_top_k(queries, cell_index(points, 12), k, query_block=10)
    assert sorted(map(tuple, found.collect())) == want
    assert 0 < share < (0.45 if spread == 0.1 and k < 40 else 1.01)


def test_nothing_to_find(spark):
    queries, points = tables(spark)
    empty = cell_index(points.where("false"), 12)
    assert cell_top_k(queries, empty)[0].count() == 0
    assert cell_top_k(queries.where("false"), cell_index(points, 12, cells=3))[0].count() == 0
    zeros = cell_index(points.where("point_id = 'zero'"), 12)
    assert {(r["point_id"], r["score"]) for r in cell_top_k(queries, zeros)[0].collect()} == {("zero", 0.0)}
