import random

import pytest
from pyspark.sql import functions as F

from fleetstream.llm import knn
from fleetstream.llm.common import table

SF = "/root/testdata/sf0.01"


def plain(rows, asks, k=5):
    out = set()
    for q, v in set(rows):
        if asks(q):
            others = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in set(rows) if i != q))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(others)}
    return out


def got(frame):
    rows = [tuple(r) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("options", [{}, {"block": 3, "slice_rows": 40, "pivots": 7}])
def test_whole_table(spark, options):
    frame = knn.quantized(table(spark, SF, "embeddings"))
    rows = [(r.vec_id, tuple(r.v)) for r in frame.collect()]
    assert got(knn.top_k(frame, F.col("vec_id") % 50 == 0, **options)) == plain(rows, lambda q: q % 50 == 0)


def test_ties_hot_vectors_and_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(i, (1, 2, 3)) for i in range(150)] + [(1000 + i, tuple(rnd.randint(-3, 3) for _ in range(rnd.randint(0, 4)))) for i in range(150)]
    rows += [(2000, (10**6, -(10**6))), (2001, ()), (7, (1, 2, 3))]
    frame = spark.createDataFrame([(i, list(v), 1) for i, v in rows], "vec_id long, v array<long>, d int")
    wide = [(i, v + (0,) * (4 - len(v))) for i, v in rows]
    assert got(knn.top_k(frame, F.col("vec_id") % 10 == 0, slice_rows=50)) == plain(wide, lambda q: q % 10 == 0)
    assert knn.top_k(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    few = frame.filter("vec_id in (10, 11, 12)")
    assert got(knn.top_k(few, F.col("vec_id") % 10 == 0)) == {(10, 1, 11, 14), (10, 2, 12, 14)}
    assert knn.top_k(few, F.col("vec_id") < 0).count() == 0


def test_clusters_are_pruned(spark):
    rnd = random.Random(3)
    centers = [tuple(rnd.choice((-90, 90)) for _ in range(12)) for _ in range(6)]
    rows = [(i, tuple(c + rnd.randint(-4, 4) for c in centers[i % 6])) for i in range(900)]
    frame = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, v array<long>")
    assert got(knn.top_k(frame, F.col("vec_id") % 30 == 0)) == plain(rows, lambda q: q % 30 == 0)


def test_components_that_are_no_numbers(spark):
    nan, inf = float("nan"), float("inf")
    frame = spark.createDataFrame([(1, [0.5, -0.001]), (2, [nan, 1.0]), (3, [inf]), (4, None), (5, [None, 1.0]), (None, [1.0]), (6, [])], "vec_id long, embedding array<float>")
    assert {r.vec_id: r.v for r in knn.quantized(frame).collect()} == {1: [128, -1], 6: []}


def test_large_numbers_stay_exact(spark):
    rows = [(0, (2**31 - 1, 1)), (1, (2**31 - 1, 5)), (2, (2**31 - 1, 4)), (3, (2**31 - 2, 9))]
    frame = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, v array<long>")
    assert got(knn.top_k(frame, F.col("vec_id") == 0)) == plain(rows, lambda q: q == 0)
