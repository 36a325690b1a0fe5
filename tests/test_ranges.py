import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetstream.operators import scan


@pytest.mark.parametrize("range_rows", [1, 20, 50_000])
def test_quantiles_do_not_depend_on_the_ranges(spark, range_rows):
    rng = random.Random(range_rows)
    values = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [float(rng.randrange(5)) for _ in range(500)], None: [rng.random() for _ in range(40)], "one": [7.0]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v double")
    got = {(r.k, r.step): (r.n, r.q) for r in scan.grid_quantiles(df, ["k"], "v", 10, range_rows=range_rows, step="step").collect()}
    for k, vs in values.items():
        for i in range(11):
            n, q = got[k, i]
            assert n == len(vs) and abs(q - np.quantile(vs, i / 10)) < 1e-12
    whole = scan.grid_quantiles(df, [], "v", 4, range_rows=range_rows).collect()
    every = [v for vs in values.values() for v in vs]
    assert np.allclose(sorted(r.q for r in whole), np.quantile(every, [0, 0.25, 0.5, 0.75, 1]))


def test_a_thousand_ranges_of_a_bounded_size(spark):
    counted = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * F.col("id")).cast("double").alias("__v"), F.lit(1).alias("__c"))
    cuts = scan._range_cuts(counted, ["k"], 20)
    sizes = counted.join(cuts, "k").groupBy(scan._range_of(F.col("__v"), "__cuts").alias("b")).count().collect()
    assert len(sizes) == 1000 and max(r["count"] for r in sizes) <= 40
    assert sorted(r.b for r in sizes) == list(range(1000))
