"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors get one more component so that all data vectors have the same norm;
then the largest inner product is the smallest Euclidean distance. Queries and
data are grouped by their nearest pivot. Summaries of the groups (radius of the
query groups, sizes and smallest pivot distances of the data groups) give each
query group a bound on the distance of its k-th neighbour, and a data vector
goes only to the query groups for which it can lie within the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstream.llm.common import bounded_sample
from fleetstream.session import stage

#: Most pivots, queries of a block, and data vectors that a task compares with a block at a time.
PIVOTS, QUERY_BLOCK, DATA_SLICE = 64, 512, 20_000
#: Distances are taken as up to this share larger or smaller than computed, so rounding never drops a neighbour.
SLACK = 1e-9


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as longs, of rows whose vector and components are finite numbers."""
    doubles = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("x")).filter(
        "vec_id is not null and x is not null and forall(x, e -> e is not null and not isnan(e) and abs(e) < double('Infinity'))"
    )
    return whole.select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def _padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, v in enumerate(rows):
        out[i, : len(v)] = v
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: by floating point where every partial sum is below 2**53."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if largest < 1 << 53 else a @ b.T


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Data vectors with the component that makes all norms equal (squares sum to ``most``)."""
    x = v.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _asked(v: np.ndarray) -> np.ndarray:
    return np.concatenate([v.astype(np.float64), np.zeros((len(v), 1))], axis=1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T, 0))


def _nearest(frame: DataFrame, width: int, lift, pivots: np.ndarray) -> DataFrame:
    """Adds pivot and its distance d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = _distances(lift(_padded(batch.column(1).to_pylist(), width)), pivots)
            best = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(best)), best])], ["vec_id", "v", "pivot", "d"])

    return frame.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>, pivot int, d double")


def _bounds(reach: dict[int, float], near: pd.DataFrame, pivots: np.ndarray, k: int) -> dict[int, float]:
    """For each query group: a distance within which every query of it has ``k`` data vectors.

    A data vector at distance d from its pivot is no further from any query of
    the group than the group's radius, the way between the pivots, and d.
    """
    between = _distances(pivots, pivots)
    out = {}
    for g, radius in reach.items():
        far = np.sort(radius + between[g, near["pivot"]] + near["d"])
        out[g] = float(far[k - 1]) if len(far) >= k else np.inf
    return out


def _solve(width: int, k: int):
    def run(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or data.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        data = data.sort_values("vec_id")
        ids, asked = data["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        scores = _dot(_padded(queries["v"].tolist(), width), _padded(data["v"].tolist(), width))
        most = min(k, len(ids))
        # ids rise, so a stable sort by score leaves ties in the order of ids
        order = np.argsort(-scores, axis=1, kind="stable")[:, : most + 1]
        query, vec, score = np.repeat(asked, order.shape[1]), ids[order].ravel(), np.take_along_axis(scores, order, axis=1).ravel()
        other = query != vec
        return pd.DataFrame({"query_id": query[other], "vec_id": vec[other], "score": score[other]})

    return run


def top_k(vectors: DataFrame, asks: Column, k: int = 5, pivots: int = PIVOTS, block: int = QUERY_BLOCK, slice_rows: int = DATA_SLICE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query with other rows.

    ``vectors``: (vec_id, v) as from ``quantized``; ``asks``: which rows are
    queries. Ties go to the smaller vec_id; a query gets all others if there are
    fewer than ``k``. Vectors of unequal length are compared as if filled up
    with 0. Of equal vectors only the ``k`` + 1 smallest ids can be in a result,
    so a vector that is very frequent is cut to these before anything is
    shuffled by group. Rows with a null id or vector take no part; a repeated
    row (equal id and vector) counts once; an empty table gives no rows. Exact
    while inner products fit a long.
    """
    spark = vectors.sparkSession
    rows = stage(vectors.select("vec_id", "v").distinct(), "vectors")
    first = Window.partitionBy("v").orderBy("vec_id")
    data = stage(rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).drop("n"), "different")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    total, width, most = data.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chosen = _lifted(_padded([r.v for r in bounded_sample(data, "vec_id", max(1, min(pivots, int(total**0.5) // 4))).collect()], width), most)
    grouped = stage(_nearest(data, width, lambda v: _lifted(v, most), chosen), "data-groups")
    asked = stage(_nearest(rows.filter(asks), width, _asked, chosen), "query-groups")
    reach = {r.pivot: r.d for r in asked.groupBy("pivot").agg(F.max("d").alias("d")).collect()}
    # summaries: at most pivots * (k + 1) rows
    closest = Window.partitionBy("pivot").orderBy("d", "vec_id")
    near = grouped.select("pivot", "d", "vec_id").withColumn("n", F.row_number().over(closest)).filter(F.col("n") <= k + 1).select("pivot", "d").toPandas()
    limit = _bounds(reach, near, chosen, k + 1)
    groups = np.array(sorted(reach), dtype=np.int64)
    farthest = np.array([(reach[g] + limit[g]) * (1 + SLACK) + SLACK for g in groups])
    slices = -(-total // slice_rows)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                d = _distances(_lifted(_padded(part.column(1).to_pylist(), width), most), chosen[groups])
                row, g = np.nonzero(d * (1 - SLACK) <= farthest)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(groups[g].astype(np.int32))], ["vec_id", "v", "pivot"])

    # a query group is cut into blocks, a block's data into slices, by hashes: no task gets more than a block and a slice
    sizes = asked.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = asked.join(sizes, "pivot").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    left = dealt.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("pivot", F.col("b").cast("int").alias("b"), F.col("s").cast("int").alias("s"), "vec_id", "v")
    copies = grouped.mapInArrow(replicate, "vec_id long, v array<long>, pivot int").join(sizes, "pivot")
    right = copies.select("pivot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(slices)).cast("int").alias("s"), "vec_id", "v")
    key = ["pivot", "b", "s"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_solve(width, k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
