"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a join side that is broadcast; a larger side is joined by shuffling both.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts may be long: Arrow batches of at most ``rows`` rows bound what a Python worker, and the executor feeding it, hold at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() parts exactly at these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with ``small`` broadcast if a count shows that it has at most ``rows`` rows, else by shuffling; same result."""
    fits = small.select(on).limit(rows + 1).count() <= rows
    return big.join(F.broadcast(small) if fits else small, on, how)


_CACHE: dict = {}


def worker_cache(name, make: Callable):
    """The one large cache that a Python worker keeps between tasks; asking for another one drops it."""
    if name not in _CACHE:
        _CACHE.clear()
        _CACHE[name] = make()
    return _CACHE[name]


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.crc32(doc_id.cast("string")) % 5 == 0


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``key``: the same rows in each run and on any cluster."""
    return df.orderBy(F.xxhash64(key), F.col(key)).limit(n)


def local_components(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of the component of each of ``n`` nodes, for links a[i]-b[i]; ``parent`` continues earlier links."""
    parent = np.arange(n) if parent is None else parent
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        open_ = low != high
        if not open_.any():
            return parent
        a, b = a[open_], b[open_]
        np.minimum.at(parent, high[open_], low[open_])
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent[:] = up


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
