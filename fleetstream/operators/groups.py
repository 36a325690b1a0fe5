"""Small in-order steps in Python over groups that Spark has partitioned and sorted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """Rows of Arrow batches as plain tuples, in order."""
    for pdf in batches:
        yield from zip(*[pdf[c] for c in columns])


def clustered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows of a key in one partition, sorted.

    Partitioned by a hash of the keys, not by the keys: the planner drops a
    repartition that a join or union below seems to provide, and adaptive
    execution may then change that input, unaware that mapInPandas relies on it.
    """
    d = df.withColumn("__part", F.xxhash64(*keys)).repartition("__part")
    return d.sortWithinPartitions(*keys, *order).drop("__part")


def fold_groups(
    df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str, finish: Callable | None = None
) -> DataFrame:
    """Run ``step(state, row) -> rows`` over each group in order; ``start(row)`` gives a group's first state.

    Groups stream through: a task holds one batch and one state, never a whole
    group. ``finish(state)`` may emit rows at the end of a group. Rows are
    tuples in the order of ``df``'s columns; results are tuples of ``schema``.
    """
    columns = df.columns
    n_keys = [columns.index(k) for k in keys]
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    d = clustered(df, keys, order)

    def run(batches):
        current, state, out = None, None, []
        for row in ordered_rows(batches, columns):
            key = tuple(row[i] for i in n_keys)
            if key != current:
                if current is not None and finish is not None:
                    out.extend(finish(state))
                current, state = key, start(row)
            out.extend(step(state, row))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if current is not None and finish is not None:
            out.extend(finish(state))
        if out:
            yield pd.DataFrame(out, columns=names)

    return d.mapInPandas(run, schema)
