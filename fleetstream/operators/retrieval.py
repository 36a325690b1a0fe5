"""Sliced, impact-ordered index for ranked retrieval, and search with exact early stopping.

Chunks are hashed into slices of a bounded size and numbered within. Per slice
and term, postings are stored in blocks of neighbouring numbers, blocks with the
largest impact first. A search brings the queries' weighted terms to the slices
that have them; what is shuffled is the postings of asked terms and, in the
end, at most k rows per query and slice. Within a slice, the largest impacts
bound the score of any chunk of a block: blocks are taken by falling bound, and
a query is done with the slice once the next bound is below its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Chunks of a slice (about, since chunks are hashed), numbers of a block, queries that are searched together.
SLICE, BLOCK, TOGETHER = 2048, 64, 2048
#: Queries of a part that advance together through a slice.
AT_ONCE = 128
#: Impacts per term that are kept to bound the k-th score from below before any slice is opened.
BEST = 32
#: Name of a slice's row of chunk ids, and mark of rows that list the chunks of a tag.
IDS, TAG = "", "\x01"
_SCORES = pa.schema([("__q", pa.string()), ("chunk_id", pa.string()), ("score", pa.float64())])


def sliced_index(postings: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """(slice, term, blocks, ids) of postings (chunk_id, tags, term, tf_factor).

    ``blocks``: (top, block, postings) by falling top, postings being (no,
    impact) by number. Rows of tags have no impacts. ``ids``, in one row per
    slice, has the chunk ids by number, in ascending order.
    """
    known = postings.select("chunk_id", "tags").distinct()
    slices = F.greatest(F.lit(1), F.ceil(known.agg(F.count("*")).scalar() / slice_rows)).cast("int")
    tagged = known.select("chunk_id", F.explode(F.array_distinct("tags")).alias("term")).select("chunk_id", F.concat(F.lit(TAG), "term").alias("term"), F.lit(0.0).alias("impact"))
    listed = postings.select("chunk_id", "term", F.col("tf_factor").alias("impact")).unionByName(tagged)
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = listed.withColumn("slice", F.pmod(F.xxhash64("chunk_id"), slices).cast("int")).repartition(tasks, "slice")
    return d.groupBy("slice").applyInArrow(
        _slice_rows, "slice int, term string, blocks array<struct<top: double, block: int, postings: array<struct<no: int, impact: double>>>>, ids array<string>"
    )


def _ranked(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct values in ascending order, and the place of each row's value among them."""
    coded = column.combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def _slice_rows(rows: pa.Table) -> pa.Table:
    """The rows of one slice from its postings (slice, chunk_id, term, impact)."""
    ids, no = _ranked(rows["chunk_id"])
    terms, term = _ranked(rows["term"])
    order = np.lexsort((no, term))
    no, term, impact = no[order], term[order], rows["impact"].to_numpy()[order]
    start = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(no // BLOCK) != 0)])
    stop, top = np.r_[start[1:], len(no)], np.maximum.reduceat(impact, start)
    order = np.lexsort((-(no[start] // BLOCK), -top, term[start]))
    start, stop, top = start[order], stop[order], top[order]
    _, place = _spans(start, stop)
    postings = pa.StructArray.from_arrays([pa.array(no[place].astype(np.int32)), pa.array(impact[place])], names=["no", "impact"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(stop - start)].astype(np.int32)), postings)
    blocks = pa.StructArray.from_arrays([pa.array(top), pa.array((no[start] // BLOCK).astype(np.int32)), lists], names=["top", "block", "postings"])
    cuts = np.searchsorted(term[start], np.arange(len(terms) + 1)).astype(np.int32)
    blocks = pa.ListArray.from_arrays(pa.array(cuts), blocks)
    names = pa.array([rows["slice"][0].as_py()] * (len(terms) + 1), pa.int32())
    return pa.Table.from_arrays([
        names, pa.concat_arrays([terms, pa.array([IDS], terms.type)]), pa.concat_arrays([blocks, pa.nulls(1, blocks.type)]),
        pa.concat_arrays([pa.nulls(len(terms), pa.list_(ids.type)), pa.array([ids.to_pylist()], pa.list_(ids.type))]),
    ], names=["slice", "term", "blocks", "ids"])


def best_impacts(postings: DataFrame) -> DataFrame:
    """(term, best): the ``BEST`` largest impacts of each term, falling; the rank limit is applied in each task before the shuffle."""
    w = Window.partitionBy("term").orderBy(F.col("tf_factor").desc())
    top = postings.select("term", "tf_factor", F.row_number().over(w).alias("__r")).where(F.col("__r") <= BEST)
    return top.groupBy("term").agg(F.sort_array(F.collect_list("tf_factor"), asc=False).alias("best"))


def _asked(texts: DataFrame, weighted: DataFrame, k: int) -> DataFrame:
    """(part, term, askers): queries by part of a bounded number, with weights and what their k-th score is at least."""
    c = F.col
    # the k-th best of one term alone is a bound if no weight is negative
    alone = F.get("best", F.lit(k - 1)) * c("w")
    least = weighted.groupBy("__q").agg(F.when(F.min("w") >= 0, F.max(alone)).alias("least"))
    parts = F.greatest(F.lit(1), F.ceil(texts.agg(F.count("*")).scalar() / TOGETHER)).cast("int")
    rows = weighted.select("__q", "term", "w").join(least, "__q")
    tags = texts.select("__q", F.explode(F.array_distinct("qtags")).alias("tag")).select("__q", F.concat(F.lit(TAG), "tag").alias("term"), F.lit(0.0).alias("w"), F.lit(None).cast("double").alias("least"))
    part = F.pmod(F.xxhash64("__q"), parts).cast("int").alias("part")
    rows = rows.unionByName(tags).select(part, "term", F.struct("__q", "w", "least").alias("asker"))
    askers = rows.groupBy("part", "term").agg(F.collect_list("asker").alias("askers"))
    heads = rows.select("part").distinct().select("part", F.lit(IDS).alias("term"), F.array().cast(askers.schema["askers"].dataType).alias("askers"))
    return askers.unionByName(heads)


class _Slice:
    """One slice's rows for a part of the queries, as flat arrays."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("term")
        self.terms = rows["term"].to_pylist()
        head = self.terms.index(IDS)
        self.ids = rows["ids"].slice(head, 1).to_pylist()[0]
        blocks = rows["blocks"].combine_chunks()
        flat = blocks.flatten()
        self.start = np.r_[0, np.cumsum(blocks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
        self.top, self.block = flat.field("top").to_numpy(), flat.field("block").to_numpy()
        lists = flat.field("postings")
        self.at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64)
        postings = lists.flatten()
        self.no, self.impact = postings.field("no").to_numpy(), postings.field("impact").to_numpy()
        askers = rows["askers"].combine_chunks()
        who = askers.flatten()
        self.is_tag = np.array([t[:1] == TAG for t in self.terms])
        self.row = np.repeat(np.arange(rows.num_rows), askers.value_lengths().to_numpy())
        names = who.field("__q").dictionary_encode()
        self.query, self.names = names.indices.to_numpy(), names.dictionary.to_pylist()
        self.weight, self.least = who.field("w").to_numpy(), who.field("least").to_numpy(zero_copy_only=False)


def _spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which span each place belongs to, and the places of all spans one after the other."""
    counts = stop - start
    return np.repeat(np.arange(len(counts)), counts), np.repeat(stop - np.cumsum(counts), counts) + np.arange(counts.sum())


def _best_of_slice(rows: pa.Table, k: int, boost: float, read: list | None = None) -> pa.Table:
    s = _Slice(rows)
    order = np.argsort(s.query, kind="stable")
    cuts = np.searchsorted(s.query[order], np.arange(0, len(s.names) + AT_ONCE, AT_ONCE))
    found = [_best_of_queries(s, order[a:b], k, boost, read) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
    query, no, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [], [])
    columns = [[s.names[i] for i in query], [s.ids[i] for i in no], score]
    return pa.Table.from_arrays([pa.array(col, f.type) for col, f in zip(columns, _SCORES, strict=True)], schema=_SCORES)


def _best_of_queries(s: _Slice, members: np.ndarray, k: int, boost: float, read: list | None) -> tuple[np.ndarray, ...]:
    """(query, no, score) of the k best chunks of each of some queries, whose rows ``members`` are; all queries advance together."""
    n = len(s.ids)
    n_blocks = -(-n // BLOCK)
    first = s.query[members[0]]
    query, row, weight = s.query[members] - first, s.row[members], s.weight[members]
    many = int(query[-1]) + 1
    tag = s.is_tag[row]
    factor = np.ones((many, n))
    asker, entry = _spans(s.start[row[tag]], s.start[row[tag] + 1])
    block, place = _spans(s.at[entry], s.at[entry + 1])
    factor[query[tag][asker][block], s.no[place]] = boost
    query, row, weight = query[~tag], row[~tag], weight[~tag]
    # what each block can add at most, and a k-th score known from below
    asker, entry = _spans(s.start[row], s.start[row + 1])
    cell = query[asker] * n_blocks + s.block[entry]
    bound = np.bincount(cell, np.maximum(weight[asker], 0.0) * s.top[entry], many * n_blocks).reshape(many, n_blocks)
    touched = np.bincount(cell, minlength=many * n_blocks).reshape(many, n_blocks) > 0
    bound = np.where(touched, bound * np.maximum.reduceat(factor, np.arange(0, n, BLOCK), axis=1), -np.inf)
    least = np.full(many, -np.inf)
    known = s.least[members]
    np.fmax.at(least, s.query[members] - first, known)
    rank = np.empty((many, n_blocks), dtype=np.int64)
    np.put_along_axis(rank, np.argsort(-bound, axis=1, kind="stable"), np.arange(n_blocks)[None, :], axis=1)
    best = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))
    at, step = 0, 4
    while at < n_blocks:
        # a little below the bound: sums of the same numbers may differ in the last bits
        chosen = touched & (rank >= at) & (rank < at + step) & (bound >= least[:, None] - 1e-6)
        if not chosen.any():
            break
        if read is not None:
            read.append(int(chosen.sum()))
        own = np.flatnonzero(chosen.ravel()[cell])
        pair, place = _spans(s.at[entry[own]], s.at[entry[own] + 1])
        spot = query[asker[own]][pair] * n + s.no[place]
        total = np.bincount(spot, weight[asker[own]][pair] * s.impact[place], many * n)
        hit = np.flatnonzero(np.bincount(spot, minlength=many * n))
        # rounded, so that copies of a chunk tie
        score = np.floor(total[hit] * factor.ravel()[hit] * 1e9 + 0.5) / 1e9
        above = score >= least[hit // n] - 1e-6
        hit, score = hit[above], score[above]
        found = tuple(np.concatenate(x) for x in zip(best, (hit // n, hit % n, score), strict=True))
        by = np.lexsort((found[1], -found[2], found[0]))
        places = np.arange(len(by)) - np.searchsorted(found[0][by], found[0][by])
        by = by[places < k]
        best = tuple(x[by] for x in found)
        last = places[places < k] == k - 1
        least[best[0][last]] = np.maximum(least[best[0][last]], best[2][last])
        at, step = at + step, step * 4
    return best[0] + first, best[1], best[2]


def slice_hits(texts: DataFrame, weighted: DataFrame, sliced: DataFrame, k: int, boost: float) -> DataFrame:
    """(__q, chunk_id, score): the k best chunks of each slice for each query, those that can't be among the k best of all left out.

    ``texts``: __q, qtags; ``weighted``: __q, term, w, best (falling impacts of
    the term). A score is the sum of weight x impact, times ``boost`` if the
    chunk has one of the query's tags.
    """
    # much work per row: as many tasks as the session shuffles into, whatever the number of bytes
    tasks = int(sliced.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = sliced.join(_asked(texts, weighted, k), "term").repartition(tasks, "slice", "part")
    schema = "__q string, chunk_id string, score double"
    return work.groupBy("slice", "part").applyInArrow(lambda rows: _best_of_slice(rows, k, boost), schema)
