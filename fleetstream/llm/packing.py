"""Token sequences of fixed length from documents: packed id matrices, and best-fit packing with local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstream.llm.binpack import best_fit_decreasing, swap_search
from fleetstream.llm.tokens import cut, encoder
from fleetstream.session import stage

LENGTH = 2048
#: Pieces packed together, and bytes of their ids, at most.
GROUP, GROUP_BYTES = 8192, 48 << 20
END = b"\0\0\0\0"

MATRIX = "sequence_id long, ids binary, n_ids int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"


def pack_matrices(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Documents to packed sequences of ``length`` ids: a row per sequence.

    ids: ``length`` little-endian unsigned 16-bit numbers (32-bit ones for a
    vocabulary of more than 65,536), filled up with 0; n_ids: how many are used;
    cu_seqlens: 0 and the running ends of the segments; position_resets: the
    places where position ids begin again at 0; doc_ids, pieces, starts: the
    document, the number of the piece and the ids before it, per segment.

    A document's ids end with id 0. Longer documents are cut without loss into
    pieces of ``length``, the first of which may be shorter. A task packs its
    own documents in groups of bounded size by best fit decreasing, so ids are
    never shuffled; at most the last sequences of a group are less than full. A
    null or empty text is the closing id alone. Rows with equal ids are packed
    like any others; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks)
        kind = np.dtype("<u2" if enc.size <= 1 << 16 else "<u4")
        number = TaskContext.get().partitionId() << 33
        held: list[tuple[int, int, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held, size
            bins = best_fit_decreasing([len(x[3]) for x in held], length)
            rows: list[list] = [[] for _ in range(max(bins) + 1)]
            for i, b in enumerate(bins):
                rows[b].append(held[i])
            matrix = np.zeros((len(rows), length), dtype=kind)
            ends = []
            for row, parts in zip(matrix, rows, strict=True):
                end = np.cumsum([0, *(len(x[3]) for x in parts)])
                row[: end[-1]] = np.concatenate([x[3] for x in parts])
                ends.append(end)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(number, number + len(rows))), pa.array([r.tobytes() for r in matrix], pa.binary()), pa.array([int(e[-1]) for e in ends], pa.int32()),
                    pa.array(ends, pa.list_(pa.int32())), pa.array([e[:-1] for e in ends], pa.list_(pa.int32())), pa.array([[x[0] for x in r] for r in rows], pa.list_(pa.int64())),
                    pa.array([[x[1] for x in r] for r in rows], pa.list_(pa.int32())), pa.array([[x[2] for x in r] for r in rows], pa.list_(pa.int64())),
                ],
                ["sequence_id", "ids", "n_ids", "cu_seqlens", "position_resets", "doc_ids", "pieces", "starts"],
            )
            number, held, size = number + len(rows), [], 0
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(enc.ids(text) + END, dtype="<u4").astype(kind)
                for k, (at, n) in enumerate(cut(len(ids), length)):
                    held.append((doc, k, at, ids[at : at + n]))
                    size += n * kind.itemsize
                    if len(held) >= GROUP or size >= GROUP_BYTES:
                        yield flush()
        if held:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MATRIX)


def token_pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document, with the checksum of their ids as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, ranks)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = enc.ids(text) + END
                rows += [(doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])) for k, (at, n) in enumerate(cut(len(ids) // 4, length))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _pack_group(length: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"]).reset_index(drop=True)
        bins = np.array(swap_search(frame["length"].tolist(), length))
        order = np.argsort(bins, kind="stable")
        sizes = frame["length"].to_numpy()[order]
        ends = np.cumsum(sizes)
        first = np.r_[True, bins[order][1:] != bins[order][:-1]]
        begun = np.maximum.accumulate(np.where(first, ends - sizes, 0))
        frame = frame.iloc[order].assign(sequence_id=frame["g"].to_numpy()[0] * (1 << 32) + bins[order], offset=ends - sizes - begun)
        return frame.drop(columns="g")

    return run


def pack_sequences(docs: DataFrame, length: int = LENGTH, group: int = GROUP, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Pieces of documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenized once; only the lengths are packed. Full pieces are
    sequences of their own. The others are dealt by a hash of the piece and its
    place in the written table into groups of about ``group`` pieces, however
    often rows repeat; their number follows the input, and each group is packed
    by best fit decreasing and then by swap-based local search. A null or empty
    text is the closing id alone; a repeated row is packed again; an empty
    table gives no rows; other columns are not looked at.
    """
    pieces = stage(token_pieces(docs, length, vocabulary, ranks), "pieces")
    short = pieces.filter(F.col("length") < length)
    groups = max(1, -(-short.count() // group))
    schema = pieces.schema.simpleString().removeprefix("struct<").removesuffix(">") + ",sequence_id:bigint,offset:bigint"
    # the place in the written table spreads repeated rows
    dealt = short.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    packed = dealt.groupBy("g").applyInPandas(_pack_group(length), schema)
    full = pieces.filter(F.col("length") == length).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)
