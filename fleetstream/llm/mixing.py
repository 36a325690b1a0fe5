"""Mixing of sources to target weights over blocks of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstream.llm.common import words_of
from fleetstream.session import stage

#: Words of a block, times a source may be repeated, slots of an output shard (and fewest shards), rows whose places are summed in one task, equal rows laid out at once.
BLOCK, REPEATS, SHARD_SLOTS, LEAST_SHARDS, CHUNK, COPIES = 128, 3, 1 << 19, 16, 50_000, 4096
WEIGHTS = (5, 2, 1)
SPACES = "[^\\x20\\x09-\\x0D]+"


def targets(sizes: list[int], weights: list[float], repeats: int = REPEATS) -> list[float]:
    """Share of all sizes by weight, none above ``repeats`` times its own size; the excess goes to the others by weight."""
    total, out = float(sum(sizes)), [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    rest = total
    while free:
        weight = sum(weights[i] for i in free)
        full = [i for i in free if rest * weights[i] / weight > repeats * sizes[i]]
        if not full:
            for i in free:
                out[i] = rest * weights[i] / weight
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
        rest = total - sum(out)
        free = [i for i in free if i not in set(full)]
    return out


def shard_draws(quota: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """Slots of each source in each output shard, as (shards, sources).

    A shard's counts are a multinomial draw with the sources' shares of what is
    still to be placed; a draw beyond what a source has left is drawn again
    among the others, so in the end each source has its quota.
    """
    left = np.array(quota, dtype=np.int64)
    out = np.zeros((shards, len(left)), dtype=np.int64)
    rng = np.random.default_rng(seed)
    for s in range(shards):
        need = int(left.sum()) // (shards - s)
        while need:
            draw = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[s] += draw
            left -= draw
            need -= int(draw.sum())
    return out


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1 takes each index: a four-round Feistel network, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = np.random.default_rng(seed).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        high, low = out[todo] >> shift, out[todo] & mask
        for key in keys:
            mixed = (low + key) * key
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            high, low = low, high ^ ((mixed >> np.uint64(33)) & mask)
        out[todo] = (high << shift) | low
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, tie): words of each text; null texts have none."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.regexp_count("text", F.lit(SPACES)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie")
    )


def copies(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``copy``, the number of a row among equal ones.

    Equal rows are counted before the shuffle and laid out again in blocks, so
    that a row repeated any number of times is in no one task.
    """
    counted = sizes.groupBy("doc_id", "source", "size", "tie").agg(F.count("*").alias("n"))
    blocks = counted.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    laid = F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("n")) - 1)
    return blocks.withColumn("copy", F.explode(laid)).select("doc_id", "source", "size", "tie", "copy")


def placed(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``begin``: words of the source before the document.

    Documents of a source stand in a fixed pseudorandom order. Sums run over
    chunks of bounded size, so a source with a third of all rows is spread, and
    so are rows that are equal to each other.
    """
    chunks = max(1, -(-sizes.count() // CHUNK))
    cut = copies(sizes).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie", "copy", F.lit("chunk")), F.lit(chunks)))
    sums = cut.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "chunk").orderBy("doc_id", "tie", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    ordered = cut.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c"))
    return ordered.join(starts, same).withColumn("begin", F.col("start") + F.col("inside")).drop("s", "c", "chunk", "start", "inside", "copy")


def plan(sizes: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> list[dict]:
    """One row per source, in order of code points with null last: source, source_size, target, blocks, quota (slots)."""
    rows = [(r.source, r.n) for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or ""))
    wanted = targets([n for _, n in rows], [weights[i % len(weights)] for i in range(len(rows))], repeats)
    out = []
    for (source, n), target in zip(rows, wanted, strict=True):
        blocks = -(-n // BLOCK)
        out.append({"source": source, "source_size": n, "target": target, "blocks": blocks, "quota": min(repeats * blocks, round(target * blocks / n)) if n else 0})
    return out


def slots(spark, sources: list[dict], seed: int = 0, shards: int | None = None) -> DataFrame:
    """The mix: (shard, slot, source_no, pass_no, block), a row per slot of the output.

    Shards are of bounded size unless their number is given. The driver holds
    two numbers per shard and source, and nothing per block.
    """
    quota = [s["quota"] for s in sources]
    shards = shards or max(LEAST_SHARDS, -(-sum(quota) // SHARD_SLOTS))
    draws = shard_draws(quota, shards, seed)
    before = np.cumsum(draws, axis=0) - draws

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                order = np.random.default_rng((seed, shard)).permutation(np.repeat(np.arange(len(sources)), draws[shard]))
                block, turn = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
                for k in np.flatnonzero(draws[shard]):
                    mine = np.flatnonzero(order == k)
                    turn[mine], at = np.divmod(before[shard, k] + np.arange(len(mine)), sources[k]["blocks"])
                    for t in np.unique(turn[mine]):  # each pass over a source has a permutation of its own
                        here = turn[mine] == t
                        block[mine[here]] = permuted(at[here], sources[k]["blocks"], hash_seed(seed, int(k), int(t)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), shard)), pa.array(np.arange(len(order))), pa.array(order.astype(np.int32)), pa.array(turn.astype(np.int32)), pa.array(block)], ["shard", "slot", "source_no", "pass_no", "block"])

    return spark.range(0, shards, 1, min(shards, 4096)).mapInArrow(run, "shard long, slot long, source_no int, pass_no int, block long")


def hash_seed(*parts: int) -> int:
    return int(np.random.SeedSequence(parts).generate_state(1, np.uint64)[0] >> np.uint64(1))


def _numbered(frame: DataFrame, sources: list[dict]) -> DataFrame:
    """Adds source_no, source_size and target by a join with the source table (one row per source)."""
    rows = [(s["source"], i, s["source_size"], s["target"]) for i, s in enumerate(sources)]
    names = frame.sparkSession.createDataFrame(rows, "name string, source_no int, source_size long, target double")
    return frame.join(names, F.col("source").eqNullSafe(F.col("name")), "left").drop("name")


def _overlap() -> Column:
    """Words that a document has in a block."""
    end = F.col("begin") + F.col("size")
    return F.least(end, (F.col("block") + 1) * BLOCK) - F.greatest(F.col("begin"), F.col("block") * BLOCK)


def block_pieces(docs_placed: DataFrame) -> DataFrame:
    """A row for each block that a document has words in; a document has one per ``BLOCK`` words."""
    first, last = F.floor(F.col("begin") / BLOCK), F.floor((F.col("begin") + F.col("size") - 1) / BLOCK)
    return docs_placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last))).withColumn("words", _overlap())


def mix(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: int = 0, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of a mix of the sources of ``docs`` to target weights.

    documents: doc_id, source, size, source_no, source_size, target, begin, tie
    of every row. pieces: the mix itself, a row per slot and document in the
    slot's block: shard, slot, source_no, pass_no, block, doc_id, tie, begin,
    words (how many), at (first word of the document).

    Words of a source, in a fixed order of its documents, are cut into blocks
    of ``BLOCK`` words. The output has one slot per block; multinomial draws
    deal the sources over shards; the slots of a source run through passes over
    its blocks, each in an order of its own, so a block comes once per pass and
    ``repeats`` times at most. A source takes its target to within one block
    per pass. Documents without words (null, empty, white space) and sources
    without any have target 0 for their part and take nothing; sources are
    compared by code point, null last; rows with equal ids are rows of their
    own; an empty table gives no rows. The same rows and seed give the same mix.
    """
    sizes = stage(sized(docs), "sizes")
    sources = plan(sizes, weights, repeats)
    documents = stage(_numbered(placed(sizes), sources), "placed")
    drawn = slots(docs.sparkSession, sources, seed, shards)
    pieces = block_pieces(documents.select("doc_id", "tie", "source_no", "begin", "size")).withColumn("at", F.greatest(F.col("block") * BLOCK - F.col("begin"), F.lit(0)))
    # the plan takes the slots for as small as the list of shards they come from, so a broadcast is ruled out
    return documents, drawn.hint("merge").join(pieces, ["source_no", "block"]).drop("size")


def taken_words(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """``documents`` with ``taken``: words that the mix takes of each, repeats counted."""
    sums = pieces.groupBy(F.col("source_no").alias("k"), F.col("begin").alias("b"), F.col("doc_id").alias("d")).agg(F.sum("words").alias("taken"))
    same = (F.col("source_no") == F.col("k")) & (F.col("begin") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") > 0)
    return documents.join(sums, same, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("k", "b", "d")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with the columns of ``docs``: a row for each pass that takes words of a document.

    ``text`` has the words that the pass takes, in their order; a text that is
    taken whole stays as it is. ``n_chars``, if there is such a column of
    numbers, is set to the new length. Rows with the same id and text share
    what is taken of them.
    """
    _, pieces = mix(docs, **options)
    spans = pieces.groupBy(F.col("doc_id").alias("__id"), F.col("tie").alias("__tie"), "begin", "pass_no").agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("__spans"))
    taken = spans.groupBy("__id", "__tie").agg(F.collect_list("__spans").alias("__passes"))
    once = docs.withColumn("__tie_of", F.xxhash64("text"))
    joined = once.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__tie_of") == F.col("__tie"))).drop("__id", "__tie", "__tie_of")
    joined = joined.dropDuplicates(["doc_id", "text"]).withColumn("__spans", F.explode("__passes")).drop("__passes")
    columns, text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for t, spans in zip(batch.column(text).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                words = words_of(t)
                if sum(s["words"] for s in spans) == len(words):
                    texts.append(t)
                else:
                    texts.append(b" ".join(w for s in spans for w in words[s["at"] : s["at"] + s["words"]]).decode("utf-8", "surrogatepass"))
            out = [pa.array(texts, pa.string()) if k == text else batch.column(k) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays(out, columns)

    out = joined.select(*columns, "__spans").mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
