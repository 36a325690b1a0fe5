"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most 3 of 64 bits are linked. Candidates come
from 16 exact keys of 28 bits: a fingerprint falls into four blocks of 16 bits,
of which at least one is equal in a linked pair; the other 48 bits fall into
four blocks of 12, of which again at least one is equal. Members of a key are
compared in bit-sliced form: bit p of 64 members lies in one machine word, so
one exclusive-or compares a fingerprint with 64 others, and a two-bit
carry-save counter with an overflow flag adds up 64 distances at once. Words
in which all members are beyond the radius are dropped every few planes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstream.llm.common import local_components, ranges, worker_cache
from fleetstream.llm.components import components
from fleetstream.session import stage

BITS, RADIUS, SEED, SHINGLE = 64, 3, 42, 3
#: Members of one comparison group; keys with more are split into tiles, and each pair of tiles is a group.
TILE = 8192
#: Pairs of a fingerprint and a word of 64 others that are compared at once.
SLAB = 1 << 16
ONE, FULL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint of a text; 0 if it has no word (null included)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes, lower() changes A-Z only
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("none", dict)  # what an earlier operator has left in this worker is not needed here
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        more = batch.schema.names[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *(batch.column(c) for c in more)], ["doc_id", "fp", *more])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``, and columns ``more`` of longs: fp holds the 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more).mapInArrow(_prints, ", ".join(f"{c} long" for c in ("doc_id", "fp", *more)))


def _keys():
    """The 16 keys of a fingerprint: number of the key, 16 bits of a block, 12 bits of the rest."""
    fp, out = F.col("fp"), []
    for b in range(4):
        low = fp.bitwiseAND(F.lit((1 << 16 * b) - 1))
        high = F.lit(0).cast("long") if b == 3 else F.shiftleft(F.shiftrightunsigned(fp, 16 * b + 16), 16 * b)
        block, rest = F.shiftrightunsigned(fp, 16 * b).bitwiseAND(F.lit(0xFFFF)), low.bitwiseOR(high)
        for s in range(4):
            sub = F.shiftrightunsigned(rest, 12 * s).bitwiseAND(F.lit(0xFFF))
            out.append(F.lit((4 * b + s) << 28).cast("long").bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(sub))
    return F.explode(F.array(*out))


def sliced_links(prints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Position of the first member linked with each member, directly or over others of its group.

    ``prints`` (uint64) holds groups of ``sizes`` one after the other. Only
    members of one group are compared.
    """
    n, starts = len(prints), np.cumsum(sizes) - sizes
    rank = ranges(sizes)
    bit = (rank % 64).astype(np.uint64)
    per_group = -(-sizes // 64)
    word_of = np.repeat(np.cumsum(per_group) - per_group, sizes) + rank // 64
    heads = np.flatnonzero(rank % 64 == 0)  # the first member of each word
    valid = np.add.reduceat(ONE << bit, heads)
    planes = np.empty((BITS, len(heads)), dtype=np.uint64)
    for p in range(BITS):
        planes[p] = np.add.reduceat(((prints >> np.uint64(p)) & ONE) << bit, heads)
    last_word = np.repeat(np.cumsum(per_group) - 1, sizes)
    todo = last_word - word_of + 1  # words from a member's own to the last of its group
    ends, parent = np.cumsum(todo), np.arange(n)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLAB, side="right")))
        who = np.repeat(np.arange(at, to), todo[at:to])
        word = word_of[who] + ranges(todo[at:to])
        own = prints[who]
        alive = valid[word]
        alive = np.where(word == word_of[who], alive & ~((ONE << bit[who]) | ((ONE << bit[who]) - ONE)), alive)
        ones, twos, over = (np.zeros(len(who), dtype=np.uint64) for _ in range(3))
        for p in range(BITS):
            differ = planes[p][word] ^ (np.uint64(0) - ((own >> np.uint64(p)) & ONE))
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if p % 8 == 7:
                open_ = (alive & ~over) != 0
                if 2 * np.count_nonzero(open_) < len(open_):
                    who, word, own, alive, ones, twos, over = (x[open_] for x in (who, word, own, alive, ones, twos, over))
                    if not len(who):
                        break
        hits = alive & ~over
        for k in range(64):
            if len(found := np.flatnonzero((hits >> np.uint64(k)) & ONE)):
                parent = local_components(n, who[found], heads[word[found]] + k, parent)
        at = to
    return parent


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, fp), sorted by group, to links of the members with the first of their set."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def solve(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
        parent = sliced_links(fp.view(np.uint64), np.diff(np.r_[cuts, len(fp)]))
        moved = np.flatnonzero(parent != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[parent[moved]])], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        group = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], axis=1)
        fp = batch.column(3).to_numpy()
        # the last group may go on in the next batch
        tail = len(fp) - int(np.argmin((group[::-1] == group[-1]).all(axis=1))) if (group != group[-1]).any() else 0
        if tail:
            done = [*held, (group[:tail], fp[:tail])]
            held = [(group[tail:], fp[tail:])]
            yield solve(np.concatenate([g for g, _ in done]), np.concatenate([x for _, x in done]))
        else:
            if held and (held[-1][0][-1] != group[-1]).any():
                yield solve(np.concatenate([g for g, _ in held]), np.concatenate([x for _, x in held]))
                held = []
            held.append((group, fp))
    if held:
        yield solve(np.concatenate([g for g, _ in held]), np.concatenate([x for _, x in held]))


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that join all fingerprints within the radius, not every pair.

    A key with more than ``tile`` members is split into tiles by a hash; every
    pair of tiles is a group of its own, so no task holds more than two tiles.
    """
    keyed = prints.select("fp", _keys().alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    tiled = keyed.join(sizes, "key").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    grouped = tiled.select("key", "fp", mine.alias("t"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o")).select(
        "key", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "fp"
    )
    return grouped.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links, "u long, v long")


def _placed(nodes: DataFrame) -> DataFrame:
    """Rows of distinct fingerprints (fp), with the root of their component."""
    roots = stage(components(links(nodes)), "components").withColumnRenamed("node", "fp")
    return nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, its own included.

    A row per row of ``docs``. Equal fingerprints are one node. Texts that are
    null, empty or white space have fingerprint 0 and link like any other;
    a null doc_id is never the smallest unless the component has no other;
    an empty table gives an empty one; other columns are not looked at.
    """
    prints = stage(fingerprints(docs), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    placed = _placed(nodes)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(placed.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The first row of each component, all columns kept: that of the smallest doc_id, nulls last, then of the smallest hash of the row.

    Rows are told apart by two hashes over all their columns, not by doc_id, which may be null or repeat.
    """
    columns = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.withColumns({"__h": F.xxhash64(*columns), "__g": F.hash(*columns).cast("long")})
    row = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__h", "__g")
    nodes = stage(fingerprints(keyed, "__h", "__g").groupBy("fp").agg(F.min(row).alias("row")), "fingerprints")
    kept = _placed(nodes).groupBy("root").agg(F.min("row").alias("row")).select("row.__h", "row.__g")
    return keyed.join(kept, ["__h", "__g"], "left_semi").dropDuplicates(["__h", "__g"]).select(*docs.columns)
