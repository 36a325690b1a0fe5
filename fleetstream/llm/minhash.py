"""MinHash near-duplicates by a signature-coordinate inverted join.

A signature has ``COORDINATES`` minima. Every pair of a coordinate and its
value is a posting list of the signatures that hold it, and two documents are
candidates if their signatures meet in at least ``MATCHES`` lists. Three steps
keep the join small without losing such a pair:

* a value that one signature holds meets nothing; a signature with fewer than
  ``MATCHES`` shared values has no partner and leaves the join;
* prefix: of its m shared values, rarest first, a signature is posted under the
  first m - ``MATCHES`` + 1 only. Two signatures that meet ``MATCHES`` times meet
  there, so lists of very frequent values are rarely opened;
* skip: in a list, a signature is counted against those not yet linked with it,
  and a pair is dropped once the coordinates that are left can't bring it to
  ``MATCHES``.

Candidates are linked, not listed: a list gives links that connect them. What
is connected so is confirmed on the full shingle sets, again against those not
yet linked, so copies by the thousand cost about one comparison each. Lists
and groups that are too long for a task are cut into tiles, every pair of
tiles being a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstream.llm.common import join_checked, ranges, worker_cache
from fleetstream.llm.components import components
from fleetstream.session import stage

SHINGLE, COORDINATES = 4, 32
#: Least matches of a candidate. At a similarity of 0.8, fewer than 14 of 32 coordinates match with a probability of 1.2e-6.
MATCHES = 14
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Most signatures of a list, and most shingles of a group, in one task; longer ones are tiled.
LIST_TILE, SET_TILE = 8192, 1 << 21
SEED = 20_013
_RNG = np.random.default_rng(SEED)
#: Fixed odd multipliers and offsets, one pair per coordinate.
MULTIPLIER = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_PART = 1 << 14


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; empty if it has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # of bytes, lower() changes A-Z only
    if not words:
        return np.empty(0, dtype=np.uint64)
    parts = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p) for p in parts], dtype=np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum of each coordinate's hash over the set, mixed with the coordinate's number: equal values meet in one list."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), _PART):
        part = shingles[at : at + _PART]
        for k in range(COORDINATES):
            least[k] = min(least[k], _mixed(part * MULTIPLIER[k] + OFFSET[k]).min())
    return _mixed(least + np.arange(1, COORDINATES + 1, dtype=np.uint64))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache("none", dict)
    for batch in batches:
        n, low, high, values, bits = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            h = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
            low.append(h & (1 << 64) - 1)
            high.append(h >> 64)
            own = signature(s) if len(s) else None
            values.append(None if own is None else own.view(np.int64))
            bits.append(None if own is None else own.astype(np.uint32).tobytes())
        as_long = lambda v: pa.array(np.array(v, dtype=np.uint64).view(np.int64))
        columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), as_long(low), as_long(high), pa.array(values, pa.list_(pa.int64())), pa.array(bits, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "hash", "n_shingles", "low", "high", "values", "bits"])


def sketches(texts: DataFrame) -> DataFrame:
    """(doc_id, hash, n_shingles, low, high, values, bits) per row of (doc_id, text, hash).

    low and high name the set by 128 bits; ``values`` is its signature, ``bits``
    the low 32 bits of each value, both null if the set is empty.
    """
    return texts.mapInArrow(_sketch, "doc_id long, hash long, n_shingles long, low long, high long, values array<long>, bits binary")


def connected(label: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], role: np.ndarray) -> np.ndarray:
    """Labels of the members of a group after links; equal labels are known to be connected.

    ``near(i, others)`` says which of ``others`` link with i. A member is
    compared with those of another label only; if there are members of role 0
    and of role 1, only pairs of both roles are compared.
    """
    root = label.copy()
    both = len(role) and role[0] != role[-1]  # rows are sorted by role
    first = int(np.searchsorted(role, 1)) if both else 0
    for i in range(first if both else len(root) - 1):
        at = first if both else i + 1
        others = at + np.flatnonzero(root[at:] != root[i])
        if len(others) and len(hit := others[near(i, others)]):
            joined = np.unique(np.r_[root[i], root[hit]])
            root[np.isin(root, joined)] = joined[0]
    return root


def matching(values: np.ndarray, least: int = MATCHES) -> Callable[[int, np.ndarray], np.ndarray]:
    """``near`` for signatures (rows of ``values``): at least ``least`` equal coordinates."""
    step = max(1, (values.shape[1] - least + 1) // 2)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        alive, count = np.arange(len(others)), np.zeros(len(others), dtype=np.int64)
        for at in range(0, values.shape[1], step):
            to = min(at + step, values.shape[1])
            count[alive] += (values[others[alive], at:to] == values[i, at:to]).sum(axis=1)
            alive = alive[count[alive] + values.shape[1] - to >= least]
            if not len(alive):
                break
        out = np.zeros(len(others), dtype=bool)
        out[alive] = True
        return out

    return near


def similar(flat: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> Callable[[int, np.ndarray], np.ndarray]:
    """``near`` for sets, given one after the other (each sorted): 100 * intersection >= percent * union."""
    starts = np.cumsum(sizes) - sizes

    def near(i: int, others: np.ndarray) -> np.ndarray:
        own = flat[starts[i] : starts[i] + sizes[i]]
        out = np.zeros(len(others), dtype=bool)
        fits = np.flatnonzero(100 * np.minimum(sizes[others], sizes[i]) >= percent * np.maximum(sizes[others], sizes[i]))
        at = 0
        while at < len(fits):  # a bounded number of shingles at a time
            ends = np.cumsum(sizes[others[fits[at:]]])
            some = fits[at : at + max(1, int(np.searchsorted(ends, 1 << 20, side="right")))]
            length = sizes[others[some]]
            where = np.repeat(starts[others[some]], length) + ranges(length)
            x = flat[where]
            found = np.minimum(np.searchsorted(own, x), len(own) - 1)
            both = np.add.reduceat((own[found] == x).astype(np.int64), np.cumsum(length) - length)
            out[some] = 100 * both >= percent * (sizes[i] + length - both)
            at += len(some)
        return out

    return near


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows of each group, rows being sorted by the first ``n_keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(n_keys)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if last is not None and (keys[0] != last).any():
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)], strict=True):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def _solved(batches: Iterator[pa.RecordBatch], near_of: Callable) -> Iterator[pa.RecordBatch]:
    """Groups of rows (key, a, b, role, id, label, payload) to links of ids whose labels were connected."""
    for rows in _groups(batches, 3):
        ids, label = rows["id"].to_numpy(), rows["label"].to_numpy()
        root = connected(label, near_of(rows["payload"].combine_chunks()), rows["role"].to_numpy())
        # the labels are ids, so a link of labels is one of ids
        moved = np.flatnonzero(root != label)
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(root[moved])], ["u", "v"])
        yield pa.RecordBatch.from_arrays([pa.array(label[moved]), pa.array(root[moved])], ["u", "v"])


def _near_signatures(payload: pa.Array) -> Callable:
    return matching(np.frombuffer(b"".join(payload.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES))


def _near_sets(payload: pa.Array) -> Callable:
    return similar(payload.flatten().to_numpy().view(np.uint64), payload.value_lengths().to_numpy().astype(np.int64))


def _solve(rows: DataFrame, near_of: Callable) -> DataFrame:
    part = rows.select(F.xxhash64("key", "a", "b").alias("part"), "*").repartition("part").drop("part")
    ordered = part.sortWithinPartitions("key", "a", "b", "role", "id")
    return ordered.mapInArrow(lambda batches: _solved(batches, near_of), "u long, v long").distinct()


def connecting_links(rows: DataFrame, near_of: Callable, bound: int) -> DataFrame:
    """Links (u, v) that connect all near members of each group; ``rows``: (key, id, weight, payload), staged.

    A group whose weights add up to at most ``bound`` is solved by one task. A
    longer one is cut into tiles, which are solved first; then all members are
    compared with one of them, and only groups that are not connected by then go
    on: members outside the largest component meet all others, tile by tile. So
    a group of very many near copies costs about two comparisons a member, and
    no pair of members is left uncompared unless it is connected already.
    """
    zero = F.lit(0)
    size = rows.groupBy("key").agg(F.sum("weight").alias("size"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    tiled = rows.join(size.select("key", F.ceil(F.col("size") / bound).cast("int").alias("tiles")), "key").withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    found = stage(_solve(tiled.select("key", F.col("t").alias("a"), zero.alias("b"), zero.alias("role"), "id", F.col("id").alias("label"), "payload"), near_of), "near-links")
    if size.filter(F.col("size") > bound).isEmpty():
        return found
    large = stage(tiled.filter("tiles > 1"), "near-large")
    hub = large.groupBy("key").agg(F.min_by(F.struct("id", "payload"), "id").alias("hub"), F.first("tiles").alias("tiles"))
    hubs = hub.select("key", F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("a"), zero.alias("b"), zero.alias("role"), "hub.id", F.col("hub.id").alias("label"), "hub.payload")
    others = large.select("key", F.col("t").alias("a"), zero.alias("b"), F.lit(1).alias("role"), "id", F.col("id").alias("label"), "payload")
    found = stage(found.union(_solve(hubs.union(others), near_of)).distinct(), "near-links")

    roots = stage(components(found), "near-roots")
    named = large.join(roots, large["id"] == roots["node"], "left").withColumn("label", F.coalesce("root", "id")).drop("node", "root")
    of_label = named.groupBy("key", "label").agg(F.sum("weight").alias("w"))
    main = of_label.groupBy("key").agg(F.max_by("label", "w").alias("main"), F.max("w").alias("w_main"), F.sum("w").alias("w_all")).filter("w_all > w_main")
    split = main.select("key", "main", F.ceil((F.col("w_all") - F.col("w_main")) / bound).cast("int").alias("rests"))
    if split.isEmpty():
        return found
    left = stage(named.join(split, "key"), "near-rest")
    rest = left.filter("label != main").withColumn("b", F.pmod(F.xxhash64("id"), F.col("rests")).cast("int"))
    rest = rest.select("key", F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("a"), "b", zero.alias("role"), "id", "label", "payload")
    every = left.select("key", F.col("t").alias("a"), F.explode(F.sequence(zero, F.col("rests") - 1)).alias("b"), F.lit(1).alias("role"), "id", "label", "payload")
    return stage(found.union(_solve(rest.union(every), near_of)).distinct(), "near-links")


def candidates(sets: DataFrame, matches: int = MATCHES, tile: int = LIST_TILE) -> DataFrame:
    """(id, values, bits) of distinct sets -> links (u, v) that connect all pairs with at least ``matches`` equal values."""
    held = sets.select("id", F.explode("values").alias("value"))
    shared = stage(held.groupBy("value").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "minhash-values")
    rare_first = F.sort_array(F.collect_list(F.struct("size", "value")))
    prefix = held.join(shared, "value").groupBy("id").agg(rare_first.alias("met")).filter(F.size("met") >= matches)
    prefix = prefix.select("id", F.expr(f"slice(met, 1, size(met) - {matches - 1})").alias("met"))
    posted = sets.select("id", "bits").join(prefix, "id").select(F.explode("met.value").alias("key"), "id", F.lit(1).alias("weight"), F.col("bits").alias("payload"))
    return connecting_links(stage(posted, "minhash-postings"), _near_signatures, tile)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):  # one text at a time: sets are as large as the texts
            s = shingle_set(batch.column(3)[at].as_py())
            one = batch.slice(at, 1)
            yield pa.RecordBatch.from_arrays([*(one.column(k) for k in range(3)), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["key", "id", "weight", "payload"])


def confirmed(texts: DataFrame, members: DataFrame, bound: int = SET_TILE) -> DataFrame:
    """Links (u, v) that connect all linked sets of each group, confirmed on the sets.

    ``members``: (grp, id, n_shingles, holder), the holder naming a row (doc_id,
    hash) of ``texts`` that has the set. Rows equal in both are one.
    """
    wanted = members.select(F.col("grp").alias("key"), "id", F.col("n_shingles").alias("weight"), F.col("holder.doc_id").alias("of"), "holder.hash")
    found = join_checked(texts, wanted, "hash").filter(F.col("doc_id").eqNullSafe(F.col("of")))
    one = found.groupBy("key", "id", "weight").agg(F.first("text").alias("text"))
    sets = one.mapInArrow(_sets, "key long, id long, weight long, payload array<long>")
    return connecting_links(stage(sets, "minhash-members"), _near_sets, bound)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Null, empty and white texts have an empty set, are linked with nothing and
    are their own component. A null doc_id is the component of others only if
    none of them has an id; a row is kept if its id, null included, is that of
    its component, so repeated rows of the first id are kept alike. Equal sets
    are one member. An empty table gives an empty one; columns other than
    doc_id and text are not looked at. Texts are taken whole.
    """
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"))
    rows = stage(sketches(texts), "minhash-sketches")
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash"))
    any_row = F.first(F.struct("n_shingles", "values", "bits")).alias("row")
    classes = rows.filter("n_shingles > 0").groupBy("low", "high").agg(holder.alias("holder"), any_row)
    sets = stage(classes.select(F.monotonically_increasing_id().alias("id"), "low", "high", "holder", "row.*"), "minhash-sets")
    near = components(candidates(sets))
    members = sets.join(near, sets["id"] == near["node"]).select(F.col("root").alias("grp"), "id", "n_shingles", "holder")
    roots = components(confirmed(texts, stage(members, "minhash-groups")))
    placed = sets.join(roots, sets["id"] == roots["node"], "left").select("low", "high", "holder.doc_id", F.coalesce("root", "id").alias("root"))
    placed = stage(placed, "minhash-components")
    of_set = placed.join(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("low", "high", "component_id")
    found = rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "low", "high").join(of_set, ["low", "high"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
