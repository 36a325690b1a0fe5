"""Merkle manifest of a document table: leaf digests, a tree per source, a root over the sources, and a proof per row.

Every node has a place in its tree; runs of ``ARITY`` consecutive places share
a parent. A window over a run gives a node its siblings by lag and lead at the
fixed offsets 1 to ``ARITY`` - 1, masked by the node's slot in the run and by
the length of the run, and the first row of a run hashes the parent. So no
window ever holds more than ``ARITY`` rows, however many rows a source has.
Places come from a sort over ranges: rows per source and range are counted and
added up, no source is gathered. Texts are hashed where they are read; only
digests are shuffled. All of it is built-in functions.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstream.session import stage

ARITY = 16
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column | str) -> Column:
    """Lowercase hex sha256 of the parts one after the other; parts that are null are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(**replaced: Column) -> Column:
    """Digest of a row, some of its fields replaced."""
    return digest(*[field(replaced.get(name, F.col(name))) for name in FIELDS])


def lower_ascii(text: Column | str) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def group_key(source: Column) -> Column:
    """Key of a source that is never null and sorts null first, then by bytes."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def placed(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``pos`` (from 0, in ``order``, nulls first) and ``n`` (rows) within ``key`` without gathering a key.

    Rows are sorted over ranges and written once with their place in the range;
    what lies before a range is a sum over one row per key and range. Rows that
    are equal in ``order`` are told apart by where they are stored, so that any
    number of them still falls into several ranges.
    """
    order = (*order, "__stored")
    ranged = rows.withColumn("__stored", F.monotonically_increasing_id()).repartitionByRange(key, *order).sortWithinPartitions(key, *order).drop("__stored")
    at = stage(ranged.withColumn("__at", F.monotonically_increasing_id()), "merkle-order").withColumn("__range", F.shiftrightunsigned("__at", 33))
    each = at.groupBy(key, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    of_key = Window.partitionBy(key)
    before = F.sum("__rows").over(of_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select(key, "__range", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__rows").over(of_key).alias("n"))
    return at.join(each, [key, "__range"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__range", "__shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds ``run`` (place of the parent), ``slot`` in the run, and the digests ``left`` and ``right`` of the node within it."""
    slot = F.pmod("pos", F.lit(ARITY))
    rows = nodes.withColumns({"run": F.expr(f"pos div {ARITY}"), "slot": slot.cast("int")})
    in_run = Window.partitionBy("key", "run").orderBy("pos")
    length = F.least(F.lit(ARITY), F.col("n") - F.col("run") * ARITY)
    left = [F.when(F.col("slot") >= k, F.lag("h", k).over(in_run)) for k in range(ARITY - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < length, F.lead("h", k).over(in_run)) for k in range(1, ARITY)]
    columns = {f"__{i}": c for i, c in enumerate(left + right)}
    named = [F.col(c) for c in columns]
    wide = rows.withColumns(columns).withColumns({"left": F.concat_ws("", *named[: ARITY - 1]), "right": F.concat_ws("", *named[ARITY - 1 :])})
    return wide.drop(*columns)


def levels(leaves: DataFrame) -> list[DataFrame]:
    """(key, pos, n, h) per level, from the leaves up to single nodes; a key ends at the level where it has one node."""
    out = [leaves]
    widest = leaves.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        first = with_siblings(out[-1].filter("n > 1").select("key", "pos", "n", "h")).filter("slot = 0")
        parents = first.select("key", F.col("run").alias("pos"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), digest("h", "right").alias("h"))
        out.append(stage(parents, "merkle-level"))
        widest = -(-widest // ARITY)
    return out


def _paths(tree: list[DataFrame], roots: DataFrame, *more: str) -> DataFrame:
    """Rows of the lowest level with the columns of ``roots`` (key, path, ...), siblings of each level put before ``path``.

    From the top down: a level joins the one above, which has a sixteenth of
    its rows, so the joins cost little more than the last one.
    """
    carried = [c for c in roots.columns if c not in ("key", "path")]
    above = None
    for level in reversed(tree):
        own = [c for c in more if c in level.columns]
        done = level.filter("n = 1").join(roots, "key").select("key", "pos", "h", *own, "path", *carried)
        if above is not None:
            open_ = with_siblings(level.filter("n > 1").select("key", "pos", "n", "h", *own))
            step = F.struct("left", "right")
            above = above.withColumnRenamed("pos", "run").drop("h")
            joined = open_.join(above, ["key", "run"]).withColumn("path", F.concat(F.array(step), "path"))
            done = done.unionByName(joined.select(*done.columns))
        above = done
    return above


@dataclass
class Manifest:
    """Leaves with their places, the subroot of each source, and the root (one row of key '' and h, none for an empty table)."""

    leaves: DataFrame
    subroots: DataFrame
    root: DataFrame
    tree: list[DataFrame]
    top: list[DataFrame]

    def proofs(self) -> DataFrame:
        """(key, pos, h, columns of the leaves, subroot, root, path): ``path`` holds (left, right) sibling digests per level, leaf to root."""
        whole = self.root.select("key", F.col("h").alias("root"))
        empty = F.array().cast("array<struct<left:string,right:string>>")
        over = _paths(self.top, whole.withColumn("path", empty), "of")
        roots = over.select(F.col("of").alias("key"), "path", F.col("h").alias("subroot"), "root")
        more = [c for c in self.leaves.columns if c not in ("key", "pos", "n", "h")]
        return _paths(self.tree, stage(roots, "merkle-subroots"), *more)


def build(leaves: DataFrame, *order: str) -> Manifest:
    """Manifest of rows (key, h, more columns), leaves of a key being ordered by ``order`` and then by digest.

    Rows that are equal in all of these are interchangeable: whichever comes
    first, the same digests result.
    """
    base = placed(leaves, "key", *order, "h")
    tree = levels(base)
    single = tree[0].filter("n = 1").select("key", "h")
    for level in tree[1:]:
        single = single.union(level.filter("n = 1").select("key", "h"))
    top = levels(placed(single.select(F.lit("").alias("key"), F.col("key").alias("of"), "h"), "key", "of"))
    return Manifest(base, single, top[-1].filter("n = 1").select("key", "h"), tree, top)


def folded(start: Column, path: Column | str) -> Column:
    """Root that follows from a leaf digest and its sibling digests."""
    return F.aggregate(path, start, lambda acc, step: digest(step["left"], acc, step["right"]))


def document_leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, h, changed): leaf digest of each row, and that of its altered copy where one is simulated.

    Altered rows are those whose unsigned crc32 of the decimal doc_id is
    divisible by 5; only A-Z of their text become lower case.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return rows.select(group_key(F.col("source")).alias("key"), "doc_id", leaf().alias("h"), F.when(hit, leaf(text=lower_ascii("text"))).alias("changed"))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    A null in any field is the field ``-``; a null source is a source of its
    own; a null doc_id comes first and is never altered; an empty text is
    ``0:``. Repeated rows are leaves of their own; rows of equal doc_id are
    ordered by leaf. A source with one row has that leaf as subroot, a table
    with one source that subroot as root, and the proof of a table of one row
    is the digest of nothing. An empty table gives an empty one; columns other
    than the five fields are not looked at. Texts of any length are hashed whole.
    """
    leaves = stage(document_leaves(docs), "merkle-leaves")
    rows = build(leaves, "doc_id").proofs()
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    out = rows.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.coalesce("changed", "h"), "path").alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
