"""Hash-chained audit log: payload hashes, appending, verification."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstream.config import Config
from fleetstream.functions.hashing import ascii_escaped, canonical_json, iso_utc
from fleetstream.operators.groups import clustered
from fleetstream.operators.scan import scan

ENTRY_FIELDS = ("actor_id", "action", "target_type", "target_id")


def payload_hash(**fields: Column) -> Column:
    """SHA-256 of the payload's canonical JSON, in its form of ASCII only (frames are signed over unescaped text)."""
    return F.sha2(ascii_escaped(canonical_json(**fields)), 256)


def entry_hash(prev_hash: str = "prev_hash") -> Column:
    c = F.col
    return F.sha2(ascii_escaped(canonical_json(
        prev_hash=c(prev_hash), payload_hash=c("payload_hash"), ts=iso_utc(c("ts")), **{f: c(f) for f in ENTRY_FIELDS}
    )), 256)


def append_chain(entries: DataFrame, heads: DataFrame | None = None, max_chain: int | None = None) -> DataFrame:
    """Add ``prev_hash`` and ``current_hash`` to new entries of many chains.

    Each hash needs the one before it, so one chain is worked off in order; the
    rows of a chain stream through its task batch by batch and are never held
    together. ``heads``: chain_id, current_hash of chains that exist. With
    ``max_chain``, longer appends to a single chain are refused.
    """
    if max_chain is not None:
        long = entries.groupBy("chain_id").count().where(F.col("count") > max_chain).limit(1).collect()
        if long:
            raise ValueError(f"chain {long[0]['chain_id']} has {long[0]['count']} new entries, limit {max_chain}: split it into chains")
    d = entries.select("chain_id", "id", *ENTRY_FIELDS, "payload_hash", "ts").withColumn("__ts", iso_utc(F.col("ts")))
    if heads is not None:
        d = d.join(heads.select("chain_id", F.col("current_hash").alias("__head")), "chain_id", "left")
    else:
        d = d.withColumn("__head", F.lit(None).cast("string"))
    d = clustered(d, ["chain_id"], ["id"])

    def link(batches):
        chain, prev = None, None
        for pdf in batches:
            prevs, currents = [], []
            for row in zip(pdf["chain_id"], pdf["__head"], pdf["payload_hash"], pdf["__ts"], *[pdf[f] for f in ENTRY_FIELDS]):
                if row[0] != chain:
                    chain, prev = row[0], row[1]
                body = {"prev_hash": prev, "payload_hash": row[2], "ts": row[3], **dict(zip(ENTRY_FIELDS, row[4:]))}
                current = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
                prevs.append(prev)
                currents.append(current)
                prev = current
            yield pdf.drop(columns=["__ts", "__head"]).assign(prev_hash=pd.Series(prevs, index=pdf.index, dtype=object), current_hash=currents)

    ddl = "chain_id string, id long, " + ", ".join(f"{f} string" for f in ENTRY_FIELDS) + ", payload_hash string, ts timestamp, prev_hash string, current_hash string"
    return d.mapInPandas(link, ddl)


def check_entries(log: DataFrame, block: int = 100_000, cfg: Config = Config()) -> DataFrame:
    """Add ``problem`` per entry: GENESIS, LINK, HASH or NULL. Hashes are recomputed row by row, links by looking one row back."""
    c = F.col
    d = log.withColumn("__chunk", F.floor(c("id") / F.lit(block)).cast("long"))
    d = scan(d, ["chain_id"], "__chunk", ["id"], prevs={"__before": F.struct(c("current_hash").alias("h"))})
    problem = (
        F.when(c("__before").isNull() & c("prev_hash").isNotNull(), "GENESIS")
        .when(c("__before").isNotNull() & ~c("prev_hash").eqNullSafe(c("__before")["h"]), "LINK")
        .when(entry_hash() != c("current_hash"), "HASH")
    )
    return d.withColumn("problem", problem).drop("__chunk", "__before")


def verify_chain(log: DataFrame, block: int = 100_000) -> DataFrame:
    """Per chain: whether it is intact, and the first bad entry with its reason."""
    d = check_entries(log, block)
    return d.groupBy("chain_id").agg(F.min(F.when(F.col("problem").isNotNull(), F.struct("id", "problem"))).alias("bad"), F.count("*").alias("entries")).select(
        "chain_id", "entries", F.col("bad").isNull().alias("is_valid"), F.col("bad")["id"].alias("first_invalid_id"), F.col("bad")["problem"].alias("reason")
    )


def latest_heads(log: DataFrame) -> DataFrame:
    return log.groupBy("chain_id").agg(F.max_by("current_hash", "id").alias("current_hash"))


