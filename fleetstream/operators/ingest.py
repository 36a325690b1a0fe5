"""Admission of telemetry: signature, freshness, sequence, replay, known machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstream.config import Config
from fleetstream.functions.hashing import canonical_frame, hmac_pads, hmac_sha256
from fleetstream.operators.scan import scan, seconds, time_chunk


def sign_frames(frames: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``expected_sig``; NULL for machines without a key. ``keys``: machine_id, secret."""
    inner, outer = hmac_pads(F.col("secret"))
    pads = keys.select("machine_id", inner.alias("__i"), outer.alias("__o"))
    return (
        frames.join(pads, "machine_id", "left")
        .withColumn("expected_sig", hmac_sha256(F.col("__i"), F.col("__o"), canonical_frame()))
        .drop("__i", "__o")
    )


def verify_signatures(frames: DataFrame, keys: DataFrame) -> DataFrame:
    """Add ``verdict``: ACCEPTED, UNKNOWN_KEY or BAD_SIGNATURE."""
    return sign_frames(frames, keys).withColumn(
        "verdict",
        F.when(F.col("expected_sig").isNull(), "UNKNOWN_KEY")
        .when(F.col("sig").isNull() | (F.col("sig") != F.col("expected_sig")), "BAD_SIGNATURE")
        .otherwise("ACCEPTED"),
    )


def fresh(arrivals: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Keep frames whose time is within the limit of their arrival time."""
    return arrivals.where(F.abs(seconds("ts") - seconds("arrival_ts")) <= cfg.freshness_s)


def classify_sequence(arrivals: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add ``result``: first, accepted, duplicate, out_of_order or gap, against the highest seq so far."""
    d = arrivals.withColumn("__chunk", time_chunk("arrival_ts", cfg.chunk_s))
    d = scan(d, ["machine_id"], "__chunk", ["arrival_ts", "arrival_no"], prior_maxs={"last_seq": F.col("seq")})
    last = F.col("last_seq")
    result = (
        F.when(last.isNull(), "first").when(F.col("seq") == last, "duplicate").when(F.col("seq") < last, "out_of_order")
        .when(F.col("seq") > last + 1, "gap").otherwise("accepted")
    )
    return d.withColumn("result", result).drop("__chunk")


def admitted(arrivals: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Rows that pass on: duplicates are ignored and out-of-order frames rejected."""
    return classify_sequence(arrivals, cfg).where(F.col("result").isin("first", "accepted", "gap"))


def drop_replays(arrivals: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Keep frames whose seq is above every earlier one of the machine."""
    d = classify_sequence(arrivals, cfg)
    return d.where(F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))).drop("result", "last_seq")


def known_machines(frames: DataFrame, machines: DataFrame) -> DataFrame:
    return frames.join(machines.select("machine_id"), "machine_id", "left_semi")


def with_site(frames: DataFrame, machines: DataFrame) -> DataFrame:
    """Site of the machine; UNKNOWN when the machine is not configured."""
    sites = machines.select("machine_id", F.col("site_id").alias("__site"))
    return (
        frames.drop("site_id").join(sites, "machine_id", "left")
        .withColumn("site_id", F.coalesce("__site", F.lit("UNKNOWN"))).drop("__site")
    )
