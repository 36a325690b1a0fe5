"""Deterministic identifiers as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: name space of all derived ids.
NAMESPACE_HEX = "6f1c2d4e9a3b4c5d8e7f0a1b2c3d4e5f"


def uuid5(name: Column, namespace_hex: str = NAMESPACE_HEX) -> Column:
    """RFC 4122 version-5 UUID of ``name``."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8), F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def evidence_key(zone: Column, metric: Column) -> Column:
    return F.coalesce(zone, metric, F.lit(""))


def hot_event_id(machine: Column, seq: Column, type_: Column, disc: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("hot"), machine, seq.cast("string"), type_, disc))


def warm_event_id(window: Column, type_: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("warm"), window, type_))


def eta_slip_event_id(task: Column, band: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("eta_slip"), task, band.cast("string")))


def incident_id(machine: Column, trigger: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("incident"), machine, trigger))


def lesson_id(incident: Column) -> Column:
    return uuid5(F.concat_ws(":", F.lit("lesson"), incident))


def window_start_s(ts: Column, width_s: int) -> Column:
    return (F.floor(F.unix_seconds(ts) / F.lit(width_s)) * width_s).cast("long")


def window_id(machine: Column, ts: Column, width_s: int) -> Column:
    return F.concat_ws(":", machine, window_start_s(ts, width_s).cast("string"))


def shard(key: Column, n: int = 4) -> Column:
    """First four bytes of SHA-256, big-endian, modulo ``n``."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % n).cast("int")
