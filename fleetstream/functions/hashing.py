"""Keyed hashing and canonical JSON text as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pad(key_hex: Column, byte: int) -> Column:
    bytes_ = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.lpad(
            F.hex(
                F.coalesce(F.conv(F.nullif(F.substr(key_hex, i * 2 + 1, F.lit(2)), F.lit("")), 16, 10).cast("long"), F.lit(0))
                .bitwiseXOR(F.lit(byte).cast("long"))
            ),
            2, "0",
        ),
    )
    return F.array_join(bytes_, "")


def hmac_pads(secret: Column) -> tuple[Column, Column]:
    """Inner and outer pad (hex) of a text key; compute once per key, not per row."""
    raw = F.hex(F.encode(secret, "UTF-8"))
    key = F.when(F.length(raw) > 128, F.sha2(F.encode(secret, "UTF-8"), 256)).otherwise(raw)
    return _pad(key, 0x36), _pad(key, 0x5C)


def hmac_sha256(inner_hex: Column, outer_hex: Column, message: Column) -> Column:
    inner = F.sha2(F.concat(F.unhex(inner_hex), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.unhex(outer_hex), F.unhex(inner)), 256)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text in UTC with 'Z'; microseconds only when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    return F.concat(whole, F.when(micros == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))), F.lit("Z"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.transform(F.array(value), then)[0]


def number_text(x: Column) -> Column:
    """Shortest decimal text of a double that reads back as the same value, as Python and JSON signers write it.

    Plain from 1e-4 to below 1e16, else with an exponent of at least two digits (``2e+23``). The JVM's own
    digits are taken, and shortened where fewer digits give the same double.
    """

    def parsed(text: Column) -> Column:
        mantissa, power = F.substring_index(text, "E", 1), F.coalesce(F.nullif(F.regexp_extract(text, "E(-?[0-9]+)", 1), F.lit("")).cast("int"), F.lit(0))
        whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
        exponent = power + F.when(whole == "0", -F.length(F.regexp_extract(part, "^(0*)", 1)) - 1).otherwise(F.length(whole) - 1)
        return F.struct(F.regexp_replace(F.concat(whole, part), "^0+|0+$", "").alias("d"), exponent.alias("e"))

    def cut(p: Column, k: int, near: bool) -> Column:
        """Digits and exponent with ``k`` places fewer, the last one rounded to the nearer or to the other side."""
        rest = F.substring(p["d"], F.length(p["d"]) - k + 1, F.lit(k)).try_cast("int")
        up = F.when(rest >= 5 * 10 ** (k - 1), int(near)).otherwise(int(not near))
        rounded = (F.substring(p["d"], F.lit(1), F.length(p["d"]) - k).try_cast("decimal(20,0)") + up).cast("decimal(20,0)").cast("string")
        return F.struct(F.regexp_replace(rounded, "0+$", "").alias("d"), (p["e"] + F.length(rounded) - (F.length(p["d"]) - k)).alias("e"))

    def same(p: Column) -> Column:
        return F.concat(p["d"], F.lit("E"), (p["e"] - F.length(p["d"]) + 1).cast("string")).cast("double") == F.abs(x)

    def shortest(p: Column) -> Column:
        shorter = F.filter(F.array(*[cut(p, k, near) for k in (2, 1) for near in (True, False)]), same)
        return F.when((F.length(p["d"]) < 16) & (p["e"] > -308), p).otherwise(F.coalesce(F.get(shorter, F.lit(0)), p))

    def written(p: Column) -> Column:
        d, e, n = p["d"], p["e"], F.length(p["d"])
        plain = (
            F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))
            .when(n <= e + 1, F.concat(d, F.repeat(F.lit("0"), e + 1 - n), F.lit(".0")))
            .otherwise(F.concat(F.substring(d, F.lit(1), e + 1), F.lit("."), F.substring(d, e + 2, n)))
        )
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise(F.lit(""))
        size = F.abs(e).cast("string")
        power = F.concat(F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")), F.when(F.length(size) < 2, F.lit("0")).otherwise(F.lit("")), size)
        return F.when((e >= -4) & (e < 16), plain).otherwise(F.concat(F.substring(d, 1, 1), tail, power))

    text = _let(_let(parsed(F.abs(x).cast("string")), shortest), written)
    sign = F.when(x.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.when(x == 0, F.lit("0.0")).otherwise(text))


def _numbers_rewritten(text: Column) -> Column:
    """JSON text with its doubles in the form of ``number_text``; texts whose doubles have it already are left alone."""
    tokens = F.regexp_extract_all(text, F.lit('"(?:[^"\\\\]|\\\\.)*"|-?[0-9][0-9.E+-]*|[^"0-9-]+'), F.lit(0))
    rewritten = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]+[.]"), number_text(t.cast("double"))).otherwise(t)), "")
    return F.when(text.rlike("[0-9]E-?[0-9]|[0-9.]{17}"), rewritten).otherwise(text)


def ascii_escaped(text: Column) -> Column:
    """Every character beyond ASCII as \\uXXXX, those beyond the basic plane as two."""
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def char(c: Column) -> Column:
        code = F.ascii(c)
        over = code - 0x10000
        pair = F.concat(unit(F.shiftright(over, 10) + 0xD800), unit(over.bitwiseAND(F.lit(0x3FF)) + 0xDC00))
        return F.when(code < 0x80, c).when(code < 0x10000, unit(code)).otherwise(pair)

    return F.when(text.rlike("[^\\x00-\\x7F]"), F.array_join(F.transform(F.split(text, ""), char), "")).otherwise(text)


def canonical_json(**fields: Column) -> Column:
    """JSON object text with sorted keys, no spaces, and NULLs written out; doubles as in ``number_text``."""
    cols = [fields[k].alias(k) for k in sorted(fields)]
    return _numbers_rewritten(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))


def canonical_frame() -> Column:
    """Text a telemetry frame is signed over (all fields but the signature)."""
    c = F.col
    prox = F.when(c("proximity").isNotNull(), F.struct(c("proximity.distance_m").alias("distance_m"), c("proximity.source").alias("source"), c("proximity.zone").alias("zone")))
    names = (
        "cycle_completed", "engine_rpm", "engine_temp_c", "fuel_rate_lph", "gps", "hauler_queue_len",
        "hydraulic_pressure_bar", "machine_id", "operator_id", "seatbelt", "seq", "speed_kmh", "task_id", "truck_present",
    )
    return canonical_json(**{n: c(n) for n in names}, proximity=prox, ts=iso_utc(c("ts")))
