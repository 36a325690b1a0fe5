"""Column expressions against the standard library."""

import hashlib
import hmac
import json
import random
import struct
import uuid

from pyspark.sql import functions as F

from fleetstream.functions import ids, text
from fleetstream.functions.hashing import ascii_escaped, canonical_frame, canonical_json, hmac_pads, hmac_sha256, number_text
from fleetstream.functions.stats import round_binary
from fleetstream.operators.attribution import planned_break


def test_uuid5_and_shard(spark):
    names = ["hot:M1:7:HEALTH_THRESHOLD:engine_temp_c", "", "é×"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(F.col("n")).alias("u"), ids.shard(F.col("n")).alias("s")).collect()
    ns = uuid.UUID(ids.NAMESPACE_HEX)
    for r in rows:
        assert r.u == str(uuid.uuid5(ns, r.n))
        assert r.s == int.from_bytes(hashlib.sha256(r.n.encode()).digest()[:4], "big") % 4


def test_hmac_matches_library(spark):
    cases = [("key", "message"), ("k" * 64, "m"), ("long key " * 20, "text"), ("", ""), ("ключ", "é")]
    d = spark.createDataFrame(cases, "k string, m string")
    i, o = hmac_pads(F.col("k"))
    for r in d.withColumns({"i": i, "o": o}).withColumn("h", hmac_sha256(F.col("i"), F.col("o"), F.col("m"))).collect():
        assert r.h == hmac.new(r.k.encode(), r.m.encode(), hashlib.sha256).hexdigest()


def test_canonical_frame_is_sorted_compact_json(spark, pipe):
    r = pipe.t("signed").where("prox_zone is not null").select(canonical_frame().alias("j"), "*").first()
    body = json.loads(r.j)
    assert r.j == json.dumps(body, sort_keys=True, separators=(",", ":"))
    assert body["ts"].endswith("Z") and body["proximity"]["zone"] == r.prox_zone and "sig" not in body


def test_text(spark):
    d = spark.createDataFrame([("  Why It Matters: Here! ", "One. Two. Three", "ETA_SLIP")], "h string, t string, c string")
    r = d.select(text.slug(F.col("h")).alias("s"), text.first_sentence(F.col("t")).alias("f"), text.label(F.col("c")).alias("l"), text.tokens(F.col("h")).alias("k")).first()
    assert (r.s, r.f, r.l, r.k) == ("why-it-matters-here", "One.", "Eta Slip", ["why", "it", "matters", "here"])


def test_planned_break_bounds(spark):
    d = spark.sql("select explode(array(timestamp'2026-01-01 11:59:59', timestamp'2026-01-01 12:00:00', timestamp'2026-01-01 12:29:59', timestamp'2026-01-01 12:30:00')) ts")
    assert [r[0] for r in d.select(planned_break(F.col("ts"), "12:00-12:30, 18:00-18:15")).collect()] == [False, True, True, False]
    assert not any(r[0] for r in d.select(planned_break(F.col("ts"), "")).collect())


def test_round_binary_like_python(spark):
    xs = [4.475, 0.125, 2.5, -1.005, 1.115]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(round_binary(F.col("x"), 2).alias("y")).collect()
    assert [r.y for r in rows][:2] == [round(4.475, 2), round(0.125, 2)]


def test_number_text_is_that_of_json(spark):
    rnd = random.Random(4)
    values = [0.0005, 1e7, 2e23, 1e16, 9999999999999998.0, 123456789012345680.0, 0.0001, 0.00001, 5e-324, 1.7976931348623157e308, -0.0, 0.0, -2.5, 1 / 3, 100.0, 1e22, 1e23]
    values += [rnd.choice([1, -1]) * 10 ** rnd.uniform(-12, 25) for _ in range(1500)] + [round(rnd.uniform(-200, 200), rnd.randint(0, 6)) for _ in range(500)]
    values += [x for x in (struct.unpack("d", rnd.randbytes(8))[0] for _ in range(600)) if x == x and abs(x) != float("inf")]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", number_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [json.dumps(x) for x in values]


def test_canonical_json_is_that_of_json(spark):
    rows = [(0.0005, "é\U0001f389 \"x\": 1.0E-9,", 7, None), (2e23, "plain", -1, "b"), (-12.25, "line\nend \\ 5.0E10", 0, "")]
    d = spark.createDataFrame(rows, "a double, b string, c long, d string")
    text = canonical_json(a=F.col("a"), b=F.col("b"), c=F.col("c"), d=F.col("d"))
    for r in d.select("*", text.alias("t"), ascii_escaped(text).alias("u")).collect():
        body = {"a": r.a, "b": r.b, "c": r.c, "d": r.d}
        assert r.t == json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.u == json.dumps(body, sort_keys=True, separators=(",", ":"))
