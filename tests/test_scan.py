"""Chunked ordered scans against plain loops."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fleetstream.operators.scan import asof_join, gap_sessions, grid_quantiles, scan

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_scan_matches_loop(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randint(0, 9), rng.choice([None, 1, 2]), rng.random() < 0.2) for k in "ab" for i in range(200) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "k string, i long, v long, w long, hit boolean").repartition(5)
    got = scan(
        df.withColumn("ch", F.floor(F.col("i") / 7)), ["k"], "ch", ["i"], sums={"s": F.col("v")}, maxs={"mx": F.col("v")}, mins={"mn": F.col("v")},
        lasts={"la": F.col("w")}, prevs={"pv": F.col("w")}, prior_maxs={"pm": F.col("v")}, sinces={"si": F.col("hit")},
    )
    got = {(r.k, r.i): r for r in got.collect()}
    for k in "ab":
        s, mx, mn, la, pv, pm, si = 0, None, None, None, None, None, 0
        for _, i, v, w, hit in [r for r in rows if r[0] == k]:
            pm = mx
            s += v
            mx = v if mx is None else max(mx, v)
            mn = v if mn is None else min(mn, v)
            la = w if w is not None else la
            si = 0 if hit else si + 1
            r = got[(k, i)]
            assert (r.s, r.mx, r.mn, r.la, r.pv, r.pm, r.si) == (s, mx, mn, la, pv, pm, si)
            pv = w


def test_gap_sessions_cross_chunks(spark):
    rng = random.Random(2)
    rows = []
    for k in "xy":
        t = 0
        for i in range(150):
            t += rng.choice([0, 1, 5, 10, 30, 31, 200])
            rows.append((k, T0 + timedelta(seconds=t), i))
    df = spark.createDataFrame(rows, "k string, ts timestamp, i long")
    got = {(r.k, r.i): r for r in gap_sessions(df, ["k"], "ts", ["i"], 30, 40).collect()}
    for k in "xy":
        prev = first = None
        pos = 0
        for _, ts, i in sorted(r for r in rows if r[0] == k):
            gap = None if prev is None else (ts - prev).total_seconds()
            if gap is None or gap > 30:
                first, pos = ts, 0
            pos += 1
            r = got[(k, i)]
            assert r.sess_gap_s == gap and r.sess_pos == pos
            assert r.sess_first_ts == first.replace(tzinfo=None)
            prev = ts


def test_grid_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "hot", "hot", "b", "one"], 3000), "v": np.round(rng.exponential(5, 3000), 2)})
    pdf.loc[pdf["k"] == "one", "k"] = "b"
    pdf.loc[0, "k"] = "one"
    df = spark.createDataFrame(pdf)
    got = grid_quantiles(df.withColumnRenamed("k", "g"), ["g"], "v", 10, range_rows=8).collect()
    assert len(got) == 3 * 11
    for r in got:
        assert abs(r.q - np.quantile(pdf.loc[pdf["k"] == r.g, "v"], r.k / 10)) < 1e-9
    whole = grid_quantiles(df.select("v"), [], "v", 1000).collect()
    assert len(whole) == 1001
    for r in whole:
        assert abs(r.q - np.quantile(pdf["v"], r.k / 1000)) < 1e-9


def test_asof_join(spark):
    rng = random.Random(4)
    left = [(rng.choice("ab"), T0 + timedelta(seconds=rng.randint(0, 2000)), i) for i in range(300)]
    right = {(rng.choice("abc"), T0 + timedelta(seconds=rng.randint(100, 2000))): i for i in range(60)}
    ldf = spark.createDataFrame(left, "k string, ts timestamp, i long")
    rdf = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k string, at timestamp, v long")
    got = {r.i: r.v for r in asof_join(ldf, rdf, ["k"], "ts", "at", ["v"], 60).collect()}
    assert len(got) == 300
    for k, t, i in left:
        before = [(rt, v) for (rk, rt), v in right.items() if rk == k and rt <= t]
        assert got[i] == (max(before)[1] if before else None)


def test_asof_join_with_few_rows(spark):
    """A small right side is broadcast: same rows, and the left side is not shuffled."""
    rng = random.Random(5)
    ldf = spark.createDataFrame([(rng.choice(["a", "b", None]), T0 + timedelta(seconds=rng.randint(0, 2000)), i) for i in range(300)], "k string, ts timestamp, i long")
    rdf = spark.createDataFrame([("ab"[i % 2], T0 + timedelta(seconds=50 * i), i) for i in range(40)], "k string, at timestamp, v long")
    few = asof_join(ldf, rdf, ["k"], "ts", "at", ["v"], 60, few=True)
    assert {r.i: r.v for r in few.collect()} == {r.i: r.v for r in asof_join(ldf, rdf, ["k"], "ts", "at", ["v"], 60).collect()}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
