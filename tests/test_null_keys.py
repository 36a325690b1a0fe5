"""Rows without a key keep their own timeline: as many come out as go in, with the values they would have under a name."""

import pytest
from pyspark.sql import functions as F

from fleetstream.operators import ingest, risk, scan, states, windows


def named(df, key="machine_id"):
    return df.withColumn(key, F.coalesce(F.col(key), F.lit("nobody")))


def rows(df, key="machine_id"):
    return sorted(map(str, named(df, key).select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def frames(pipe):
    c = F.col("machine_id")
    return pipe.t("enveloped").where("machine_id <= 'M00004'").withColumn("machine_id", F.when(c != "M00002", c))


OPERATORS = {
    "machine_states": lambda d, cfg: states.machine_states(d, cfg),
    "risk_frame": lambda d, cfg: risk.risk_trajectory(d.withColumn("risk_added", F.col("engine_temp_c") / 50), "frame", cfg),
    "risk_event": lambda d, cfg: risk.risk_trajectory(d.withColumn("risk_added", F.col("engine_temp_c") / 50), "event", cfg),
    "envelope_changes": lambda d, cfg: states.envelope_changes(d, cfg),
    "risk_levels": lambda d, cfg: risk.risk_levels(d.withColumn("risk_score", F.col("seq") * 7 % 90), cfg),
    "numbered": lambda d, cfg: scan.numbered(d.withColumn("__blk", F.expr("seq div 10")), ["machine_id"], "__blk", ["seq"]).drop("__blk"),
    "window_features": lambda d, cfg: windows.window_features(d, cfg),
    "classify_sequence": lambda d, cfg: ingest.classify_sequence(d.withColumns({"arrival_ts": F.col("ts"), "arrival_no": F.col("seq")}), cfg),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_a_null_machine_is_a_machine(pipe, frames, name):
    run = OPERATORS[name]
    got, want = run(frames, pipe.cfg), run(named(frames), pipe.cfg)
    cols = [c for c in got.columns if c != "window_id"]
    assert rows(got.select(*cols)) == rows(want.select(*cols))


def test_asof_join_of_null_keys(spark):
    left = spark.createDataFrame([(k, t) for k in ("a", None) for t in (5, 65, 1000)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    right = spark.createDataFrame([("a", 1, "x"), (None, 3, "y"), (None, 60, "z")], "k string, s long, v string").select("k", F.timestamp_seconds("s").alias("ts"), "v")
    got = scan.asof_join(left, right, ["k"], "ts", "ts", ["v"])
    assert sorted((str(r.k), r.s, r.v) for r in got.collect()) == [("None", 5, "y"), ("None", 65, "z"), ("None", 1000, "z"), ("a", 5, "x"), ("a", 65, "x"), ("a", 1000, "x")]
