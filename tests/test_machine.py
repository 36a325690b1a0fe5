"""Machine state, risk and levels: chunked closed forms against frame-by-frame folds."""

import math
import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest

from fleetstream.config import Config
from fleetstream.operators import risk, states

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
SMALL = replace(Config(), chunk_rows=13, chunk_s=17)


def _frames(seed, n=700):
    rng = random.Random(seed)
    rows = []
    for m in ("A", "B", "C"):
        mode, seq = "idle", 0
        for _ in range(n):
            seq += rng.choice([1, 1, 1, 2, 40]) if rng.random() < 0.1 else 1
            if rng.random() < 0.12:
                mode = rng.choice(["idle", "idle", "work", "travel", "ambig", "off"])
            rpm, hyd, speed = {"idle": (800.0, 20.0, 0.0), "work": (1900.0, 200.0, 0.2), "travel": (1400.0, 80.0, 3.0), "ambig": (1200.0, 80.0, 0.0), "off": (0.0, 0.0, 0.0)}[mode]
            rows.append((m, seq, T0 + timedelta(seconds=seq), rpm, hyd, speed, mode == "idle" and rng.random() < 0.02, rng.choice([0.0] * 12 + [10.0, 15.0, 25.0, 39.0])))
    return rows


DDL = "machine_id string, seq long, ts timestamp, engine_rpm double, hydraulic_pressure_bar double, speed_kmh double, cycle_completed boolean, risk_added double"


def _fold_states(rows):
    out, state, dwell, ticks = {}, "OFF", 0, 0
    for m, seq, ts, rpm, hyd, speed, cyc, a in rows:
        if rpm == 0:
            state, dwell = "OFF", 0
        elif hyd >= 120 or cyc:
            state, dwell = "WORKING", 0
        elif speed >= 0.5:
            state, dwell = "TRAVEL", 0
        elif rpm < 1000 and hyd < 50:
            if state == "IDLE":
                dwell = 0
            else:
                dwell += 1
                if dwell >= 5:
                    state, dwell = "IDLE", 0
        else:
            dwell = 0
        ticks = ticks + 1 if state == "IDLE" else 0
        out[(m, seq)] = (state, ticks)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_states_match_fold(spark, seed):
    rows = _frames(seed)
    want = {}
    for m in ("A", "B", "C"):
        want |= _fold_states([r for r in rows if r[0] == m])
    got = states.machine_states(spark.createDataFrame(rows, DDL), SMALL).collect()
    assert {(r.machine_id, r.seq): (r.state, r.idle_ticks) for r in got} == want


@pytest.mark.parametrize("dt", ["frame", "event"])
def test_risk_and_level_match_fold(spark, dt):
    rows = _frames(5)
    k = risk.LN2 / 300
    d = risk.risk_levels(risk.risk_trajectory(spark.createDataFrame(rows, DDL), dt, SMALL), SMALL)
    got = {(r.machine_id, r.seq): (r.risk_score, r.risk_level) for r in d.collect()}
    seen = set()
    for m in ("A", "B", "C"):
        x, level, last = 0.0, "NORMAL", None
        for _, seq, ts, *_, a in [r for r in rows if r[0] == m]:
            step = 1.0 if dt == "frame" else (0.0 if last is None else (ts - last).total_seconds())
            x, last = min(100.0, x * math.exp(-k * step) + a), ts
            shown = round(x, 10)
            if level == "NORMAL":
                level = "HIGH" if shown >= 60 else "ELEVATED" if shown >= 30 else level
            elif level == "ELEVATED":
                level = "HIGH" if shown >= 60 else "NORMAL" if shown < 20 else level
            elif shown < 45:
                level = "NORMAL" if shown < 20 else "ELEVATED"
            r, lv = got[(m, seq)]
            assert abs(r - x) < 1e-8 and lv == level
            seen.add(level)
    assert seen == {"NORMAL", "ELEVATED", "HIGH"}


def test_envelope_takes_widest_factor_and_lowest_cap(spark):
    row = [("RAIN", 2.0, 9999.0, 50.0, "ICY", True), (None, None, None, None, None, None), ("CLOUDY", 0.0, 9999.0, 5.0, "DRY", False)]
    d = spark.createDataFrame(row, "weather string, rainfall_mm_h double, visibility_m double, wind_kmh double, ground string, daylight boolean")
    a, b, c = states.with_envelope(d).collect()
    assert (a.conditions, a.red_radius_m, a.orange_radius_m, a.speed_cap_kmh) == ("RAIN,ICY,WINDY", 6.0, 10.5, 2.0)
    assert (b.conditions, b.red_radius_m, b.speed_cap_kmh, b.condition_multiplier) == ("", 4.0, 6.0, 1.0)
    assert (c.conditions, c.condition_multiplier, c.speed_cap_kmh) == ("LOW_VIS", 1.5, 3.0)


@pytest.mark.parametrize("dt", ["frame", "event"])
def test_risk_over_many_stretches(spark, dt):
    """A short half-life makes the axis of chunks many stretches long."""
    rows = _frames(8)
    cfg = replace(SMALL, risk_half_life_s=0.5)
    k = risk.LN2 / 0.5
    got = {(r.machine_id, r.seq): r.risk_score for r in risk.risk_trajectory(spark.createDataFrame(rows, DDL), dt, cfg).collect()}
    for m in ("A", "B", "C"):
        x, last = 0.0, None
        for _, seq, ts, *_, a in [r for r in rows if r[0] == m]:
            step = 1.0 if dt == "frame" else (0.0 if last is None else (ts - last).total_seconds())
            x, last = min(100.0, x * math.exp(-k * step) + a), ts
            assert abs(got[(m, seq)] - x) < 1e-7
