"""Envelope, machine state, rule events, risk and alert queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from fleetstream.operators import alerts, risk, safety, states
from fleetstream.plans.oracle import cte
from fleetstream.plans.pipeline import stage_table
from fleetstream.plans.q_ingest import uuid5_sql
from fleetstream.plans.registry import query
from fleetstream.sources import sinks


def r(name: str, n: int = 4):
    return (F.round(F.col(name), n) + F.lit(0.0)).alias(name)


# --- stages ------------------------------------------------------------------

@stage_table("enveloped")
def _enveloped(p):
    return states.with_envelope(states.with_context(p.t("frames"), p.t("context")))


@stage_table("states")
def _states(p):
    return states.machine_states(p.t("enveloped"), p.cfg)


@stage_table("frame_events")
def _frame_events(p):
    return safety.with_risk_added(safety.frame_events(p.t("states"), p.cfg))


@stage_table("hot_events")
def _hot_events(p):
    return safety.explode_events(p.t("frame_events"))


@stage_table("risk")
def _risk(p):
    d = p.t("frame_events").select("machine_id", "site_id", "operator_id", "seq", "ts", "state", "idle_ticks", "risk_added")
    return risk.risk_trajectory(d, "frame", p.cfg)


@stage_table("risk_levels")
def _risk_levels(p):
    return risk.risk_levels(p.t("risk"), p.cfg)


@stage_table("alert_windows")
def _alert_windows(p):
    return alerts.decide_alerts(alerts.alert_windows(p.t("hot_events"), p.cfg))


# --- SQL ---------------------------------------------------------------------

cte(
    "env",
    """select *, round(4e0 * mult, 1) red_radius_m, round(7e0 * mult, 1) orange_radius_m,
      concat_ws(',', case when rain then 'RAIN' end, case when lowvis then 'LOW_VIS' end, case when muddy then 'MUDDY' end,
        case when icy then 'ICY' end, case when windy then 'WINDY' end) conditions,
      least(6e0, case when rain then 4e0 else 6e0 end, case when lowvis or muddy then 3e0 else 6e0 end, case when icy then 2e0 else 6e0 end,
        case when windy then 5e0 else 6e0 end) speed_cap_kmh
    from (select *, greatest(1e0, case when rain then 1.3e0 else 1e0 end, case when lowvis or icy then 1.5e0 else 1e0 end, case when muddy then 1.2e0 else 1e0 end) mult
    from (select *, coalesce(weather = 'RAIN' or rainfall_mm_h > 0, false) rain,
      coalesce((weather = 'CLOUDY' and not daylight) or visibility_m < 50, false) lowvis, coalesce(ground = 'MUDDY', false) muddy,
      coalesce(ground = 'ICY', false) icy, coalesce(wind_kmh > 40 or weather = 'WINDY', false) windy from frames_ctx))""",
)
cte(
    "st1",
    """select *, row_number() over w rn, case when engine_rpm = 0 then 'OFF' when hydraulic_pressure_bar >= 120 or cycle_completed then 'WORKING'
      when speed_kmh >= 0.5 then 'TRAVEL' end def0,
      (engine_rpm > 0 and engine_rpm < 1000 and hydraulic_pressure_bar < 50 and speed_kmh < 0.5 and not cycle_completed) idle
    from env window w as (partition by machine_id order by seq)""",
)
cte(
    "st2",
    """select *, coalesce(last_value(def ignore nulls) over w, 'OFF') state from (select *, coalesce(def0, case when run >= 5 then 'IDLE' end) def from (
      select *, case when idle then rn - coalesce(max(case when not idle then rn end) over w, 0) else 0 end run from st1
      window w as (partition by machine_id order by seq)))
    window w as (partition by machine_id order by seq rows between unbounded preceding and current row)""",
)
cte(
    "st",
    """select *, case when state = 'IDLE' then rn - coalesce(max(case when state <> 'IDLE' then rn end) over (partition by machine_id order by seq), 0) else 0 end idle_ticks from st2""",
)
cte(
    "hot",
    f"""select *, {uuid5_sql("'hot:'||machine_id||':'||frame_seq||':'||type||':'||coalesce(zone, metric, '')")} event_id,
      case type when 'SEATBELT_VIOLATION' then 25e0 when 'PROXIMITY_BREACH' then case when zone = 'RED' then 30e0 else 10e0 end
        when 'OVERSPEED_CONDITION' then 15e0 else 10e0 end * mult added,
      row_number() over (partition by machine_id, frame_seq order by ord) - 1 pos from (
      select machine_id, operator_id, site_id, ts, seq frame_seq, mult, 1 ord, 'SEATBELT_VIOLATION' type, case when state = 'IDLE' then 'WARNING' else 'CRITICAL' end severity,
        cast(null as varchar) zone, cast(null as varchar) metric, cast(null as double) value, cast(null as double) threshold, state, 'safety@1.0' source_engine from st
        where seatbelt = 'UNFASTENED' and (state in ('TRAVEL','WORKING') or (state = 'IDLE' and idle_ticks > 10))
      union all select machine_id, operator_id, site_id, ts, seq, mult, 2, 'PROXIMITY_BREACH', case when prox_distance_m < red_radius_m or prox_zone = 'RED' then 'CRITICAL' else 'WARNING' end,
        case when prox_distance_m < red_radius_m or prox_zone = 'RED' then 'RED' else 'ORANGE' end, null, prox_distance_m,
        case when prox_distance_m < red_radius_m or prox_zone = 'RED' then red_radius_m else orange_radius_m end, null, 'safety@1.0' from st
        where prox_distance_m is not null and (prox_distance_m < orange_radius_m or prox_zone in ('RED','ORANGE'))
      union all select machine_id, operator_id, site_id, ts, seq, mult, 3, 'OVERSPEED_CONDITION', 'WARNING', null, null, speed_kmh, speed_cap_kmh, null, 'safety@1.0' from st
        where state = 'TRAVEL' and speed_kmh > speed_cap_kmh
      union all select machine_id, operator_id, site_id, ts, seq, mult, 4, 'HEALTH_THRESHOLD', 'CRITICAL', null, 'engine_temp_c', engine_temp_c, 105e0, null, 'health@1.0' from st where engine_temp_c > 105
      union all select machine_id, operator_id, site_id, ts, seq, mult, 5, 'HEALTH_THRESHOLD', 'WARNING', null, 'hydraulic_pressure_bar', hydraulic_pressure_bar, 320e0, null, 'health@1.0' from st where hydraulic_pressure_bar > 320)""",
)
# frame by frame, as the rule is stated
cte("risk_in", "select machine_id, seq, ts, rn, state, coalesce((select sum(added) from hot h where h.machine_id = st.machine_id and h.frame_seq = st.seq), 0e0) a from st")
cte(
    "risk_fold",
    """/*recursive*/ select machine_id, rn, least(100e0, a) risk_score, case when least(100e0, a) >= 60 then 'HIGH' when least(100e0, a) >= 30 then 'ELEVATED' else 'NORMAL' end risk_level
      from risk_in where rn = 1
    union all select machine_id, rn, x, case risk_level when 'NORMAL' then case when x >= 60 then 'HIGH' when x >= 30 then 'ELEVATED' else 'NORMAL' end
        when 'ELEVATED' then case when x >= 60 then 'HIGH' when x < 20 then 'NORMAL' else 'ELEVATED' end
        else case when x < 20 then 'NORMAL' when x < 45 then 'ELEVATED' else 'HIGH' end end
      from (select r.machine_id, i.rn, least(100e0, r.risk_score * exp(-0.69314718056e0 / 300) + i.a) x, r.risk_level
        from risk_fold r join risk_in i on i.machine_id = r.machine_id and i.rn = r.rn + 1)""",
)
cte("risk_rows", "select i.machine_id, i.seq, i.ts, i.state, f.risk_score, f.risk_level from risk_in i join risk_fold f on f.machine_id = i.machine_id and f.rn = i.rn")
cte(
    "alert1",
    """select *, row_number() over (partition by machine_id, type, zz, sess order by ts, frame_seq, pos) alert_count, first_value(ts) over (partition by machine_id, type, zz, sess order by ts, frame_seq, pos) alert_first_ts
    from (select *, sum(case when gap is null or gap > 30 then 1 else 0 end) over (partition by machine_id, type, zz order by ts, frame_seq, pos) sess
    from (select *, epoch(ts) - epoch(lag(ts) over (partition by machine_id, type, zz order by ts, frame_seq, pos)) gap from (select *, coalesce(zone, '') zz from hot)))""",
)
cte(
    "alert2",
    """select *, case when alert_count = 1 then true when out_severity = 'CRITICAL' then gap >= 5 else persistent and gap >= 10 end emit from (
      select *, case when persistent and severity = 'WARNING' then 'CRITICAL' when persistent and severity = 'INFO' then 'WARNING' else severity end out_severity
      from (select *, alert_count > 1 and (alert_count >= 3 or epoch(ts) - epoch(alert_first_ts) >= 15) persistent from alert1))""",
)


# --- queries -----------------------------------------------------------------

@query("s1_envelope", "select machine_id, seq, conditions, mult condition_multiplier, red_radius_m, orange_radius_m, speed_cap_kmh from env")
def _(p):
    d = states.with_envelope(states.with_context(p.t("frames"), p.t("context")))
    return d.select("machine_id", "seq", "conditions", "condition_multiplier", "red_radius_m", "orange_radius_m", "speed_cap_kmh")


@query(
    "s2_envelope_changes",
    """select machine_id, seq, conditions from (select machine_id, seq, conditions, coalesce(lag(conditions) over (partition by machine_id order by seq), '') p from env) where p <> conditions""",
)
def _(p):
    return states.envelope_changes(p.t("enveloped"), p.cfg).select("machine_id", "seq", "conditions")


@query("s3_machine_state", "select machine_id, seq, state from st")
def _(p):
    return states.machine_states(p.t("enveloped"), p.cfg).select("machine_id", "seq", "state")


@query("s4_idle_ticks", "select machine_id, seq, idle_ticks from st where state = 'IDLE'")
def _(p):
    return states.machine_states(p.t("enveloped"), p.cfg).where("state = 'IDLE'").select("machine_id", "seq", "idle_ticks")


@query("s5_ui_mode", "select machine_id, seq, case when state = 'IDLE' and idle_ticks >= 30 then 'IDLE_HUB' else 'HUD' end ui_mode from st")
def _(p):
    return states.with_ui_mode(p.t("states"), p.cfg).select("machine_id", "seq", "ui_mode")


@query(
    "s5_idle_hub_edges",
    """select machine_id, seq, operator_id from (select *, coalesce(lag(m) over (partition by machine_id order by seq), 'HUD') pm from (
      select *, case when state = 'IDLE' and idle_ticks >= 30 then 'IDLE_HUB' else 'HUD' end m from st)) where m = 'IDLE_HUB' and pm <> 'IDLE_HUB'""",
)
def _(p):
    return states.idle_hub_edges(p.t("states"), p.cfg).select("machine_id", "seq", "operator_id")


_EVENT_COLS = ["machine_id", "frame_seq", "type", "severity", "zone", "metric", "event_id", "pos"]
_EVENT_SQL = "select machine_id, frame_seq, type, severity, zone, metric, event_id, cast(pos as int) pos from hot"


def _events(p, where: str):
    return safety.explode_events(safety.frame_events(p.t("states"), p.cfg)).where(where).select(*_EVENT_COLS)


for _name, _cond in (
    ("s6_seatbelt", "type = 'SEATBELT_VIOLATION'"), ("s7_proximity", "type = 'PROXIMITY_BREACH'"),
    ("s8_overspeed", "type = 'OVERSPEED_CONDITION'"), ("s9_health", "type = 'HEALTH_THRESHOLD'"),
):
    query(_name, f"{_EVENT_SQL} where {_cond}")(lambda p, cond=_cond: _events(p, cond))


@query("s10_event_fan_out", _EVENT_SQL)
def _(p):
    return _events(p, "true")


@query("s11_risk", "select machine_id, seq, round(risk_score, 6) risk_score from risk_rows")
def _(p):
    return risk.risk_trajectory(p.t("frame_events"), "frame", p.cfg).select("machine_id", "seq", r("risk_score", 6))


@query("s12_risk_level", "select machine_id, seq, risk_level from risk_rows")
def _(p):
    return risk.risk_levels(p.t("risk"), p.cfg).select("machine_id", "seq", "risk_level")


@query("s13_alert_windows", "select event_id, cast(alert_count as bigint) alert_count, cast(epoch(alert_first_ts) as bigint) first_s, gap gap_s from alert1")
def _(p):
    d = alerts.alert_windows(p.t("hot_events"), p.cfg)
    return d.select("event_id", F.col("alert_count").cast("long").alias("alert_count"), F.unix_seconds("alert_first_ts").alias("first_s"), F.col("alert_gap_s").alias("gap_s"))


@query("s14_persistence", "select event_id, persistent, out_severity from alert2")
def _(p):
    return alerts.decide_alerts(alerts.alert_windows(p.t("hot_events"), p.cfg)).select("event_id", "persistent", "out_severity")


@query("s15_repeat_limiter", "select event_id, out_severity, cast(alert_count as bigint) alert_count from alert2 where emit")
def _(p):
    d = alerts.decide_alerts(alerts.alert_windows(p.t("hot_events"), p.cfg)).where("emit")
    return d.select("event_id", "out_severity", F.col("alert_count").cast("long").alias("alert_count"))


@query(
    "s16_flood_guard",
    """select event_id, case when n > 2 then 'Flood: ' || (n - 1) || ' other alerts suppressed' end flood_warning from (select *, count(*) over w n,
      row_number() over (partition by machine_id, cast(floor(epoch(ts) / 10) as bigint) order by case out_severity when 'CRITICAL' then 2 when 'WARNING' then 1 else 0 end desc, ts, frame_seq, pos) rk
      from alert2 where emit window w as (partition by machine_id, cast(floor(epoch(ts) / 10) as bigint))) where n <= 2 or rk = 1""",
)
def _(p):
    cfg = replace(p.cfg, flood_threshold=2, flood_width_s=10)
    return alerts.flood_guard(p.t("alert_windows"), cfg).select("event_id", "flood_warning")


@query("s17_state_log", "select cast(epoch(ts) as bigint) ts_s, machine_id, state, round(risk_score, 1) risk_score, risk_level, seq frame_seq from risk_rows")
def _(p):
    d = states.state_log(p.t("risk_levels"))
    return d.select(F.unix_seconds("ts").alias("ts_s"), "machine_id", "state", r("risk_score", 1), "risk_level", "frame_seq")


@query(
    "s17_state_changes",
    "select machine_id, seq, state, previous_state from (select *, lag(state) over (partition by machine_id order by seq) previous_state from st) where previous_state is distinct from state",
)
def _(p):
    return states.state_changes(p.t("states"), p.cfg).select("machine_id", "seq", "state", "previous_state")


@query("s18_alert_kpi", "select type, count(*) raw, count(*) filter (emit) delivered, count(*) filter (not emit) suppressed from alert2 group by type")
def _(p):
    return alerts.alert_kpi(alerts.decide_alerts(alerts.alert_windows(p.t("hot_events"), p.cfg)))


@query(
    "a8_change_feed",
    """select type, machine_id, count(*) n, max(cast(epoch(ts) as bigint)) last_s from (select 'state_change' type, machine_id, ts from st
      union all select 'alert', machine_id, ts from alert2 where emit) group by all""",
)
def _(p):
    feed = sinks.change_feed(p.t("risk_levels"), "state_change", F.struct("state", "risk_level", F.round("risk_score", 1).alias("risk_score"), "seq"))
    feed = feed.unionByName(sinks.change_feed(p.t("alert_windows").where("emit"), "alert", F.struct("event_id", "type", F.col("out_severity").alias("severity"), F.col("alert_count").alias("count"), "action_hint")))
    return feed.groupBy("type", "machine_id").agg(F.count("*").alias("n"), F.max(F.unix_seconds("ts")).alias("last_s"))
