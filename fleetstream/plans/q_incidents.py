"""Incident and read-model queries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from fleetstream.operators import attribution, incidents, readmodels, states
from fleetstream.plans.oracle import cte
from fleetstream.plans.pipeline import stage_table
from fleetstream.plans.q_ingest import uuid5_sql
from fleetstream.plans.registry import query

SEC = F.unix_seconds


def _evidence():
    """Evidence of the event feed as a map; the reading goes under the name its type uses."""
    c = F.col
    name = (
        F.when(c("type") == "PROXIMITY_BREACH", "distance_m").when(c("type") == "OVERSPEED_CONDITION", "speed_kmh")
        .when(c("type") == "HEALTH_THRESHOLD", "value").otherwise("deviation_ratio")
    )
    m = F.create_map(F.lit("zone"), c("zone"), F.lit("metric"), c("metric"), F.lit("state"), c("state"), name, c("reading").cast("string"))
    return F.map_filter(m, lambda k, v: v.isNotNull())


@stage_table("feed")
def _feed(p):
    return p.t("event_feed").withColumn("evidence", _evidence())


@stage_table("linked_events")
def _linked_events(p):
    return incidents.link_events(p.t("feed"), p.cfg)


@stage_table("linked")
def _linked(p):
    return incidents.with_risk_level(p.t("linked_events"), p.t("risk_feed"))


@stage_table("incidents")
def _incidents(p):
    return incidents.with_task(incidents.incidents(p.t("linked")), p.t("windows"))


@stage_table("timeline")
def _timeline(p):
    return incidents.incident_timeline(p.t("linked"), p.cfg)


cte(
    "sess",
    """select *, sum(case when gap is null or gap > 300 then 1 else 0 end) over (partition by machine_id order by ts, event_id) sid, case severity when 'CRITICAL' then 2 when 'WARNING' then 1 else 0 end rk
      from (select *, epoch(ts) - epoch(lag(ts) over (partition by machine_id order by ts, event_id)) gap from event_feed)""",
)
cte("trig", "select machine_id, sid, ts tts, event_id tid, type ttype, severity tsev, rk trk, operator_id top_, site_id tsite from sess where rk >= 1 qualify row_number() over (partition by machine_id, sid order by ts, event_id) = 1")
cte(
    "lnk0",
    f"""select s.*, t.* exclude (machine_id, sid), {uuid5_sql("'incident:'||s.machine_id||':'||tid")} incident_id,
      case when s.event_id = tid then 'OPEN' when s.ts > tts or (s.ts = tts and s.event_id > tid) then 'EXTEND' when s.ts < tts and epoch(s.ts) >= epoch(tts) - 300 then 'LOOKBACK' end role
      from sess s join trig t on s.machine_id = t.machine_id and s.sid = t.sid""",
)
cte(
    "lnk",
    "select l.*, coalesce(r.risk_level, 'NORMAL') risk_level from (select * from lnk0 where role is not null) l asof left join risk_feed r on l.machine_id = r.machine_id and l.ts >= r.ts",
)
cte(
    "inc",
    """select incident_id, machine_id, any_value(tsite) site_id, any_value(top_) operator_id, arg_min(type, (-rk, ts, event_id)) filter (role <> 'LOOKBACK') category,
      case max(rk) when 2 then 'CRITICAL' else 'WARNING' end severity, coalesce(bool_or(role = 'EXTEND' and (rk > trk or risk_level = 'HIGH')), false) escalated,
      any_value(tts) opened_at, max(ts) last_event_at, any_value(tid) trigger_event_id, any_value(tsev) opened_severity, count(*) event_count,
      min((ts, event_id)) filter (role = 'EXTEND' and rk > trk) rise_at, min((ts, event_id)) filter (role = 'EXTEND' and risk_level = 'HIGH') high_at,
      max(case when role = 'OPEN' then risk_level end) risk_level_at_open
      from lnk group by incident_id, machine_id""",
)
cte(
    "inc_task",
    "select i.*, f.task_id from inc i asof left join (select machine_id, make_timestamp(ws * 1000000) wts, task_id from feat) f on i.machine_id = f.machine_id and i.opened_at >= f.wts",
)
cte(
    "esc",
    """select incident_id, machine_id, rise_at[1] ts, rise_at[2] event_id, severity from inc where rise_at is not null
      union all select incident_id, machine_id, high_at[1], high_at[2], opened_severity from inc where high_at is not null and (rise_at is null or high_at < rise_at)""",
)
cte(
    "summed",
    """select *, type || ':' || coalesce(zone, metric, '') entry_key, case type when 'SEATBELT_VIOLATION' then 'Seatbelt unfastened while ' || coalesce(state, 'operating')
      when 'PROXIMITY_BREACH' then 'Proximity breach in ' || coalesce(zone, 'unknown') || ' zone at ' || reading || 'm'
      when 'OVERSPEED_CONDITION' then 'Overspeed: ' || reading || ' km/h (cap ?)' when 'HEALTH_THRESHOLD' then coalesce(metric, 'health metric') || ' threshold breached: ' || reading
      else 'Idle time above expected for context (×' || reading || ')' end summary from lnk""",
)
cte(
    "tl",
    """select incident_id, entry_key, min(ts) first_ts, max(ts) last_ts, count(*) AS count, arg_min(event_id, (ts, event_id)) representative_event_id, arg_min(summary, (ts, event_id)) summary,
      arg_min(severity, (ts, event_id)) severity, arg_min(type, (ts, event_id)) event_type from (
      select *, sum(case when g is null or g > 30 then 1 else 0 end) over (partition by incident_id, entry_key order by ts, event_id) e from (
      select *, epoch(ts) - epoch(lag(ts) over (partition by incident_id, entry_key order by ts, event_id)) g from summed)) group by incident_id, entry_key, e""",
)

_LINK = ["incident_id", "event_id", "role"]


@query("c1_decide", "select e.event_id, coalesce(l.role, 'IGNORE_INFO') AS action from event_feed e left join lnk l using (event_id)")
def _(p):
    linked = incidents.link_events(p.t("feed"), p.cfg)
    return incidents.decide(p.t("feed"), linked).select("event_id", "action")


@query("c2_active_extensions", "select incident_id, event_id from lnk where role = 'EXTEND'")
def _(p):
    return incidents.link_events(p.t("feed"), p.cfg).where("role = 'EXTEND'").select("incident_id", "event_id")


@query("c3_lookback", "select incident_id, event_id from lnk where role = 'LOOKBACK'")
def _(p):
    return incidents.link_events(p.t("feed"), p.cfg).where("role = 'LOOKBACK'").select("incident_id", "event_id")


@query("c4_link_once", "select incident_id, event_id, role from lnk")
def _(p):
    twice = p.t("feed").unionByName(p.t("feed"))  # every event delivered twice
    return incidents.link_events(twice, p.cfg).select(*_LINK)


@query("c5_incidents", "select incident_id, machine_id, site_id, operator_id, category, severity, cast(epoch(opened_at) as bigint) opened_s, cast(epoch(last_event_at) as bigint) last_s, trigger_event_id, event_count from inc")
def _(p):
    return incidents.incidents(p.t("linked")).select(
        "incident_id", "machine_id", "site_id", "operator_id", "category", "severity", SEC("opened_at").alias("opened_s"), SEC("last_event_at").alias("last_s"), "trigger_event_id", "event_count"
    )


@query("c6_escalated", "select incident_id, escalated, risk_level_at_open from inc")
def _(p):
    d = incidents.with_risk_level(incidents.link_events(p.t("feed"), p.cfg), p.t("risk_feed"))
    return incidents.incidents(d).select("incident_id", "escalated", "risk_level_at_open")


@query("c6_escalations", "select incident_id, cast(epoch(ts) as bigint) ts_s, event_id, severity from esc")
def _(p):
    return incidents.escalations(p.t("incidents")).select("incident_id", SEC("ts").alias("ts_s"), "event_id", "severity")


@query("c8_timeline", "select incident_id, entry_key, cast(epoch(first_ts) as bigint) first_s, cast(epoch(last_ts) as bigint) last_s, count, representative_event_id from tl")
def _(p):
    return incidents.incident_timeline(p.t("linked"), p.cfg).select(
        "incident_id", "entry_key", SEC("first_ts").alias("first_s"), SEC("last_ts").alias("last_s"), "count", "representative_event_id"
    )


@query("c9_status_rows", "select distinct incident_id, 'status:escalated:' || strftime(ts, '%Y-%m-%dT%H:%M:%S') entry_key, severity, 'Escalated to ' || severity summary from esc")
def _(p):
    return incidents.status_rows(incidents.escalation_steps(incidents.escalations(p.t("incidents")))).select("incident_id", "entry_key", "severity", "summary")


@query("c10_summaries", "select event_id, summary from summed")
def _(p):
    return p.t("linked").select("event_id", incidents.summary_text().alias("summary"))


_AS_OF = datetime(2026, 1, 1, 6, 0, tzinfo=timezone.utc)


@query(
    "j8_unlinked",
    """select event_id from event_feed e where severity <> 'INFO' and ts <= timestamp '2026-01-01 06:00:00' and epoch(ts) >= epoch(timestamp '2026-01-01 06:00:00') - 900
      and not exists (select 1 from lnk l where l.event_id = e.event_id and l.ts <= timestamp '2026-01-01 05:50:00')""",
)
def _(p):
    stored = p.t("linked").where(F.col("ts") <= F.lit("2026-01-01 05:50:00").cast("timestamp"))
    return incidents.unlinked(p.t("feed"), stored, F.lit(_AS_OF).cast("timestamp"), p.cfg).select("event_id")


_STORED = "2026-01-01 05:50:00"


@stage_table("sessions_stored")
def _sessions_stored(p):
    """What earlier passes left behind: sessions of the events up to the stored time."""
    return incidents.sessions_of(p.t("feed").where(F.col("ts") <= F.lit(_STORED).cast("timestamp")), p.cfg)


@query("c12_reconcile", """select event_id, incident_id from lnk where severity <> 'INFO' and ts <= timestamp '2026-01-01 06:00:00' and ts > timestamp '2026-01-01 05:50:00'""")
def _(p):
    stored = p.t("linked").where(F.col("ts") <= F.lit(_STORED).cast("timestamp"))
    missed, _after = incidents.reconcile(p.t("feed"), stored, p.t("sessions_stored"), F.lit(_AS_OF).cast("timestamp"), p.cfg)
    return missed.where("severity <> 'INFO'").select("event_id", "incident_id")


# a quarter of the events come late: they extend, open and bridge sessions of the others
_LATE = "frame_seq % 4 = 1"


@stage_table("sessions_early")
def _sessions_early(p):
    return incidents.sessions_of(p.t("feed").where(f"not ({_LATE})"), p.cfg)


@stage_table("sessions_late")
def _sessions_late(p):
    return incidents.advance_sessions(p.t("sessions_early"), p.t("feed").where(_LATE), p.cfg)


cte("sess_rows", "select machine_id, min(ts) fts, max(ts) lts, arg_min(event_id, (ts, event_id)) filter (rk >= 1) tid from sess group by machine_id, sid")
cte(
    "early_rows",
    """select machine_id, min(ts) fts, arg_min(event_id, (ts, event_id)) filter (severity <> 'INFO') tid from (
      select *, sum(case when gap is null or gap > 300 then 1 else 0 end) over (partition by machine_id order by ts, event_id) sid from (
      select *, epoch(ts) - epoch(lag(ts) over (partition by machine_id order by ts, event_id)) gap from event_feed where not (frame_seq % 4 = 1))) group by machine_id, sid""",
)


@query("c12_late_sessions", "select machine_id, cast(epoch(fts) as bigint) first_s, cast(epoch(lts) as bigint) last_s, tid trigger_event_id from sess_rows")
def _(p):
    return p.t("sessions_late").select("machine_id", SEC("first_ts").alias("first_s"), SEC("last_ts").alias("last_s"), F.col("trigger")["event_id"].alias("trigger_event_id"))


@query("c12_late_links", "select event_id, incident_id, role from lnk where frame_seq % 4 = 1")
def _(p):
    return incidents.link_to_sessions(p.t("feed").where(_LATE), p.t("sessions_late"), p.cfg).select("event_id", "incident_id", "role")


@query(
    "c12_superseded",
    f"""select o.machine_id, {uuid5_sql("'incident:'||o.machine_id||':'||o.tid")} old_incident_id, {uuid5_sql("'incident:'||n.machine_id||':'||n.tid")} incident_id
      from early_rows o join sess_rows n on o.machine_id = n.machine_id and o.fts between n.fts and n.lts where o.tid is not null and o.tid <> n.tid""",
)
def _(p):
    return incidents.superseded(p.t("sessions_early"), p.t("sessions_late"), p.cfg)


@query("c13_work_feed", "select incident_id, 'opened' reason, cast(epoch(opened_at) as bigint) ts_s from inc union all select incident_id, 'escalated', cast(epoch(ts) as bigint) from esc")
def _(p):
    return incidents.work_feed(p.t("incidents")).select("incident_id", "reason", SEC("ts").alias("ts_s"))


# --- read models -------------------------------------------------------------

@query(
    "j7_scope",
    """select 'SUPERVISOR' as role, incident_id from inc where site_id in (select site_id from user_sites where user_id = 'SUP3') union all select 'OPERATOR', incident_id from inc where operator_id = 'OP4'
      union all select 'ADMIN', incident_id from inc""",
)
def _(p):
    parts = [
        readmodels.scope(p.t("incidents"), u, role, p.t("user_sites")).select(F.lit(role).alias("role"), "incident_id")
        for u, role in (("SUP3", "SUPERVISOR"), ("OP4", "OPERATOR"), ("ADM0", "ADMIN"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SINCE = datetime(2026, 1, 1, 1, 0, tzinfo=timezone.utc)
_R1 = "from inc where site_id in (select site_id from user_sites where user_id = 'SUP3') and opened_at >= timestamp '2026-01-01 01:00:00'"


def _r1(p):
    d = readmodels.scope(p.t("incidents"), "SUP3", "SUPERVISOR", p.t("user_sites"))
    return readmodels.filter_incidents(d, status="OPEN", since=_SINCE)


@query("r1_incident_list", f"select incident_id, machine_id, severity, cast(epoch(opened_at) as bigint) opened_s {_R1} order by opened_at desc, incident_id limit 50 offset 10")
def _(p):
    return readmodels.page(_r1(p), 50, 10).select("incident_id", "machine_id", "severity", SEC("opened_at").alias("opened_s"))


@query("r1_incident_total", f"select count(*) total {_R1}")
def _(p):
    return _r1(p).agg(F.count("*").alias("total"))


@query("r3_timeline_events", "select t.incident_id, t.entry_key, cast(epoch(t.first_ts) as bigint) first_s, e.event_id, e.severity event_severity from tl t left join event_feed e on e.event_id = t.representative_event_id")
def _(p):
    d = readmodels.timeline_view(p.t("timeline"), p.t("feed"))
    return d.select("incident_id", "entry_key", SEC("first_ts").alias("first_s"), F.col("representative_event_id").alias("event_id"), "event_severity")


@query("j10_representative_events", "select t.incident_id, t.entry_key, cast(epoch(t.first_ts) as bigint) first_s, cast(epoch(e.ts) as bigint) event_s from tl t join event_feed e on e.event_id = t.representative_event_id")
def _(p):
    d = readmodels.timeline_view(p.t("timeline"), p.t("feed"))
    return d.select("incident_id", "entry_key", SEC("first_ts").alias("first_s"), SEC("event_ts").alias("event_s"))


_SNAP = datetime(2026, 1, 1, 0, 10, 5, tzinfo=timezone.utc)


@query(
    "r4_fleet_snapshot",
    """with hotl as (select machine_id, arg_max(state, seq) state, arg_max(risk_level, seq) risk_level, max(ts) hts from risk_rows where ts <= timestamp '2026-01-01 00:10:05' group by machine_id),
      rec as (select machine_id, string_agg(event_id, ',' order by ts desc, event_id) ids from (select *, row_number() over (partition by machine_id order by ts desc, event_id) rk from hot
        where ts <= timestamp '2026-01-01 00:10:05' and epoch(ts) >= epoch(timestamp '2026-01-01 00:10:05') - 60 and severity <> 'INFO') where rk <= 10 group by machine_id),
      win as (select machine_id, arg_max(f.window_id, f.ws) window_id, arg_max(coalesce(a.primary_cause, '-'), f.ws) cause from feat f left join (select window_id, primary_cause from attr) a using (window_id)
        where f.ws + 30 <= epoch(timestamp '2026-01-01 00:10:05') group by machine_id),
      op as (select machine_id, string_agg(incident_id, ',' order by last_event_at desc, incident_id) ids from (select *, row_number() over (partition by machine_id order by last_event_at desc, incident_id) rk from inc
        where opened_at <= timestamp '2026-01-01 00:10:05') where rk <= 5 group by machine_id)
      select m.machine_id, h.state, h.risk_level, epoch(timestamp '2026-01-01 00:10:05') - epoch(h.hts) > 10 stale, rec.ids recent_events, win.window_id, win.cause primary_cause, op.ids open_incidents
      from machines m left join hotl h using (machine_id) left join rec using (machine_id) left join win using (machine_id) left join op using (machine_id)""".replace("with hotl as", "select * from (with hotl as") + ")",
)
def _(p):
    keep = ["machine_id", "seq", "conditions", "speed_cap_kmh", "red_radius_m", "weather"]
    live = states.with_ui_mode(p.t("risk_levels"), p.cfg).join(p.t("enveloped").select(*keep), ["machine_id", "seq"])
    win = p.t("windows").join(p.t("attributed").select("window_id", "primary_cause"), "window_id", "left").withColumn("primary_cause", F.coalesce("primary_cause", F.lit("-")))
    eta = p.t("tasks").select("task_id", F.lit("BASELINE").alias("eta_status"))
    d = readmodels.fleet_snapshot(p.t("machines"), live, p.t("hot_events"), win, eta, p.t("incidents"), _SNAP, p.cfg)
    return d.select(
        "machine_id", "state", "risk_level", "stale", F.array_join("recent_events", ",").alias("recent_events"), "window_id", "primary_cause",
        F.array_join("open_incidents", ",").alias("open_incidents"),
    )


@query("r5_window_history", "select window_id, machine_id, frame_count, primary_cause from (select f.*, a.primary_cause, row_number() over (partition by f.machine_id order by f.ws desc) rk from feat f left join (select window_id, primary_cause from attr) a using (window_id)) where rk <= 20")
def _(p):
    return readmodels.window_history(p.t("windows"), p.t("attributed"), 20).select("window_id", "machine_id", "frame_count", "primary_cause")


@query("r5_cause_totals", "select cause, sum(s) AS seconds from (select unnest(['PLANNED','MACHINE','WEATHER','SITE','OPERATOR']) cause, unnest([s_planned, s_machine, s_weather, s_site, s_operator]) s from (select *, row_number() over (partition by machine_id order by ws desc) rk from attr) where rk <= 20) group by cause")
def _(p):
    return attribution.recent_cause_totals(p.t("attributed"), 20).groupBy("cause").agg(F.sum("seconds").alias("seconds"))


@query("r6_operator_tasks", "select operator_id, count(*) tasks, count(*) filter (status = 'ACTIVE') active, sum(est_duration_minutes) AS minutes from tasks group by operator_id")
def _(p):
    return readmodels.operator_tasks(p.t("tasks"))


@query("r6_site_tasks", "select task_id, site_id, status, est_duration_minutes from tasks where site_id in (select site_id from user_sites where user_id = 'SUP3')")
def _(p):
    return readmodels.scope(p.t("tasks"), "SUP3", "SUPERVISOR", p.t("user_sites")).select("task_id", "site_id", "status", "est_duration_minutes")


@query("r8_site_overview", "select site_id, coalesce(m, 0) machines, coalesce(i, 0) open_incidents from (select site_id, count(distinct machine_id) m from machines group by 1) full join (select site_id, count(*) i from inc group by 1) using (site_id)")
def _(p):
    return readmodels.site_overview(p.t("machines"), p.t("incidents"))


@query(
    "r9_latest_view",
    """with f as (select machine_id, 'alert' AS type, event_id item, ts, severity = 'INFO' closed, event_id pos from event_feed where type <> 'IDLE_DEVIATION'),
      al as (select * from (select *, row_number() over (partition by machine_id order by ts desc, pos desc) rk from f where not closed) where rk <= 3),
      iv as (select machine_id, arg_max(event_id, (ts, event_id)) v from event_feed where type = 'IDLE_DEVIATION' group by machine_id)
      select machine_id, 'alert' AS type, item payload from al union all select machine_id, 'idle_attribution', v from iv""".replace("with f as", "select * from (with f as") + ")",
)
def _(p):
    c = F.col
    feed = p.t("feed").select(
        "machine_id", F.when(c("type") == "IDLE_DEVIATION", "idle_attribution").when(c("severity") == "INFO", "alert_clear").otherwise("alert").alias("type"),
        "ts", c("event_id").alias("pos"), c("event_id").alias("item_id"), c("event_id").alias("payload"), (c("severity") == "INFO").alias("closed"),
    )
    return readmodels.latest_view(feed).select("machine_id", "type", "payload")
