"""Window feature, idle attribution and baseline queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetstream.config import WINDOW_FEATURES
from fleetstream.operators import attribution, baselines, windows
from fleetstream.plans.oracle import cte
from fleetstream.plans.pipeline import stage_table
from fleetstream.plans.q_ingest import uuid5_sql
from fleetstream.plans.q_safety import r
from fleetstream.plans.registry import query

SEC = F.unix_seconds


# --- stages ------------------------------------------------------------------

@stage_table("windows")
def _windows(p):
    d = windows.minimal_rows(windows.window_features(p.t("frames"), p.cfg), p.cfg)
    d = windows.with_alert_counts(d, p.t("hot_events"), p.cfg)
    return windows.with_window_context(d, p.t("context"))


@stage_table("causes")
def _causes(p):
    d = attribution.idle_causes(p.t("frames"), p.t("context"), p.t("hot_events"), p.cfg)
    # what readers of causes use: other columns of a frame need not go through the join with faults
    return d.select("machine_id", "seq", "ts", "window_start", "window_end", "hydraulic_pressure_bar", "speed_kmh", "cause")


@stage_table("attributed")
def _attributed(p):
    return attribution.attribute_idle(p.t("causes"), p.cfg)


@stage_table("idle_baselines")
def _idle_baselines(p):
    return baselines.idle_baselines(_train(p), p.cfg)


@stage_table("window_context")
def _window_context(p):
    """Windows with the keys of the baseline lookup."""
    c = F.col
    d = p.t("windows").join(p.t("attributed").drop("machine_id", "window_start", "window_end", "frame_count"), "window_id", "left")
    tasks = p.t("tasks").select("task_id", c("task_type").alias("__tt"))
    users = p.t("users").where("role = 'OPERATOR'").select(c("user_id").alias("operator_id"), "skill_level")
    d = d.join(tasks, "task_id", "left").join(users, "operator_id", "left")
    return d.withColumns({
        "task_type": F.coalesce("__tt", F.lit("NONE")), "operator_skill": F.coalesce("skill_level", F.lit("INTERMEDIATE")),
        "weather": F.coalesce("weather", F.lit("SUNNY")),
    }).drop("__tt", "skill_level")


@stage_table("deviations")
def _deviations(p):
    d = attribution.deviation(attribution.backoff(p.t("window_context"), p.t("idle_baselines"), p.cfg), p.cfg)
    return attribution.persistence(d, p.cfg)


def _hist(p):
    return p.t("hist_windows").withColumn("split", baselines.time_split(F.col("dd"), 60)).withColumn(
        "task_type", F.coalesce(F.nullif(F.col("task_type"), F.lit("")), F.lit("NONE"))
    )


def _train(p):
    return _hist(p).where("split = 'train'")


# --- SQL ---------------------------------------------------------------------

cte("fw", "select *, cast(floor(epoch(ts) / 30) * 30 as bigint) ws, row_number() over (partition by machine_id, floor(epoch(ts) / 30) order by seq) - 1 i from frames")
cte(
    "fw2",
    """select *, case when cycle_completed then i - max(case when cycle_completed then i end) over (partition by machine_id, ws order by seq rows between unbounded preceding and 1 preceding) end since from fw""",
)
cte(
    "feat",
    """select *, case when cycle_count >= 2 then ct end cycle_time_mean, case when cycle_count >= 2 and ct > 0 then cs / ct end cycle_time_cv,
      case when cycle_count >= 2 then fuel_l_total / cycle_count end fuel_per_cycle, case when frame_count >= 2 then sl else 0e0 end temp_slope from (
      select machine_id || ':' || ws window_id, machine_id, ws, count(*) frame_count, min(seq) first_seq, max(seq) last_seq, arg_max(site_id, seq) site_id,
      arg_max(operator_id, seq) operator_id, arg_max(task_id, seq) task_id, avg(engine_rpm) rpm_mean, stddev_pop(engine_rpm) rpm_std,
      quantile_cont(hydraulic_pressure_bar, 0.95) hyd_p95, avg(case when hydraulic_pressure_bar < 50 and speed_kmh < 0.5 then 1e0 else 0e0 end) idle_ratio,
      avg(case when hydraulic_pressure_bar >= 120 then 1e0 else 0e0 end) working_ratio, avg(case when truck_present then 1e0 else 0e0 end) truck_present_ratio,
      avg(cast(hauler_queue_len as double)) hauler_queue_mean, sum(fuel_rate_lph) / 3600e0 fuel_l_total, count(*) filter (cycle_completed) cycle_count,
      avg(cast(since as double)) ct, stddev_pop(cast(since as double)) cs, case when count(*) >= 2 then regr_slope(engine_temp_c, i / 60e0) end sl from fw2 group by machine_id, ws)""",
)
cte("ctx_sec", "select site_id, ts, weather, rainfall_mm_h, visibility_m, ambient_temp_c, wind_kmh, ground, daylight from context")
cte(
    "feat_ctx",
    """select f.*, c.weather, c.rainfall_mm_h, c.visibility_m, c.ambient_temp_c, c.wind_kmh, c.ground, c.daylight
      from (select *, make_timestamp((ws + 30) * 1000000) we from feat) f asof left join ctx_sec c on f.site_id = c.site_id and f.we >= c.ts""",
)
cte("faults", "select distinct machine_id, ts fault_ts from hot where type = 'HEALTH_THRESHOLD'")
cte("fw_fault", "select f.*, coalesce(epoch(f.ts) - epoch(h.fault_ts) <= 120, false) fault_active from fw f asof left join faults h on f.machine_id = h.machine_id and f.ts >= h.fault_ts")
cte(
    "fw_ctx",
    """select f.*, c.weather, c.rainfall_mm_h, c.visibility_m, c.wind_kmh, c.ground from (select *, make_timestamp((ws + 30) * 1000000) we from fw_fault) f
      asof left join ctx_sec c on f.site_id = c.site_id and f.we >= c.ts""",
)
cte(
    "causes_sql",
    """select *, case when strftime(ts, '%H:%M') >= '00:03' and strftime(ts, '%H:%M') < '00:05' or strftime(ts, '%H:%M') >= '00:08' and strftime(ts, '%H:%M') < '00:09' then 'PLANNED'
      when fault_active or engine_temp_c > 105 or hydraulic_pressure_bar > 320 then 'MACHINE'
      when coalesce(rainfall_mm_h >= 20, false) or coalesce(visibility_m < 50, false) or coalesce(wind_kmh >= 60, false) or coalesce(ground = 'ICY', false) then 'WEATHER'
      when not truck_present or hauler_queue_len = 0 then 'SITE' else 'OPERATOR' end cause from fw_ctx""",
)
cte(
    "attr",
    """select *, case greatest(s_planned, s_machine, s_weather, s_site, s_operator) when s_planned then 'PLANNED' when s_machine then 'MACHINE' when s_weather then 'WEATHER'
      when s_site then 'SITE' else 'OPERATOR' end primary_cause, round(s_operator / (s_planned + s_machine + s_weather + s_site + s_operator), 4) operator_idle_ratio from (
      select machine_id || ':' || ws window_id, machine_id, ws, count(*) frame_count, count(*) filter (cause = 'PLANNED') * 1e0 s_planned, count(*) filter (cause = 'MACHINE') * 1e0 s_machine,
        count(*) filter (cause = 'WEATHER') * 1e0 s_weather, count(*) filter (cause = 'SITE') * 1e0 s_site, count(*) filter (cause = 'OPERATOR') * 1e0 s_operator
      from causes_sql group by machine_id, ws having count(*) >= 20)""",
)
cte("hist_split", "select * replace (case when task_type = '' then 'NONE' else task_type end as task_type), case when dd < 42 then 'train' when dd < 48 then 'val' else 'test' end split from hist_windows")
cte(
    "idle_train",
    """select *, idle_s_operator / window_s oir from hist_split where split = 'train' and idle_s_planned + idle_s_machine + idle_s_weather + idle_s_site + idle_s_operator > 0""",
)
cte(
    "idle_lv",
    """select 'operator_context' level, operator_id || '||' || task_type || '||' || weather || '||' || operator_skill key, dd, window_id, oir from idle_train
      union all select 'skill_context', operator_skill || '||' || task_type || '||' || weather, dd, window_id, oir from idle_train
      union all select 'task_type', task_type, dd, window_id, oir from idle_train union all select 'global', 'global', dd, window_id, oir from idle_train""",
)
cte(
    "ewma_sql",
    """select level, key, sum(case when back = n then pow(0.9e0, back - 1) else 0.1e0 * pow(0.9e0, back - 1) end * oir) ewma from (
      select *, row_number() over (partition by level, key order by dd desc, window_id desc) back, count(*) over (partition by level, key) n from idle_lv) group by all""",
)
cte(
    "base_sql",
    """select level, key, n, round(ewma, 4) ewma, round(median, 4) median, round(mad, 4) mad from
      (select level, key, count(*) n, median(oir) median, median(abs(oir - m)) mad from (select *, median(oir) over (partition by level, key) m from idle_lv) group by level, key)
      join ewma_sql using (level, key)""",
)
cte(
    "win_keys",
    """select f.*, a.s_planned, a.s_machine, a.s_weather, a.s_site, a.s_operator, a.primary_cause, a.operator_idle_ratio, coalesce(t.task_type, 'NONE') tt,
      coalesce(u.skill_level, 'INTERMEDIATE') skill, coalesce(f.weather, 'SUNNY') wx from feat_ctx f left join attr a using (window_id)
      left join tasks t on t.task_id = f.task_id left join (select user_id, skill_level from users where role = 'OPERATOR') u on u.user_id = f.operator_id""",
)
cte("base20", "select * from base_sql where n >= 20")
cte(
    "dev1",
    """select w.*, case when b1.key is not null then 'operator_context' when b2.key is not null then 'skill_context' when b3.key is not null then 'task_type' when b4.key is not null then 'global' end baseline_level,
      coalesce(b1.ewma, b2.ewma, b3.ewma, b4.ewma) be, coalesce(b1.median, b2.median, b3.median, b4.median) bm, coalesce(b1.mad, b2.mad, b3.mad, b4.mad) bd from win_keys w
      left join base20 b1 on b1.level = 'operator_context' and b1.key = operator_id || '||' || tt || '||' || wx || '||' || skill
      left join base20 b2 on b2.level = 'skill_context' and b2.key = skill || '||' || tt || '||' || wx
      left join base20 b3 on b3.level = 'task_type' and b3.key = tt left join base20 b4 on b4.level = 'global'""",
)
cte(
    "dev2",
    """select *, coalesce(ratio >= 2 and z > 2.5, false) raw_flag from (select *, operator_idle_ratio / greatest(be, 0.01e0) ratio,
      case when bd = 0 then 0e0 else (operator_idle_ratio - bm) / (1.4826e0 * bd) end z from dev1)""",
)
cte(
    "dev3",
    """select *, run >= 2 flag from (select *, case when raw_flag then rn - coalesce(max(case when not raw_flag then rn end) over (partition by machine_id order by ws), 0) else 0 end run from (
      select *, row_number() over (partition by machine_id order by ws) rn from dev2))""",
)


# --- windows -----------------------------------------------------------------

def _feat(p):
    return windows.window_features(p.t("frames"), p.cfg)


@query("w1_tumbling", "select window_id, ws start_s, frame_count from feat")
def _(p):
    return _feat(p).select("window_id", SEC("window_start").alias("start_s"), "frame_count")


@query(
    "w2_late_frames",
    """select machine_id, cast(floor(epoch(ts) / 30) * 30 as bigint) start_s, count(*) filter (late) late_frames, count(*) frames from (select *,
      coalesce(max(epoch(ts)) over (partition by machine_id order by arrival_ts, arrival_no rows between unbounded preceding and current row) >= floor(epoch(ts) / 30) * 30 + 35, false) late
      from arrivals) group by all""",
)
def _(p):
    d = windows.mark_late(p.t("arrivals"), p.cfg)
    return d.groupBy("machine_id", SEC("window_start").alias("start_s")).agg(F.count_if("late").alias("late_frames"), F.count("*").alias("frames"))


@query(
    "w3_min_frames",
    """select window_id, frame_count, case when frame_count >= 20 then round(rpm_mean, 6) end rpm_mean, case when frame_count >= 20 then cycle_count end cycle_count, frame_count >= 20 sufficient from feat""",
)
def _(p):
    return windows.minimal_rows(_feat(p), p.cfg).select("window_id", "frame_count", r("rpm_mean", 6), "cycle_count", "sufficient")


@query("w5_identity", "select window_id, first_seq, last_seq, frame_count, operator_id, task_id, site_id from feat")
def _(p):
    return _feat(p).select("window_id", "first_seq", "last_seq", "frame_count", "operator_id", "task_id", "site_id")


for _name, _cols in {
    "w6_rpm": ["rpm_mean", "rpm_std"], "w7_hyd_p95": ["hyd_p95"],
    "w8_ratios": ["idle_ratio", "working_ratio", "truck_present_ratio", "hauler_queue_mean"], "w9_fuel": ["fuel_l_total"],
    "w10_cycles": ["cycle_count", "cycle_time_mean", "cycle_time_cv", "fuel_per_cycle"], "w11_temp_slope": ["temp_slope"],
}.items():
    query(_name, "select window_id, " + ", ".join(c if c == "cycle_count" else f"round({c}, 6) + 0 {c}" for c in _cols) + " from feat")(
        lambda p, cols=_cols: _feat(p).select("window_id", *[c if c == "cycle_count" else r(c, 6) for c in cols])
    )


@query("w12_alerts_count", "select window_id, (select count(*) from hot h where h.machine_id = feat.machine_id and epoch(h.ts) >= ws and epoch(h.ts) < ws + 30) alerts_count from feat")
def _(p):
    d = windows.with_alert_counts(p.t("windows").drop("alerts_count"), p.t("hot_events"), p.cfg)
    return d.select("window_id", "alerts_count")


@query("w13_context", "select window_id, weather, rainfall_mm_h, visibility_m, ambient_temp_c, wind_kmh, ground, daylight from feat_ctx")
def _(p):
    base = p.t("windows").select("window_id", "site_id", "window_start", "window_end")
    return windows.with_window_context(base, p.t("context")).select("window_id", "weather", "rainfall_mm_h", "visibility_m", "ambient_temp_c", "wind_kmh", "ground", "daylight")


@query(
    "flagship_idle_machines",
    """select machine_id, count(*) windows, round(avg(idle_ratio), 6) idle_ratio, round(sum(fuel_l_total), 5) fuel_l, sum(cycle_count) cycles from feat where frame_count >= 20 group by machine_id""",
)
def _(p):
    d = _feat(p).where(F.col("frame_count") >= p.cfg.min_frames)
    return d.groupBy("machine_id").agg(
        F.count("*").alias("windows"), F.round(F.avg("idle_ratio"), 6).alias("idle_ratio"),
        F.round(F.sum("fuel_l_total"), 5).alias("fuel_l"), F.sum("cycle_count").alias("cycles"),
    )


# --- joins -------------------------------------------------------------------

@query(
    "j2_task_asof",
    """select h.event_id, f.task_id from hot h asof left join (select machine_id, make_timestamp(ws * 1000000) wts, task_id from feat) f on h.machine_id = f.machine_id and h.ts >= f.wts""",
)
def _(p):
    return windows.task_at(p.t("hot_events"), p.t("windows")).select("event_id", "task_id")


@query("j3_fault_active", "select machine_id, seq, fault_active from fw_fault")
def _(p):
    return attribution.fault_active(p.t("frames"), p.t("hot_events"), p.cfg).select("machine_id", "seq", "fault_active")


@query(
    "j3_fault_events",
    """select window_id, coalesce((select string_agg(event_id, ',' order by event_id) from hot h where h.machine_id = feat.machine_id and type = 'HEALTH_THRESHOLD'
      and epoch(h.ts) >= ws - 120 and epoch(h.ts) < ws + 30), '') ids from feat""",
)
def _(p):
    d = attribution.fault_event_ids(p.t("windows"), p.t("hot_events"), p.cfg)
    return d.select("window_id", F.array_join("fault_event_ids", ",").alias("ids"))


@query("j4_interval_count", "select machine_id, cast(floor(epoch(ts) / 30) * 30 as bigint) start_s, type, count(*) n from hot group by all")
def _(p):
    return windows.event_counts(p.t("hot_events"), p.cfg).select("machine_id", SEC("window_start").alias("start_s"), "type", "n")


@query("j5_lookups", "select window_id, tt task_type, skill operator_skill from win_keys")
def _(p):
    return p.t("window_context").select("window_id", "task_type", "operator_skill")


@query("j6_backoff", "select window_id, baseline_level, be baseline_ewma from dev1")
def _(p):
    return attribution.backoff(p.t("window_context"), p.t("idle_baselines"), p.cfg).select("window_id", "baseline_level", "baseline_ewma")


@query("j9_previous_window", "select window_id, lag(window_id) over w prev_window_id, lag(frame_count) over w prev_frame_count from feat window w as (partition by machine_id order by ws)")
def _(p):
    return windows.previous_window(p.t("windows"), ["window_id", "frame_count"], p.cfg).select("window_id", "prev_window_id", "prev_frame_count")


# --- attribution -------------------------------------------------------------

@query(
    "i1_planned_break",
    """select machine_id, seq from frames where strftime(ts, '%H:%M') >= '00:03' and strftime(ts, '%H:%M') < '00:05' or strftime(ts, '%H:%M') >= '00:08' and strftime(ts, '%H:%M') < '00:09'""",
)
def _(p):
    return p.t("frames").where(attribution.planned_break(F.col("ts"), p.cfg.planned_breaks)).select("machine_id", "seq")


@query("i2_weather_stop", "select site_id, cast(epoch(ts) as bigint) ts_s, rainfall_mm_h >= 20 or visibility_m < 50 or wind_kmh >= 60 or ground = 'ICY' stop from context")
def _(p):
    return p.t("context").select("site_id", SEC("ts").alias("ts_s"), attribution.weather_stop(p.cfg).alias("stop"))


@query("i3_frame_cause", "select machine_id, seq, cause from causes_sql")
def _(p):
    return attribution.idle_causes(p.t("frames"), p.t("context"), p.t("hot_events"), p.cfg).select("machine_id", "seq", "cause")


@query("i4_breakdown", "select window_id, s_planned, s_machine, s_weather, s_site, s_operator, operator_idle_ratio from attr")
def _(p):
    return attribution.attribute_idle(p.t("causes"), p.cfg).select("window_id", "s_planned", "s_machine", "s_weather", "s_site", "s_operator", "operator_idle_ratio")


@query(
    "i4_breakdown_idle_only",
    "select machine_id || ':' || ws window_id, count(*) filter (hydraulic_pressure_bar < 50 and speed_kmh < 0.5) * 1e0 idle_seconds from causes_sql group by machine_id, ws having count(*) >= 20",
)
def _(p):
    return attribution.attribute_idle(p.t("causes"), p.cfg, idle_only=True).select("window_id", "idle_seconds")


@query("i5_primary_cause", "select window_id, primary_cause from attr")
def _(p):
    return attribution.attribute_idle(p.t("causes"), p.cfg).select("window_id", "primary_cause")


@query("i6_deviation", "select window_id, baseline_level, round(ratio, 3) deviation_ratio, round(z, 3) + 0 robust_z, raw_flag from dev2")
def _(p):
    d = attribution.deviation(attribution.backoff(p.t("window_context"), p.t("idle_baselines"), p.cfg), p.cfg)
    return d.select("window_id", "baseline_level", "deviation_ratio", r("robust_z", 3), "raw_flag")


@query("i7_persistence", "select window_id, cast(run as bigint) consecutive_windows, flag operator_deviation_flag from dev3")
def _(p):
    d = attribution.deviation(attribution.backoff(p.t("window_context"), p.t("idle_baselines"), p.cfg), p.cfg)
    return attribution.persistence(d, p.cfg).select("window_id", "consecutive_windows", "operator_deviation_flag")


@query("i8_deviation_events", f"select window_id, {uuid5_sql(chr(39) + 'warm:' + chr(39) + '||window_id||' + chr(39) + ':IDLE_DEVIATION' + chr(39))} event_id, ws + 30 ts_s, last_seq frame_seq from dev3 where flag")
def _(p):
    d = attribution.idle_deviation_events(p.t("deviations"))
    return d.select(F.get_json_object("evidence", "$.window_id").alias("window_id"), "event_id", SEC("ts").alias("ts_s"), "frame_seq")


@query(
    "i9_robust_z",
    """select h.window_id, s.feature, round(case when mad = 0 then 0e0 else (h.value - median) / (1.4826e0 * mad) end, 4) + 0 z from (unpivot (select window_id, working_ratio, cycle_count, fuel_per_cycle, rpm_mean, rpm_std,
      hyd_p95, idle_ratio, cycle_time_mean, cycle_time_cv, temp_slope from feat) on fuel_per_cycle, rpm_mean, rpm_std, hyd_p95, idle_ratio, cycle_time_mean, cycle_time_cv, temp_slope into name feature value value) h
      join fstats s using (feature)""",
)
def _(p):
    from fleetstream.functions.stats import robust_z

    d = baselines.feature_rows(p.t("feature_windows"), ["window_id"]).where("value is not null").join(p.t("feature_stats"), "feature")
    return d.select("window_id", "feature", (F.round(robust_z(F.col("value"), F.col("median"), F.col("mad")), 4) + F.lit(0.0)).alias("z"))


@stage_table("feature_windows")
def _feature_windows(p):
    return _feat(p)


@query(
    "i10_cause_totals",
    """select machine_id, cause, sum(s) AS seconds from (select machine_id, unnest(['PLANNED','MACHINE','WEATHER','SITE','OPERATOR']) cause, unnest([s_planned, s_machine, s_weather, s_site, s_operator]) s from (
      select *, row_number() over (partition by machine_id order by ws desc) rk from attr) where rk <= 5) group by all""",
)
def _(p):
    return attribution.recent_cause_totals(p.t("attributed"), 5)


# --- statistics --------------------------------------------------------------

cte("elig_train", "select * from hist_split where split = 'train' and working_ratio >= 0.5 and cycle_count >= 2 and fuel_per_cycle is not null and cycle_time_mean is not null and cycle_time_cv is not null")
cte(
    "fvals",
    "unpivot (select window_id, " + ", ".join(WINDOW_FEATURES) + " from elig_train) on " + ", ".join(WINDOW_FEATURES) + " into name feature value value",
)
cte("fstats", "select feature, count(*) n, median(value) median, median(abs(value - m)) mad from (select *, median(value) over (partition by feature) m from fvals) group by feature")


@stage_table("feature_stats")
def _feature_stats(p):
    return baselines.feature_stats(_train(p))


@query("t1_split", "select case when dd < 42 then 'train' when dd < 48 then 'val' else 'test' end split, count(*) n from hist_tasks group by 1")
def _(p):
    return p.t("hist_tasks").groupBy(baselines.time_split(F.col("dd"), 60).alias("split")).agg(F.count("*").alias("n"))


@query("t2_idle_windows", "select window_id, round(oir, 6) operator_idle_ratio from idle_train")
def _(p):
    return baselines.idle_windows(_train(p)).select("window_id", r("operator_idle_ratio", 6))


@query(
    "t3_levels",
    """select operator_id, task_type, weather, operator_skill, count(*) n from idle_train group by grouping sets
      ((operator_id, task_type, weather, operator_skill), (operator_skill, task_type, weather), (task_type), ())""",
)
def _(p):
    return baselines.level_counts(baselines.idle_windows(_train(p))).select("operator_id", "task_type", "weather", "operator_skill", "n")


@query("t4_medians", "select level, key, n, median, mad from base_sql")
def _(p):
    rows = baselines.idle_windows(_train(p))
    counted = rows.groupBy("operator_id", "task_type", "weather", "operator_skill", "operator_idle_ratio").agg(F.count("*").alias("c"))
    return baselines.medians(baselines.at_levels(counted), ["level", "key"], "operator_idle_ratio", "c").select("level", "key", "n", r("median"), r("mad"))


@query("t5_ewma", "select level, key, round(ewma, 4) ewma from ewma_sql")
def _(p):
    rows = baselines.idle_windows(_train(p))
    return baselines.ewma_last(baselines.at_levels(rows), ["level", "key"], "operator_idle_ratio", ["dd", "window_id"], p.cfg.ewma_alpha).select("level", "key", r("ewma"))


@query(
    "t5_ewma_small_alpha",
    """select level, key, round(sum(case when back = n then pow(0.998e0, back - 1) else 0.002e0 * pow(0.998e0, back - 1) end * oir), 4) ewma from (
      select level, key, oir, row_number() over (partition by level, key order by dd desc, window_id desc) back, count(*) over (partition by level, key) n from idle_lv) group by level, key""",
)
def _(p):
    rows = baselines.idle_windows(_train(p)).select("operator_id", "task_type", "weather", "operator_skill", "dd", "window_id", "operator_idle_ratio")
    return baselines.ewma_last(baselines.at_levels(rows), ["level", "key"], "operator_idle_ratio", ["dd", "window_id"], 0.002).select("level", "key", r("ewma"))


@query("t5_idle_baselines", "select * from base_sql")
def _(p):
    return baselines.idle_baselines(_train(p), p.cfg)


@query("t6_feature_stats", "select feature, n, round(median, 6) median, round(mad, 6) mad from fstats")
def _(p):
    return baselines.feature_stats(_train(p)).select("feature", "n", r("median", 6), r("mad", 6))


@query(
    "t7_score_quantiles",
    """select cast(k as bigint) k, round(list_extract(qs, k::int + 1), 6) q from
      (select quantile_cont(rpm_std * (1 + temp_slope), list_transform(range(1001), lambda i: i / 1000e0)) qs from elig_train), (select unnest(range(1001)) k)""",
)
def _(p):
    d = baselines.eligible(_train(p)).select((F.col("rpm_std") * (1 + F.col("temp_slope"))).alias("score"))
    return baselines.score_quantiles(d).select("k", r("q", 6))


_TEXT = ", ".join(
    f"coalesce(cast({c} as varchar), '~')" if c not in ("actual_min", "ambient_temp_c", "hauler_queue_mean", "planner_estimate_min", "rainfall_mm_h", "visibility_m", "wind_kmh")
    else f"coalesce(cast(cast(floor({c} * 1e6 + 0.5e0) as bigint) as varchar), '~')"
    for c in sorted([
        "task_id", "dd", "operator_id", "task_type", "target_cycles", "weather", "ground", "operator_skill", "machine_type", "machine_age_years", "rainfall_mm_h",
        "visibility_m", "wind_kmh", "ambient_temp_c", "hauler_queue_mean", "actual_min", "planner_estimate_min",
    ])
)


@query(
    "t8_content_hash",
    f"""select count(*) n, substr(md5(cast(sum(cast(('0x' || substr(md5(concat_ws('|', {_TEXT})), 1, 15))::bigint as hugeint)) as varchar)), 1, 8) content_hash from hist_tasks""",
)
def _(p):
    return baselines.content_hash(p.t("hist_tasks"))


@query("t9_sample", "select task_id, task_type from (select *, row_number() over (partition by task_type order by sha256(task_id || ':42'), task_id) rk from hist_tasks) where rk <= 100")
def _(p):
    return baselines.sample_per_group(p.t("hist_tasks"), "task_type", "task_id", 100, 42).select("task_id", "task_type")
