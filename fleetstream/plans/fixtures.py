"""Input tables derived from the given TPC-H-like tables.

Each text runs unchanged in Spark and in the SQL engine used for checking, so
both sides of a comparison see the same rows. ``{name}`` stands for a table.
Integer arithmetic only, and double literals are written as 60e0.
"""

from __future__ import annotations

# Long key that makes the order of lineitem rows total at every scale.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]

# seq of the frame within its machine: row number over supplier in LINE_ORDER
SEQD_SQL = (
    "select l.*, row_number() over (partition by l_suppkey order by " + ", ".join(LINE_ORDER) + ") seq from lineitem l"
)

TELEMETRY = """
with b as (select concat('M', lpad(cast(l_suppkey as varchar(9)), 5, '0')) machine_id,
        concat('S', cast(s_nationkey as varchar(9))) site_id, cast(seq as bigint) seq,
        timestamp '2026-01-01 00:00:00' + seq * interval '1' second ts,
        (cast(floor(seq/45) as bigint) + l_suppkey) % 7 ph, l_partkey pk, cast(l_quantity as int) qty,
        cast(round(l_discount*100) as int) dc, cast(round(l_tax*100) as int) tx, l_suppkey sk
      from {seqd} join {supplier} on s_suppkey = l_suppkey),
m as (select *, case when ph in (2,5) then 'IDLE' when ph = 3 then 'TRAVEL'
        when ph = 6 and pk % 3 = 0 then 'AMBIG' else 'WORK' end md from b)
select machine_id, site_id, seq, ts,
  concat('OP', cast((cast(floor(seq/200) as bigint) + sk) % 8 as varchar(9))) operator_id,
  concat(machine_id, '-T', cast(cast(floor(seq/200) as bigint) as varchar(9))) task_id,
  cast(case md when 'IDLE' then case when pk % 97 = 0 then 0 else 800+pk%150 end when 'TRAVEL' then 1400+pk%100 when 'AMBIG' then 1200 else 1800+pk%400 end as double) engine_rpm,
  cast(case when pk % 10 = 0 then 85 + pk % 23 else 85 + pk % 20 end as double) engine_temp_c,
  cast(case md when 'IDLE' then 20+pk%25 when 'TRAVEL' then 80+pk%30 when 'AMBIG' then 80 else case when pk % 10 = 0 then 200+pk%130 else 200+pk%120 end end as double) hydraulic_pressure_bar,
  cast(case md when 'IDLE' then 4+qty%3 else 14+qty%9 end as double) fuel_rate_lph,
  cast(case md when 'TRAVEL' then 1+(qty%50)/8e0 when 'WORK' then 0.25e0 else 0e0 end as double) speed_kmh,
  case when ph in (1,2) and dc >= 8 and pk % 10 = 0 then 'UNFASTENED' else 'FASTENED' end seatbelt,
  cast(case when tx = 8 and qty % 5 = 0 then 2 + qty/4e0 end as double) prox_distance_m,
  case when tx = 8 and qty % 5 = 0 then case when qty % 10 = 0 then 'ORANGE' else 'YELLOW' end end prox_zone,
  (md = 'WORK' and seq % 13 = 0) cycle_completed, (md <> 'IDLE' or ph = 5) truck_present,
  cast(case when md <> 'IDLE' or ph = 5 then 1 + qty % 3 else 0 end as int) hauler_queue_len,
  cast(pk as bigint) pk, qty
from m
"""

CONTEXT = """
with g as (select concat('S', cast(c_nationkey as varchar(9))) site_id, c_nationkey nk,
        cast((c_custkey * 37) % 660 as bigint) sec, max(c_custkey) ck
      from {customer} group by c_nationkey, (c_custkey * 37) % 660),
h as (select *, (cast(floor(sec/60) as bigint) * 7 + nk * 3) % 10 w from g)
select site_id, timestamp '2026-01-01 00:00:00' + sec * interval '1' second ts,
  case w when 0 then 'RAIN' when 1 then 'CLOUDY' when 2 then 'WINDY' when 3 then 'CLOUDY' else 'SUNNY' end weather,
  cast(case w when 0 then 5 + ck % 20 when 4 then ck % 2 else 0 end as double) rainfall_mm_h,
  cast(case w when 5 then 30 + ck % 30 else 9999 end as double) visibility_m,
  cast(10 + ck % 25 as double) ambient_temp_c,
  cast(case w when 2 then 30 + ck % 40 else ck % 20 end as double) wind_kmh,
  case w when 0 then 'MUDDY' when 6 then 'ICY' when 7 then 'MUDDY' when 8 then 'WET' else 'DRY' end ground,
  (w <> 3) daylight
from h
"""

# repeats (pk%37=0), late swaps (pk%41=0), drops (pk%43=0); arrival_no is the total arrival order
ARRIVALS = """
with a as (select machine_id, seq, ts, pk, qty, 0 copy from {telemetry} where pk % 43 <> 0
  union all select machine_id, seq, ts, pk, qty, 1 copy from {telemetry} where pk % 37 = 0)
select machine_id, seq, ts, copy,
  timestamp '2026-01-01 00:00:00' + (seq + case when pk % 41 = 0 then 3 else 0 end + copy * (qty % 4)) * interval '1' second
    + (case when pk % 29 = 0 then 45 else 0 end) * interval '1' second arrival_ts,
  (seq + case when pk % 41 = 0 then 3 else 0 end + copy * (qty % 4)) * 100000 + (seq % 40000) * 2 + copy arrival_no
from a
"""

MACHINES = """
select concat('M', lpad(cast(s_suppkey as varchar(9)), 5, '0')) machine_id,
  concat('S', cast(s_nationkey as varchar(9))) site_id,
  case s_suppkey % 3 when 0 then 'LOADER' else 'EXCAVATOR' end type,
  case s_suppkey % 4 when 0 then '950' when 1 then '320' when 2 then '336' else '980' end model,
  cast(1 + s_suppkey % 5 as int) age_years
from {supplier} where s_suppkey % 20 <> 7
"""

USERS = """
select user_id, role, skill_level from (
  select concat('OP', cast(k as varchar(9))) user_id, 'OPERATOR' role,
    case when k < 2 then 'EXPERT' when k < 5 then 'INTERMEDIATE' else 'BEGINNER' end skill_level
  from (select distinct s_suppkey % 7 k from {supplier}) x
  union all select concat('SUP', cast(n_nationkey as varchar(9))), 'SUPERVISOR', cast(null as varchar(9)) from {nation}
  union all select concat('ADM', cast(r_regionkey as varchar(9))), 'ADMIN', cast(null as varchar(9)) from {region}) u
"""

USER_SITES = """
select concat('SUP', cast(a.n_nationkey as varchar(9))) user_id, concat('S', cast(b.n_nationkey as varchar(9))) site_id
from {nation} a join {nation} b on a.n_regionkey = b.n_regionkey
"""

TASKS = """
select task_id, operator_id, machine_id, site_id,
  case when tn % 3 = 0 then 'ACTIVE' when tn % 3 = 1 then 'PENDING' else 'DONE' end status,
  cast(12 + pk % 9 as int) est_duration_minutes,
  case when pk % 11 = 0 then cast(null as varchar(9)) else case tn % 5 when 0 then 'TRENCHING' when 1 then 'TRUCK_LOADING'
    when 2 then 'BULK_EXCAVATION' when 3 then 'GRADING' else 'STOCKPILE_MGMT' end end task_type,
  cast(case when pk % 13 = 0 then 0 else 5 + pk % 12 end as int) target_cycles
from (select task_id, min(operator_id) operator_id, machine_id, site_id, max(pk) pk,
        max(pk) + count(*) tn from {telemetry} group by task_id, machine_id, site_id) t
where pk % 17 <> 3
"""

HIST_TASKS = """
with o as (select o_orderkey k, o_custkey c, cast(floor(o_totalprice) as bigint) p,
        cast(floor(date_diff('day', timestamp '1995-01-01 00:00:00', o_orderdate)) as bigint) % 60 dd from {orders}),
b as (select *, 20 + c % 61 target_cycles,
        case k % 5 when 0 then 'BULK_EXCAVATION' when 1 then 'GRADING' when 2 then 'STOCKPILE_MGMT' when 3 then 'TRENCHING' else 'TRUCK_LOADING' end task_type,
        case k % 5 when 0 then 60 when 1 then 70 when 2 then 50 when 3 then 55 else 45 end cycle_s,
        case c % 4 when 0 then 'SUNNY' when 1 then 'CLOUDY' when 2 then 'WINDY' else 'RAIN' end weather,
        case (c + k) % 4 when 0 then 'DRY' when 1 then 'WET' when 2 then 'MUDDY' else 'ICY' end ground,
        case p % 8 when 0 then 'EXPERT' when 1 then 'EXPERT' when 2 then 'BEGINNER' when 3 then 'BEGINNER' else 'INTERMEDIATE' end operator_skill
      from o)
select concat('HT', cast(k as varchar(20))) task_id, cast(dd as int) dd, concat('OP', cast(p % 8 as varchar(9))) operator_id,
  task_type, cast(target_cycles as int) target_cycles, weather, ground, operator_skill,
  case k % 2 when 0 then 'EXCAVATOR' else 'LOADER' end machine_type, cast(1 + k % 5 as int) machine_age_years,
  cast(case weather when 'RAIN' then 2 + p % 20 else 0 end as double) rainfall_mm_h,
  cast(case weather when 'RAIN' then 400 + p % 900 else 9999 end as double) visibility_m,
  cast(case weather when 'WINDY' then 35 + p % 30 else p % 20 end as double) wind_kmh,
  cast(10 + p % 25 as double) ambient_temp_c, cast(p % 4 as double) hauler_queue_mean,
  target_cycles * cycle_s / 60e0
    * case weather when 'SUNNY' then 1e0 when 'CLOUDY' then 1.03e0 when 'WINDY' then 1.1e0 else 1.18e0 end
    * case ground when 'DRY' then 1e0 when 'WET' then 1.06e0 when 'MUDDY' then 1.15e0 else 1.25e0 end
    * case operator_skill when 'EXPERT' then 0.93e0 when 'INTERMEDIATE' then 1.05e0 else 1.3e0 end
    * (0.9e0 + (p % 200) / 1e3) actual_min,
  target_cycles * cycle_s / 60e0
    * case operator_skill when 'EXPERT' then 0.95e0 when 'INTERMEDIATE' then 1e0 else 1.1e0 end planner_estimate_min
from b
"""

# one 300 s historical window per line; window_id is unique
HIST_WINDOWS = """
with l as (select concat('W', cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(9)), '-', cast(l_partkey as varchar(20)), '-',
        cast(l_suppkey as varchar(20)), '-', cast(cast(round(l_extendedprice*100) as bigint) as varchar(20)), '-', cast(cast(l_quantity as int) as varchar(9)), '-',
        cast(cast(round(l_tax*100) as int) as varchar(9))) window_id,
        l_orderkey ok, l_partkey pk, l_suppkey sk, cast(l_quantity as int) qty, cast(round(l_extendedprice*100) as bigint) px,
        cast(round(l_tax*100) as int) tx, cast(round(l_discount*100) as int) dc from {lineitem})
select window_id, cast(ok % 60 as int) dd, concat('OP', cast((pk + qty) % 8 as varchar(9))) operator_id,
  case (pk + qty) % 8 when 0 then 'EXPERT' when 1 then 'EXPERT' when 6 then 'BEGINNER' when 7 then 'BEGINNER' else 'INTERMEDIATE' end operator_skill,
  case sk % 7 when 0 then 'TRENCHING' when 1 then 'TRUCK_LOADING' when 2 then 'BULK_EXCAVATION' when 3 then 'GRADING' when 4 then 'STOCKPILE_MGMT' else '' end task_type,
  case dc % 4 when 0 then 'SUNNY' when 1 then 'CLOUDY' when 2 then 'WINDY' else 'RAIN' end weather,
  case tx % 5 when 0 then 'ICY' when 1 then 'MUDDY' else 'DRY' end ground,
  cast(case when dc % 4 = 3 then px % 30 else 0 end as double) rainfall_mm_h,
  cast(case when dc % 4 = 1 then 20 + px % 400 else 9999 end as double) visibility_m,
  cast(px % 70 as double) wind_kmh, cast(300 as int) window_s,
  cast(case when qty % 6 = 0 then px % 90 else 0 end as double) idle_s_planned,
  cast(case when pk % 7 = 0 then px % 60 else 0 end as double) idle_s_machine,
  cast(case when dc % 4 = 3 and px % 30 >= 20 then px % 110 else 0 end as double) idle_s_weather,
  cast(case when tx % 3 = 0 then px % 80 else 0 end as double) idle_s_site,
  cast(case when qty % 2 = 0 then (px + pk) % 70 else 0 end as double) idle_s_operator,
  (px % 100) / 100e0 truck_present_ratio, (qty % 20) / 10e0 hauler_queue_mean,
  0.3e0 + (px % 70) / 100e0 working_ratio, cast(qty % 9 as int) cycle_count,
  case when qty % 9 >= 2 then (200 + px % 900) / 100e0 * case when pk % 33 = 0 then 1.6e0 else 1e0 end end fuel_per_cycle,
  1400e0 + (px % 4000) / 10e0 rpm_mean, 50e0 + (px % 3000) / 10e0 * case when pk % 33 = 11 then 2e0 else 1e0 end rpm_std,
  180e0 + (px % 1500) / 10e0 hyd_p95, (px % 60) / 100e0 idle_ratio,
  case when qty % 9 >= 2 then 30e0 + (px % 600) / 10e0 end cycle_time_mean,
  case when qty % 9 >= 2 then (px % 350) / 1000e0 * case when pk % 33 = 11 then 3e0 else 1e0 end end cycle_time_cv,
  (px % 400 - 200) / 100e0 + case when pk % 33 = 22 then 4e0 else 0e0 end temp_slope,
  (pk % 33 in (0, 11, 22)) is_anomaly,
  case when pk % 33 = 0 then 'HIGH_FUEL_PER_CYCLE' when pk % 33 = 11 then 'ERRATIC_CYCLES' when pk % 33 = 22 then 'HOT_ENGINE' else '' end anomaly_type
from l
"""

# sparse event stream: 30 days squeezed to 12 hours, so that 300 s gaps split it into incidents
EVENT_FEED = """
with e as (select event_id eid, concat('M', lpad(cast(user_id as varchar(9)), 5, '0')) machine_id, user_id u, event_type et, value v,
        timestamp '2026-01-01 00:00:00' + cast(floor(date_diff('second', timestamp '2024-01-01 00:00:00', cast(ts as timestamp)) / 60) as bigint) * interval '1' second ts
      from {events})
select concat('E', lpad(cast(eid as varchar(12)), 12, '0')) event_id,
  case et when 'click' then 'OVERSPEED_CONDITION' when 'view' then 'PROXIMITY_BREACH' when 'purchase' then 'HEALTH_THRESHOLD'
    when 'error' then 'SEATBELT_VIOLATION' else 'IDLE_DEVIATION' end type,
  case when et = 'signup' or v < 15 then 'INFO' when v < 90 then 'WARNING' else 'CRITICAL' end severity,
  machine_id, concat('OP', cast(u % 8 as varchar(9))) operator_id, concat('S', cast(u % 5 as varchar(9))) site_id, ts,
  case when et in ('click','view','error') then 'safety@1.0' when et = 'purchase' then 'health@1.0' else 'attribution@1.0' end source_engine,
  case when et = 'view' then case when v >= 90 then 'RED' else 'ORANGE' end end zone,
  case when et = 'purchase' then case when eid % 2 = 0 then 'engine_temp_c' else 'hydraulic_pressure_bar' end end metric,
  case when et = 'error' then case when eid % 2 = 0 then 'WORKING' else 'TRAVEL' end end state,
  cast(floor(v) as bigint) reading, cast(eid as bigint) frame_seq
from e
"""

RISK_FEED = """
select machine_id, ts, max(case when frame_seq % 3 = 0 then 'HIGH' when frame_seq % 3 = 1 then 'ELEVATED' else 'NORMAL' end) risk_level
from {event_feed} where reading > 60 group by machine_id, ts
"""

AUDIT_INPUT = """
select cast(event_id as bigint) id, concat('chain', cast(user_id as varchar(9))) chain_id, concat('U', cast(event_id % 97 as varchar(9))) actor_id,
  case event_type when 'click' then 'INCIDENT_ACK' when 'view' then 'INCIDENT_CLOSE' else 'INCIDENT_EXPLAIN_REQUEST' end action,
  'incident' target_type, concat('I', cast(event_id % 1009 as varchar(9))) target_id,
  'OPEN' from_status, concat('note ', cast(cast(floor(value) as bigint) as varchar(9))) note,
  timestamp '2026-01-01 00:00:00' + cast(event_id as bigint) * interval '1' second ts
from {events}
"""

KNOWLEDGE_DOCS = """
select concat('doc-', cast(doc_id as varchar(12))) file_stem,
  concat('---', {nl}, 'doc_id: d', cast(doc_id as varchar(12)), {nl}, 'title: Guide ', cast(doc_id as varchar(12)), {nl}, 'tags: [',
    case doc_id % 4 when 0 then 'SEATBELT_VIOLATION, PROXIMITY_BREACH' when 1 then 'HEALTH_THRESHOLD' when 2 then 'OVERSPEED_CONDITION' else 'IDLE_DEVIATION, ETA_SLIP' end,
    ']', {nl}, '---', {nl}, {nl}, '## Overview ', source, {nl}, {nl}, replace(text, '#', ' '), {nl}, {nl}, '## Key Points: ', lang, {nl}, {nl}, 'Points for ', source, ' readers.', {nl}) raw
from {documents}
"""

SEARCHES = """
select concat('Q', cast(item_id as varchar(12))) query_id, text query,
  case item_id % 3 when 0 then 'SEATBELT_VIOLATION' when 1 then 'HEALTH_THRESHOLD' else 'IDLE_DEVIATION' end tag
from {benchmark}
"""

# name -> (text, tables it reads)
FIXTURES: dict[str, str] = {
    "telemetry": TELEMETRY, "context": CONTEXT, "arrivals": ARRIVALS, "machines": MACHINES, "users": USERS,
    "user_sites": USER_SITES, "tasks": TASKS, "hist_tasks": HIST_TASKS, "hist_windows": HIST_WINDOWS,
    "event_feed": EVENT_FEED, "risk_feed": RISK_FEED, "audit_input": AUDIT_INPUT,
    "knowledge_docs": KNOWLEDGE_DOCS, "searches": SEARCHES,
}
BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
