"""Sources, admission and identifier queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetstream.functions import ids
from fleetstream.operators import ingest, states
from fleetstream.plans.oracle import cte
from fleetstream.plans.pipeline import stage_table
from fleetstream.plans.registry import query
from fleetstream.session import stage_path
from fleetstream.sources import dimensions, records, sinks

EPOCH = F.unix_seconds


# --- staged inputs -----------------------------------------------------------

@stage_table("frames")
def _frames(p):
    return ingest.with_site(p.t("telemetry"), p.t("machines"))


cte("frames", "select t.* exclude (site_id), coalesce(m.site_id, 'UNKNOWN') site_id from telemetry t left join machines m using (machine_id)")


@stage_table("signed")
def _signed(p):
    """Signed frames with nested proximity; every 50th part key spoils the signature."""
    c = F.col
    prox = F.when(c("prox_zone").isNotNull(), F.struct(c("prox_zone").alias("zone"), c("prox_distance_m").alias("distance_m"), F.lit("UWB").alias("source")))
    d = p.t("telemetry").withColumns({
        "proximity": prox,
        "gps": F.array((c("pk") % 90).cast("double") + 0.5, (c("pk") % 180).cast("double") + 0.25),
    })
    d = ingest.sign_frames(d, _keys(p))
    return d.withColumn("sig", F.when(c("pk") % 50 == 0, "bad").otherwise(c("expected_sig"))).drop("expected_sig")


def _keys(p):
    return p.t("machines").select("machine_id", F.concat(F.lit("secret-"), "machine_id").alias("secret"))


_PAD = "list_aggregate(list_transform(range(0, 64), lambda i: printf('%02x', xor(case when i < strlen('secret-' || machine_id) then ascii(substr('secret-' || machine_id, i::int + 1, 1)) else 0 end, {b}))), 'string_agg', '')"
cte(
    "signed_sql",
    "select s.*, sha256(from_hex(opad) || from_hex(sha256(from_hex(ipad) || encode(msg)))) expected_sig from (select machine_id, seq, pk,"
    + _PAD.format(b=54) + " ipad," + _PAD.format(b=92) + """ opad,
    '{"cycle_completed":' || cycle_completed || ',"engine_rpm":' || engine_rpm || ',"engine_temp_c":' || engine_temp_c || ',"fuel_rate_lph":' || fuel_rate_lph
    || ',"gps":[' || (pk % 90 + 0.5e0) || ',' || (pk % 180 + 0.25e0) || '],"hauler_queue_len":' || hauler_queue_len
    || ',"hydraulic_pressure_bar":' || hydraulic_pressure_bar || ',"machine_id":"' || machine_id || '","operator_id":"' || operator_id || '","proximity":'
    || case when prox_zone is null then 'null' else '{"distance_m":' || prox_distance_m || ',"source":"UWB","zone":"' || prox_zone || '"}' end
    || ',"seatbelt":"' || seatbelt || '","seq":' || seq || ',"speed_kmh":' || speed_kmh || ',"task_id":"' || task_id
    || '","truck_present":' || truck_present || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z"}' msg
    from telemetry) s""",
)

_VERDICT_SQL = """select machine_id, seq, case when pk % 50 = 0 then 'bad' when m.machine_id is null then null else expected_sig end sig,
  case when m.machine_id is null then 'UNKNOWN_KEY' when pk % 50 = 0 then 'BAD_SIGNATURE' else 'ACCEPTED' end verdict
  from signed_sql left join (select machine_id from machines) m using (machine_id)"""


@query("b1_signatures", _VERDICT_SQL)
def _(p):
    return ingest.verify_signatures(p.t("signed"), _keys(p)).select("machine_id", "seq", "sig", "verdict")


# --- sources -----------------------------------------------------------------

@stage_table("raw_frames")
def _raw_frames(p):
    """Telemetry as JSON text lines, some of them broken."""
    d = p.t("telemetry")
    nested = F.struct(
        "seq", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "machine_id", "operator_id", "task_id", "engine_rpm", "engine_temp_c",
        "hydraulic_pressure_bar", "fuel_rate_lph", "speed_kmh", "seatbelt",
        F.when(F.col("prox_zone").isNotNull(), F.struct(F.col("prox_zone").alias("zone"), F.col("prox_distance_m").alias("distance_m"), F.lit("UWB").alias("source"))).alias("proximity"),
        "cycle_completed", "truck_present", "hauler_queue_len",
    )
    text = F.to_json(nested)
    return d.select(F.when(F.col("pk") % 61 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value"))


@query(
    "a1_telemetry_source",
    "select machine_id, seq, cast(epoch(ts) as bigint) ts_s, engine_rpm, prox_zone, prox_distance_m, cycle_completed from telemetry where pk % 61 <> 0",
)
def _(p):
    good, _bad = records.parse_telemetry(p.t("raw_frames"))
    return good.select("machine_id", "seq", EPOCH("ts").alias("ts_s"), "engine_rpm", "prox_zone", "prox_distance_m", "cycle_completed")


@query("a1_quarantine", "select count(*) n from telemetry where pk % 61 = 0")
def _(p):
    _good, bad = records.parse_telemetry(p.t("raw_frames"))
    return bad.agg(F.count("*").alias("n"))


@query(
    "a2_context_source",
    """select site_id, cast(epoch(ts) as bigint) ts_s, weather, case when weather = 'SUNNY' then 0e0 else rainfall_mm_h end rainfall_mm_h,
      case when weather = 'CLOUDY' then 9999e0 else visibility_m end visibility_m, ground, daylight from context""",
)
def _(p):
    raw = p.t("context").select(F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "site_id", "weather",
        F.when(F.col("weather") != "SUNNY", F.col("rainfall_mm_h")).alias("rainfall_mm_h"),
        F.when(F.col("weather") != "CLOUDY", F.col("visibility_m")).alias("visibility_m"),
        "ambient_temp_c", "wind_kmh", "ground", "daylight",
    )).alias("value"))
    d = records.parse_context(raw)
    return d.select("site_id", EPOCH("ts").alias("ts_s"), "weather", "rainfall_mm_h", "visibility_m", "ground", "daylight")


@query("a3_event_source", "select event_id, type, severity, machine_id, cast(epoch(ts) as bigint) ts_s, zone, metric, reading from event_feed")
def _(p):
    d = records.parse_events(records.event_envelopes(p.t("event_feed")))
    return d.select("event_id", "type", "severity", "machine_id", EPOCH("ts").alias("ts_s"), "zone", "metric", F.col("reading").cast("long").alias("reading"))


@query(
    "a4_history_source",
    "select case when task_type = '' then 'NONE' else task_type end task_type, count(*) n, sum(window_s) window_s from hist_windows group by 1",
)
def _(p):
    d = records.history_windows(p.t("hist_windows"))
    return d.groupBy("task_type").agg(F.count("*").alias("n"), F.sum("window_s").alias("window_s"))


@query(
    "a6_insert_if_absent",
    """select x.event_id, x.machine_id, x.type from event_feed x where not exists (select 1 from event_feed t where t.event_id = x.event_id and t.frame_seq % 3 = 0)""",
)
def _(p):
    x = p.t("event_feed").select("event_id", "machine_id", "type", "frame_seq")
    target = x.where(F.col("frame_seq") % 3 == 0)
    replayed = x.unionByName(x)  # delivered twice
    return sinks.new_rows(replayed, target, ["event_id"]).select("event_id", "machine_id", "type")


@query("a6_sink_replay", "select event_id, machine_id, type, cast(epoch(ts) as bigint) ts_s from event_feed")
def _(p):
    """Three deliveries of the events written to a table, the second and third with replays, and read back."""
    x, path = p.t("event_feed").select("event_id", "machine_id", "type", "ts", "frame_seq"), stage_path(p.spark, "sink")
    for part in (x.where("frame_seq % 3 = 0"), x.where("frame_seq % 3 <> 2"), x.unionByName(x)):
        sinks.insert_if_absent(part, path, ["machine_id", "event_id"], "ts")
    return p.spark.read.parquet(path).select("event_id", "machine_id", "type", EPOCH("ts").alias("ts_s"))


@query(
    "a7_upsert",
    "select machine_id, max(seq) seq, cast(epoch(max(ts)) as bigint) ts_s, arg_max(speed_kmh, seq) speed_kmh, arg_max(task_id, seq) task_id from telemetry group by machine_id",
)
def _(p):
    """The latest frame per machine kept in a table over three deliveries, the last of which is an old one, and read back."""
    x, path = p.t("telemetry").select("machine_id", "seq", "ts", "speed_kmh", "task_id"), stage_path(p.spark, "latest")
    for part in (x.where("seq % 2 = 0"), x.where("seq % 2 = 1"), x.where("seq < 100")):
        sinks.upsert_latest(part, path, ["machine_id"], ["ts", "seq"])
    return p.spark.read.parquet(path).select("machine_id", "seq", EPOCH("ts").alias("ts_s"), "speed_kmh", "task_id")


@query(
    "a4_history_reader",
    "select case when task_type = '' then 'NONE' else coalesce(task_type, 'NONE') end task_type, count(*) n, sum(window_s) window_s, count(distinct operator_id) operators from hist_windows group by 1",
)
def _(p):
    """History written as gzipped CSV and read by the reader."""
    x, path = p.t("hist_windows").select("window_id", "operator_id", "task_type", "window_s"), stage_path(p.spark, "history")
    x.write.option("header", True).option("compression", "gzip").csv(path)
    d = records.history_windows(records.read_history(p.spark, path, ",".join(f"{n} {k}" for n, k in x.dtypes)))
    return d.groupBy("task_type").agg(F.count("*").alias("n"), F.sum("window_s").alias("window_s"), F.countDistinct("operator_id").alias("operators"))


@query(
    "a7_latest_per_key",
    "select machine_id, max(seq) seq, cast(epoch(max(ts)) as bigint) ts_s, arg_max(speed_kmh, seq) speed_kmh, arg_max(task_id, seq) task_id from telemetry group by machine_id",
)
def _(p):
    d = sinks.latest(p.t("telemetry"), ["machine_id"], ["ts", "seq"])
    return d.select("machine_id", "seq", EPOCH("ts").alias("ts_s"), "speed_kmh", "task_id")


@query("a9_dimensions", "select type, count(*) machines, sum(age_years) age_years from machines group by type")
def _(p):
    return p.t("machines").groupBy("type").agg(F.count("*").alias("machines"), F.sum("age_years").alias("age_years"))


@query(
    "a9_task_types",
    """select h.task_type, c.cycle_s, count(*) n from hist_tasks h join (values ('TRENCHING', 55), ('TRUCK_LOADING', 45), ('BULK_EXCAVATION', 60),
      ('GRADING', 70), ('STOCKPILE_MGMT', 50)) c(task_type, cycle_s) using (task_type) group by all""",
)
def _(p):
    types = dimensions.task_types(p.spark)
    return p.t("hist_tasks").join(types, "task_type").groupBy("task_type", "cycle_s").agg(F.count("*").alias("n"))


# --- admission ---------------------------------------------------------------

@query("b2_freshness", "select machine_id, seq, copy from arrivals where abs(epoch(ts) - epoch(arrival_ts)) <= 30")
def _(p):
    return ingest.fresh(p.t("arrivals")).select("machine_id", "seq", "copy")


cte(
    "seq_class",
    """select *, case when last_seq is null then 'first' when seq = last_seq then 'duplicate' when seq < last_seq then 'out_of_order'
      when seq > last_seq + 1 then 'gap' else 'accepted' end result from (select *, max(seq) over (partition by machine_id
      order by arrival_ts, arrival_no rows between unbounded preceding and 1 preceding) last_seq from arrivals)""",
)


@query("b3_sequence", "select machine_id, seq, copy, last_seq, result from seq_class")
def _(p):
    return ingest.classify_sequence(p.t("arrivals")).select("machine_id", "seq", "copy", "last_seq", "result")


@query("b4_replay_drop", "select machine_id, seq, copy from seq_class where last_seq is null or seq > last_seq")
def _(p):
    return ingest.drop_replays(p.t("arrivals")).select("machine_id", "seq", "copy")


@query("b5_known_machines", "select machine_id, count(*) n from telemetry where machine_id in (select machine_id from machines) group by 1")
def _(p):
    return ingest.known_machines(p.t("telemetry"), p.t("machines")).groupBy("machine_id").agg(F.count("*").alias("n"))


@query(
    "b6_shard",
    "select machine_id, cast(('0x' || substr(sha256(machine_id), 1, 8))::bigint % 4 as int) shard, count(*) n from telemetry group by machine_id",
)
def _(p):
    return p.t("telemetry").groupBy("machine_id").agg(F.count("*").alias("n")).withColumn("shard", ids.shard(F.col("machine_id")))


def uuid5_sql(name: str) -> str:
    h = f"sha1(from_hex('{ids.NAMESPACE_HEX}') || encode({name}))"
    return (
        f"(select substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')"
        f"||substr(h,18,3)||'-'||substr(h,21,12) from (select {h} h))"
    )


@query(
    "b7_uuid5",
    f"""select event_id, {uuid5_sql("'hot:'||machine_id||':'||frame_seq||':'||type||':'||coalesce(zone, metric, '')")} hot_id,
      {uuid5_sql("'warm:'||machine_id||':'||type")} warm_id, {uuid5_sql("'eta_slip:'||machine_id||':'||reading")} slip_id,
      {uuid5_sql("'incident:'||machine_id||':'||event_id")} inc_id, {uuid5_sql("'lesson:'||event_id")} les_id from event_feed""",
)
def _(p):
    c = F.col
    return p.t("event_feed").select(
        "event_id",
        ids.hot_event_id(c("machine_id"), c("frame_seq"), c("type"), ids.evidence_key(c("zone"), c("metric"))).alias("hot_id"),
        ids.warm_event_id(c("machine_id"), c("type")).alias("warm_id"), ids.eta_slip_event_id(c("machine_id"), c("reading")).alias("slip_id"),
        ids.incident_id(c("machine_id"), c("event_id")).alias("inc_id"), ids.lesson_id(c("event_id")).alias("les_id"),
    )


@query("b8_evidence_key", "select type, coalesce(zone, metric, '') disc, count(*) n from event_feed group by all")
def _(p):
    return p.t("event_feed").groupBy("type", ids.evidence_key(F.col("zone"), F.col("metric")).alias("disc")).agg(F.count("*").alias("n"))


@query("b9_window_id", "select machine_id || ':' || cast(floor(epoch(ts) / 30) * 30 as bigint) window_id, count(*) n from telemetry group by 1")
def _(p):
    return p.t("telemetry").groupBy(ids.window_id(F.col("machine_id"), F.col("ts"), 30).alias("window_id")).agg(F.count("*").alias("n"))


@query("b10_site", "select site_id, count(*) n from frames group by 1")
def _(p):
    return ingest.with_site(p.t("telemetry"), p.t("machines")).groupBy("site_id").agg(F.count("*").alias("n"))


cte(
    "frames_ctx",
    """select f.*, c.weather, c.rainfall_mm_h, c.visibility_m, c.ambient_temp_c, c.wind_kmh, c.ground, c.daylight
      from frames f asof left join context c on f.site_id = c.site_id and f.ts >= c.ts""",
)


@query("j1_context_asof", "select machine_id, seq, weather, rainfall_mm_h, wind_kmh, ground, daylight from frames_ctx")
def _(p):
    d = states.with_context(p.t("frames"), p.t("context"))
    return d.select("machine_id", "seq", "weather", "rainfall_mm_h", "wind_kmh", "ground", "daylight")
