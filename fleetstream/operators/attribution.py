"""Why a machine was idle, and whether its operator idles more than expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstream.config import IDLE_CAUSES, Config
from fleetstream.functions.ids import warm_event_id
from fleetstream.functions.stats import robust_z
from fleetstream.operators.scan import broadcast_if_few, gap_sessions, scan, seconds, time_chunk
from fleetstream.operators.windows import site_context, with_window

KEY_SEP = "||"


def planned_break(ts: Column, breaks: str) -> Column:
    """Whether the time of day lies in one of the breaks 'HH:MM-HH:MM,...' (start <= t < end)."""
    hm = F.date_format(ts, "HH:mm")
    spans = F.transform(F.split(F.lit(breaks), ","), lambda b: F.split(F.trim(b), "-"))
    return F.exists(spans, lambda b: (F.size(b) == 2) & (F.get(b, F.lit(0)) <= hm) & (hm < F.get(b, F.lit(1))))


def weather_stop(cfg: Config = Config()) -> Column:
    c = F.col
    breach = (
        (c("rainfall_mm_h") >= cfg.weather_stop_rain_mm_h) | (c("visibility_m") < cfg.weather_stop_visibility_m)
        | (c("wind_kmh") >= cfg.weather_stop_wind_kmh) | (c("ground") == "ICY")
    )
    return F.coalesce(breach, F.lit(False))


def fault_active(frames: DataFrame, events: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add ``fault_active``: a health event of the machine within the hold time before the frame.

    Faults become disjoint spans, each listed under the time slots it covers;
    frames meet them on (machine, slot) and find at most one span.
    """
    hold = cfg.fault_hold_s
    faults = events.where("type = 'HEALTH_THRESHOLD'").select("machine_id", "ts").distinct()
    s = gap_sessions(faults, ["machine_id"], "ts", [], hold, cfg.chunk_s, "span")
    spans = s.groupBy("machine_id", F.col("span_first_ts").alias("__from")).agg(F.max("ts").alias("__last"))
    slot = lambda sec: F.floor(sec / F.lit(hold)).cast("long")
    spans = spans.withColumn("__slot", F.explode(F.sequence(slot(seconds("__from")), slot(seconds("__last") + hold))))
    f, g = frames.withColumn("__slot", slot(seconds("ts"))).alias("f"), spans.alias("g")
    cond = (F.col("f.machine_id") == F.col("g.machine_id")) & (F.col("f.__slot") == F.col("g.__slot"))
    cond = cond & (F.col("f.ts") >= F.col("g.__from")) & (seconds("f.ts") - seconds("g.__last") <= hold)
    return f.join(g, cond, "left").select("f.*", F.col("g.__from").isNotNull().alias("fault_active")).drop("__slot")


def fault_event_ids(windows: DataFrame, events: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Health events from hold time before the window to its end, as a sorted id list per window."""
    steps = -(-cfg.fault_hold_s // cfg.window_s)  # rounded up: the hold may end inside a window
    e = with_window(events.where("type = 'HEALTH_THRESHOLD'"), cfg)
    reach = e.select(
        "machine_id", "event_id", "ts",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.unix_seconds("window_start") + k * cfg.window_s)).alias("__w"),
    ).withColumn("window_start", F.timestamp_seconds("__w"))
    reach = reach.where(seconds("ts") >= F.col("__w") - cfg.fault_hold_s)
    ids = reach.groupBy("machine_id", "window_start").agg(F.sort_array(F.collect_list("event_id")).alias("fault_event_ids"))
    return windows.join(ids, ["machine_id", "window_start"], "left").withColumn(
        "fault_event_ids", F.coalesce("fault_event_ids", F.array().cast("array<string>"))
    )


def idle_causes(frames: DataFrame, context: DataFrame, events: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add ``cause`` per frame: the first that applies, in priority order, with the context at the window's end."""
    d = with_window(frames, cfg)
    d = d.join(broadcast_if_few(site_context(d, context), "site-context"), ["site_id", "window_start"], "left")
    d = fault_active(d, events, cfg)
    c = F.col
    cause = (
        F.when(planned_break(c("ts"), cfg.planned_breaks), "PLANNED")
        .when(c("fault_active") | (c("engine_temp_c") > 105) | (c("hydraulic_pressure_bar") > 320), "MACHINE")
        .when(weather_stop(cfg), "WEATHER")
        .when(~c("truck_present") | (c("hauler_queue_len") == 0), "SITE").otherwise("OPERATOR")
    )
    return d.withColumn("cause", cause)


def attribute_idle(causes: DataFrame, cfg: Config = Config(), idle_only: bool = False) -> DataFrame:
    """Seconds per cause and the primary cause of each window with enough frames.

    By default every frame of the window counts; ``idle_only`` counts frames in
    idle conditions only.
    """
    s = float(cfg.seconds_per_frame)
    c = F.col
    counted = (c("hydraulic_pressure_bar") < 50) & (c("speed_kmh") < 0.5) if idle_only else F.lit(True)
    d = causes.groupBy("machine_id", "window_start", "window_end").agg(
        F.count("*").alias("frame_count"),
        *[(F.count_if(counted & (c("cause") == k)) * s).alias(f"s_{k.lower()}") for k in IDLE_CAUSES],
    ).where(c("frame_count") >= cfg.min_frames)
    per_cause = [c(f"s_{k.lower()}") for k in IDLE_CAUSES]
    total = sum(per_cause[1:], per_cause[0])
    top = F.greatest(*per_cause)
    primary = F.coalesce(*[F.when(v == top, k) for k, v in zip(IDLE_CAUSES, per_cause)])
    return d.withColumns({
        "window_id": F.concat_ws(":", "machine_id", F.unix_seconds("window_start").cast("string")),
        "idle_seconds": total,
        "primary_cause": F.when(top > 0, primary),
        "operator_idle_ratio": F.round(F.when(total > 0, c("s_operator") / total).otherwise(0.0), 4),
    })


def breakdown_map() -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in IDLE_CAUSES]), F.array(*[F.col(f"s_{k.lower()}") for k in IDLE_CAUSES]))


def backoff(windows: DataFrame, baselines: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Most specific baseline with enough windows: operator x context, skill x context, task type, global.

    ``windows`` has operator_id, task_type, weather, operator_skill. Each level
    is an equi-join on its key; small levels are broadcast at run time.
    """
    keys = {
        "operator_context": ["operator_id", "task_type", "weather", "operator_skill"],
        "skill_context": ["operator_skill", "task_type", "weather"],
        "task_type": ["task_type"],
    }
    d = windows
    picks = []
    for level, cols in keys.items():
        side = baselines.where((F.col("level") == level) & (F.col("n") >= cfg.baseline_min_n)).select(
            F.col("key").alias(f"__k_{level}"), F.struct(F.lit(level).alias("level"), "ewma", "median", "mad").alias(f"__b_{level}")
        )
        d = d.join(side, F.concat_ws(KEY_SEP, *cols) == F.col(f"__k_{level}"), "left").drop(f"__k_{level}")
        picks.append(F.col(f"__b_{level}"))
    # the global level is one row
    overall = baselines.where((F.col("level") == "global") & (F.col("n") >= cfg.baseline_min_n)).select(F.struct("level", "ewma", "median", "mad")).scalar()
    d = d.withColumn("__b", F.coalesce(*picks, overall))
    return d.withColumns({
        "baseline_level": F.col("__b")["level"], "baseline_ewma": F.col("__b")["ewma"],
        "baseline_median": F.col("__b")["median"], "baseline_mad": F.col("__b")["mad"],
    }).drop("__b", *[f"__b_{level}" for level in keys])


def deviation(windows: DataFrame, cfg: Config = Config(), mad_floor: float = 0.0) -> DataFrame:
    """Ratio to the expected idle share, robust z, and the raw flag."""
    c = F.col
    mad = F.greatest(c("baseline_mad"), F.lit(mad_floor)) if mad_floor else c("baseline_mad")
    ratio = c("operator_idle_ratio") / F.greatest(c("baseline_ewma"), F.lit(0.01))
    z = robust_z(c("operator_idle_ratio"), c("baseline_median"), mad)
    known = c("baseline_level").isNotNull()
    return windows.withColumns({
        "deviation_status": F.when(known, "OK").otherwise("UNAVAILABLE"),
        "expected_idle_ratio": F.round("baseline_ewma", 4),
        "deviation_ratio": F.when(known, F.round(ratio, 3)),
        "robust_z": F.when(known, F.round(z, 3)),
        "raw_flag": F.coalesce((ratio >= cfg.idle_dev_ratio) & (z > cfg.idle_dev_robust_z), F.lit(False)),
    })


def persistence(windows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Length of the run of raw flags up to each window of a machine; flagged from two on.

    Windows without attribution (too few frames) have raw_flag NULL or false and break the run.
    """
    flag = F.coalesce("raw_flag", F.lit(False))
    d = windows.withColumn("__chunk", time_chunk("window_start", cfg.chunk_s))
    d = scan(d, ["machine_id"], "__chunk", ["window_start"], sinces={"__run": ~flag})
    run = F.col("__run")
    return d.withColumns({
        "consecutive_windows": run.cast("long"), "operator_deviation_flag": flag & (run >= cfg.idle_dev_persist),
    }).drop("__chunk", "__run")


def idle_deviation_events(windows: DataFrame) -> DataFrame:
    d = windows.where("operator_deviation_flag")
    return d.select(
        warm_event_id(F.col("window_id"), F.lit("IDLE_DEVIATION")).alias("event_id"), F.lit("IDLE_DEVIATION").alias("type"), F.lit("INFO").alias("severity"),
        "machine_id", "operator_id", "site_id", F.col("window_end").alias("ts"), F.lit("attribution@1.0").alias("source_engine"),
        F.col("last_seq").alias("frame_seq"),
        F.to_json(F.struct(
            "window_id", "operator_idle_ratio", "expected_idle_ratio", "deviation_ratio", "robust_z", "baseline_level", "consecutive_windows",
            breakdown_map().alias("breakdown_s"),
        )).alias("evidence"),
    )


def recent_cause_totals(attributed: DataFrame, last_n: int) -> DataFrame:
    """Seconds per cause over each machine's last N windows; the rank limit prunes before the shuffle."""
    w = Window.partitionBy("machine_id").orderBy(F.col("window_start").desc())
    d = attributed.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= last_n)
    d = d.select("machine_id", F.explode(breakdown_map()).alias("cause", "s"))
    return d.groupBy("machine_id", "cause").agg(F.sum("s").alias("seconds"))
