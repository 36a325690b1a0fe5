"""Event-time windows of frames and their operating features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetstream.config import Config
from fleetstream.functions.ids import window_start_s
from fleetstream.operators.scan import asof_join, scan, time_chunk
from fleetstream.operators.states import CONTEXT_COLUMNS

FEATURES = [
    "rpm_mean", "rpm_std", "hyd_p95", "idle_ratio", "working_ratio", "truck_present_ratio", "hauler_queue_mean",
    "fuel_l_total", "cycle_count", "cycle_time_mean", "cycle_time_cv", "fuel_per_cycle", "temp_slope",
]


def with_window(frames: DataFrame, cfg: Config = Config(), ts: str = "ts") -> DataFrame:
    start = window_start_s(F.col(ts), cfg.window_s)
    return frames.withColumns({
        "window_start": F.timestamp_seconds(start), "window_end": F.timestamp_seconds(start + cfg.window_s),
    })


def mark_late(arrivals: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add ``late``: the frame's window had closed (end + allowed lateness) when it arrived."""
    d = with_window(arrivals, cfg).withColumn("__chunk", time_chunk("arrival_ts", cfg.chunk_s))
    order = ["arrival_ts", "arrival_no"]
    d = scan(d, ["machine_id"], "__chunk", order, maxs={"__max": F.col("ts")})
    closed = F.unix_seconds("__max") >= F.unix_seconds("window_end") + cfg.lateness_s
    return d.withColumn("late", F.coalesce(closed, F.lit(False))).drop("__chunk", "__max")


def window_features(frames: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row per (machine, window): identity, counts and features.

    The frame index inside a window needs the rows of that window together;
    the window functions and the aggregate share one shuffle on
    (machine, window), and such a group is as small as the window.
    """
    s = float(cfg.seconds_per_frame)
    c = F.col
    w = Window.partitionBy("machine_id", "window_start").orderBy("seq")
    d = with_window(frames, cfg).withColumn("__i", F.row_number().over(w) - 1)
    d = d.withColumn(
        "__since",
        F.when(
            c("cycle_completed"),
            c("__i") - F.last(F.when(c("cycle_completed"), c("__i")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        ) * s,
    )
    share = lambda cond: F.avg(cond.cast("double"))
    agg = d.groupBy("machine_id", "window_start", "window_end").agg(
        F.count("*").alias("frame_count"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        F.max_by("site_id", "seq").alias("site_id"), F.max_by("operator_id", "seq").alias("operator_id"), F.max_by("task_id", "seq").alias("task_id"),
        F.avg("engine_rpm").alias("rpm_mean"), F.stddev_pop("engine_rpm").alias("rpm_std"),
        F.percentile("hydraulic_pressure_bar", F.lit(0.95)).alias("hyd_p95"),
        share((c("hydraulic_pressure_bar") < 50) & (c("speed_kmh") < 0.5)).alias("idle_ratio"),
        share(c("hydraulic_pressure_bar") >= 120).alias("working_ratio"),
        share(c("truck_present")).alias("truck_present_ratio"),
        F.avg(c("hauler_queue_len").cast("double")).alias("hauler_queue_mean"),
        (F.sum("fuel_rate_lph") * s / F.lit(3600.0)).alias("fuel_l_total"),
        F.count_if("cycle_completed").alias("cycle_count"),
        F.avg("__since").alias("__ct"), F.stddev_pop("__since").alias("__cs"),
        F.regr_slope("engine_temp_c", c("__i") * F.lit(s / 60.0)).alias("__slope"),
    )
    two = c("cycle_count") >= 2
    out = agg.withColumns({
        "window_id": F.concat_ws(":", "machine_id", F.unix_seconds("window_start").cast("string")),
        "cycle_time_mean": F.when(two, c("__ct")),
        "cycle_time_cv": F.when(two & (c("__ct") > 0), c("__cs") / c("__ct")),
        "fuel_per_cycle": F.when(two, c("fuel_l_total") / c("cycle_count")),
        "temp_slope": F.when(c("frame_count") >= 2, F.coalesce("__slope", F.lit(0.0))).otherwise(0.0),
    })
    return out.select(
        "window_id", "machine_id", "site_id", "operator_id", "task_id", "window_start", "window_end",
        "frame_count", "first_seq", "last_seq", *FEATURES,
    )


def minimal_rows(windows: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Windows with too few frames keep their identity only."""
    enough = F.col("frame_count") >= cfg.min_frames
    return windows.withColumns({f: F.when(enough, F.col(f)) for f in FEATURES}).withColumn("sufficient", enough)


def with_alert_counts(windows: DataFrame, events: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Events in [start, end) of each window: events are counted per window start, then joined on equality."""
    counts = with_window(events, cfg).groupBy("machine_id", "window_start").agg(F.count("*").alias("alerts_count"))
    return windows.join(counts, ["machine_id", "window_start"], "left").na.fill({"alerts_count": 0})


def event_counts(events: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Events per machine, window and type: machine_id, window_start, type, n."""
    return with_window(events, cfg).groupBy("machine_id", "window_start", "type").agg(F.count("*").alias("n"))


def site_context(windows: DataFrame, context: DataFrame) -> DataFrame:
    """Context of each (site, window) at the window's end; one row per site and window."""
    needed = windows.select("site_id", "window_start", "window_end").distinct()
    return asof_join(needed, context, ["site_id"], "window_end", "ts", CONTEXT_COLUMNS, 60).drop("window_end")


def with_window_context(windows: DataFrame, context: DataFrame) -> DataFrame:
    return windows.join(site_context(windows, context), ["site_id", "window_start"], "left")


def previous_window(windows: DataFrame, columns: list[str], cfg: Config = Config()) -> DataFrame:
    """Add ``prev_<column>`` of the machine's window before."""
    d = windows.withColumn("__chunk", time_chunk("window_start", cfg.chunk_s))
    return scan(d, ["machine_id"], "__chunk", ["window_start"], prevs={f"prev_{c}": F.col(c) for c in columns}).drop("__chunk")


def task_at(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Task of the machine's latest window starting at or before each event."""
    return asof_join(events, windows, ["machine_id"], "ts", "window_start", ["task_id"], 600)
