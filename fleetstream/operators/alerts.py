"""Consolidation of rule events into alerts that are worth delivering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetstream.config import Config
from fleetstream.operators.scan import gap_sessions, seconds

ACTION_HINT = "Condition persisting. Take immediate action."


def alert_windows(events: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Group events of one (machine, type, zone) whose gaps stay within the window; add the running count."""
    d = events.withColumn("__zone", F.coalesce("zone", F.lit("")))
    d = gap_sessions(d, ["machine_id", "type", "__zone"], "ts", ["frame_seq", "pos"], cfg.alert_window_s, cfg.chunk_s, "alert")
    return d.withColumn("alert_key", F.concat_ws(":", "machine_id", "type", "__zone")).drop("__zone").withColumnRenamed("alert_pos", "alert_count")


def decide_alerts(windows: DataFrame) -> DataFrame:
    """Severity after persistence, and whether the repeat limiter lets the event through."""
    c = F.col
    repeat = c("alert_count") > 1
    persistent = repeat & ((c("alert_count") >= 3) | (seconds("ts") - seconds("alert_first_ts") >= 15))
    out = F.when(persistent & (c("severity") == "WARNING"), "CRITICAL").when(persistent & (c("severity") == "INFO"), "WARNING").otherwise(c("severity"))
    d = windows.withColumns({
        "persistent": persistent,
        "out_severity": out,
        "action_hint": F.when(persistent & (c("severity") == "WARNING"), ACTION_HINT),
    })
    gap = c("alert_gap_s")
    emit = ~repeat | F.when(c("out_severity") == "CRITICAL", gap >= 5).otherwise(c("persistent") & (gap >= 10))
    return d.withColumn("emit", emit)


def flood_guard(alerts: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Of more emitted alerts than the limit in one tick of a machine, keep the most severe and note the rest."""
    rank = F.when(F.col("out_severity") == "CRITICAL", 2).when(F.col("out_severity") == "WARNING", 1).otherwise(0)
    tick = F.floor(F.unix_seconds("ts") / F.lit(cfg.flood_width_s))
    d = alerts.where("emit").withColumn("__tick", tick)
    per_tick = Window.partitionBy("machine_id", "__tick")
    d = d.withColumns({
        "__n": F.count("*").over(per_tick),
        "__rk": F.row_number().over(per_tick.orderBy(rank.desc(), "ts", "frame_seq", "pos")),
    })
    flooded = F.col("__n") > cfg.flood_threshold
    return (
        d.where(~flooded | (F.col("__rk") == 1))
        .withColumn("flood_warning", F.when(flooded, F.concat(F.lit("Flood: "), (F.col("__n") - 1).cast("string"), F.lit(" other alerts suppressed"))))
        .drop("__tick", "__n", "__rk")
    )


def arbitrate(events: DataFrame, cfg: Config = Config()) -> DataFrame:
    return flood_guard(decide_alerts(alert_windows(events, cfg)), cfg)


def alert_kpi(decided: DataFrame) -> DataFrame:
    """Raw, delivered and suppressed counts per event type."""
    return decided.groupBy("type").agg(
        F.count("*").alias("raw"), F.count_if("emit").alias("delivered"), F.count_if(~F.col("emit")).alias("suppressed")
    )
