"""Streaming twins that need no state of our own: watermarked windows and sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetstream.config import Config
from fleetstream.operators.incidents import summary_text
from fleetstream.operators.safety import proximity_event
from fleetstream.operators.windows import window_features
from fleetstream.functions.ids import evidence_key

FRAME = [
    "machine_id", "site_id", "seq", "ts", "operator_id", "task_id", "engine_rpm", "engine_temp_c", "hydraulic_pressure_bar", "fuel_rate_lph",
    "speed_kmh", "cycle_completed", "truck_present", "hauler_queue_len",
]


def unique_within(frames: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drop frames of a machine whose seq was seen within the delay; later copies and frames out of order pass (see ``keyed.without_replays``)."""
    return frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["machine_id", "seq"])


def closed_windows(frames: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The frames of each window once the watermark has passed its end; later frames are dropped and counted by the query."""
    d = frames.withWatermark("ts", f"{cfg.lateness_s} seconds")
    d = d.groupBy("machine_id", F.window("ts", f"{cfg.window_s} seconds")).agg(F.collect_list(F.struct(*FRAME)).alias("frames"))
    return d.select(F.explode("frames").alias("f")).select("f.*")


def window_feature_sink(write: Callable[[DataFrame], None], cfg: Config = Config()) -> Callable[[DataFrame, int], None]:
    """For foreachBatch behind ``closed_windows``: the batch features of the windows that closed."""

    def on_batch(batch: DataFrame, _epoch: int) -> None:
        write(window_features(batch, cfg))

    return on_batch


def timeline_sessions(linked: DataFrame, cfg: Config = Config(), delay: str = "10 minutes") -> DataFrame:
    """Timeline rows by session windows: same condition of an incident within the merge gap."""
    d = linked.withWatermark("ts", delay).withColumn("entry_key", F.concat_ws(":", "type", evidence_key(F.col("zone"), F.col("metric"))))
    s = d.groupBy("incident_id", "entry_key", F.session_window("ts", f"{cfg.timeline_merge_s} seconds")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("count"),
        F.min(F.struct("ts", "event_id", "severity", summary_text().alias("summary"))).alias("f"),
    )
    return s.select(
        "incident_id", "entry_key", "first_ts", "last_ts", "count", F.col("f")["event_id"].alias("representative_event_id"),
        F.col("f")["severity"].alias("severity"), F.col("f")["summary"].alias("summary"),
    )


def risk_inputs(enveloped: DataFrame) -> DataFrame:
    """Columns the keyed risk twin reads: weights of the rules that do not depend on the state, flags of those that do."""
    c = F.col
    prox = proximity_event()
    base = (
        F.when(prox["zone"] == "RED", 30.0).when(prox["zone"] == "ORANGE", 10.0).otherwise(0.0)
        + F.when(c("engine_temp_c") > 105, 10.0).otherwise(0.0) + F.when(c("hydraulic_pressure_bar") > 320, 10.0).otherwise(0.0)
    )
    return enveloped.select(
        "machine_id", "seq", "ts", "engine_rpm", "hydraulic_pressure_bar", "speed_kmh", "cycle_completed", base.alias("risk_base"),
        (c("seatbelt") == "UNFASTENED").alias("loose"), (c("speed_kmh") > c("speed_cap_kmh")).alias("fast"), c("condition_multiplier").alias("factor"),
    )
