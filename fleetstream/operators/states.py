"""Safety envelope, machine state, and UI mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetstream.config import Config
from fleetstream.operators.scan import null_free, asof_join, scan

CONTEXT_COLUMNS = ["weather", "rainfall_mm_h", "visibility_m", "ambient_temp_c", "wind_kmh", "ground", "daylight"]

# Base radii (m) and speed cap (km/h); per condition its radius factor and speed cap.
BASE_RED, BASE_ORANGE, BASE_CAP = 4.0, 7.0, 6.0
CONDITIONS = {
    "RAIN": (1.3, 4.0),
    "LOW_VIS": (1.5, 3.0),
    "MUDDY": (1.2, 3.0),
    "ICY": (1.5, 2.0),
    "WINDY": (1.0, 5.0),
}


def with_context(frames: DataFrame, context: DataFrame, ts: str = "ts", bucket_s: int = 60) -> DataFrame:
    """Latest site context at or before each frame."""
    return asof_join(frames, context, ["site_id"], ts, "ts", CONTEXT_COLUMNS, bucket_s, few=True)


def _active() -> dict[str, Column]:
    c = F.col
    return {
        "RAIN": (c("weather") == "RAIN") | (c("rainfall_mm_h") > 0),
        "LOW_VIS": ((c("weather") == "CLOUDY") & ~c("daylight")) | (c("visibility_m") < 50),
        "MUDDY": c("ground") == "MUDDY",
        "ICY": c("ground") == "ICY",
        "WINDY": (c("wind_kmh") > 40) | (c("weather") == "WINDY"),
    }


def with_envelope(frames: DataFrame) -> DataFrame:
    """Condition list, widest radius factor and lowest speed cap of the active conditions."""
    active = {k: F.coalesce(v, F.lit(False)) for k, v in _active().items()}
    factor = F.greatest(F.lit(1.0), *[F.when(on, F.lit(CONDITIONS[k][0])).otherwise(F.lit(1.0)) for k, on in active.items()])
    cap = F.least(F.lit(BASE_CAP), *[F.when(on, F.lit(CONDITIONS[k][1])).otherwise(F.lit(BASE_CAP)) for k, on in active.items()])
    names = F.concat_ws(",", *[F.when(on, F.lit(k)) for k, on in active.items()])
    return frames.withColumns({
        "conditions": names,
        "condition_multiplier": factor,
        "red_radius_m": F.round(F.lit(BASE_RED) * factor, 1),
        "orange_radius_m": F.round(F.lit(BASE_ORANGE) * factor, 1),
        "speed_cap_kmh": F.round(cap, 1),
    })


def seq_chunk(cfg: Config) -> Column:
    return F.floor(F.col("seq") / F.lit(cfg.chunk_rows)).cast("long")


def envelope_changes(frames: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Frames at which the condition list differs from the frame before (at first: from none)."""
    d = scan(frames.withColumn("__chunk", seq_chunk(cfg)), ["machine_id"], "__chunk", ["seq"], prevs={"__prev": F.col("conditions")})
    return d.where(F.coalesce("__prev", F.lit("")) != F.col("conditions")).drop("__chunk", "__prev")


def machine_states(frames: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add ``state`` and ``idle_ticks`` per frame, ordered by seq within the machine.

    OFF, WORKING and TRAVEL take effect at once; IDLE needs a run of idle
    frames; anything else keeps the state before. One pass over chunks gives
    the run, the state and the idle count carried into each chunk.
    """
    dwell = cfg.idle_dwell
    c = F.col
    definite = (
        F.when(c("engine_rpm") == 0, "OFF")
        .when((c("hydraulic_pressure_bar") >= 120) | c("cycle_completed"), "WORKING")
        .when(c("speed_kmh") >= 0.5, "TRAVEL")
    )
    idle = (
        definite.isNull() & (c("engine_rpm") > 0) & (c("engine_rpm") < 1000)
        & (c("hydraulic_pressure_bar") < 50) & (c("speed_kmh") < 0.5)
    )
    w = Window.partitionBy("__key0", "__chunk").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    rows = null_free(frames, ["machine_id"])[0].withColumns({"__chunk": seq_chunk(cfg), "__def": definite, "__idle": idle}).withColumn("__rn", F.row_number().over(w))
    rows = rows.withColumns({
        "__stop": F.max(F.when(~c("__idle"), c("__rn"))).over(upto),
        "__seg": F.coalesce(F.max(F.when(c("__def").isNotNull(), c("__rn"))).over(upto), F.lit(0)),
    }).withColumns({
        "__run": F.when(c("__idle"), c("__rn") - F.coalesce("__stop", F.lit(0))).otherwise(0),
        "__lead": c("__idle") & c("__stop").isNull(),
    })

    known = F.coalesce(c("__def"), F.when(c("__run") >= dwell, "IDLE"))
    summary = rows.groupBy("__key0", "__chunk").agg(
        F.count("*").alias("n"),
        F.count_if("__lead").alias("lead"),
        F.max("__stop").alias("stop"),
        F.max(F.when(known.isNotNull(), F.struct(c("__rn").alias("rn"), known.alias("v")))).alias("known"),
        F.max("__seg").alias("seg"),
        F.max(F.when(known == "IDLE", F.struct(c("__seg").alias("seg"), (-c("__rn")).alias("neg")))).alias("idle_from"),
    )
    over = Window.partitionBy("__key0").orderBy("__chunk")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    s = summary.withColumn("total", F.sum("n").over(over))
    s = s.withColumn(
        "run_in",
        c("total") - c("n")
        + F.coalesce(F.last(F.when(c("stop").isNotNull(), c("n") - c("stop") - c("total")), ignorenulls=True).over(before), F.lit(0)),
    )
    lead_idle = (c("lead") > 0) & (c("run_in") + c("lead") >= dwell)
    s = s.withColumn("state_out", F.coalesce(c("known")["v"], F.when(lead_idle, "IDLE")))
    s = s.withColumn("state_in", F.coalesce(F.last("state_out", ignorenulls=True).over(before), F.lit("OFF")))
    local_from = F.when(c("idle_from")["seg"] == c("seg"), -c("idle_from")["neg"])
    first_idle = F.when(c("seg") > 0, local_from).otherwise(
        F.least(local_from, F.when(lead_idle, F.greatest(F.lit(1), F.lit(dwell) - c("run_in"))))
    )
    chained = (c("seg") == 0) & (c("state_in") == "IDLE")
    s = s.withColumn("ticks_at", F.when(~chained, F.coalesce(c("n") - first_idle + 1, F.lit(0)) - c("total")))
    s = s.withColumn(
        "ticks_in", F.coalesce(c("total") - c("n") + F.last("ticks_at", ignorenulls=True).over(before), F.lit(0))
    )
    carry = s.select("__key0", "__chunk", "run_in", "state_in", "ticks_in")

    d = rows.join(carry, ["__key0", "__chunk"])
    run = c("__run") + F.when(c("__lead"), c("run_in")).otherwise(0)
    d = d.withColumn("__known", F.coalesce(c("__def"), F.when(run >= dwell, "IDLE")))
    d = d.withColumn("state", F.coalesce(F.last("__known", ignorenulls=True).over(upto), c("state_in")))
    d = d.withColumn("__busy", F.max(F.when(c("state") != "IDLE", c("__rn"))).over(upto))
    ticks = c("__rn") - F.coalesce("__busy", F.lit(0)) + F.when(c("__busy").isNull(), c("ticks_in")).otherwise(0)
    d = d.withColumn("idle_ticks", F.when(c("state") == "IDLE", ticks).otherwise(0).cast("long"))
    return d.select(*frames.columns, "state", "idle_ticks")


def with_ui_mode(states: DataFrame, cfg: Config = Config()) -> DataFrame:
    hub = (F.col("state") == "IDLE") & (F.col("idle_ticks") >= cfg.idle_hub_ticks)
    return states.withColumn("ui_mode", F.when(hub, "IDLE_HUB").otherwise("HUD"))


def idle_hub_edges(states: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Frames at which the mode turns from HUD to IDLE_HUB.

    The idle count grows by one per frame, so the edge is where it first
    reaches the limit: no look at the previous frame is needed.
    """
    return with_ui_mode(states, cfg).where((F.col("state") == "IDLE") & (F.col("idle_ticks") == cfg.idle_hub_ticks))


def state_log(risk_rows: DataFrame) -> DataFrame:
    """One log row per frame; natural key (ts, machine_id)."""
    return risk_rows.select("ts", "machine_id", "state", "risk_score", "risk_level", F.col("seq").alias("frame_seq"))


def state_changes(states: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Frames at which the machine state differs from the frame before."""
    d = scan(states.withColumn("__chunk", seq_chunk(cfg)), ["machine_id"], "__chunk", ["seq"], prevs={"previous_state": F.col("state")})
    return d.where(~F.col("previous_state").eqNullSafe(F.col("state"))).drop("__chunk")
