"""Rule events per frame, and the risk they add."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetstream.config import Config
from fleetstream.functions.ids import evidence_key, hot_event_id

# Health limits and risk weights.
TEMP_LIMIT_C, PRESSURE_LIMIT_BAR = 105.0, 320.0
RISK_WEIGHTS = {"SEATBELT_VIOLATION": 25.0, "PROXIMITY_RED": 30.0, "PROXIMITY_OTHER": 10.0, "OVERSPEED_CONDITION": 15.0, "HEALTH_THRESHOLD": 10.0}

_FIELDS = {
    "type": "string", "severity": "string", "source_engine": "string", "zone": "string", "metric": "string",
    "state": "string", "idle_ticks": "long", "distance_m": "double", "effective_radius_m": "double",
    "multiplier": "double", "speed_kmh": "double", "cap_kmh": "double", "value": "double", "threshold": "double",
}


def _event(type_: str, severity: str | Column, engine: str, **evidence: Column | str) -> Column:
    values = {"type": type_, "severity": severity, "source_engine": engine, **evidence}
    cols = []
    for name, dtype in _FIELDS.items():
        v = values.get(name)
        col = v if isinstance(v, Column) else F.lit(v)
        cols.append(col.cast(dtype).alias(name))
    return F.struct(*cols)


def seatbelt_event(cfg: Config = Config()) -> Column:
    c = F.col
    loose = c("seatbelt") == "UNFASTENED"
    return (
        F.when(loose & c("state").isin("TRAVEL", "WORKING"), _event("SEATBELT_VIOLATION", "CRITICAL", "safety@1.0", state=c("state")))
        .when(
            loose & (c("state") == "IDLE") & (c("idle_ticks") > cfg.seatbelt_idle_ticks),
            _event("SEATBELT_VIOLATION", "WARNING", "safety@1.0", state=c("state"), idle_ticks=c("idle_ticks")),
        )
    )


def proximity_event() -> Column:
    c = F.col
    near = c("prox_distance_m").isNotNull()
    red = near & ((c("prox_distance_m") < c("red_radius_m")) | (c("prox_zone") == "RED"))
    orange = near & ((c("prox_distance_m") < c("orange_radius_m")) | (c("prox_zone") == "ORANGE"))

    def breach(zone: str, severity: str) -> Column:
        return _event(
            "PROXIMITY_BREACH", severity, "safety@1.0", zone=zone, distance_m=c("prox_distance_m"),
            effective_radius_m=c(f"{zone.lower()}_radius_m"), multiplier=c("condition_multiplier"),
        )

    return F.when(red, breach("RED", "CRITICAL")).when(orange, breach("ORANGE", "WARNING"))


def overspeed_event() -> Column:
    c = F.col
    return F.when(
        (c("state") == "TRAVEL") & (c("speed_kmh") > c("speed_cap_kmh")),
        _event("OVERSPEED_CONDITION", "WARNING", "safety@1.0", speed_kmh=c("speed_kmh"), cap_kmh=c("speed_cap_kmh"), multiplier=c("condition_multiplier")),
    )


def health_event_columns() -> list[Column]:
    def over(metric: str, limit: float, severity: str) -> Column:
        return F.when(
            F.col(metric) > limit,
            _event("HEALTH_THRESHOLD", severity, "health@1.0", metric=metric, value=F.col(metric), threshold=F.lit(limit)),
        )

    return [over("engine_temp_c", TEMP_LIMIT_C, "CRITICAL"), over("hydraulic_pressure_bar", PRESSURE_LIMIT_BAR, "WARNING")]


def frame_events(states: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add ``events``: the rule hits of each frame, in rule order, none to five."""
    rules = F.array(seatbelt_event(cfg), proximity_event(), overspeed_event(), *health_event_columns())
    return states.withColumn("events", F.filter(rules, lambda e: e.isNotNull()))


def with_risk_added(frames: DataFrame) -> DataFrame:
    """Add ``risk_added``: summed weight of the frame's events times the condition factor."""
    w = RISK_WEIGHTS

    def weight(e: Column) -> Column:
        return (
            F.when(e["type"] == "SEATBELT_VIOLATION", w["SEATBELT_VIOLATION"])
            .when((e["type"] == "PROXIMITY_BREACH") & (e["zone"] == "RED"), w["PROXIMITY_RED"])
            .when(e["type"] == "PROXIMITY_BREACH", w["PROXIMITY_OTHER"])
            .when(e["type"] == "OVERSPEED_CONDITION", w["OVERSPEED_CONDITION"])
            .when(e["type"] == "HEALTH_THRESHOLD", w["HEALTH_THRESHOLD"]).otherwise(0.0)
        )

    total = F.aggregate("events", F.lit(0.0), lambda acc, e: acc + weight(e) * F.col("condition_multiplier"))
    return frames.withColumn("risk_added", total)


def explode_events(frames: DataFrame) -> DataFrame:
    """One row per event with its position in the frame and its deterministic id."""
    d = frames.select("machine_id", "operator_id", "site_id", "ts", F.col("seq").alias("frame_seq"), F.posexplode("events").alias("pos", "e"))
    d = d.select("machine_id", "operator_id", "site_id", "ts", "frame_seq", "pos", "e.*")
    return d.withColumn("event_id", hot_event_id(F.col("machine_id"), F.col("frame_seq"), F.col("type"), evidence_key(F.col("zone"), F.col("metric"))))


def evidence_json() -> Column:
    """Free-form evidence of an event as JSON text; absent fields are left out."""
    return F.to_json(F.struct(*[n for n in _FIELDS if n not in ("type", "severity", "source_engine")]))
