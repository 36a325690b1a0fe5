"""Thresholds and sizes used by the operators, in one immutable place."""

from __future__ import annotations

from dataclasses import dataclass

# Cause priority, most specific first.
IDLE_CAUSES = ("PLANNED", "MACHINE", "WEATHER", "SITE", "OPERATOR")

# Window features used by the anomaly operators, in model order.
WINDOW_FEATURES = (
    "fuel_per_cycle", "rpm_mean", "rpm_std", "hyd_p95",
    "idle_ratio", "cycle_time_mean", "cycle_time_cv", "temp_slope",
)

# Severity order.
SEVERITY_RANK = {"INFO": 0, "WARNING": 1, "CRITICAL": 2}


@dataclass(frozen=True)
class Config:
    # ingest
    freshness_s: int = 30
    shards: int = 4
    # machine state
    idle_dwell: int = 5
    idle_hub_ticks: int = 30
    seatbelt_idle_ticks: int = 10
    # risk
    risk_half_life_s: float = 300.0
    # alerts
    alert_window_s: int = 30
    flood_threshold: int = 10
    flood_width_s: int = 1
    # windows
    window_s: int = 30
    lateness_s: int = 5
    min_frames: int = 20
    inactivity_s: int = 40
    seconds_per_frame: float = 1.0
    # idle attribution
    planned_breaks: str = ""
    weather_stop_rain_mm_h: float = 20.0
    weather_stop_visibility_m: float = 50.0
    weather_stop_wind_kmh: float = 60.0
    fault_hold_s: int = 120
    idle_dev_ratio: float = 2.0
    idle_dev_robust_z: float = 2.5
    idle_dev_persist: int = 2
    baseline_min_n: int = 20
    ewma_alpha: float = 0.1
    # anomaly
    anomaly_threshold: float = 0.97
    robust_z_threshold: float = 3.5
    # task time
    eta_slip: float = 0.10
    eta_slip_warning: float = 0.25
    eta_min_cycles: int = 3
    # fewest validation rows of a task type that give it a band of its own
    eta_band_min_n: int = 30
    # incidents
    correlation_window_s: int = 300
    timeline_merge_s: int = 30
    reconcile_lookback_s: int = 900
    extend_push_throttle_s: int = 5
    # packets
    packet_timeline: int = 40
    packet_head: int = 10
    packet_events: int = 25
    knowledge_top_k: int = 5
    knowledge_text_chars: int = 800
    # read models
    stale_s: int = 10
    # physical: rows of one key that one task may scan in order
    chunk_s: int = 900
    chunk_rows: int = 900
