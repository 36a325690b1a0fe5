"""Schemas of the records that enter the library."""

from __future__ import annotations

from pyspark.sql import types as T

PROXIMITY = T.StructType([
    T.StructField("zone", T.StringType()), T.StructField("distance_m", T.DoubleType()), T.StructField("source", T.StringType()),
])
TELEMETRY = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("machine_id", T.StringType()),
    T.StructField("operator_id", T.StringType()), T.StructField("task_id", T.StringType()), T.StructField("engine_rpm", T.DoubleType()),
    T.StructField("engine_temp_c", T.DoubleType()), T.StructField("hydraulic_pressure_bar", T.DoubleType()),
    T.StructField("fuel_rate_lph", T.DoubleType()), T.StructField("speed_kmh", T.DoubleType()), T.StructField("seatbelt", T.StringType()),
    T.StructField("proximity", PROXIMITY), T.StructField("cycle_completed", T.BooleanType()), T.StructField("truck_present", T.BooleanType()),
    T.StructField("hauler_queue_len", T.IntegerType()), T.StructField("gps", T.ArrayType(T.DoubleType())), T.StructField("sig", T.StringType()),
])
CONTEXT = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("site_id", T.StringType()), T.StructField("weather", T.StringType()),
    T.StructField("rainfall_mm_h", T.DoubleType()), T.StructField("visibility_m", T.DoubleType()), T.StructField("ambient_temp_c", T.DoubleType()),
    T.StructField("wind_kmh", T.DoubleType()), T.StructField("ground", T.StringType()), T.StructField("daylight", T.BooleanType()),
])
EVENT = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("severity", T.StringType()),
    T.StructField("machine_id", T.StringType()), T.StructField("operator_id", T.StringType()), T.StructField("site_id", T.StringType()),
    T.StructField("ts", T.TimestampType()), T.StructField("source_engine", T.StringType()),
    T.StructField("evidence", T.MapType(T.StringType(), T.StringType())), T.StructField("frame_seq", T.LongType()),
])
HIST_WINDOW_DDL = (
    "window_id string, day int, split string, machine_id string, site_id string, operator_id string, operator_skill string, task_type string, "
    "weather string, ground string, rainfall_mm_h double, visibility_m double, wind_kmh double, window_s int, is_anomaly boolean, anomaly_type string, "
    "target_cycles int, idle_s_PLANNED double, idle_s_MACHINE double, idle_s_WEATHER double, idle_s_SITE double, idle_s_OPERATOR double, "
    "truck_present_ratio double, hauler_queue_mean double, working_ratio double, cycle_count int, fuel_per_cycle double, rpm_mean double, "
    "rpm_std double, hyd_p95 double, idle_ratio double, cycle_time_mean double, cycle_time_cv double, temp_slope double, fuel_l_total double"
)
HIST_TASK_DDL = (
    "task_id string, day int, split string, machine_id string, site_id string, machine_type string, machine_age_years int, operator_id string, "
    "operator_skill string, task_type string, target_cycles int, weather string, rainfall_mm_h double, visibility_m double, wind_kmh double, "
    "ambient_temp_c double, ground string, hauler_queue_mean double, actual_min double, planner_estimate_min double, queue_delay_min double"
)
REQUIRED_TELEMETRY = ["seq", "ts", "machine_id", "operator_id", "engine_rpm", "engine_temp_c", "hydraulic_pressure_bar", "fuel_rate_lph", "speed_kmh", "seatbelt"]
