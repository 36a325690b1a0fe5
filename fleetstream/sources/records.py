"""Typed records from text: telemetry, context, events, history files, documents.

Each parser takes a DataFrame with a ``value`` text column, so it serves batch
reads (``spark.read.text``) and streams (``spark.readStream``) alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstream import schemas


def parse_telemetry(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(typed frames with flat proximity, quarantined text)."""
    d = raw.select("value", F.from_json("value", schemas.TELEMETRY, {"mode": "PERMISSIVE"}).alias("r"))
    ok = F.col("r").isNotNull()
    for name in schemas.REQUIRED_TELEMETRY:
        ok = ok & F.col("r")[name].isNotNull()
    flat = d.where(ok).select("r.*").withColumns({
        "prox_zone": F.col("proximity.zone"), "prox_distance_m": F.col("proximity.distance_m"), "prox_source": F.col("proximity.source"),
    })
    return flat, d.where(~ok).select("value")


def flatten_telemetry(frames: DataFrame) -> DataFrame:
    """Nested frame to flat columns, as carried on the wire."""
    return frames.select(
        *[c for c in frames.columns if c not in ("proximity", "gps")],
        F.col("proximity.zone").alias("proximity_zone"), F.col("proximity.distance_m").alias("proximity_distance_m"),
        F.col("proximity.source").alias("proximity_source"),
        F.col("gps")[0].alias("gps_lat"), F.col("gps")[1].alias("gps_lon"),
    )


def parse_context(raw: DataFrame) -> DataFrame:
    """Context records with defaults; records without time, site, weather or ground are dropped (the one before stays)."""
    d = raw.select(F.from_json("value", schemas.CONTEXT).alias("r")).select("r.*")
    d = d.where(F.col("ts").isNotNull() & F.col("site_id").isNotNull() & F.col("weather").isNotNull() & F.col("ground").isNotNull())
    return d.na.fill({"rainfall_mm_h": 0.0, "visibility_m": 9999.0, "ambient_temp_c": 20.0, "wind_kmh": 0.0, "daylight": True})


def parse_events(raw: DataFrame) -> DataFrame:
    """Event envelopes; the discriminating evidence fields become columns."""
    d = raw.select(F.from_json("value", schemas.EVENT).alias("r")).select("r.*").where(F.col("event_id").isNotNull())
    e = F.col("evidence")
    return d.withColumns({"zone": e["zone"], "metric": e["metric"], "state": e["state"], "reading": e["reading"]})


def event_envelopes(events: DataFrame) -> DataFrame:
    """Events as JSON text, the inverse of ``parse_events``."""
    evidence = F.map_filter(
        F.create_map(
            F.lit("zone"), F.col("zone"), F.lit("metric"), F.col("metric"), F.lit("state"), F.col("state"),
            F.lit("reading"), F.col("reading").cast("string"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return events.select(F.to_json(F.struct(
        "event_id", "type", "severity", "machine_id", "operator_id", "site_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "source_engine", evidence.alias("evidence"), "frame_seq",
    )).alias("value"))


def read_history(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """History CSV (also .csv.gz) with a given schema; nothing is inferred."""
    return spark.read.csv(path, schema=ddl, header=True)


def history_windows(windows: DataFrame) -> DataFrame:
    """Windows without a task get a group of their own instead of an empty or NULL key."""
    return windows.withColumn("task_type", F.coalesce(F.nullif(F.col("task_type"), F.lit("")), F.lit("NONE")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``file_stem`` and ``raw``."""
    d = spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")
    return d.withColumn("file_stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)).select("file_stem", "raw")
