"""Readers of files, flattening, and the timer of the window stream."""

import gzip
import time
from datetime import datetime
from dataclasses import replace

from pyspark.sql import functions as F

from fleetstream import schemas
from fleetstream.config import Config
from fleetstream.operators.knowledge import chunk_documents
from fleetstream.session import stage_path
from fleetstream.sources import dimensions, records
from fleetstream.streaming import keyed, native, run, timers


def test_history_csv_keeps_empty_task_type_as_a_group(spark, tmp_path):
    cols = [c.strip().split(" ")[0] for c in schemas.HIST_WINDOW_DDL.split(",")]
    row = {c: "" for c in cols} | {"window_id": "w", "day": "3", "window_s": "300", "idle_s_SITE": "12.5"}
    path = str(tmp_path / "windows.csv.gz")
    with gzip.open(path, "wt") as f:
        f.write(",".join(cols) + "\n" + ",".join(row[c] for c in cols) + "\n" + ",".join((row | {"task_type": "GRADING"})[c] for c in cols) + "\n")
    d = records.history_windows(records.read_history(spark, path, schemas.HIST_WINDOW_DDL))
    assert sorted((r.task_type, r.idle_s_SITE, r.day) for r in d.collect()) == [("GRADING", 12.5, 3), ("NONE", 12.5, 3)]


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a-guide.md").write_text("---\ntitle: A\ntags: [X]\n---\n\n## One\n\ntext\n")
    (tmp_path / "b.md").write_text("## Two\nbody")
    got = chunk_documents(records.read_documents(spark, str(tmp_path))).collect()
    assert sorted((r.chunk_id, r.title) for r in got) == [("a-guide#one", "A"), ("b#two", "b")]


def test_flatten_and_parse(spark, pipe):
    good, bad = records.parse_telemetry(pipe.t("raw_frames"))
    flat = records.flatten_telemetry(good)
    assert {"proximity_zone", "gps_lat"} <= set(flat.columns) and "proximity" not in flat.columns
    assert good.count() + bad.count() == pipe.t("raw_frames").count()


def test_context_without_site_is_dropped(spark):
    d = spark.createDataFrame([('{"ts":"2026-01-01T00:00:00Z","weather":"RAIN","ground":"WET"}',), ("{}",), ("no json",)], "value string")
    assert records.parse_context(d).count() == 0


def test_dimensions(spark):
    assert dimensions.machines(spark).count() == 6
    assert dimensions.levels(spark).where("field = 'ground'").count() == 4
    assert dimensions.duration_factors(spark).where("level = 'RAIN'").first().factor == 1.18


def test_replays_dropped_in_stream(spark, pipe):
    d = run.drain(native.unique_within(pipe.stream("arrivals")), "t_replays")
    assert d.count() == pipe.t("arrivals").select("machine_id", "seq").distinct().count()


def test_frames_of_old_or_low_seq_dropped_in_stream(spark, tmp_path):
    ddl = "machine_id string, seq long, ts timestamp"
    parts = [[("a", 1, 0), ("a", 3, 1), ("a", 2, 2), ("b", 5, 0), (None, 1, 0)], [("a", 3, 90000), ("a", 4, 90001), ("b", 5, 90000), ("b", 6, 90002), (None, 1, 90000)]]
    for k, rows in enumerate(parts):
        spark.createDataFrame([(m, s, datetime.fromtimestamp(t)) for m, s, t in rows], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1 * (k == 0))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run.drain(keyed.without_replays(stream), "t_replays_state").collect()
    assert sorted((str(r.machine_id), r.seq) for r in got) == [("None", 1), ("a", 1), ("a", 3), ("a", 4), ("b", 5), ("b", 6)]


def test_silent_window_closes_by_timer(spark):
    rows = [(m, i, datetime.fromtimestamp(1_767_225_600 + t)) for m, times in {"a": [0, 5, 31, 36, 200, 205], "b": [1, 64, 65], "c": [3]}.items() for i, t in enumerate(times)]
    d = spark.createDataFrame(rows, "machine_id string, seq long, ts timestamp")
    tick = spark.createDataFrame([(None, None, datetime.fromtimestamp(1_767_225_600 + 9000))], d.schema)
    cfg = replace(Config(), window_s=30, lateness_s=5, inactivity_s=60)
    want = [("a", 0, 2, 0, 1, "EVENT_TIME"), ("a", 30, 2, 2, 3, "INACTIVE"), ("a", 180, 2, 4, 5, "INACTIVE"), ("b", 0, 1, 0, 0, "INACTIVE"), ("b", 60, 2, 1, 2, "INACTIVE"), ("c", 0, 1, 0, 0, "INACTIVE")]
    for slices in (2, 5):  # the result doesn't depend on where batches are cut, nor on restarts
        got = run.replay(d, "ts", lambda s: timers.closed_on_timer(s, cfg), "t_timer", slices, tick).collect()
        assert sorted((r.machine_id, r.window_start - 1_767_225_600, r.frame_count, r.first_seq, r.last_seq, r.reason) for r in got) == want
