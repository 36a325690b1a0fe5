"""The jobs run end to end on derived tables and agree with the single operators."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from fleetstream.operators import lifecycle
from fleetstream.plans import jobs


def test_safety_windows_incidents_explanations(spark, pipe):
    cfg = pipe.cfg
    hot = jobs.safety_job(pipe.t("telemetry"), pipe.t("context"), pipe.t("machines"), cfg)
    assert hot["events"].count() == pipe.t("hot_events").count()
    assert hot["risk"].groupBy("risk_level").count().count() >= 2
    warm = jobs.window_job(
        pipe.t("telemetry"), pipe.t("context"), pipe.t("machines"), hot["events"], pipe.t("tasks"), pipe.t("users"), pipe.t("idle_baselines"),
        pipe.t("feature_stats"), pipe.t("eta_baseline"), cfg=cfg,
    )
    known = {r.machine_id for r in pipe.t("machines").collect()}
    assert warm["windows"].count() == pipe.t("windows").where(F.col("machine_id").isin(*known)).count()
    evidence = F.map_filter(F.create_map(F.lit("zone"), "zone", F.lit("metric"), "metric", F.lit("state"), "state"), lambda k, v: v.isNotNull())
    feed = hot["events"].withColumn("evidence", evidence)
    cold = jobs.incident_job(feed, hot["risk"].select("machine_id", "ts", "risk_level"), warm["windows"], cfg)
    n = cold["incidents"].count()
    assert 0 < n <= feed.count() and cold["linked"].groupBy("event_id").count().where("count > 1").count() == 0
    out = jobs.explanation_job(
        cold["incidents"], cold["timeline"], feed, pipe.t("machines"), hot["risk"], pipe.t("tasks"),
        warm["eta_live"].groupBy("task_id").agg(F.first("status").alias("eta_status"), F.max("eta_total_p50_min").alias("eta_total_p50_min")),
        warm["windows"], pipe.t("knowledge_docs"), F.lit(datetime(2026, 1, 2, tzinfo=timezone.utc)), cfg,
    )
    assert out["packets"].count() == n and out["explanations"].where("size(probable_causes) > 0 and lesson is not null").count() == n
    assert out["lessons"].count() == n
    # the same with manual actions: statuses follow them, and an escalation of an acknowledged incident says so
    acted = jobs.incident_job(pipe.t("feed"), pipe.t("risk_feed"), warm["windows"], cfg, pipe.t("actions"))
    moves = lifecycle.lifecycle(acted["linked"], pipe.t("actions"))
    last = {}
    for r in sorted(moves.where("incident_id is not null").collect(), key=lambda r: (r.ts, {"ESCALATE": 0, "ACK": 1}.get(r.action, 2))):
        last[r.incident_id] = r.to_status
    rows = acted["incidents"].select("incident_id", "status").collect()
    assert {r.status for r in rows} >= {"OPEN", "CLOSED"} and all(r.status == last.get(r.incident_id, "OPEN") for r in rows)
    again = {(r.incident_id, r.ts) for r in moves.where("action = 'ESCALATE' and from_status = 'ACKNOWLEDGED'").collect()}
    noted = {(r.incident_id, r.first_ts) for r in acted["timeline"].where("summary like '%(re-opened from ACKNOWLEDGED)'").collect()}
    assert noted == again
