"""The operators put together as jobs over a user's own tables.

Each job takes and returns DataFrames; the dictionary keys name the tables a
caller would write. Stages that several results read are staged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from fleetstream.config import Config
from fleetstream.operators import (
    alerts, anomaly, attribution, baselines, eta, explain, incidents, ingest, knowledge, lifecycle, packets, risk, safety, states, windows,
)
from fleetstream.session import stage
from fleetstream.sources.sinks import latest


def safety_job(telemetry: DataFrame, context: DataFrame, machines: DataFrame, cfg: Config = Config()) -> dict[str, DataFrame]:
    """Frames (in seq order per machine, replays dropped) to states, events, risk and delivered alerts."""
    frames = ingest.with_site(telemetry, machines)
    st = stage(states.machine_states(states.with_envelope(states.with_context(frames, context)), cfg), "job-states")
    hits = stage(safety.with_risk_added(safety.frame_events(st, cfg)), "job-hits")
    events = stage(safety.explode_events(hits), "job-events")
    scored = stage(risk.risk_trajectory(hits.drop("events"), "frame", cfg), "job-risk")
    levels = risk.risk_levels(scored, cfg)
    return {
        "states": states.with_ui_mode(st, cfg), "events": events, "risk": levels, "state_log": states.state_log(levels),
        "alerts": alerts.arbitrate(events, cfg), "envelope_changes": states.envelope_changes(st, cfg),
    }


def window_job(
    telemetry: DataFrame, context: DataFrame, machines: DataFrame, events: DataFrame, tasks: DataFrame, users: DataFrame,
    idle_baselines: DataFrame, feature_stats: DataFrame, eta_baseline: DataFrame | None = None,
    forest: DataFrame | None = None, quantiles: DataFrame | None = None, cfg: Config = Config(),
) -> dict[str, DataFrame]:
    """Frames to window features, idle attribution, deviation, anomaly and task-time results with their events."""
    from pyspark.sql import functions as F

    frames = ingest.known_machines(ingest.with_site(telemetry, machines), machines)
    win = windows.minimal_rows(windows.window_features(frames, cfg), cfg)
    win = stage(windows.with_window_context(windows.with_alert_counts(win, events, cfg), context), "job-windows")
    idle = attribution.attribute_idle(attribution.idle_causes(frames, context, events, cfg), cfg)
    d = win.join(idle.drop("machine_id", "window_start", "window_end", "frame_count"), "window_id", "left")
    d = d.join(tasks.select("task_id", F.col("task_type").alias("__t")), "task_id", "left")
    d = d.join(users.select(F.col("user_id").alias("operator_id"), F.col("skill_level").alias("__s")), "operator_id", "left")
    d = d.withColumns({
        "task_type": F.coalesce("__t", F.lit("NONE")), "operator_skill": F.coalesce("__s", F.lit("INTERMEDIATE")), "weather": F.coalesce("weather", F.lit("SUNNY")),
    }).drop("__t", "__s")
    deviated = stage(attribution.persistence(attribution.deviation(attribution.backoff(d, idle_baselines, cfg), cfg), cfg), "job-deviation")
    scored = anomaly.score_anomalies(win, feature_stats, forest, quantiles, cfg)
    live = stage(eta.live_eta(win, tasks, eta_baseline, cfg), "job-live")
    slips = eta.eta_slips(live, win, cfg)
    return {
        "windows": deviated, "anomalies": scored, "eta_live": live, "eta_slips": slips,
        "idle_events": attribution.idle_deviation_events(deviated), "anomaly_events": anomaly.anomaly_events(scored), "eta_events": eta.eta_slip_events(slips),
    }


def incident_job(
    events: DataFrame, risk_levels: DataFrame, window_rows: DataFrame, cfg: Config = Config(), actions: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Events (with an ``evidence`` map) to incidents, links, timeline and the work feed.

    With ``actions`` (incident_id, ts, action, actor_id, note), closes end what
    an incident holds, rows carry the status that the accepted actions leave,
    and the timeline has their steps.
    """
    held = incidents.link_events(events, cfg) if actions is None else lifecycle.with_trigger(lifecycle.link_with_actions(events, actions, cfg))
    linked = stage(incidents.with_risk_level(held, risk_levels), "job-linked")
    rows = incidents.with_task(incidents.incidents(linked), window_rows)
    if actions is None:
        rows = stage(rows, "job-incidents")
        steps = incidents.status_rows(incidents.escalation_steps(incidents.escalations(rows)))
    else:
        moves = stage(lifecycle.lifecycle(linked, actions), "job-moves")
        rows = stage(lifecycle.final_status(moves, rows), "job-incidents")
        raised = incidents.escalation_steps(incidents.escalations(rows), moves)
        steps = incidents.status_rows(raised.unionByName(lifecycle.action_steps(moves, rows)))
    return {
        "linked": linked, "incidents": rows, "timeline": incidents.incident_timeline(linked, cfg).unionByName(steps), "work_feed": incidents.work_feed(rows),
    }


def explanation_job(
    incident_rows: DataFrame, timeline: DataFrame, events: DataFrame, machines: DataFrame, state_rows: DataFrame, tasks: DataFrame, eta_rows: DataFrame,
    window_rows: DataFrame, documents: DataFrame, as_of: Column, cfg: Config = Config(),
) -> dict[str, DataFrame]:
    """Incidents and documents to packets, template explanations and lessons."""
    chunks = stage(knowledge.chunk_documents(documents), "job-chunks")
    postings = stage(knowledge.bm25_postings(chunks), "job-postings")
    terms = stage(knowledge.bm25_terms(postings, chunks), "job-terms")
    slices, weights = knowledge.search_index(postings, terms)
    index = (stage(slices, "job-slices"), stage(weights, "job-weights"))
    state = latest(state_rows.select("machine_id", "ts", "seq", "state", "risk_level"), ["machine_id"], ["ts", "seq"])
    view = latest(window_rows, ["machine_id"], ["window_start"])
    found = stage(packets.incident_packets(incident_rows, timeline, events, machines, state, tasks, eta_rows, view, chunks, index, as_of, cfg), "job-packets")
    return {"packets": found, "explanations": explain.template_explanations(found, "NO_CANDIDATE"), "lessons": explain.template_lessons(found)}


def training_job(hist_windows: DataFrame, hist_tasks: DataFrame, n_days: int, cfg: Config = Config(), trees: int = 200, eta_iterations: int = 600) -> dict:
    """History to baselines, feature statistics, forest with its quantiles, and the task-time model with its bands."""
    from pyspark.sql import functions as F

    train = hist_windows.where(baselines.time_split(F.col("dd"), n_days) == "train")
    forest = stage(anomaly.fit_forest(train, trees=trees), "job-forest")
    tasks = hist_tasks.withColumn("split", baselines.time_split(F.col("dd"), n_days))
    model = eta.fit_eta(tasks, eta_iterations)
    bands = eta.residual_bands(eta.predict_p50(tasks.where("split = 'val'"), model))
    return {
        "idle_baselines": baselines.idle_baselines(train, cfg), "feature_stats": baselines.feature_stats(train), "forest": forest,
        "forest_quantiles": baselines.score_quantiles(anomaly.forest_scores(baselines.eligible(train), forest).select("raw_score"), "raw_score"),
        "eta_model": model, "eta_bands": bands,
    }
