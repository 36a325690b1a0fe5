"""Retrieval, packet, explanation, lesson, audit and lifecycle queries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from fleetstream.functions import text
from fleetstream.functions.ids import incident_id, lesson_id
from fleetstream.operators import audit, explain, grounding, incidents, knowledge, lifecycle, packets, retrieval, states
from fleetstream.plans.oracle import cte
from fleetstream.plans.pipeline import stage_table
from fleetstream.plans.q_ingest import uuid5_sql
from fleetstream.plans.q_safety import r
from fleetstream.plans.registry import query
from fleetstream.sources.sinks import latest

SEC = F.unix_seconds
AS_OF = datetime(2026, 1, 1, 12, 0, tzinfo=timezone.utc)


def _now():
    return F.lit(AS_OF).cast("timestamp")


# --- stages ------------------------------------------------------------------

@stage_table("chunks")
def _chunks(p):
    return knowledge.chunk_documents(p.t("knowledge_docs"))


@stage_table("postings")
def _postings(p):
    return knowledge.bm25_postings(p.t("chunks"))


@stage_table("terms")
def _terms(p):
    return knowledge.bm25_terms(p.t("postings"), p.t("chunks"))


@stage_table("slices")
def _slices(p):
    return knowledge.search_index(p.t("postings"), p.t("terms"))[0]


@stage_table("weights")
def _weights(p):
    return knowledge.search_index(p.t("postings"), p.t("terms"))[1]


def _latest_windows(p):
    d = p.t("deviations").select(
        "machine_id", "window_start", "weather", "ground", "s_planned", "s_machine", "s_weather", "s_site", "s_operator", "primary_cause", "operator_deviation_flag"
    )
    return latest(d, ["machine_id"], ["window_start"])


@stage_table("packets")
def _packets(p):
    from fleetstream.operators import eta

    est = eta.latest_eta(p.t("tasks"), p.t("live_eta"), p.t("eta_baseline"))
    state = latest(p.t("risk_levels").select("machine_id", "ts", "seq", "state", "risk_level"), ["machine_id"], ["ts", "seq"])
    return packets.incident_packets(
        p.t("incidents"), p.t("timeline"), p.t("feed"), p.t("machines"), state, p.t("tasks"), est, _latest_windows(p), p.t("chunks"),
        (p.t("slices"), p.t("weights")), _now(), p.cfg,
    )


@stage_table("actions")
def _actions(p):
    c = F.col
    d = p.t("feed").where("severity <> 'INFO'").withColumn("incident_id", incident_id(c("machine_id"), c("event_id")))
    at = lambda s: F.timestamp_seconds(SEC("ts") + s)
    actor = F.concat(F.lit("SUP"), c("frame_seq") % 7)
    ack = d.where("frame_seq % 4 = 0").select("incident_id", F.lit("ACK").alias("action"), actor.alias("actor_id"), at(c("reading") % 60).alias("ts"), F.lit(None).cast("string").alias("note"))
    close = d.where("frame_seq % 6 = 0").select("incident_id", F.lit("CLOSE").alias("action"), actor.alias("actor_id"), at(60 + c("reading") % 240).alias("ts"), F.concat(F.lit("note "), c("event_id")).alias("note"))
    return ack.unionByName(close)


# --- retrieval ---------------------------------------------------------------

cte(
    "chunks_sql",
    """select doc_id || '#' || trim(regexp_replace(lower(trim(heading)), '[^a-z0-9]+', '-', 'g'), '-') chunk_id, * from (
      select doc_id, tags, position, trim(split_part(s, chr(10), 1)) heading, regexp_replace(substr(s, instr(s, chr(10))), '^\\s+|\\s+$', '', 'g') body from (
      select doc_id, tags, unnest(list_slice(parts, 2, len(parts))) s, generate_subscripts(list_slice(parts, 2, len(parts)), 1) - 1 position from (
      select regexp_extract(raw, 'doc_id: (\\S+)', 1) doc_id, string_split(regexp_extract(raw, 'tags: \\[([^\\]]*)\\]', 1), ', ') tags,
        regexp_split_to_array(regexp_extract(raw, '(?s)^---.*?---(.*)$', 1), '(?m)^##\\s+') parts from knowledge_docs)))""",
)
cte("tok", "select chunk_id, tags, unnest(regexp_extract_all(lower(heading || ' ' || body), '[a-z0-9]+')) term from chunks_sql")
cte("dlen", "select chunk_id, count(t.term) dl from chunks_sql left join tok t using (chunk_id) group by chunk_id")
cte("tfs", "select chunk_id, term, count(*) tf from tok group by all")
cte("idfs", "select term, df, case when raw < 0 then 0.25e0 * (avg(raw) over ()) else raw end idf from (select term, count(*) df, ln(((select count(*) from chunks_sql) - count(*) + 0.5e0) / (count(*) + 0.5e0)) raw from tfs group by term)")
cte("posts", "select t.chunk_id, t.term, t.tf * 2.5e0 / (t.tf + 1.5e0 * (0.25e0 + 0.75e0 * d.dl / (select avg(dl) from dlen))) tf_factor from tfs t join dlen d using (chunk_id)")
cte("qterms", "select query_id, tag, term, count(*) qtf from (select query_id, tag, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) term from searches) group by all")
cte(
    "found",
    """select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) rk from (
      select q.query_id, p.chunk_id, round(sum(q.qtf * i.idf * p.tf_factor) * case when list_contains(any_value(c.tags), any_value(q.tag)) then 1.5e0 else 1e0 end, 9) score
      from qterms q join posts p using (term) join idfs i using (term) join chunks_sql c on c.chunk_id = p.chunk_id group by q.query_id, p.chunk_id)""",
)


@query("k1_chunks", "select chunk_id, doc_id, heading, len(body) text_chars, md5(body) text_md5, array_to_string(tags, ',') tags from chunks_sql")
def _(p):
    d = knowledge.chunk_documents(p.t("knowledge_docs"))
    return d.select("chunk_id", "doc_id", "heading", F.length("text").cast("long").alias("text_chars"), F.md5("text").alias("text_md5"), F.array_join("tags", ",").alias("tags"))


@query("a5_document_source", "select distinct doc_id, 'Guide ' || substr(doc_id, 2) title, array_to_string(tags, ',') tags from chunks_sql")
def _(p):
    return knowledge.chunk_documents(p.t("knowledge_docs")).select("doc_id", "title", F.array_join("tags", ",").alias("tags")).distinct()


@query("k1_duplicates", "select chunk_id, count(*) n from (select chunk_id from chunks_sql union all select chunk_id from chunks_sql where position = 1) group by chunk_id having count(*) > 1")
def _(p):
    d = p.t("chunks")
    return knowledge.duplicate_chunks(d.unionByName(d.where("position = 1")))


@query("k2_tokens", "select query_id, cast(len(regexp_extract_all(lower(query), '[a-z0-9]+')) as bigint) n, array_to_string(regexp_extract_all(lower(query), '[a-z0-9]+'), ' ') tokens from searches")
def _(p):
    t = text.tokens(F.col("query"))
    return p.t("searches").select("query_id", F.size(t).cast("long").alias("n"), F.array_join(t, " ").alias("tokens"))


@query("k3_postings", "select term, count(*) chunks, round(sum(tf_factor), 5) factor from posts group by term")
def _(p):
    d = knowledge.bm25_index(p.t("chunks"))[0]
    return d.groupBy("term").agg(F.count("*").alias("chunks"), F.round(F.sum("tf_factor"), 5).alias("factor"))


@query("k3_idf", "select term, df, round(idf, 6) idf from idfs")
def _(p):
    return knowledge.bm25_index(p.t("chunks"))[1].select("term", "df", r("idf", 6))


@query("k4_search", "select query_id, cast(rk as int) rank, chunk_id, round(score, 6) score from found where rk <= 5")
def _(p):
    q = p.t("searches").select("query_id", "query", F.array("tag").alias("tags"))
    return knowledge.bm25_search(q, p.t("chunks"), (p.t("slices"), p.t("weights")), 5).select("query_id", "rank", "chunk_id", r("score", 6))


@query("k4_index", "select term, count(*) chunks, round(max(tf_factor), 6) top, round(sum(tf_factor), 5) factor from posts group by term")
def _(p):
    c = F.col
    d = p.t("slices").where(~c("term").startswith(retrieval.TAG) & (c("term") != retrieval.IDS)).select("term", F.explode("blocks").alias("b"))
    d = d.select("term", "b.top", F.size("b.postings").alias("n"), F.aggregate("b.postings", F.lit(0.0), lambda a, x: a + x["impact"]).alias("f"))
    return d.groupBy("term").agg(F.sum("n").alias("chunks"), F.round(F.max("top"), 6).alias("top"), F.round(F.sum("f"), 5).alias("factor"))


cte("bnd0", "select *, row_number() over (partition by incident_id order by first_ts, entry_key) r, count(*) over (partition by incident_id) n from tl")
cte("bnd", "select *, r position from bnd0 where n <= 40 or r <= 10 or r > n - 30")
cte("lastwin", "select machine_id, arg_max(coalesce(weather, 'SUNNY'), ws) weather, arg_max(coalesce(ground, ''), ws) ground from feat_ctx group by machine_id")


@query(
    "k5_incident_query",
    """select b.incident_id, concat_ws(' ', string_agg(summary, ' ' order by position), any_value(w.weather), nullif(any_value(w.ground), '')) AS query, array_to_string(list_sort(list(distinct event_type)), ',') tags
      from bnd b join inc i using (incident_id) left join lastwin w on w.machine_id = i.machine_id group by b.incident_id""",
)
def _(p):
    ctx = p.t("incidents").select("incident_id", "machine_id").join(_latest_windows(p).select("machine_id", "weather", "ground"), "machine_id", "left")
    d = knowledge.incident_queries(packets.bounded_timeline(p.t("timeline"), p.cfg), ctx.select("incident_id", "weather", "ground"))
    return d.select(F.col("query_id").alias("incident_id"), "query", F.array_join("tags", ",").alias("tags"))


# --- packets -----------------------------------------------------------------

@query(
    "k6_packets",
    """select i.incident_id, count(b.position) timeline_rows, any_value(b.n) > 40 timeline_truncated, any_value(m.type) machine_type, any_value(i.task_id) task_id, 5 knowledge_rows
      from inc_task i left join bnd b using (incident_id) left join machines m on m.machine_id = i.machine_id group by i.incident_id""",
)
def _(p):
    d = p.t("packets")
    return d.select(
        "incident_id", F.size("timeline").cast("long").alias("timeline_rows"), "timeline_truncated", F.col("machine")["type"].alias("machine_type"), "task_id", F.size("knowledge").alias("knowledge_rows")
    )


@query("k7_bounded_timeline", "select incident_id, entry_key, cast(epoch(first_ts) as bigint) first_s, cast(position as bigint) position, n total from bnd")
def _(p):
    return packets.bounded_timeline(p.t("timeline"), p.cfg).select("incident_id", "entry_key", SEC("first_ts").alias("first_s"), "position", "total")


@query("k7_bounded_small", "select incident_id, entry_key, cast(r as bigint) position from bnd0 where n <= 3 or r <= 2 or r > n - 1")
def _(p):
    from dataclasses import replace

    return packets.bounded_timeline(p.t("timeline"), replace(p.cfg, packet_timeline=3, packet_head=2)).select("incident_id", "entry_key", "position")


@query(
    "k8_evidence",
    """select event_id, concat_ws(',', case when type = 'HEALTH_THRESHOLD' then 'metric=' || metric end, case when type = 'SEATBELT_VIOLATION' then 'state=' || state end,
      case type when 'PROXIMITY_BREACH' then 'distance_m=' || reading when 'OVERSPEED_CONDITION' then 'speed_kmh=' || reading when 'HEALTH_THRESHOLD' then 'value=' || reading when 'IDLE_DEVIATION' then 'deviation_ratio=' || reading end,
      case when type = 'PROXIMITY_BREACH' then 'zone=' || zone end) evidence from event_feed""",
)
def _(p):
    d = p.t("feed").select("event_id", packets.allowed_evidence().alias("e"))
    pairs = F.array_sort(F.transform(F.map_entries("e"), lambda x: F.concat_ws("=", x["key"], x["value"])))
    return d.select("event_id", F.array_join(pairs, ",").alias("evidence"))


@query("k9_history", "select machine_id, category, count(*) n from inc where epoch(opened_at) >= epoch(timestamp '2026-01-01 12:00:00') - 7 * 86400 group by all")
def _(p):
    return packets.category_history(p.t("incidents"), _now())


_HASH_SQL = """sha256('{"category":"' || category || '","event_count":' || event_count || ',"incident_id":"' || incident_id || '","severity":"' || severity || '"}')"""


@query("k10_packet_hash", f"select incident_id, {_HASH_SQL} packet_hash from inc where event_count % 3 <> 0")
def _(p):
    d = p.t("incidents").withColumn("packet_hash", packets.packet_hash("category", "event_count", "incident_id", "severity"))
    stored = d.where("event_count % 3 = 0").select("incident_id", "packet_hash")
    return packets.unexplained(d, stored).select("incident_id", "packet_hash")


# --- grounding ---------------------------------------------------------------

_Z = "cast(substr(trigger_event_id, 2) as bigint) % 10"


@stage_table("candidates")
def _candidates(p):
    """Candidate explanations with planted faults, one kind per last digit of the trigger."""
    c = F.col
    z = F.expr(_Z)
    none = F.array().cast("array<string>")
    d = p.t("incidents").withColumn("z", z)
    return d.select(
        "incident_id", "trigger_event_id", "operator_id", "z",
        F.when(c("z") == 1, "It is proven that the cap failed").when(c("z") == 2, F.concat(F.lit("See "), c("incident_id"))).when(c("z") == 3, F.repeat(F.lit("long "), 140)).otherwise("An incident").alias("summary"),
        F.array(F.struct(
            F.when(c("z") == 4, "The root cause is speed").otherwise("Speed").alias("cause"),
            F.when(c("z") == 5, F.array(F.lit("nope"), c("trigger_event_id"))).when(c("z") == 6, none).otherwise(F.array(c("trigger_event_id"))).alias("evidence_refs"),
            F.when(c("z") == 7, "SURE").otherwise("MEDIUM").alias("likelihood"),
        )).alias("probable_causes"),
        F.array(F.struct(
            F.lit("Slow down").alias("action"), F.when(c("z") == 8, "As in kb#other").otherwise("Safer").alias("rationale"),
            F.when(c("z") == 9, F.array(F.lit("kb#none"))).otherwise(F.array(F.lit("kb#intro"))).alias("knowledge_refs"),
        )).alias("recommended_actions"),
        F.struct(F.lit("Title").alias("title"), F.lit("Tip").alias("tip"), F.array(F.lit("kb#intro")).alias("knowledge_refs")).alias("lesson"),
        F.array(F.lit("kb#intro")).alias("training_refs"), F.lit("LOW").alias("confidence"),
    )


def _allowed(p):
    return p.t("incidents").select("incident_id", F.array("trigger_event_id").alias("allowed_event_ids"), F.array(F.lit("kb#intro")).alias("allowed_chunk_ids"))


def _checked(p, column, name):
    d = p.t("candidates").join(_allowed(p), "incident_id")
    return d.select("incident_id", F.array_join(column, "; ").alias(name)).where(F.col(name) != "")


cte("candz", f"select incident_id, machine_id, operator_id, category, trigger_event_id, {_Z} z from inc")


@query(
    "k11_unknown_refs",
    """select incident_id, case z when 5 then 'probable_causes[0].evidence_refs: unknown event id ''nope''' when 6 then 'probable_causes[0]: no evidence_refs'
      else 'recommended_actions[0].knowledge_refs: unknown chunk id ''kb#none''' end violations from candz where z in (5, 6, 9)""",
)
def _(p):
    return _checked(p, grounding.unknown_refs(), "violations")


@query(
    "k12_smuggled",
    """select incident_id, case z when 2 then 'smuggled_ref: unknown event id ''' || incident_id || ''' in free text field summary'
      else 'smuggled_ref: unknown chunk id ''kb#other'' in free text field recommended_actions[0].rationale' end violations from candz where z in (2, 8)""",
)
def _(p):
    return _checked(p, grounding.smuggled_refs(), "violations")


@query(
    "k13_forbidden",
    """select incident_id, case z when 1 then 'forbidden_claim: ''proven'' found in summary' else 'forbidden_claim: ''root cause is'' found in probable_causes[0].cause' end violations from candz where z in (1, 4)""",
)
def _(p):
    return _checked(p, grounding.forbidden_claims(), "violations")


@query("k14_schema", "select incident_id, case z when 3 then 'schema: summary' when 6 then 'schema: probable_causes.evidence_refs' else 'schema: probable_causes.likelihood' end violations from candz where z in (3, 6, 7)")
def _(p):
    return _checked(p, grounding.schema_violations(), "violations")


@query("k14_all_checks", "select incident_id, cast(case when z = 0 then 0 else 1 end as int) n from candz")
def _(p):
    return grounding.grounding_violations(p.t("candidates"), _allowed(p)).select("incident_id", F.size("violations").alias("n"))


# --- explanations and lessons ------------------------------------------------

def _case(col: str, table: dict, default: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return f"case {col} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in table.items()) + f" else {q(default)} end"


cte("types_in_order", "select incident_id, event_type, min(position) pos from bnd group by all")
cte(
    "tops",
    "select incident_id, string_agg(event_type || ' x' || count, ', ' order by rk) top3 from (select *, row_number() over (partition by incident_id order by count desc, position) rk from bnd) where rk <= 3 group by incident_id",
)


@query(
    "k15_explanations",
    """select incident_id, left(i.severity || ' incident on ' || i.machine_id || ': ' || nt || ' event types between ' || strftime(f, '%Y-%m-%dT%H:%M:%S+00:00') || ' and ' || strftime(l, '%Y-%m-%dT%H:%M:%S+00:00')
        || ' (' || top3 || '). Explanation generated without the LLM (NO_CANDIDATE).', 600) summary, cast(least(nt, 4) as int) causes, cast(least(nt, 5) as int) actions, """
    + _case("t1", {k: v[0] for k, v in explain.ACTION_TEXT.items()}, explain.DEFAULT_ACTION[0])
    + """ action1 from inc i join (select incident_id, count(*) nt, arg_min(event_type, pos) t1 from types_in_order group by 1) using (incident_id)
      join tops using (incident_id) join (select incident_id, arg_min(first_ts, position) f, arg_max(last_ts, position) l from bnd group by 1) using (incident_id)""",
)
def _(p):
    d = explain.template_explanations(p.t("packets"), "NO_CANDIDATE")
    return d.select("incident_id", "summary", F.size("probable_causes").alias("causes"), F.size("recommended_actions").alias("actions"), F.col("recommended_actions")[0]["action"].alias("action1"))


@query(
    "k15_causes",
    """select incident_id, case b.event_type when 'SEATBELT_VIOLATION' then 'Seatbelt was unfastened while the machine was ' || coalesce(e.state, 'unknown')
      when 'PROXIMITY_BREACH' then 'A person or obstacle was detected within the ' || coalesce(e.zone, 'unknown') || ' proximity zone' when 'HEALTH_THRESHOLD' then coalesce(e.metric, 'unknown') || ' exceeded its safe operating threshold'
      when 'OVERSPEED_CONDITION' then 'Machine speed exceeded the condition-adjusted cap' else 'Idle time was above the expected baseline for this context' end cause, b.representative_event_id ref
      from bnd b join event_feed e on e.event_id = b.representative_event_id where b.position = 1""",
)
def _(p):
    d = explain.template_explanations(p.t("packets"), "NO_CANDIDATE")
    first = F.col("probable_causes")[0]
    return d.select("incident_id", first["cause"].alias("cause"), first["evidence_refs"][0].alias("ref"))


@query(
    "k16_lessons",
    f"select {uuid5_sql(chr(39) + 'lesson:' + chr(39) + '||incident_id')} lesson_id, incident_id, operator_id, {_case('category', explain.TIP_TEXT, explain.DEFAULT_TIP)} short_tip, "
    f"{_case('category', explain.LESSON_TEXT, explain.DEFAULT_LESSON)} explanation, "
    + _case("category", {k: k.replace("_", " ").title().replace("Eta", "Eta") + " — What To Watch For" for k in explain.TIP_TEXT}, "") + " title from inc",
)
def _(p):
    return explain.template_lessons(p.t("packets")).select("lesson_id", "incident_id", "operator_id", "short_tip", "explanation", "title")


@query(
    "k17_lesson_per_incident",
    f"select {uuid5_sql(chr(39) + 'lesson:' + chr(39) + '||incident_id')} lesson_id, incident_id, case when z in (1, 2) then 'FALLBACK' when z < 5 then 'GENERATED' else 'FALLBACK' end source from candz where z <> 0",
)
def _(p):
    c = F.col
    cand = p.t("candidates").where("z < 5").join(p.t("packets").select("incident_id", "allowed_chunk_ids"), "incident_id").select(
        "incident_id", F.lit("Short title").alias("title"), F.lit("A tip").alias("short_tip"),
        F.when(c("z") == 1, "It was proven").when(c("z") == 2, F.concat(F.lit("see "), c("incident_id"))).otherwise("Plain words").alias("explanation"),
        F.slice("allowed_chunk_ids", 1, 1).alias("knowledge_refs"),
    )
    stored = p.t("candidates").where("z = 0").select(lesson_id(c("incident_id")).alias("lesson_id"))
    return explain.lessons(p.t("packets"), cand, stored).select("lesson_id", "incident_id", "source")


@stage_table("lessons")
def _lessons(p):
    """Lessons with a generation time inside the ten minutes of the machines' frames."""
    d = p.t("incidents").withColumn("n", F.expr("cast(substr(trigger_event_id, 2) as bigint)"))
    return d.select(
        lesson_id(F.col("incident_id")).alias("lesson_id"), "incident_id", "operator_id", "category",
        F.timestamp_seconds(SEC(F.lit("2026-01-01 00:00:00").cast("timestamp")) + (F.col("n") * 7919) % 600).alias("generated_at"),
    )


cte("lessons_sql", f"select {uuid5_sql(chr(39) + 'lesson:' + chr(39) + '||incident_id')} lesson_id, incident_id, operator_id, category, timestamp '2026-01-01 00:00:00' + (cast(substr(trigger_event_id, 2) as bigint) * 7919 % 600) * interval '1' second generated_at from inc")
cte(
    "edges_sql",
    """select *, row_number() over (partition by operator_id order by ts, machine_id || ':' || lpad(cast(seq as varchar), 19, '0')) j, (select count(*) from lessons_sql l where l.operator_id = e.operator_id and l.generated_at <= e.ts) a
      from (select machine_id, seq, ts, operator_id from st where state = 'IDLE' and idle_ticks = 30) e""",
)
cte(
    "served",
    """/*recursive*/ select operator_id, j, least(a, 1) d, least(a, 1) hit from edges_sql where j = 1
      union all select e.operator_id, e.j, least(e.a, s.d + 1), case when e.a > s.d then 1 else 0 end from served s join edges_sql e on e.operator_id = s.operator_id and e.j = s.j + 1""",
)


@query(
    "k18_delivery",
    """select l.lesson_id, e.machine_id, e.seq, cast(epoch(e.ts) as bigint) delivered_s from served s join edges_sql e using (operator_id, j)
      join (select *, row_number() over (partition by operator_id order by generated_at, lesson_id) n from lessons_sql) l on l.operator_id = s.operator_id and l.n = s.d where s.hit = 1""",
)
def _(p):
    d = explain.deliver_lessons(states.idle_hub_edges(p.t("states"), p.cfg), p.t("lessons"), p.cfg)
    return d.select("lesson_id", "machine_id", "seq", SEC("delivered_at").alias("delivered_s"))


@query("k19_first_read", "select machine_id lesson_id, cast(epoch(min(ts)) as bigint) read_s from event_feed where type = 'PROXIMITY_BREACH' group by 1")
def _(p):
    reads = p.t("feed").where("type = 'PROXIMITY_BREACH'").select(F.col("machine_id").alias("lesson_id"), "ts")
    return explain.first_reads(reads).select("lesson_id", SEC("read_at").alias("read_s"))


@query(
    "k20_outcomes",
    "select case when event_count % 5 = 0 then 'CACHED' when z = 0 then 'GENERATED' else 'FALLBACK' end outcome, case when event_count % 5 <> 0 and z <> 0 then 'GROUNDING_INVALID' end fallback_reason, count(*) n from inc join candz using (incident_id) group by all",
)
def _(p):
    stored = p.t("packets").join(p.t("incidents").where("event_count % 5 = 0").select("incident_id"), "incident_id", "left_semi").select("incident_id", "packet_hash")
    checked = grounding.grounding_violations(p.t("candidates"), _allowed(p))
    return explain.outcomes(p.t("packets"), checked, stored).groupBy("outcome", "fallback_reason").agg(F.count("*").alias("n"))


@query("r2_incident_detail", "select incident_id, severity, case when event_count % 2 = 0 then 'second' end explanation from inc")
def _(p):
    from fleetstream.operators.readmodels import incident_detail

    c = F.col
    base = p.t("incidents").where("event_count % 2 = 0")
    ex = base.select("incident_id", F.lit("a").alias("packet_hash"), c("opened_at").alias("created_at"), F.lit("first").alias("explanation")).unionByName(
        base.select("incident_id", F.lit("b").alias("packet_hash"), F.timestamp_seconds(SEC("opened_at") + 60).alias("created_at"), F.lit("second").alias("explanation"))
    )
    return incident_detail(p.t("incidents"), ex).select("incident_id", "severity", "explanation")


@query("r7_lessons", "select operator_id, lesson_id, cast(rk as int) rank from (select *, row_number() over (partition by operator_id order by generated_at desc, lesson_id) rk from lessons_sql) where rk <= 20")
def _(p):
    from fleetstream.operators.readmodels import lessons_of

    return lessons_of(p.t("lessons"), 20).select("operator_id", "lesson_id", "rank")


# --- audit chain -------------------------------------------------------------

@stage_table("audit_entries")
def _audit_entries(p):
    c = F.col
    return p.t("audit_input").withColumn("payload_hash", audit.payload_hash(**{"from": c("from_status"), "note_sha256": F.sha2("note", 256)}))


@stage_table("audit_log")
def _audit_log(p):
    return audit.append_chain(p.t("audit_entries"))


cte("aud", """select *, sha256('{"from":"' || from_status || '","note_sha256":"' || sha256(note) || '"}') payload_hash, row_number() over (partition by chain_id order by id) rn from audit_input""")


def _entry_sql(prev: str, a: str = "") -> str:
    return (
        f"""sha256('{{"action":"' || {a}action || '","actor_id":"' || {a}actor_id || '","payload_hash":"' || {a}payload_hash || '","prev_hash":' || {prev} || ',"target_id":"' || {a}target_id"""
        f""" || '","target_type":"' || {a}target_type || '","ts":"' || strftime({a}ts, '%Y-%m-%dT%H:%M:%S') || 'Z"}}')"""
    )


cte(
    "chain_sql",
    f"""/*recursive*/ select chain_id, rn, id, cast(null as varchar) prev_hash, {_entry_sql("'null'")} current_hash from aud where rn = 1
      union all select a.chain_id, a.rn, a.id, c.current_hash, {_entry_sql("'\"' || c.current_hash || '\"'", "a.")} from chain_sql c join aud a on a.chain_id = c.chain_id and a.rn = c.rn + 1""",
)


@query("h1_payload_hash", "select id, payload_hash from aud")
def _(p):
    c = F.col
    return p.t("audit_input").select("id", audit.payload_hash(**{"from": c("from_status"), "note_sha256": F.sha2("note", 256)}).alias("payload_hash"))


@query("h2_append", "select chain_id, id, prev_hash, current_hash from chain_sql")
def _(p):
    return audit.append_chain(p.t("audit_entries")).select("chain_id", "id", "prev_hash", "current_hash")


@query(
    "h3_verify",
    """select chain_id, count(*) entries, min(case when id % 101 = 7 then id end) is null is_valid, min(case when id % 101 = 7 then id end) first_invalid_id, case when min(case when id % 101 = 7 then id end) is not null then 'HASH' end reason from aud group by chain_id""",
)
def _(p):
    tampered = p.t("audit_log").withColumn("target_id", F.when(F.col("id") % 101 == 7, "other").otherwise(F.col("target_id")))
    return audit.verify_chain(tampered)


@query(
    "h3_missing_entries",
    """select chain_id, min(case when rn2 = 1 and rn > 1 then id when rn2 > 1 and gone then id end) first_invalid_id from (select *, row_number() over (partition by chain_id order by rn) rn2 from (
      select *, lag(id % 89 = 5) over (partition by chain_id order by rn) gone from aud) where id % 89 <> 5) group by chain_id""",
)
def _(p):
    # rows removed from the log: the next one no longer links
    return audit.verify_chain(p.t("audit_log").where(F.col("id") % 89 != 5)).select("chain_id", "first_invalid_id")


# --- lifecycle ---------------------------------------------------------------

@stage_table("linked_actions")
def _linked_actions(p):
    return incidents.with_risk_level(lifecycle.link_with_actions(p.t("feed"), p.t("actions"), p.cfg), p.t("risk_feed"))


cte(
    "acts",
    f"""select incident_id, action, 'SUP' || (frame_seq % 7) actor_id, date_trunc('second', ts) + to_seconds(wait) ts, note from (
      select *, {uuid5_sql("'incident:'||machine_id||':'||event_id")} incident_id from (
        select *, 'ACK' AS action, reading % 60 wait, null note from event_feed where severity <> 'INFO' and frame_seq % 4 = 0
        union all select *, 'CLOSE', 60 + reading % 240, 'note ' || event_id from event_feed where severity <> 'INFO' and frame_seq % 6 = 0))""",
)
# events of a machine one by one: an incident takes all until it is closed or the gap is too long
cte(
    "aev",
    """select machine_id, event_id, ts, case severity when 'CRITICAL' then 2 when 'WARNING' then 1 else 0 end rk, row_number() over (partition by machine_id order by ts, event_id) n,
      case when severity <> 'INFO' and frame_seq % 6 = 0 then date_trunc('second', ts) + to_seconds(60 + reading % 240) end close_ts from event_feed""",
)
cte(
    "awalk",
    """/*recursive*/ select machine_id, n, event_id, ts, rk, case when rk >= 1 then event_id end opener, case when rk >= 1 then ts end ots, case when rk >= 1 then rk end ork, case when rk >= 1 then close_ts end oclose, ts last_ts
      from aev where n = 1
      union all select machine_id, n, event_id, ts, rk, case when alive then opener when rk >= 1 then event_id end, case when alive then ots when rk >= 1 then ts end, case when alive then ork when rk >= 1 then rk end,
        case when alive then oclose when rk >= 1 then close_ts end, ts from (
        select e.*, w.opener, w.ots, w.ork, w.oclose, w.opener is not null and (w.oclose is null or e.ts <= w.oclose) and epoch(e.ts) - epoch(w.last_ts) <= 300 alive
        from awalk w join aev e on e.machine_id = w.machine_id and e.n = w.n + 1)""",
)
cte(
    "alnk",
    f"""select *, {uuid5_sql("'incident:'||machine_id||':'||opener")} incident_id from (
      select machine_id, event_id, ts, rk, opener, ots, ork, oclose, case when event_id = opener then 'OPEN' else 'EXTEND' end AS role from awalk where opener is not null
      union all select u.machine_id, u.event_id, u.ts, u.rk, o.opener, o.ots, o.ork, null, 'LOOKBACK' from awalk u join awalk o on o.machine_id = u.machine_id and o.event_id = o.opener
        and o.ts > u.ts and epoch(o.ts) - epoch(u.ts) <= 300 where u.opener is null qualify row_number() over (partition by u.machine_id, u.event_id order by o.n) = 1)""",
)
cte(
    "aper",
    """select incident_id, any_value(ots) opened_at, min((ts, event_id)) filter (role = 'EXTEND' and rk = 2 and ork < 2) rise, min((ts, event_id)) filter (role = 'EXTEND' and risk_level = 'HIGH') high
      from (select l.*, coalesce(r.risk_level, 'NORMAL') risk_level from (select * from alnk where role <> 'LOOKBACK') l asof left join risk_feed r on l.machine_id = r.machine_id and l.ts >= r.ts) group by incident_id""",
)
cte(
    "asteps",
    """select *, row_number() over (partition by incident_id order by ts, o, actor_id, note) n, coalesce(ts >= opened_at, false) counts from (
      select incident_id, opened_at, rise[1] ts, 'ESCALATE' AS action, null actor_id, null note, 0 o from aper where rise is not null
      union all select incident_id, opened_at, high[1], 'ESCALATE', null, null, 0 from aper where high is not null and (rise is null or high < rise)
      union all select a.incident_id, p.opened_at, a.ts, a.action, a.actor_id, a.note, case a.action when 'ACK' then 1 else 2 end from acts a left join aper p using (incident_id))""",
)
cte(
    "amoves",
    """/*recursive*/ select incident_id, 0::bigint n, null::timestamp ts, null::varchar action, null::varchar actor_id, null::varchar note, 'OPEN' from_status, 'OPEN' to_status, false accepted from (select distinct incident_id from asteps)
      union all select s.incident_id, s.n, s.ts, s.action, s.actor_id, s.note, m.to_status,
        case when not s.counts or m.to_status = 'CLOSED' then m.to_status when s.action = 'CLOSE' then 'CLOSED' when s.action = 'ACK' then 'ACKNOWLEDGED' else 'OPEN' end,
        s.counts and case when s.action = 'ACK' then m.to_status = 'OPEN' else m.to_status <> 'CLOSED' end
      from amoves m join asteps s on s.incident_id = m.incident_id and s.n = m.n + 1""",
)


@query("c7_incidents_with_closes", "select incident_id, count(*) events, cast(epoch(max(oclose)) as bigint) closed_s from alnk group by incident_id")
def _(p):
    d = lifecycle.link_with_actions(p.t("feed"), p.t("actions"), p.cfg)
    return d.groupBy("incident_id").agg(F.count("*").alias("events"), SEC(F.max("closed_at")).alias("closed_s"))


@query("c7_status_steps", "select incident_id, cast(epoch(ts) as bigint) ts_s, action, from_status, to_status, accepted from amoves where n > 0")
def _(p):
    d = lifecycle.lifecycle(p.t("linked_actions"), p.t("actions"))
    return d.select("incident_id", SEC("ts").alias("ts_s"), "action", "from_status", "to_status", "accepted")


@query("c7_final_status", "select status, count(*) n from (select coalesce(arg_max(to_status, n), 'OPEN') status from aper left join amoves using (incident_id) group by incident_id) group by status")
def _(p):
    opened = p.t("linked_actions").select("incident_id").distinct()
    d = lifecycle.final_status(lifecycle.lifecycle(p.t("linked_actions"), p.t("actions")), opened)
    return d.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "c9_action_rows",
    """select distinct m.incident_id, 'status:' || case action when 'ACK' then 'acknowledged' else 'closed' end || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') entry_key, i.severity,
      case action when 'ACK' then 'Acknowledged by supervisor' else 'Closed: ' || coalesce(note, '') end summary, actor_id from amoves m left join inc i using (incident_id) where accepted and action <> 'ESCALATE'""",
)
def _(p):
    steps = lifecycle.lifecycle(p.t("linked_actions"), p.t("actions"))
    rows = incidents.status_rows(lifecycle.action_steps(steps, p.t("incidents")))
    return rows.select("incident_id", "entry_key", "severity", "summary", "actor_id")


cte("ext", "select incident_id, ts, row_number() over (partition by incident_id order by ts) n, lag(ts) over (partition by incident_id order by ts) p from (select distinct incident_id, ts from lnk where role = 'EXTEND')")
cte(
    "thr",
    """/*recursive*/ select incident_id, n, ts sent, true hit from ext where n = 1
      union all select e.incident_id, e.n, case when epoch(e.ts) - epoch(t.sent) >= 5 then e.ts else t.sent end, epoch(e.ts) - epoch(t.sent) >= 5 from thr t join ext e on e.incident_id = t.incident_id and e.n = t.n + 1""",
)


@query("c11_push_throttle", "select incident_id, min(event_id) event_id from thr join lnk l using (incident_id) where hit and l.role = 'EXTEND' and l.ts = thr.sent group by incident_id, sent")
def _(p):
    return lifecycle.throttle_extends(p.t("linked"), p.cfg)


@query("c11_push_slots", "select incident_id, arg_min(event_id, (ts, event_id)) event_id from lnk where role = 'EXTEND' group by incident_id, cast(floor(epoch(ts) / 5) as bigint)")
def _(p):
    return lifecycle.throttle_by_bucket(p.t("linked"), p.cfg)


# --- report text -------------------------------------------------------------

@query(
    "f_report_text",
    """select event_id, case when reading < 1 then '<1m' when reading >= 60 then cast(reading // 60 as varchar) || 'h ' || (reading % 60) || 'm' else reading || 'm' end duration,
      case when s < 5 then 'just now' when s < 60 then s || 's ago' when m < 60 then m || 'm ago' when h < 24 then h || 'h ago' else cast(floor(h / 24e0 + 0.5) as bigint) || 'd ago' end age from (
      select *, cast(floor(m / 60e0 + 0.5) as bigint) h from (select *, cast(floor(s / 60e0 + 0.5) as bigint) m from (select *, cast(epoch(timestamp '2026-01-01 12:00:00') - epoch(ts) as bigint) s from event_feed)))""",
)
def _(p):
    return p.t("feed").select("event_id", text.minutes_text(F.col("reading").cast("double")).alias("duration"), text.age_text(F.col("ts"), _now()).alias("age"))
