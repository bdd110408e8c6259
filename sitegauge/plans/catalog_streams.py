"""Registered queries: batch forms with reference SQL, and the same results from real streams over the tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from sitegauge.plans import oracle as o, views as v
from sitegauge.params import DEFAULT
from sitegauge.streaming import live as lv, stages as sg, telemetry as tm

C = F.col
ENTRIES: dict = {}


def add(name, fn, sql=None):
    ENTRIES[name] = (fn, sql)


def stream(s, d, name):
    """A table as a file stream, whether it is one file or a folder; a pattern may name either, a plain path only a folder."""
    schema = v.table(s, d, name).schema
    rows = s.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")
    return rows.withColumn("ts", C("ts").cast("timestamp")) if "ts" in rows.columns else rows


def stages(e):
    return e.select("event_id", C("user_id").alias("target_id"), C("event_type").alias("stage"), "ts",
                    F.when(C("event_id") % 2 == 0, "running").when(C("event_id") % 7 == 0, "failed").otherwise("success").alias("status"))


def finished(s, df, name):
    """Runs an append stream over all available input and reads what it wrote."""
    out = lv.scratch(s, name)
    lv.start_files(df, out).awaitTermination()
    return s.read.schema(df.schema).parquet(f"{out}/data")


_STAGE = ("ev as (select event_id, user_id as target_id, event_type as stage, ts, case when event_id % 2 = 0 then 'running' when event_id % 7 = 0 then 'failed' else 'success' end as status, case when event_id % 2 = 0 then 1 else -1 end as d from events), "
          "cs as (select *, sum(d) over w as s from ev window w as (partition by target_id, stage order by event_id)), cm as (select *, least(0, min(s) over (partition by target_id, stage order by event_id)) as m, "
          "least(0, coalesce(min(s) over (partition by target_id, stage order by event_id rows between unbounded preceding and 1 preceding), 0)) as pm from cs), "
          "dp as (select *, s - m as depth, d = -1 and s < pm as lost from cm), lg as (select *, case when d = 1 then depth else depth + 1 end as level from dp where not lost), "
          "pr as (select *, lag(event_id) over l as start_id, lag(ts) over l as start_ts from lg window l as (partition by target_id, stage, level order by event_id))")
_STAGE_SQL = f"with {_STAGE} select target_id, stage, start_id, event_id as finish_id, status, epoch_us(ts) // 1000 - epoch_us(start_ts) // 1000 as duration_ms from pr where d = -1"
add("stream_stage_durations", lambda s, d: lv.stage_durations(v.stage_events(s, d)), _STAGE_SQL)
# the table is read in one batch, in which nothing can be late
add("stream_stage_durations_live", lambda s, d: finished(s, sg.stream_stage_durations(stages(stream(s, d, "events")), DEFAULT.with_(late_events="0 seconds")), "stages"), _STAGE_SQL)


def shown_log(df):
    return df.select("scan_id", "target_id", "event_id", "stage", "status", "service", F.length("message").alias("message_chars"), "context",
                     F.coalesce("http_status", F.lit(0)).alias("http_status"), "request_id", F.unix_millis("ts").alias("at"), C("day").cast("string").alias("day"))


def telemetry(s, d):
    """Batches of the log, one of them written twice, read with the days before the middle of the month compacted."""
    out, events = lv.scratch(s, "telemetry"), v.as_telemetry(v.events(s, d))
    for batch in (0, 1, 0):
        tm.append(events.filter(C("event_id") % 2 == batch), out, batch)
    tm.compact(s, out, date(2024, 1, 1), date(2024, 1, 16))
    return shown_log(tm.read(s, out, date(2024, 1, 16)))


def live_telemetry(s, d):
    out = lv.scratch(s, "telemetry")
    tm.stream_telemetry(v.as_telemetry(stream(s, d, "events")), out).awaitTermination()
    return shown_log(tm.read(s, out))


_LOG = ("select user_id % 20 as scan_id, user_id as target_id, event_id, event_type as stage, case when event_id % 2 = 0 then 'running' when event_id % 7 = 0 then 'failed' else 'success' end as status, "
        "case when event_id % 4 = 0 then 'crawler' else 'detector' end as service, (5 + event_id % 9000)::int as message_chars, "
        "'{' || case when event_id % 3 = 0 then '\"http_status\":\"' || (200 + event_id % 5 * 100) || '\",' else '' end || '\"request_id\":\"r-' || event_id || '\",\"k\":\"' || (props->>'$.k') || '\"}' as context, "
        "case when event_id % 3 = 0 then 200 + event_id % 5 * 100 else 0 end::int as http_status, 'r-' || event_id as request_id, epoch_us(ts) // 1000 as \"at\", ts::date::varchar as day from events")
add("sink_telemetry", telemetry, _LOG)
add("sink_telemetry_live", live_telemetry, _LOG)


def contexts(s, d):
    k = C("doc_id")
    return v.table(s, d, "documents").select("doc_id", F.to_json(F.struct(
        k.cast("string").alias("id"), F.lit("key").alias("api_key"), C("text").alias("content"),
        F.repeat(F.lit("x"), F.when(k % 7 == 0, 25000).otherwise(5)).alias("note"))).alias("context"))


add("stream_context_sanitize", lambda s, d: contexts(s, d).withColumn("clean", lv.sanitize_context(C("context"))).select("doc_id", F.length("clean").alias("chars"), F.coalesce(F.get_json_object("clean", "$.id"), F.lit("-")).alias("kept_id"), F.get_json_object("clean", "$.api_key").isNull().alias("no_secret")),
    "select doc_id, length(case when doc_id % 7 = 0 then '{\"id\":\"' || doc_id || '\",\"note\":\"' || repeat('x', 25000) || '\"}' else '{\"id\":\"\",\"note\":\"xxxxx\"}' || doc_id end)::int as chars, doc_id::varchar as kept_id, true as no_secret from documents")


def updates(e):
    k = C("event_id")
    status = F.element_at(F.array(*[F.lit(x) for x in lv.STATUSES]), (k * 7 % 5 + 1).cast("int"))
    return e.select((C("user_id") % 20).alias("scan_id"), C("user_id").cast("string").alias("url_hash"), status.alias("status"), k.alias("seq"))


def live_progress(s, d):
    out = lv.scratch(s, "progress")
    lv.stream_progress(updates(stream(s, d, "events")), out).awaitTermination()
    return lv.live_progress(s, out)


_PROGRESS = ("with u as (select user_id % 20 as scan_id, user_id, arg_max(event_id * 7 % 5, event_id) as k from events group by all) select scan_id, "
             + ", ".join(f"count(*) filter (where k = {i})::bigint as {x}" for i, x in enumerate(lv.STATUSES)) + " from u group by 1")
add("stream_progress", lambda s, d: lv.progress_counts(updates(v.events(s, d))), _PROGRESS)
add("stream_progress_live", live_progress, _PROGRESS)


def line_findings(s, d):
    return v.findings(s, d).select("fingerprint", "severity", "last_seen_at")


def live_findings(s, d):
    out = lv.scratch(s, "findings")
    rows = stream(s, d, "lineitem").select(
        F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (C("l_quantity") * 2).cast("int")), 256).alias("fingerprint"), C("l_shipdate").alias("last_seen_at"))
    lv.stream_live_findings(rows, out).awaitTermination()
    return lv.newest_at(out).read(s).select("fingerprint")


_NEWEST = f"with {o.FINDINGS} select fingerprint from fb order by last_seen_at desc, fingerprint limit 100"
add("stream_live_findings", lambda s, d: lv.newest(line_findings(s, d)).select("fingerprint"), _NEWEST)
add("stream_live_findings_live", live_findings, _NEWEST)


def page_stream(s, d):
    e = stream(s, d, "pages")
    return v.as_responses(e)


def live_pages(s, d):
    out = lv.scratch(s, "pages")
    lv.stream_scan_pages(page_stream(s, d), out).awaitTermination()
    return lv.findings_table(out).read(s).select("page_id", "rule_key", "severity", "fingerprint")


_PAGES = (f"with {o.RULE_ROWS} select page_id, rule_key, severity, fingerprint from rl where page_id % 17 <> 0 and (page_id % 11 = 0 or page_id % 13 <> 0)")
add("stream_scan_pages", lambda s, d: lv.page_findings(v.responses(s, d)).select("page_id", "rule_key", "severity", "fingerprint"), _PAGES)
add("stream_scan_pages_live", live_pages, _PAGES)


def claims(e):
    return e.select((C("user_id") % 30).alias("scan_id"), C("user_id").cast("string").alias("url_hash"), (C("event_id") * 13 % 4).cast("string").alias("claimant"), "event_id", "ts")


_CLAIMS = "with c as (select user_id % 30 as scan_id, user_id::varchar as url_hash, (event_id * 13 % 4)::varchar as claimant, event_id from events), f as (select scan_id, url_hash, arg_min(claimant, event_id) as claimant from c group by all) select c.* from c join f using (scan_id, url_hash, claimant)"
add("stream_claim_dedupe", lambda s, d: lv.claimed(claims(v.events(s, d))).drop("ts"), _CLAIMS)
add("stream_claim_dedupe_live", lambda s, d: finished(s, lv.stream_claim_dedupe(claims(stream(s, d, "events"))), "claims"), _CLAIMS)


def work(e):
    return e.select(C("user_id").alias("scan_id"), "event_id")


_LATE = f"with {o.SCANS} select event_id, user_id as scan_id from events where user_id not in (select scan_id from sc where status in ('completed', 'partial', 'cancelled', 'failed'))"
add("stream_late_terminal", lambda s, d: lv.late_terminal(work(v.events(s, d)), v.scans(s, d)), _LATE)
add("stream_late_terminal_live", lambda s, d: finished(s, lv.late_terminal(work(stream(s, d, "events")), v.scans(s, d)), "late"), _LATE)
_STUCK_NOW = "timestamp '2024-01-30 12:00:00'"
add("stream_stuck_scans", lambda s, d: lv.stuck_scans(v.events(s, d).select(C("user_id").alias("scan_id"), "ts"), F.expr(_STUCK_NOW)),
    f"select user_id as scan_id, 'cancelled' as status from events group by 1 having max(ts) <= {_STUCK_NOW} - interval 30 minute")
add("stream_stuck_scans_live", lambda s, d: finished(s, lv.stream_stuck_scans(stream(s, d, "events").select(C("user_id").alias("scan_id"), "ts"), DEFAULT.with_(late_events="0 seconds")), "stuck"),
    "select user_id as scan_id, 'cancelled' as status from events group by 1 having max(ts) < (select max(ts) from events) - interval 30 minute")


def live_views(s, d):
    out = lv.scratch(s, "views")
    lv.stream_page_views(v.as_page_views(stream(s, d, "events")), out).awaitTermination()
    return lv.live_page_views(s, out, F.lit(date(2024, 1, 1)), F.lit(date(2024, 3, 1)))


_VIEWS = f"with {o.VIEWS} select path, (ts::date + k::int)::varchar as day, count(*) as views from vw, (select unnest(range(1, 8)) as k) group by all"
add("stream_page_views_7d", lambda s, d: lv.page_views_windows(v.page_views(s, d)).withColumn("day", C("day").cast("string")), _VIEWS)
add("stream_page_views_7d_live", lambda s, d: live_views(s, d).withColumn("day", C("day").cast("string")), _VIEWS)
