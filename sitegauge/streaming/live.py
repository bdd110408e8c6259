"""Live views with Structured Streaming. Each operator has a batch form with the same result."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery

from sitegauge.functions import html as hx, vocab
from sitegauge.operators import merge as mg, rules as ru, snapshots as sn, sources as so
from sitegauge.operators.numbering import number_in_group
from sitegauge.params import DEFAULT, Params
from sitegauge.session import shared_folder

C = F.col


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the session's shared checkpoint location."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def start_files(df: DataFrame, out: str, mode: str = "append") -> StreamingQuery:
    """Append to parquet until the available input is read; restartable from its own checkpoint."""
    return (
        df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{out}/_checkpoint")
        .option("path", f"{out}/data").trigger(availableNow=True).start()
    )


def start_batches(df: DataFrame, out: str, handle, mode: str = "append") -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/_checkpoint")
        .foreachBatch(handle).trigger(availableNow=True).start()
    )


# ---------------------------------------------------------------- stage durations

def _depths(events: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """Number of open starts after each event, never below zero; computed over chunks so a hot key is spread."""
    part = [*keys, "_chunk"]
    rows = events.withColumns({"_d": F.when(C("status") == "running", 1).otherwise(-1), "_chunk": F.floor(C("event_id") / p.chunk)})
    inside = W.partitionBy(*part).orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum("_d").over(inside)).withColumn("_m", F.min("_s").over(inside))
    sizes = rows.groupBy(*part).agg(F.sum("_d").alias("_total"), F.min("_s").alias("_low"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    sizes = sizes.withColumn("_floor", F.coalesce(F.min(C("_base") + C("_low")).over(before), F.lit(0))).drop("_total", "_low")
    rows = rows.join(sizes, part)
    floor = F.least(F.lit(0), C("_floor"), C("_base") + C("_m"))
    return rows.withColumn("depth", C("_base") + C("_s") - floor).withColumn(
        "hit_floor", (C("_d") == -1) & (C("_base") + C("_s") == floor) & (C("_base") + C("_s") < F.least(F.lit(0), C("_floor"), C("_base") + F.coalesce(
            F.min("_s").over(W.partitionBy(*part).orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(1 << 40))))
    ).drop("_d", "_chunk", "_s", "_m", "_base", "_floor")


def stage_durations(events: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Each finish closes the latest still running start of its (target, stage). Batch form.

    Starts and finishes at one nesting depth alternate, so the n-th finish of a depth belongs to its n-th start. A start
    open for more than ``open_stage_days`` is forgotten: only then is every start below it as old, so leaving out the
    pairs that took longer gives the same as taking the start away. ``events``: event_id, target_id, stage, status, ts.
    """
    keys = ["target_id", "stage"]
    rows = _depths(events, keys, p)
    starts = rows.filter("status = 'running'").select(*keys, C("depth").alias("level"), "event_id", C("ts").alias("started_at"))
    ends = rows.filter("status <> 'running' and not hit_floor").select(
        *keys, (C("depth") + 1).alias("level"), "event_id", C("ts").alias("finished_at"), "status"
    )
    a = number_in_group(starts, [*keys, "level"], "event_id", "n", p.chunk).withColumnRenamed("event_id", "start_id")
    b = number_in_group(ends, [*keys, "level"], "event_id", "n", p.chunk).withColumnRenamed("event_id", "finish_id")
    took = F.unix_millis("finished_at") - F.unix_millis("started_at")
    pairs = a.join(b, [*keys, "level", "n"]).filter(took <= p.open_stage_ms)
    return pairs.select(*keys, "start_id", "finish_id", "status", F.greatest(F.lit(0), took).alias("duration_ms"))


# ---------------------------------------------------------------- telemetry context

def sanitize_context(context: Column) -> Column:
    """Context JSON without secret and full-text keys, whatever its size."""
    entries = F.from_json(context, "map<string,string>")
    return F.to_json(F.map_filter(entries, lambda k, x: ~k.isin(*vocab.SECRET_KEYS)))


# ---------------------------------------------------------------- progress

STATUSES = ["queued", "running", "completed", "reused", "failed"]


def _status_counts() -> list[Column]:
    return [F.count_if(C("status") == s).alias(s) for s in STATUSES]


def progress_counts(updates: DataFrame) -> DataFrame:
    """Targets per latest status and scan (batch form). ``updates``: scan_id, url_hash, status, seq."""
    latest = updates.groupBy("scan_id", "url_hash").agg(F.max_by("status", "seq").alias("status"))
    return latest.groupBy("scan_id").agg(*_status_counts())


def targets_at(out: str, buckets: int = 64) -> sn.Snapshot:
    return sn.Snapshot(f"{out}/targets", ("scan_id", "url_hash"), buckets)


def stream_progress(updates: DataFrame, out: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the latest status per target in a bucketed table and the counters per scan of each bucket beside it.

    A batch rewrites the buckets it touches and then their counters, both from what is stored, so a replay or a late
    update (a smaller ``seq``) changes nothing, and no state has to expire. A hot scan is spread over all buckets.
    """
    targets = targets_at(out, buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        targets.ensure(batch)
        touched = sn.replace_rows(targets, batch, "seq")
        if touched:
            counts = targets.part(spark, touched).groupBy(sn.BUCKET, "scan_id").agg(*_status_counts())
            counts.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(sn.BUCKET).parquet(f"{out}/counters")

    return start_batches(updates.select("scan_id", "url_hash", "status", "seq"), out, handle)


def live_progress(spark: SparkSession, out: str) -> DataFrame:
    """Targets per status and scan so far: sums of the small counters, at most one row per bucket and scan."""
    return spark.read.parquet(f"{out}/counters").groupBy("scan_id").agg(*[F.sum(s).alias(s) for s in STATUSES])


# ---------------------------------------------------------------- live findings

def newest(findings: DataFrame, n: int = 100) -> DataFrame:
    return findings.orderBy(F.desc("last_seen_at"), "fingerprint").limit(n)


def stream_live_findings(findings: DataFrame, out: str, n: int = 100) -> StreamingQuery:
    """Newest findings so far: every batch is merged into the short list, a table of one bucket that is replaced."""
    table = newest_at(out)

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        return newest(mg.latest_per_key(old.unionByName(rows), ["fingerprint"], "last_seen_at"), n)

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.ensure(batch)
        table.upsert(newest(batch, n), merge)  # what is not among the newest of its batch is not among all

    return start_batches(findings, out, handle)


def newest_at(out: str) -> sn.Snapshot:
    return sn.Snapshot(f"{out}/newest", ("fingerprint",), 1)


# ---------------------------------------------------------------- pages

def page_findings(responses: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Findings of usable responses; the same body serves batches and micro-batches."""
    pages = hx.page_signals(so.src_responses(responses).withColumnRenamed("grp", "website_id"))
    return ru.rules_local(pages, p.scan_type, p)


def findings_table(out: str, buckets: int = 64) -> sn.Snapshot:
    """Findings per page: pages that share a URL have equal fingerprints."""
    return sn.findings_at(f"{out}/findings", buckets, ("website_id", "page_id", "fingerprint"))


def stream_scan_pages(responses: DataFrame, out: str, p: Params = DEFAULT, epoch: int = 0, buckets: int = 64) -> StreamingQuery:
    """Merges the findings of every micro-batch into the stored ones, bucket by bucket.

    A stored row remembers the last batch that saw it, so replays and late batches change nothing. Batch numbers belong
    to the checkpoint in ``out``; a stream that starts over with a new one takes the next ``epoch``.
    """
    table, now = findings_table(out, buckets), F.lit(p.now).cast("timestamp")

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = page_findings(batch, p).withColumn("seen_order", F.lit(0).cast("long"))
        keyed = rows.withColumn("website_id", F.coalesce("website_id", F.lit("")))
        state = {"status": F.lit("open"), **{c: now for c in ("first_seen_at", "last_seen_at", "resolved_at")}, "batch_number": F.lit(0).cast("long")}
        table.ensure(keyed.limit(0).withColumns(state))
        sn.store_batch(table, keyed, now, (epoch << 32) + batch_id)

    return start_batches(responses, out, handle)


# ---------------------------------------------------------------- claims and late work

def claimed(events: DataFrame) -> DataFrame:
    """Events of the first claimant of each target (batch form). ``events``: scan_id, url_hash, claimant, event_id, ts."""
    first = events.groupBy("scan_id", "url_hash").agg(F.min_by("claimant", "event_id").alias("owner"))
    return events.join(first, ["scan_id", "url_hash"]).filter(C("claimant") == C("owner")).drop("owner")


def stream_claim_dedupe(events: DataFrame, delay: str = "1 hour", keep_days: int = DEFAULT.claim_days) -> DataFrame:
    """Streaming form: a target's claimant is kept until ``keep_days`` after its last event; others are dropped, retries pass."""
    def own(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("event_id")
        owner = state.get[0] if state.exists else rows["claimant"].iloc[0]
        state.update((owner,))
        state.setTimeoutTimestamp(int(rows["ms"].max()) + keep_days * 86_400_000)
        kept = rows[rows["claimant"] == owner]
        yield pd.DataFrame({"scan_id": kept["scan_id"], "url_hash": kept["url_hash"], "claimant": kept["claimant"], "event_id": kept["event_id"]})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.withWatermark("ts", delay).select("scan_id", "url_hash", "claimant", "event_id", F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("scan_id", "url_hash").applyInPandasWithState(
        own, f"scan_id {kinds['scan_id']}, url_hash {kinds['url_hash']}, claimant {kinds['claimant']}, event_id long",
        f"owner {kinds['claimant']}", "append", "EventTimeTimeout",
    )


def late_terminal(events: DataFrame, scans: DataFrame) -> DataFrame:
    """Drops work that arrives after its scan is terminal. Works for batches and as a stream-static join."""
    done = scans.filter(C("status").isin(*vocab.TERMINAL_SCAN_STATUSES)).select("scan_id", F.lit(True).alias("_done"))
    return events.join(done, "scan_id", "left").filter(C("_done").isNull()).drop("_done")


# ---------------------------------------------------------------- stuck scans

def stuck_scans(updates: DataFrame, now: Column, p: Params = DEFAULT) -> DataFrame:
    """Scans without an update for the stale period (batch form)."""
    last = updates.groupBy("scan_id").agg(F.max("ts").alias("last_update"))
    return last.filter(C("last_update") <= F.timestamp_add("MINUTE", F.lit(-p.stale_minutes), now)).select("scan_id", F.lit("cancelled").alias("status"))


def stream_stuck_scans(updates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Streaming form: an event-time timer per scan, moved forward by every update, also by one that comes late."""
    wait = p.stale_minutes * 60_000

    def watch(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"scan_id": [key[0]], "status": ["cancelled"]})
            return
        last = max([f["ms"].max() for f in frames] + ([state.get[0]] if state.exists else []))
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) + wait, state.getCurrentWatermarkMs() + 1))

    kind = updates.schema["scan_id"].dataType.simpleString()
    rows = updates.withWatermark("ts", p.late_events).select("scan_id", F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("scan_id").applyInPandasWithState(
        watch, f"scan_id {kind}, status string", "last long", "append", "EventTimeTimeout"
    )


# ---------------------------------------------------------------- traffic

def daily_views(views: DataFrame) -> DataFrame:
    """Views per path and day: the panes that windows are added up from, each view counted once."""
    return views.groupBy("path", F.to_date("ts").alias("pane")).agg(F.count("*").alias("views"))


def slide(panes: DataFrame, days: int = DEFAULT.traffic_days) -> DataFrame:
    """Sums of the last ``days`` full days, for every day a pane belongs to; the day itself is excluded."""
    ends = panes.select("path", "views", F.explode(F.transform(F.sequence(F.lit(1), F.lit(days)), lambda k: F.date_add("pane", k))).alias("day"))
    return ends.groupBy("path", "day").agg(F.sum("views").alias("views"))


def page_views_windows(views: DataFrame, days: int = DEFAULT.traffic_days) -> DataFrame:
    """Views per path over trailing windows of full days, one window per day (batch form)."""
    return slide(daily_views(views), days)


def stream_page_views(views: DataFrame, out: str) -> StreamingQuery:
    """Writes every batch's panes in a folder of its own. A late view is one more pane of its day, a replay writes the same folder."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        daily_views(batch).write.mode("overwrite").parquet(f"{out}/panes/batch={batch_id}")

    return start_batches(views, out, handle)


def live_page_views(spark: SparkSession, out: str, first: Column, last: Column, days: int = DEFAULT.traffic_days) -> DataFrame:
    """Windows that end between two days, from the panes written so far; other panes are not summed."""
    panes = spark.read.parquet(f"{out}/panes").filter((C("pane") >= F.date_sub(first, days)) & (C("pane") < last))
    return slide(panes.groupBy("path", "pane").agg(F.sum("views").alias("views")), days).filter(C("day").between(first, last))
