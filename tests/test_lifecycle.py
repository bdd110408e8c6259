"""Snapshots, replay, and stream = batch."""

import time
from datetime import datetime

from pyspark.sql import functions as F

from sitegauge.operators import lifecycle as lc
from sitegauge.params import DEFAULT
from sitegauge.plans import views as v
from sitegauge.streaming import live as lv, stages as sg

SF = "/root/testdata/sf0.001"
SCHEMA = ("website_id long, fingerprint string, page_id long, rule_key string, category string, severity string, confidence int, status string, "
          "first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp")
OLD, NOW = datetime(2026, 1, 1), datetime(2026, 2, 1)


def finding(fp, status="open", rule="content.thin-page", category="Content quality", page=1):
    return (1, fp, page, rule, category, "high", 90, status, OLD, OLD, OLD if status == "resolved" else None)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_upsert_reopens_keeps_work_and_is_idempotent(spark):
    old = table(spark, finding("a", "resolved"), finding("b", "investigating"), finding("c"))
    new = table(spark, finding("a"), finding("b"), finding("d")).drop("status", "first_seen_at", "last_seen_at", "resolved_at").withColumn("seen_order", F.lit(1))
    once = lc.lifecycle_upsert(old, new, F.lit(NOW))
    got = {r.fingerprint: r for r in once.collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "open", "b": "investigating", "c": "open", "d": "open"}
    assert got["a"].first_seen_at == OLD and got["a"].resolved_at is None and got["d"].first_seen_at == NOW and got["c"].last_seen_at == OLD
    assert sorted(lc.lifecycle_upsert(once, new, F.lit(NOW)).collect()) == sorted(once.collect())


def test_resolve_scopes(spark):
    rows = [finding("local"), finding("ai", rule="ai.x"), finding("browser", rule="ads.browser-x", category="Ad experience"),
            finding("copy", rule="copyright.external-content-match", category="Copyright"), finding("dup", rule="duplicate.internal-near-match", category="Duplicate content"),
            finding("seen"), finding("elsewhere", page=2), finding("sitewide", page=None)]
    df = table(spark, *rows)
    pages = spark.createDataFrame([(1, 1)], "website_id long, page_id long")
    seen = spark.createDataFrame([(1, "seen")], "website_id long, fingerprint string")
    gone = lambda scope, kind="full": {
        r.fingerprint for r in lc.resolve_missing(df, pages, seen, F.lit(NOW), F.lit(NOW), scope, DEFAULT.with_(scan_type=kind)).filter("status = 'resolved'").collect()}
    assert gone("local") == {"local", "dup"} and gone("ai") == {"ai"} and gone("browser") == {"browser"} and gone("copy") == {"copy"}
    assert gone("duplicates") == {"dup"} and gone("duplicates", "ads") == set() and gone("local", "priority") == set()
    assert gone("local", "copyright") == {"dup"} and gone("browser", "ads") == {"browser"}


def test_streams_over_file_chunks_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    events = v.events(spark, SF)
    for low, high in ((0, 300), (300, 500), (500, 900), (900, 1 << 40)):  # chunks arrive in event order
        events.filter(F.col("event_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    read = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    from sitegauge.plans import catalog_streams as cs

    stages = sg.stream_stage_durations(cs.stages(read()), DEFAULT.with_(late_events="0 seconds"))
    lv.start_files(stages, str(tmp_path / "stages")).awaitTermination()
    key = lambda df: sorted(tuple(r) for r in df.select("start_id", "finish_id", "duration_ms").collect())
    assert key(spark.read.parquet(str(tmp_path / "stages" / "data"))) == key(lv.stage_durations(cs.stages(events), DEFAULT.with_(chunk=64)))
    assert key(lv.stage_durations(cs.stages(events), DEFAULT.with_(chunk=64))) == key(lv.stage_durations(cs.stages(events)))
    lv.stream_progress(cs.updates(read()), str(tmp_path / "progress")).awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.select("scan_id", *lv.STATUSES).collect())
    assert rows(lv.live_progress(spark, str(tmp_path / "progress"))) == rows(lv.progress_counts(cs.updates(events)))


def test_stuck_scan_timer(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, datetime(2026, 1, 1, 10)), (2, datetime(2026, 1, 1, 10, 50))]
    spark.createDataFrame(rows, "scan_id long, ts timestamp").coalesce(1).write.parquet(src)
    spark.createDataFrame([(2, datetime(2026, 1, 1, 11))], "scan_id long, ts timestamp").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("scan_id long, ts timestamp").parquet(src)
    lv.start_files(lv.stream_stuck_scans(stream), str(tmp_path / "out")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "data")).collect()] == [(1, "cancelled")]


def test_numbering_splits_groups(spark):
    from sitegauge.operators.numbering import number_in_group

    df = spark.createDataFrame([("hot" if i % 3 else "cold", i * 7 % 101) for i in range(101)], "g string, k long")
    got = number_in_group(df, ["g"], "k", "n", chunk=8)
    ranks = {}
    for r in sorted(got.collect(), key=lambda r: (r.g, r.k)):
        ranks.setdefault(r.g, []).append(r.n)
    assert all(x == list(range(1, len(x) + 1)) for x in ranks.values())


def test_last_change_of_a_finding_counts_once(spark):
    old = spark.createDataFrame([("a", "open", None, None), ("b", "open", 3, None)], "fingerprint string, status string, assigned_to long, resolved_at timestamp")
    updates = spark.createDataFrame([("a", "investigating", 1, 1), ("a", "resolved", None, 2), ("b", "no such status", 9, 1)], "fingerprint string, new_status string, new_assignee long, changed_at int")
    got = {r.fingerprint: (r.status, r.assigned_to, r.resolved_at is not None) for r in lc.finding_transition(old, updates, F.lit(NOW)).collect()}
    assert got == {"a": ("resolved", None, True), "b": ("open", 9, False)}


def test_new_findings_get_a_public_id_and_new_columns_stay(spark):
    old = spark.createDataFrame([(1, "f" * 64, "open", NOW, NOW, None, "MG-1")], "website_id long, fingerprint string, status string, first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp, public_id string")
    new = spark.createDataFrame([(1, "f" * 64, 1, "s1"), (1, "e" * 64, 1, "s2")], "website_id long, fingerprint string, seen_order long, summary string")
    got = {r.fingerprint[0]: (r.public_id, r.summary) for r in lc.lifecycle_upsert(old, new, F.lit(NOW)).collect()}
    assert got["f"] == ("MG-1", "s1") and got["e"][0].endswith("E" * 16) and got["e"][1] == "s2"
