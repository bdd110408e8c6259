"""Bucketed snapshots and the telemetry log: what is rewritten, replays, late rows, secrets."""

import os
import time
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import lifecycle as lc, snapshots as sn
from sitegauge.plans import views as v
from sitegauge.streaming import live as lv, telemetry as tm

NOW = datetime(2026, 2, 1)
SF = "/root/testdata/sf0.001"
FINDING = "website_id long, fingerprint string, severity string, status string, first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp"


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def findings(spark, n, status="open"):
    return spark.range(n).select(
        (F.col("id") % 7).alias("website_id"), F.sha2(F.col("id").cast("string"), 256).alias("fingerprint"), F.lit("high").alias("severity"), F.lit(status).alias("status"),
        *[F.lit(datetime(2026, 1, 1)).alias(c) for c in ("first_seen_at", "last_seen_at")], F.lit(None).cast("timestamp").alias("resolved_at"))


def fresh(df, order=1):
    return df.drop("status", "first_seen_at", "last_seen_at", "resolved_at").withColumn("seen_order", F.lit(order))


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_upsert_rewrites_only_its_buckets(spark, tmp_path):
    old = findings(spark, 3000)
    table = sn.findings_at(str(tmp_path / "t"), 32).create(old)
    before = files(table.path)
    new = fresh(old.filter("website_id = 3").limit(2)).unionByName(fresh(findings(spark, 3001).subtract(old)))
    want = rows(lc.lifecycle_upsert(old, new, F.lit(NOW)))
    touched = sn.store_findings(table, new, F.lit(NOW))
    after = files(table.path)
    changed = {k.split("/")[0] for k, _ in set(before.items()) ^ set(after.items())}
    assert 1 <= len(touched) <= 3 and changed == {f"bucket={b}" for b in touched} and len({k.split("/")[0] for k in after}) == 33
    assert rows(table.read(spark)) == want
    sn.store_findings(table, new, F.lit(NOW))  # a repeated batch changes nothing
    assert rows(table.read(spark)) == want


def test_empty_batches_and_new_columns(spark, tmp_path):
    old = findings(spark, 50)
    table = sn.findings_at(str(tmp_path / "t"), 4).create(old)
    before = files(table.path)
    assert sn.store_findings(table, fresh(old).limit(0), F.lit(NOW)) == [] and files(table.path) == before
    sn.store_findings(table, fresh(old).limit(1).withColumn("summary", F.lit("why")), F.lit(NOW))
    got = table.read(spark)
    assert got.count() == 50 and got.filter("summary = 'why'").count() == 1
    none = sn.findings_at(str(tmp_path / "none")).create(old.limit(0))
    assert none.read(spark).columns == old.columns and none.read(spark).count() == 0
    sn.store_findings(none, fresh(old).limit(3), F.lit(NOW))
    assert none.read(spark).count() == 3
    with pytest.raises(Exception):
        sn.findings_at(table.path).create(old)


def test_stored_columns_keep_their_types(spark, tmp_path):
    old = findings(spark, 40).withColumn("last_seen_at", F.expr("timestamp_ntz'2026-01-01 00:00:00'"))
    table = sn.findings_at(str(tmp_path / "t"), 16).create(old)
    sn.store_findings(table, fresh(old).limit(2), F.lit(NOW))
    got = table.read(spark)
    assert got.schema["last_seen_at"].dataType.simpleString() == "timestamp_ntz"
    assert got.count() == 40 and got.filter(F.col("last_seen_at") == F.lit(NOW)).count() == 2


def test_pages_keep_whole_titles_and_markers(spark, tmp_path):
    schema = "website_id long, url_hash string, title string, analysis struct<ai_model: string>"
    table = sn.pages_at(str(tmp_path / "t"), 8).create(spark.createDataFrame([(1, "a", "old", ("m",)), (1, "b", "old", ("m",))], schema))
    sn.store_pages(table, spark.createDataFrame([(1, "a", "t" * 900, None), (2, "c", "new", ("n",))], schema))
    got = {r.url_hash: (len(r.title), r.analysis and r.analysis.ai_model) for r in table.read(spark).collect()}
    assert got == {"a": (900, "m"), "b": (3, "m"), "c": (3, "n")}


def test_older_rows_change_nothing(spark, tmp_path):
    table = sn.Snapshot(str(tmp_path / "t"), ("k",), 4).create(spark.createDataFrame([(1, 5, "new"), (2, 1, "x")], "k long, seq long, s string"))
    sn.replace_rows(table, spark.createDataFrame([(1, 3, "late"), (2, 4, "y"), (2, 2, "z"), (3, 1, "w")], "k long, seq long, s string"), "seq")
    assert rows(table.read(spark)) == [(1, "new", 5), (2, "y", 4), (3, "w", 1)]


# telemetry

def test_log_is_the_same_for_batches_and_streams(spark, tmp_path):
    events = v.as_telemetry(v.events(spark, SF))
    src, out, once = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "once")
    for k in range(3):
        events.filter(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    tm.stream_telemetry(stream, out).awaitTermination()
    tm.append(events, once, 0)
    want = rows(tm.read(spark, once))
    assert rows(tm.read(spark, out)) == want and len(want) == events.count()
    tm.append(events.filter("event_id % 3 = 1"), out, 1)  # a batch that is written again adds nothing
    assert rows(tm.read(spark, out)) == want
    text = " ".join(str(r) for r in want)
    assert "secret" not in text and "Bearer" not in text and "article" not in text and max(len(r.message) for r in tm.read(spark, once).collect()) > 900


def test_compaction_makes_few_files_and_takes_late_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    events = v.as_telemetry(v.events(spark, SF))
    for k in range(6):
        tm.append(events.filter(F.col("event_id") % 6 == k), out, k)
    whole = rows(tm.read(spark, out))
    end = date(2024, 1, 11)
    tm.compact(spark, out, date(2024, 1, 1), end)
    days = {k.split("/")[0] for k in files(f"{out}/days")}
    assert days == {f"day=2024-01-{d:02}" for d in range(1, 11)} and len(files(f"{out}/days")) == 10 < sum("day=2024-01-0" in k for k in files(f"{out}/log"))
    assert rows(tm.read(spark, out, end)) == whole
    late = events.filter("event_id = 0").withColumn("event_id", F.lit(10**6).cast("long"))
    tm.append(late, out, 6)
    first = late.select(F.to_date("ts")).first()[0]
    untouched = {k: t for k, t in files(f"{out}/days").items() if f"day={first}" not in k}
    tm.compact(spark, out, first, date.fromordinal(first.toordinal() + 1))
    assert {k: t for k, t in files(f"{out}/days").items() if f"day={first}" not in k} == untouched
    assert len(rows(tm.read(spark, out, end))) == len(whole) + 1
    plan = tm.read(spark, out, end).filter(F.col("day") == F.lit(first))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_rows_without_time_or_context(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = "scan_id long, target_id long, event_id long, stage string, status string, service string, message string, context string, ts timestamp"
    tm.append(spark.createDataFrame([(1, 1, 1, "fetch", "running", "s", None, None, None), (1, 1, 2, "fetch", "failed", "s", "m", '{"http_status": "odd"}', NOW)], schema), out, 0)
    got = {r.event_id: (r.day.isoformat(), r.http_status, r.context) for r in tm.read(spark, out).collect()}
    assert got == {1: ("1970-01-01", None, None), 2: ("2026-02-01", None, '{"http_status":"odd"}')}
