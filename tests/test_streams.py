"""Streams over random chunks, restarts, replay and late rows against their batch forms."""

import random
import time
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitegauge.operators import snapshots as sn
from sitegauge.params import DEFAULT
from sitegauge.plans import catalog_streams as cs, views as v
from sitegauge.streaming import live as lv, stages as sg

SF = "/root/testdata/sf0.001"


def chunked(events, days: float, late: float, seed: int):
    """Chunk numbers by arrival: an event comes up to ``late`` days after its time."""
    jitter = F.rand(seed) * F.lit(late * 86_400)
    return events.withColumn("_chunk", F.floor((F.unix_seconds("ts") + jitter) / F.lit(days * 86_400)))


def deliver(rows, path, numbers):
    for k in numbers:
        rows.filter(F.col("_chunk") == k).drop("_chunk").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)


def key(df):
    return sorted(tuple(r) for r in df.select("target_id", "stage", "start_id", "finish_id", "status", "duration_ms").collect())


@pytest.mark.parametrize("open_days", [365, 2])
def test_stage_durations_out_of_order_and_restarted(spark, tmp_path, open_days):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    p = DEFAULT.with_(late_events="3 days", open_stage_days=open_days)
    spread = chunked(v.events(spark, SF), 8, 3, 7).cache()
    numbers = sorted(r[0] for r in spread.select("_chunk").distinct().collect())
    tick = spark.createDataFrame([(-2, datetime(2030, 1, 1), -1, "tick")], "event_id long, ts timestamp, user_id long, event_type string")
    read = lambda: spark.readStream.schema(v.events(spark, SF).schema).option("maxFilesPerTrigger", 1).parquet(src)
    run = lambda: lv.start_files(sg.stream_stage_durations(cs.stages(read()), p), out).awaitTermination()
    deliver(spread, src, numbers[:2])
    run()
    early = spark.read.schema(sg.DURATION_SCHEMA).parquet(f"{out}/data").count()
    deliver(spread, src, numbers[2:])
    run()
    late = v.events(spark, SF).limit(0).unionByName(tick, allowMissingColumns=True).withColumn("_chunk", F.lit(0))
    deliver(late, src, [0])  # time goes on: what waits and what is open is due
    run()
    want = key(lv.stage_durations(cs.stages(v.events(spark, SF)), p))
    got = key(spark.read.schema(sg.DURATION_SCHEMA).parquet(f"{out}/data"))
    assert got == want and 0 < early < len(want)
    every = key(lv.stage_durations(cs.stages(v.events(spark, SF))))
    assert (len(want) < len(every)) == (open_days == 2) and set(want) <= set(every)
    state = spark.read.format("statestore").option("stateVarName", "open").load(f"{out}/_checkpoint")
    assert state.filter("key.target_id <> -1").count() == 0  # nothing stays open for good


def test_match_equals_a_stack():
    rng = random.Random(3)
    for _ in range(60):
        events, stack, pairs = [], [], []
        for k in range(rng.randint(0, 40)):
            ms = 10 * k + rng.randint(0, 9)
            status = "running" if rng.random() < 0.5 else "success"
            events.append((k, status, ms, ms))
            if status == "running":
                stack.append((k, ms))
            elif stack:
                s, t = stack.pop()
                pairs.append((s, k, ms - t))
        got, left = sg.match(pd.DataFrame(events, columns=sg.COLUMNS))
        assert sorted(got[["start_id", "finish_id", "took"]].itertuples(index=False, name=None)) == sorted(pairs)
        assert left["event_id"].tolist() == [s for s, _ in stack]


def test_match_by_group_equals_a_match_of_each():
    rng = random.Random(4)
    events = [(rng.randint(0, 3), rng.choice(["a", "b", None]), k, rng.choice(["running", "success"]), 10 * k, 10 * k) for k in range(300)]
    rows = pd.DataFrame(events, columns=[*sg.BY, *sg.COLUMNS])
    got, left = sg.match(rows, sg.BY)
    parts = [sg.match(g[sg.COLUMNS]) for _, g in rows.groupby(sg.BY, dropna=False)]
    columns = ["start_id", "finish_id", "status", "took"]
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(x for a, _ in parts for x in a[columns].itertuples(index=False, name=None))
    assert left["event_id"].tolist() == sorted(x for _, b in parts for x in b["event_id"])
    assert [tuple(x) for x in rows.set_index("event_id").loc[got["start_id"], "distance"].to_frame().to_numpy()] == [(x,) for x in got["distance"]]


def test_stage_state_is_shared_by_neighbouring_targets(spark, tmp_path):
    """Far fewer keys than (target, stage) pairs, and the batch form's rows, for negative, null and distant targets too."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    target = F.when(F.col("user_id") % 5 == 0, F.col("user_id") - 40).when(F.col("user_id") % 5 == 1, F.col("user_id") + (1 << 40)).otherwise(F.col("user_id"))
    events = v.events(spark, SF).withColumn("user_id", target)
    nulls = events.withColumn("event_type", F.when(F.col("event_id") % 3 > 0, F.col("event_type")))
    nulls.coalesce(1).write.parquet(src)
    read = spark.readStream.schema(nulls.schema).parquet(src)
    lv.start_files(sg.stream_stage_durations(cs.stages(read), DEFAULT.with_(late_events="0 seconds")), out).awaitTermination()
    named = lambda df: key(df.filter("stage is not null"))
    got = spark.read.schema(sg.DURATION_SCHEMA).parquet(f"{out}/data")
    assert named(got) == named(lv.stage_durations(cs.stages(nulls)))
    assert got.filter("stage is null").count() > 0
    timers = spark.read.format("statestore").option("readRegisteredTimers", True).load(f"{out}/_checkpoint")
    assert timers.select("key").distinct().count() * 5 < nulls.select("user_id", "event_type").distinct().count()


def test_scan_pages_stream_equals_batch_and_replay(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = v.responses(spark, SF)
    rows.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    lv.stream_scan_pages(stream, out, buckets=4).awaitTermination()
    table = lv.findings_table(out, 4)
    pick = lambda df: sorted(tuple(r) for r in df.select("fingerprint", "page_id", "severity").collect())
    batch = lv.page_findings(rows)
    assert pick(table.read(spark)) == pick(batch) and {r[0] for r in table.read(spark).select("status").distinct().collect()} == {"open"}
    # what was resolved since stays so when a batch is replayed or comes late, and reopens when a later one sees it
    now = F.lit(DEFAULT.now).cast("timestamp")
    table.upsert(table.read(spark), lambda old, new: new.withColumn("status", F.lit("resolved")))
    again = batch.withColumns({"seen_order": F.lit(0).cast("long"), "website_id": F.coalesce("website_id", F.lit(""))})
    states = lambda: {r[0] for r in table.read(spark).select("status").distinct().collect()}
    sn.store_batch(table, again, now, 0)
    assert states() == {"resolved"} and table.read(spark).count() == len(pick(batch))
    sn.store_batch(table, again, now, 9)
    assert states() == {"open"}


def test_progress_ignores_replayed_and_late_updates(spark, tmp_path):
    out, updates = str(tmp_path / "out"), cs.updates(v.events(spark, SF))
    src = str(tmp_path / "in")
    for k in (2, 0, 1):  # later updates arrive first
        updates.filter(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    read = lambda: spark.readStream.schema(updates.schema).option("maxFilesPerTrigger", 1).parquet(src)
    lv.stream_progress(read(), out, 4).awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.select("scan_id", *lv.STATUSES).collect())
    want = rows(lv.progress_counts(updates))
    assert rows(lv.live_progress(spark, out)) == want
    updates.filter("seq < 500").coalesce(1).write.mode("append").parquet(src)
    lv.stream_progress(read(), out, 4).awaitTermination()
    assert rows(lv.live_progress(spark, out)) == want


def test_page_views_stream_corrects_late_views(spark, tmp_path):
    out, views = str(tmp_path / "out"), v.page_views(spark, SF)
    src = str(tmp_path / "in")
    for k in (1, 0):
        views.filter(F.col("event_id") % 2 == k).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.02)
    stream = spark.readStream.schema(views.schema).option("maxFilesPerTrigger", 1).parquet(src)
    lv.stream_page_views(stream, out).awaitTermination()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    first, last = F.lit(datetime(2024, 1, 10)).cast("date"), F.lit(datetime(2024, 1, 20)).cast("date")
    want = rows(lv.page_views_windows(views).filter(F.col("day").between(first, last)))
    assert rows(lv.live_page_views(spark, out, first, last)) == want and len(want) > 50
