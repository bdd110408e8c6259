"""Jobs must not move or store what cannot matter to the result."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import finding as fd, text as tx
from sitegauge.operators import copies as cp, duplicates as dp, lifecycle as lc, reports as rp, snapshots as sn
from sitegauge.plans import catalog, views as v
from sitegauge.session import shared_folder
from sitegauge.streaming import telemetry as tm


def stored_bytes(spark):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared_folder(spark)) for f in names)


def words(first, n):
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("w"), (first * 1000 + i).cast("string"))), " ")


def test_texts_without_a_common_shingle_are_not_stored(spark):
    corpus = spark.range(400).select("id", words(F.col("id"), 500).alias("text")).repartition(4)
    item = spark.range(1).select((F.col("id") + 900).alias("id"), words(F.lit(7), 40).alias("text"))
    before = stored_bytes(spark)
    assert [tuple(r)[:2] for r in cp.copy_pairs(item, corpus, 0.35).collect()] == [(900, 7)]
    assert [tuple(r)[:2] for r in cp.copy_corpus_scan(item, corpus).collect()] == [(900, 7)]
    assert cp.copy_corpus_scan(corpus, item).count() == 0
    assert stored_bytes(spark) - before < 200_000  # the sets of the corpus alone take 1.6 MB each time


def shuffled_bytes(spark):
    rows = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(rows.apply(i).totalShuffleWrite() for i in range(rows.size()))


def test_candidates_move_few_hashes(spark):
    text = F.concat_ws(" ", words(F.lit(7), 60), words(F.col("id") + 10, 300))
    pages = dp.dup_sketch(spark.range(600).select(F.lit("all").alias("grp"), "id", F.col("id").alias("position"), text.alias("text"))).drop("text")
    sets = {r["id"]: {e[:16] for e in r["sketch"]} for r in pages.collect()}
    before = shuffled_bytes(spark)
    got = {(r["id"], r["candidate_id"], r["shared_seen"], r["min_hash"], r["candidate_rank"]) for r in dp.candidates(pages).collect()}
    moved = shuffled_bytes(spark) - before
    want = set()
    for a in sets:
        ranked = sorted((-len(sets[a] & sets[b]), min(sets[a] & sets[b]), b) for b in range(max(0, a - 200), a) if sets[a] & sets[b])
        want |= {(a, b, -n, h, k + 1) for k, (n, h, b) in enumerate(ranked[:30])}
    assert {g for g in got if g[0] <= 200} == {w for w in want if w[0] <= 200}
    assert moved < 6_000_000


def test_candidates_move_windows_not_pairs(spark):
    """40 hashes with 600 holders each and every page in eight of them: 4.8 million pairs in the windows."""
    k, page = F.col("k"), F.col("id")
    held = spark.range(-1500, 1500).crossJoin(spark.range(40).select(F.col("id").alias("k"))).filter(F.pmod(F.xxhash64(page, k), F.lit(5)) == 0)
    sketch = F.sort_array(F.collect_list(F.concat(F.lpad(F.hex(F.when(k % 2 == 1, F.lit(-(1 << 63)) + k * 7).otherwise(k * 7)), 16, "0"), F.lit("some words"))))
    pages = held.groupBy("id").agg(sketch.alias("sketch")).select(F.lit("all").alias("grp"), page.cast("int").alias("id"), (page * 7 + 3).alias("position"), F.transform("sketch", F.lower).alias("sketch"))
    pages = spark.createDataFrame(pages.collect(), pages.schema)
    before = shuffled_bytes(spark)
    found = dp.candidates(pages)
    rows = found.collect()
    assert shuffled_bytes(spark) - before < 6_000_000
    assert found.schema["id"].dataType.simpleString() == found.schema["candidate_id"].dataType.simpleString() == "int"
    sets, got = {r.id: [e[:16] for e in r.sketch] for r in pages.collect()}, {}
    for r in sorted(rows, key=lambda r: r.candidate_rank):
        assert (r.position, r.candidate_position) == (r.id * 7 + 3, r.candidate_id * 7 + 3)
        got.setdefault(r.id, []).append((r.candidate_id, r.shared_seen, r.min_hash))
    holders = {}
    for i in sorted(sets):
        seen = {}
        for h in sets[i]:
            for c in holders.setdefault(h, [])[-200:]:
                seen.setdefault(c, []).append(h)
            holders[h].append(i)
        ranked = sorted((-len(hs), min(hs), c) for c, hs in seen.items())[:30]
        assert got.get(i, []) == [(c, -n, h) for n, h, c in ranked], i


def test_lines_meet_orders_before_they_grow(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before, n = shuffled_bytes(spark), v.site_findings(spark, "/root/testdata/sf0.01").count()
        full = v.site_findings(spark, "/root/testdata/sf0.01")
        full.write.format("noop").mode("overwrite").save()
        assert shuffled_bytes(spark) - before < 60 * n  # a finding itself takes well over 100 bytes
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def moved_without_broadcast(spark, df):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        df.write.format("noop").mode("overwrite").save()
        return shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_only_what_a_scope_may_resolve_is_moved(spark):
    sf = "/root/testdata/sf0.01"
    rows = catalog.queries()["lifecycle_resolve_ai"](spark, sf)
    assert moved_without_broadcast(spark, rows) < 120 * v.findings(spark, sf).count()


@pytest.mark.parametrize("scope", ["browser", "copy", "duplicates"])
def test_resolving_moves_as_little_in_every_scope(spark, scope):
    sf = "/root/testdata/sf0.01"
    rows = catalog.queries()[f"lifecycle_resolve_{scope}"](spark, sf)
    assert moved_without_broadcast(spark, rows) < 80 * v.findings(spark, sf).count()


def test_wide_export_moves_keys_and_one_text(spark):
    sf = "/root/testdata/sf0.01"
    rows = catalog.queries()["export_findings_wide"](spark, sf)
    assert moved_without_broadcast(spark, rows) < 300 * v.findings(spark, sf).count()


def test_wide_export_keeps_odd_texts_and_keys(spark):
    day = datetime(2026, 1, 2)
    kind = "website_id long, page_id long, fingerprint string, public_id string, scan_id long, rule_key string, category string, severity string, confidence int, status string, title string, summary string, policy_reference string, first_seen_at timestamp, last_seen_at timestamp, remediation array<string>"
    rows = [(w, g, "f", f"{w} {g}", 7, "ai.x", "odd", None, None, "open", "\x01\x02n", "", None, day, None, ["a", None, "b\n"]) for w in (1, 2, None) for g in (1, 2, None)]
    sites = spark.createDataFrame([(1, "s.example", "https://s.example/"), (None, "none", "none")], "website_id long, domain string, start_url string")
    pages = spark.createDataFrame([(1, "https://s.example/1"), (1, "https://s.example/1b"), (None, "none")], "page_id long, url string")
    got = {tuple(r) for r in rp.export_findings_wide(spark.createDataFrame(rows, kind), sites, pages).collect()}
    rest = ("AI", "ai.x", "odd", None, None, [r.x for r in spark.range(1).select(fd.label(F.lit("open")).alias("x")).collect()][0], "\x01\x02n", "", None, "2026-01-02T00:00:00+00:00", None, "a\nb\n")
    want = set()
    for w in (1, 2, None):
        site = ("s.example", "https://s.example/") if w == 1 else (None, None)
        for g in (1, 2, None):
            want |= {(f"{w} {g}", "7", site[0], url or site[1], *rest) for url in (("https://s.example/1", "https://s.example/1b") if g == 1 else (None,))}
    assert got == want


def test_findings_without_a_page_are_kept_unresolved(spark):
    day = datetime(2026, 1, 1)
    kind = "website_id long, page_id long, fingerprint string, rule_key string, category string, status string, last_seen_at timestamp, resolved_at timestamp"
    rows = [(w, g, f"f{i}", "content.x", "Content quality", "open", day, None) for i, (w, g) in enumerate([(1, 1), (1, None), (None, 1), (1, 2), (1, 1)])]
    findings = spark.createDataFrame(rows, kind)
    pages = spark.createDataFrame([(1, 1), (None, 1), (1, None)], "website_id long, page_id long")
    seen = spark.createDataFrame([(1, "f4")], "website_id long, fingerprint string")
    out = lc.resolve_missing(findings, pages, seen, F.lit(datetime(2026, 2, 1)), F.lit(datetime(2026, 3, 1)), "local")
    assert {r.fingerprint: r.status for r in out.collect()} == {"f0": "resolved", "f1": "open", "f2": "open", "f3": "open", "f4": "open"}


def test_upsert_moves_digests_as_bytes(spark):
    sf = "/root/testdata/sf0.01"
    rows = catalog.queries()["lifecycle_upsert"](spark, sf)
    assert moved_without_broadcast(spark, rows) < 180 * v.findings(spark, sf).count()
    prints = ["", "ab", "abc", "AB", "0" * 64, "é", "a|b", None]
    back = spark.createDataFrame([(i, x) for i, x in enumerate(prints)], "i int, p string").select("i", fd.unpacked(fd.packed(F.col("p"))).alias("p"))
    assert [r.p for r in back.orderBy("i").collect()] == prints


def test_stored_findings_move_once(spark):
    sf = "/root/testdata/sf0.01"
    n, before, kept = v.findings(spark, sf).count(), shuffled_bytes(spark), stored_bytes(spark)
    rows = catalog.queries()["sink_findings"](spark, sf)
    assert shuffled_bytes(spark) - before < 350 * n
    assert stored_bytes(spark) - kept < 160 * n
    assert rows.count() == 79_884


def test_packed_texts_come_back(spark):
    texts = ["", "a", "\x01", "\x02", "\x02n", "\x02m\x01b", "é\n|", None]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)]
    df = spark.createDataFrame(rows, "i int, a string, b string").select("i", tx.packed([F.col("a"), F.col("b")]).alias("p"))
    a, b = tx.unpacked(F.col("p"), 2)
    assert [tuple(r) for r in df.select("i", a, b).orderBy("i").collect()] == rows


def test_merging_where_rows_are_dealt_keeps_odd_keys(spark, tmp_path):
    """Null and repeated keys of the old rows stay as a join leaves them, also when only some buckets are touched."""
    day = datetime(2026, 1, 1)
    kind = "website_id long, fingerprint string, severity string, note string, tags array<string>, status string, first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp"
    old = spark.createDataFrame([(w, f"{k:064x}" if k % 3 else f"odd {k}", "high", None if k % 2 else "\x01", ["x", None], "open", day, day, None) for k in range(200) for w in (1, None)] + [(1, f"{1:064x}", "low", "", None, "resolved", day, day, day)], kind)
    keys = [F.col("website_id").isNull(), F.col("fingerprint").endswith("1")]
    new = old.filter(keys[1] | (F.col("fingerprint") == "odd 3")).drop("status", "first_seen_at", "last_seen_at", "resolved_at").withColumn("seen_order", F.lit(1)).dropDuplicates(["website_id", "fingerprint"])
    now = F.lit(datetime(2026, 3, 1))
    show = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    want = show(lc.lifecycle_upsert(old, new, now))
    table = sn.findings_at(str(tmp_path / "t"), 16).create(old)
    new = spark.createDataFrame(new.collect(), new.schema)
    assert 0 < len(sn.store_findings(table, new, now)) <= 16
    assert show(table.read(spark)) == want


def test_a_large_day_is_written_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tm, "PIECE", 200_000, raising=False)
    k = F.col("id")
    events = spark.range(1000).select(
        k.alias("scan_id"), k.alias("target_id"), k.alias("event_id"), F.lit("s").alias("stage"), F.lit("running").alias("status"), F.lit("crawler").alias("service"),
        F.repeat(F.lit("x"), 9000).alias("message"), F.lit(None).cast("string").alias("context"), F.lit(datetime(2024, 1, 1)).alias("ts"))
    tm.append(events, str(tmp_path), 0)
    files = [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    assert len(files) > 20 and tm.read(spark, str(tmp_path)).count() == 1000
    tm.append(events.limit(0), str(tmp_path), 1)
    assert tm.read(spark, str(tmp_path)).count() == 1000


def test_equal_payloads_are_exploded_once(spark):
    catalog.queries()["udtf_explode_findings"](spark, "/root/testdata/sf0.001")
    payloads = spark.table("stored_findings")
    assert payloads.count() == payloads.select("payload").distinct().count()
