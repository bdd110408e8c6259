"""Sitemap files, lenient dates, incremental reachability, ranked picks of large groups, deep pages."""

import gzip
import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import discovery as dc, numbering as nb, reports as rp, sitemap_files as sf


def urlset(n, tag="p"):
    items = "".join(f"<url>\n <loc> https://e.example/{tag}{i}?a=1&amp;b={i} </loc><lastmod>2024-01-{i % 28 + 1:02}</lastmod></url>" for i in range(n))
    return f"<?xml version='1.0'?><!-- <url><loc>no</loc></url> --><urlset xmlns='x'>{items}</urlset>".encode()


def test_files_of_every_kind(spark, tmp_path):
    text = urlset(10)
    cdata = b"<urlset><url><image:image><image:loc>https://i/x.png</image:loc></image:image><loc><![CDATA[https://e.example/a&b]]></loc></url><url><loc> </loc></url></urlset>"
    index = b"<sitemapindex><sitemap><loc>https://e.example/s1.xml</loc><lastmod>2024-02-02</lastmod></sitemap><url><loc>https://e.example/no</loc></url></sitemapindex>"
    files = {"plain.xml": text, "one.xml.gz": gzip.compress(text), "members.xml.gz": gzip.compress(text[:300]) + gzip.compress(text[300:700]) + gzip.compress(text[700:]),
             "broken.xml.gz": gzip.compress(urlset(4000))[:9000], "garbage.xml.gz": b"\x1f\x8bnothing", "index.xml": index, "cdata.xml": cdata, "empty.xml": b"", "html.xml": b"<html><url><loc>x</loc></url>"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in sf.read_entries(spark, str(tmp_path)).collect():
        got.setdefault(os.path.basename(r.file), []).append(r)
    want = [f"https://e.example/p{i}?a=1&b={i}" for i in range(10)]
    for name in ("plain.xml", "one.xml.gz", "members.xml.gz"):
        rows = sorted(got[name], key=lambda r: r.i)
        assert [r.loc for r in rows] == want and [r.i for r in rows] == list(range(10)) and rows[3].lastmod == "2024-01-04" and {r.kind for r in rows} == {"urlset"}
    assert [(r.kind, r.loc, r.lastmod) for r in got["index.xml"]] == [("index", "https://e.example/s1.xml", "2024-02-02")]
    assert [r.loc for r in got["cdata.xml"]] == ["https://e.example/a&b"]
    broken = got["broken.xml.gz"]
    assert sum(r.error is not None for r in broken) == 1 and sum(r.loc is not None for r in broken) > 100
    assert [r.error is not None for r in got["garbage.xml.gz"]] == [True]
    assert "empty.xml" not in got and "html.xml" not in got


def test_large_file_in_pieces(spark, tmp_path, monkeypatch):
    text = urlset(50_000, "long-path-segment/")
    (tmp_path / "big.xml.gz").write_bytes(gzip.compress(text))
    rows = sf.read_entries(spark, str(tmp_path), "*.gz")
    assert rows.agg(F.count("*"), F.countDistinct("loc"), F.max("i")).first()[:] == (50_000, 50_000, 49_999)
    monkeypatch.setattr(sf, "PIECE", 7)  # read in this process: no cut between pieces loses an entry
    assert [x[1] for x in sf.entries(memoryview(urlset(40)))] == [f"https://e.example/p{i}?a=1&b={i}" for i in range(40)]


def test_dates_are_read_leniently(spark):
    day = int(datetime(2024, 3, 5, tzinfo=timezone.utc).timestamp())
    values = {
        "2024-03-05": day, "2024-03-05T01:02:03+00:00": day + 3723, "2024-03-05T02:02:03.500+01:00": day + 3723, "Tue, 05 Mar 2024 01:02:03 GMT": day + 3723,
        "5 Mar 2024": day, "Tuesday, 5 March 2024": day, "March 5, 2024": day, "Mar 5 2024": day, "2024/03/05": day, "20240305": day, " 2024-03-05 01:02:03 ": day + 3723,
        "Tue, 05 Mar 2024 03:02:03 +0200": day + 3723, "2024-03-05T01:02Z": day + 3720, "soon": 0, "": 0, None: 0}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r.v: r.e for r in df.select("v", dc.lastmod_epoch(F.col("v")).alias("e")).collect()}
    assert got == values


def brute_depths(starts, edges):
    depth, wave = {s: 0 for s in starts}, list(starts)
    while wave:
        nxt = []
        for site, u in wave:
            for t in edges.get((site, u), ()):
                if (site, t) not in depth:
                    depth[(site, t)] = depth[(site, u)] + 1
                    nxt.append((site, t))
        wave = nxt
    return depth


def test_reachability_follows_changes(spark):
    rng = random.Random(8)
    def edges(n):
        return {(s, f"n{rng.randint(0, 14)}", f"n{rng.randint(0, 14)}") for s in ("a", "b", "c") for _ in range(n)}
    old = edges(14)
    old |= {("c", f"m{i}", f"m{i + 1}") for i in range(20)} | {("c", "n0", "m0")}
    new = {e for e in old if e[0] != "b" or rng.random() < 0.7} | {e for e in edges(4) if e[0] != "c"}
    starts = [("a", "n0"), ("b", "n0"), ("b", "n3"), ("c", "n0")]
    later = [("a", "n0"), ("a", "n9"), ("b", "n0"), ("c", "n0")]
    frame = lambda rows, cols: spark.createDataFrame(sorted(rows), cols)
    e_old, e_new = (frame(x, "site string, from_url string, to_url string") for x in (old, new))
    s_old, s_new = (frame(x, "site string, url string") for x in (starts, later))
    graph = lambda rows: {k: [t for s, f, t in rows if (s, f) == k] for k in {(s, f) for s, f, _ in rows}}
    first = dc.link_reachable(s_old, e_old)
    assert {(r.site, r.url): r.depth for r in first.collect()} == brute_depths(starts, graph(old))
    again = dc.update_reachable(first, e_old, e_new, s_new)
    assert {(r.site, r.url): r.depth for r in again.collect()} == brute_depths(later, graph(new))
    same = dc.update_reachable(first, e_old, e_old, s_old)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, first.collect()))


@pytest.mark.parametrize("n", [1, 7, 2500])
def test_ranked_picks_equal_a_window(spark, n, monkeypatch):
    monkeypatch.setattr(nb, "FEW", 3)
    df = spark.range(6000).select(F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 2 == 0, "cold").alias("g"), (F.col("id") * 7919 % 500).alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    got = sorted((str(r.g), r.id, r.k) for r in nb.first_ranked(df, ["g"], order, n, "k").collect())
    want = sorted((str(r.g), r.id, r.k) for r in nb.top_per_group(df, ["g"], order, n, "k").collect())
    assert got == want and len(got) == sum(min(n, c) for c in (4000, 1000, 1000))


def test_a_large_group_is_numbered_in_ranges(spark, monkeypatch):
    """The ranges of one group hold about equal shares, so no task sorts it."""
    df = spark.range(0, 40_000, 1, 8).withColumn("g", F.lit("one"))
    dealt = df.repartitionByRange(8, "g", "id").withColumn("r", F.spark_partition_id()).groupBy("r").count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 12_000
    assert nb.first_ranked(df, ["g"], [F.asc("id")], 30_000, "k").filter("k <> id + 1").count() == 0


def test_pages_of_a_stored_order(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") % 40).alias("day"), "id")
    index = rp.Ordered(str(tmp_path / "o"), ("-day", "id")).build(df, 16)
    whole = [(r.day, r.id) for r in df.orderBy(F.desc("day"), "id").collect()]
    for page, size in ((1, 10), (3, 700), (167, 30), (50, 100), (51, 100), (10**6, 30), (0, 5)):
        first = (max(1, page) - 1) * size
        got = index.page(spark, page, size)
        assert [(r.day, r.id) for r in got.collect()] == whole[first:first + size]
    plan = index.page(spark, 40, 30)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan and "IN (" in plan or "(part#" in plan.split("PartitionFilters")[1][:80]
