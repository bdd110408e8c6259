"""Stored records keep whole texts and lists, findings say why, look-ups keep rows without a key, numbering is sparse-proof."""

import json

from pyspark.sql import functions as F

from sitegauge.operators import normalize as nz, reports as rp, rules as ru
from sitegauge.operators.numbering import lookup, number_in_group
from sitegauge.params import DEFAULT
from sitegauge.plans import views as v

SF = "/root/testdata/sf0.001"


def test_model_findings_keep_whole_texts_and_summary(spark):
    item = {"policy_code": "sensitive_claims", "severity": "high", "confidence": 90, "title": "t" * 400, "summary": " s" + "y" * 900, "evidence": ["e" * 700], "remediation": ["r" * 900]}
    bare = {"policy_code": "sensitive_claims", "severity": "high", "confidence": 90, "title": "only a title"}
    rows = nz.llm_findings(spark.createDataFrame([("u", json.dumps({"findings": [item, bare]}), "r")], "url string, reply string, response_id string")).collect()
    a, b = sorted(rows, key=lambda r: -len(r.title))
    assert len(a.title) == 400 and len(a.summary) == 901 and len(a.remediation[0]) == 900 and len(json.loads(a.signals)["evidence"][0]) == 700
    assert b.summary == "only a title"


def test_assessments_are_cut_only_when_shown(spark):
    payload = json.dumps({"headline": "h" * 500, "summary": "s" * 6000, "priorities": ["p" * 1200] * 11, "limitations": ["l"] * 9})
    whole = nz.assessment_normalize(spark.createDataFrame([(1, payload)], "scan_id long, payload string"))
    shown = nz.shown_assessment(whole, DEFAULT.with_(shown_priorities=3))
    a, b = whole.first(), shown.first()
    assert [len(a.headline), len(a.summary), len(a.priorities), len(a.priorities[0]), len(a.limitations)] == [500, 6000, 11, 1200, 9]
    assert [len(b.headline), len(b.summary), len(b.priorities), len(b.priorities[0]), len(b.limitations)] == [300, 5000, 3, 1000, 5]


def test_every_rule_finding_has_a_summary(spark):
    rows = ru.rules_local(v.signals(spark, SF)).select("rule_key", "title", "summary").collect()
    assert rows and all(r.summary for r in rows)
    assert all(r.summary != r.title for r in rows)


def test_sites_without_pages_have_rows(spark):
    sites = spark.createDataFrame([(1,), (2,)], "website_id long")
    pages = v.site_pages(spark, SF).withColumn("website_id", F.lit(1).cast("long"))
    profile = {r.website_id: r for r in rp.site_page_profile(sites, pages).collect()}
    assert profile[1].pages > 0 and profile[2].pages == 0 and profile[2].average_words == 0
    assert {r.website_id: len(r.missing) for r in rp.missing_types(sites, pages).collect()}[2] == 7
    assert {r.website_id: r.titles for r in rp.site_titles_sample(sites, pages, DEFAULT.with_(shown_titles=2)).collect()}[2] == []


def test_lookup_keeps_rows_without_a_key_and_reads_once(spark, tmp_path):
    rows = spark.range(500).select("id", F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("k"))
    table = spark.createDataFrame([(0, "a"), (2, "b")], "k long, v string")
    got = {r.id: r.v for r in lookup(rows, table, "k", "id").collect()}
    assert got == {i: {0: "a", 2: "b"}.get(i % 5) if i % 2 == 0 else None for i in range(500)}
    rows.write.parquet(str(tmp_path / "t"))
    plan = lookup(spark.read.parquet(str(tmp_path / "t")), table, "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_export_reads_each_table_once(spark):
    df = rp.export_findings_wide(v.site_findings(spark, SF), v.sites(spark, SF), v.site_pages(spark, SF))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert {t: plan.count(f"{t}.parquet") for t in ("lineitem", "customer", "part")} == {"lineitem": 1, "customer": 1, "part": 1}


def test_numbering_of_sparse_orders_and_null_groups(spark):
    values = [(("a", None)[i % 2], (i * i * 2**40) % (2**62) + i) for i in range(400)] + [("b", -5), ("b", -70), ("b", 3)]
    df = spark.createDataFrame(values, "g string, k long")
    for levels in (1, 3):
        ranks = {}
        for r in sorted(number_in_group(df, ["g"], "k", "n", 16, levels).collect(), key=lambda r: r.k):
            ranks.setdefault(r.g, []).append(r.n)
        assert {g: x == list(range(1, len(x) + 1)) and len(x) for g, x in ranks.items()} == {"a": 200, None: 200, "b": 3}
