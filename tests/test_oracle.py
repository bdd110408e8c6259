"""Registered queries against their reference SQL. ALL_QUERIES=1 runs every one; the default is a quick selection."""

import os

import pytest

import __spark_entry__ as entry
from oracle_compare import ROOT, compare, oracle_connection

QUICK = ["site_overview", "url_normalize", "page_text", "rules_local", "site_score", "lifecycle_upsert", "scan_progress", "site_policy_groups", "plan_batches", "stream_progress",
         "export_findings_csv", "q_live_findings", "sink_findings", "sink_telemetry", "src_sitemaps", "scan_supersede", "q_paginate_deep", "assessment_normalize"]
NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    sf = f"{ROOT}/sf0.001"
    result, _ = compare(spark, oracle_connection(sf), sf, entry.queries()[name], entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    assert entry.entry(spark).columns == ["site", "score", "open_findings", "status"]
