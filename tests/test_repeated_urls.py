"""Tables stored as folders, and pages of one site that share a URL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_compare import ROOT, TABLES, compare

SF = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def twin_pages(spark, tmp_path_factory):
    """Pages in a folder of two files; every page comes again under another id, a third of them with another body."""
    d = str(tmp_path_factory.mktemp("twins"))
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(60)
    body = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("<p>one more line</p>"))).otherwise(F.col("html"))
    twins = pages.select((F.col("page_id") + 1001).alias("page_id"), "url", body.alias("html"))
    pages.unionByName(twins).repartition(2).write.parquet(f"{d}/pages.parquet")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{f'{d}/pages.parquet/*.parquet' if t == 'pages' else f'{SF}/{t}.parquet'}'")
    return d, con


@pytest.mark.parametrize("name", ["stream_scan_pages_live", "reuse_decision", "sink_pages", "target_missing_failed", "target_document_match"])
def test_folder_of_twin_pages(spark, twin_pages, name):
    d, con = twin_pages
    result, rows = compare(spark, con, d, entry.queries()[name], entry.oracle_sql()[name])
    assert result.startswith("ok") and rows > 0, result
