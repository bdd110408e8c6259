"""All registered queries: name -> Spark query and, where SQL can express it on whole tables, the reference SQL."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from sitegauge.session import tune

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from sitegauge.plans import catalog_discovery, catalog_findings, catalog_lifecycle, catalog_pages, catalog_reports, catalog_streams

    return [catalog_pages, catalog_findings, catalog_discovery, catalog_lifecycle, catalog_reports, catalog_streams]


def _tuned(fn: Query) -> Query:
    return lambda spark, sf_dir: fn(tune(spark), sf_dir)


def queries() -> dict[str, Query]:
    return {name: _tuned(fn) for m in _modules() for name, (fn, _) in m.ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, (_, sql) in m.ENTRIES.items() if sql}
