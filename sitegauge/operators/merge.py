"""Upserts by key. A table format's MERGE could replace this module and the bucketed snapshots alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

C = F.col


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a folder of that name, on whatever storage the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def latest_per_key(rows: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """Last write per key, as a combinable aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """Full outer merge of two snapshots with unique keys.

    Columns of ``new`` replace those of ``old``; ``rules`` gives the value of a column for rows present in ``new``,
    written over ``o`` (old row, null when absent) and ``n`` (new row).
    """
    added = [c for c in new.columns if c not in old.columns]  # columns the old snapshot does not have yet
    old = old.withColumns({c: F.lit(None).cast(new.schema[c].dataType) for c in added})
    columns = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*columns).alias("o"))
    n = new.select(*keys, F.struct(*[c for c in new.columns if c not in keys]).alias("n"))
    merged = o.join(n, keys, "full_outer")
    values = []
    for c in columns:
        fresh = (rules or {}).get(c)
        if fresh is None:
            fresh = C(f"n.{c}") if c in new.columns else C(f"o.{c}")
        values.append(F.when(C("n").isNotNull(), fresh).otherwise(C(f"o.{c}")).alias(c))
    return merged.select(*keys, *values)


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one per key: the first by ``position`` if there is one, else by all columns."""
    rest = [c for c in new.columns if c not in keys]
    order = F.struct(*(["position"] if "position" in rest else []), *[c for c in rest if c != "position"])
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*") if rest else new.distinct()
    return first.join(old.select(*keys), keys, "left_anti")
