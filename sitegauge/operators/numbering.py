"""Skew-proof building blocks: numbering inside groups and joins against one-row-per-key tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sitegauge.params import DEFAULT
from sitegauge.session import cut


def number_in_group(
    df: DataFrame, group: list[str], order: str, name: str, chunk: int = DEFAULT.chunk, levels: int = 1
) -> DataFrame:
    """``row_number()`` per group in order of a unique integer column, without one task per group.

    Rows are numbered inside (group, chunk of the order column), which holds at most ``chunk`` rows however large
    the group is; chunk sizes are then summed per group to get each chunk's first number. Where the order column is
    sparse, a group may have as many chunks as rows: ``levels`` then sums chunks of chunks first, so that with three
    levels no task sorts more than ``chunk`` rows of a group for any 63-bit order. A null group is a group.
    """
    rows = df.withColumn("_chunk", F.expr(f"`{order}` div {chunk}") - (F.col(order) < 0).cast("long"))
    sizes = rows.groupBy(*group, "_chunk").agg(F.count("*").alias("_size"))
    starts = _starts(sizes, group, "_chunk", chunk, levels).withColumnsRenamed({c: f"_s{c}" for c in [*group, "_chunk"]})
    local = rows.withColumn("_local", F.row_number().over(W.partitionBy(*group, "_chunk").orderBy(order)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in [*group, "_chunk"]])
    numbered = local.join(starts, same).withColumn(name, F.col("_start") + F.col("_local"))
    return numbered.drop("_chunk", "_start", "_local", *[f"_s{c}" for c in [*group, "_chunk"]])


def _starts(sizes: DataFrame, group: list[str], at: str, chunk: int, levels: int) -> DataFrame:
    """Rows before each chunk of its group, from ``_size`` per chunk."""
    if levels <= 1:
        before = W.partitionBy(*group).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
        return sizes.select(*group, at, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    upper = f"{at}_up"
    rows = sizes.withColumn(upper, F.floor(F.col(at) / F.lit(chunk)))
    outer = _starts(rows.groupBy(*group, upper).agg(F.sum("_size").alias("_size")), group, upper, chunk, levels - 1)
    outer = outer.withColumnsRenamed({**{c: f"_o{c}" for c in [*group, upper]}, "_start": "_base"})
    before = W.partitionBy(*group, upper).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    inner = rows.withColumn("_inside", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in [*group, upper]])
    return inner.join(outer, same).select(*group, at, (F.col("_base") + F.col("_inside")).alias("_start"))


def spread_join(
    rows: DataFrame, table: DataFrame, keys: list[str], by: str, how: str = "inner", salts: int = DEFAULT.salts
) -> DataFrame:
    """Join with a table of one row per key; a key holding any share of ``rows`` is split over ``salts`` tasks.

    Only the (key, salt) combinations that occur are looked up in ``table``, so nothing is replicated blindly.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)))
    used = salted.select(*keys, "_salt").distinct()
    return salted.join(used.join(table, keys), [*keys, "_salt"], how).drop("_salt")


def lookup(rows: DataFrame, table: DataFrame, key: str, by: str) -> DataFrame:
    """Left join with a table of one row per key, reading ``rows`` once.

    Rows without a key would all meet in one task: they get one of 64 places that ``table`` does not have, by the column
    ``by``. A key that holds many rows is split at run time by the adaptive skew join, or needs no shuffle at all where
    the table turns out small enough to be sent to every task.
    """
    place = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(by), F.lit(64)) + 1).otherwise(0)
    return rows.withColumn("_place", place).join(table.withColumn("_place", F.lit(0).cast("long")), [key, "_place"], "left").drop("_place")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group. The filter on the rank lets Spark keep ``n`` rows per task before the shuffle."""
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


#: Up to so many rows a group's first ones are picked by a rank filter, which keeps that many rows per task and group.
FEW = 1000


def first_ranked(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group in a total order, with their rank; for a large ``n`` no task sorts a group.

    All rows are dealt by ranges of (group, order), so a large group lies in consecutive ranges. Counting rows per group and
    range tells which ranges a group's first ``n`` rows are in; the others are left out, and the rest is numbered inside
    its range. What is counted is one row per range that a group touches.
    """
    if n <= FEW:
        return top_per_group(df, group, order, n, name)
    ranged = cut(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "_range").agg(F.count("*").alias("_size"))
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).filter(F.col("_start") < n).drop("_size")
    starts = starts.withColumnsRenamed({c: f"_s{c}" for c in [*group, "_range"]})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in [*group, "_range"]])
    needed = ranged.join(starts, same)
    inside = F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order))
    ranked = needed.withColumn(name, (F.col("_start") + inside).cast("int")).filter(F.col(name) <= n)
    return ranked.drop("_range", "_start", *[f"_s{c}" for c in [*group, "_range"]])


def first_per_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The first row per group as a combinable aggregate (no window, no sort of the group)."""
    rest = [c for c in df.columns if c not in group]
    key = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*group).agg(F.min_by(F.struct(*rest), key).alias("_row"))
    return picked.select(*group, "_row.*")
