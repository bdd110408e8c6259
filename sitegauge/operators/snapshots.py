"""Current-state tables in hash buckets: an upsert reads and rewrites only the buckets that hold its keys.

A snapshot is a Parquet table partitioned by ``bucket``, a hash of its key columns. An upsert finds the buckets of the new
rows, merges them with the old rows of those buckets and overwrites just these partitions. A small batch on a large table
costs its own buckets, whatever the size of the table.

One writer at a time. An upsert that is interrupted leaves every bucket either old or new; running it again with the same
rows completes it, as merging the same rows twice changes nothing. The number of buckets belongs to the table: choose it so
that a bucket fits a few tasks. Hot sites do not matter, as the key names a row; a large bucket is written by several tasks.

A first state is written where its rows are read. Findings are merged in slices of buckets: old and new rows are dealt once,
by slice, with their texts in one column, and merged and written where they arrive.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sitegauge.functions import finding as fd, text as tx
from sitegauge.operators import lifecycle as lc, merge as mg
from sitegauge.session import stored

BUCKET = "bucket"
#: Part of a bucket that one task merges.
SLICE = "_slice"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextmanager
def open_files(spark: SparkSession, n: int):
    """A task keeps a file open per partition it writes, instead of sorting its rows by partition first."""
    before = spark.conf.get(WRITERS, None)
    spark.conf.set(WRITERS, n)
    try:
        yield
    finally:
        spark.conf.unset(WRITERS) if before is None else spark.conf.set(WRITERS, before)


@dataclass(frozen=True)
class Snapshot:
    path: str
    keys: tuple[str, ...]
    buckets: int = 64
    slices: int = 4  # tasks a bucket is merged by, and files it has then

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, mode: str, in_place: bool = False) -> None:
        """``in_place``: each task writes the rows it has, to a file per bucket."""
        rows = rows if in_place else rows.hint("rebalance", BUCKET)  # small buckets share a task, large ones are split
        to = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(BUCKET)
        with open_files(rows.sparkSession, self.buckets) if in_place else nullcontext():
            to.parquet(self.path)

    def _dealt(self, rows: DataFrame, touched: list[int]) -> DataFrame:
        """Rows dealt by slices of the touched buckets, equal keys to the same; on the way their texts are one column."""
        text = {f.name for f in rows.schema if f.dataType == T.StringType()}
        keys, packed = [c for c in self.keys if c in text], [c for c in rows.columns if c in text and c not in self.keys]
        whole = F.xxhash64(*self.keys)
        place = F.array_position(F.lit(touched), F.pmod(whole, F.lit(self.buckets)).cast("int")) - 1
        part = F.pmod(F.shiftrightunsigned(whole, 40), F.lit(self.slices))
        lean = rows.select(
            (place * self.slices + part).cast("int").alias(SLICE), *[fd.packed(F.col(c)).alias(c) if c in keys else F.col(c) for c in rows.columns if c not in packed],
            tx.packed([F.col(c) for c in packed]).alias("_texts"),
        ).repartitionById(len(touched) * self.slices, F.col(SLICE))
        texts = dict(zip(packed, tx.unpacked(F.col("_texts"), len(packed))))
        return lean.select(SLICE, *[(texts[c] if c in packed else fd.unpacked(F.col(c)) if c in keys else F.col(c)).alias(c) for c in rows.columns])

    def create(self, rows: DataFrame) -> "Snapshot":
        """Writes the first state, with or without rows; keys are unique and not null. An existing table is an error."""
        self._write(self._with_bucket(rows), "error", in_place=True)
        rows.limit(0).write.parquet(f"{self.path}/{BUCKET}=-1")  # an empty file that tells the columns of an empty table
        return self

    def ensure(self, empty: DataFrame) -> "Snapshot":
        """Creates the table with the columns of ``empty`` unless it is there."""
        return self if mg.exists(empty.sparkSession, f"{self.path}/{BUCKET}=-1") else self.create(empty.limit(0))

    def part(self, spark: SparkSession, buckets: list[int]) -> DataFrame:
        """Rows of some buckets, with their ``bucket``; only their files are read."""
        return spark.read.option("mergeSchema", "true").parquet(self.path).filter(F.col(BUCKET).isin(buckets))

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows; columns that later batches brought are null in buckets written before."""
        return spark.read.option("mergeSchema", "true").parquet(self.path).drop(BUCKET)

    def upsert(self, new: DataFrame, merge: Callable[..., DataFrame], by_key: bool = False) -> list[int]:
        """Merges ``new`` into the table and returns the buckets that were rewritten.

        ``merge(old, new)`` gets the old rows of the touched buckets and returns their next state. With ``by_key`` it is
        ``merge(old, new, keys)``, must join and group by these keys alone, and keeps their columns: the rows then stay
        where they were dealt. Bucket numbers, at most one per bucket, are all that reaches the driver.
        """
        spark = new.sparkSession
        rows = stored(self._with_bucket(new))  # evaluated once, and apart from the files that are replaced
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
        if touched:
            old = self.part(spark, touched).drop(BUCKET)
            rows = rows.drop(BUCKET)
            merged = merge(self._dealt(old, touched), self._dealt(rows, touched), [SLICE, *self.keys]).drop(SLICE) if by_key else merge(old, rows)
            kinds = {f.name: f.dataType for f in old.schema}
            # a stored column keeps its type, or buckets could not be read together
            other = {c for c in merged.columns if c in kinds and merged.schema[c].dataType.simpleString() != kinds[c].simpleString()}
            merged = merged.select(*[F.col(c).cast(kinds[c]).alias(c) if c in other else F.col(c) for c in merged.columns])
            self._write(self._with_bucket(merged), "overwrite", by_key)
        return touched


def findings_at(path: str, buckets: int = 64, keys: tuple[str, ...] = ("website_id", "fingerprint")) -> Snapshot:
    return Snapshot(path, keys, buckets)


def pages_at(path: str, buckets: int = 64, keys: tuple[str, ...] = lc.PAGE) -> Snapshot:
    return Snapshot(path, keys, buckets)


def store_findings(table: Snapshot, new: DataFrame, now: Column) -> list[int]:
    """Findings of a scan: first sightings are kept, worked-on statuses stay, the rest opens or reopens."""
    return table.upsert(new, lambda old, rows, keys: lc.lifecycle_upsert(old, rows, now, keys=keys), by_key=True)


def store_batch(table: Snapshot, new: DataFrame, now: Column, number: int) -> list[int]:
    """Findings of one micro-batch, whose number is kept with each row; a row that saw this batch or a later one stays.

    So a replay cannot reopen what was resolved since, and a batch that comes late does not undo a newer one.
    """
    keys = list(table.keys)

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        seen = old.filter(F.col("batch_number") >= number).select(*keys)
        return lc.lifecycle_upsert(old, rows.join(seen, keys, "left_anti"), now, keys=keys)

    return table.upsert(new.withColumn("batch_number", F.lit(number).cast("long")), merge)


def store_pages(table: Snapshot, new: DataFrame) -> list[int]:
    """Pages of a scan; a page that was reused brings no marker and keeps the stored one."""
    return table.upsert(new, lambda old, rows: lc.sink_pages(old, rows, table.keys))


def replace_rows(table: Snapshot, new: DataFrame, order: str) -> list[int]:
    """The last row of each key by ``order``; an older row than the stored one changes nothing, so late batches are safe."""
    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        return mg.latest_per_key(old.unionByName(rows, allowMissingColumns=True), list(table.keys), order)

    return table.upsert(new, merge)
