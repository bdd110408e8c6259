"""Append-only log of processing events.

``<path>/log/batch=<n>/day=<date>`` holds the rows of each batch; a batch that is repeated writes its own folder again, so
a replay adds nothing. Small files of finished days are rewritten by :func:`compact`, one Spark job, into
``<path>/days/day=<date>``; the raw rows stay until storage rules remove them, so a day with late rows is simply compacted again.
Readers take finished days from the compacted part and the others from the log, told apart by a date.

Secrets and page texts leave the context before anything is written; messages are kept whole.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sitegauge.streaming.live import sanitize_context, start_batches

C = F.col
COLUMNS = ("scan_id long, target_id long, event_id long, stage string, status string, service string, message string, context string, "
           "http_status int, request_id string, ts timestamp, day date")


def telemetry_rows(events: DataFrame) -> DataFrame:
    """Rows of the log from events (scan_id, target_id, event_id, stage, status, service, message, context, ts).

    Status code and request id come out of the context of a finish. A row without a time belongs to the day 1970-01-01.
    """
    rows = events.withColumn("context", sanitize_context(C("context")))
    return rows.select(
        C("scan_id").cast("long"), C("target_id").cast("long"), C("event_id").cast("long"), "stage", "status", "service", "message", "context",
        F.expr("try_cast(get_json_object(context, '$.http_status') as int)").alias("http_status"),
        F.get_json_object("context", "$.request_id").alias("request_id"), "ts",
        F.coalesce(F.to_date("ts"), F.lit(date(1970, 1, 1))).alias("day"))


#: Text bytes that one writing task gets, about; it sorts them by day.
PIECE = 128 << 20


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by day, large days in pieces. Pieces go by the bytes of the texts: compressed, as the sizes that Spark
    sees of a shuffle, repetitive messages take a hundredth of what a task has to hold."""
    size = F.coalesce(F.octet_length("message"), F.lit(0)) + F.coalesce(F.octet_length("context"), F.lit(0)) + 200
    days = rows.groupBy("day").agg(F.ceil(F.sum(size.cast("long")) / PIECE).alias("_pieces")).collect()  # one row per day
    if not days:
        return rows
    pieces = rows.sparkSession.createDataFrame(days, "day date, _pieces long")
    piece = F.pmod(F.xxhash64("scan_id", "target_id", "event_id", "ts"), C("_pieces"))
    dealt = rows.join(F.broadcast(pieces), "day").withColumn("_piece", piece)
    return dealt.repartition(sum(d["_pieces"] for d in days), "day", "_piece").drop("_pieces", "_piece")


def append(events: DataFrame, path: str, batch_id: int) -> None:
    """Writes one batch; the same batch id replaces what it wrote before."""
    rows = _dealt(telemetry_rows(events)).select(*[c.split()[0] for c in COLUMNS.split(", ")])
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/log/batch={batch_id}")


def stream_telemetry(events: DataFrame, path: str) -> StreamingQuery:
    return start_batches(events, path, lambda batch, batch_id: append(batch, path, batch_id))


def _log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{COLUMNS}, batch long").parquet(f"{path}/log").drop("batch")


def compact(spark: SparkSession, path: str, first: date, end: date) -> None:
    """Rewrites the days from ``first`` up to, not including, ``end`` in files of the advised size, by scan and event."""
    rows = _log(spark, path).filter((C("day") >= F.lit(first)) & (C("day") < F.lit(end)))
    even = _dealt(rows).sortWithinPartitions("day", "scan_id", "target_id", "event_id")
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/days")


def read(spark: SparkSession, path: str, compacted_to: date | None = None) -> DataFrame:
    """The whole log; days before ``compacted_to`` come from the compacted part. Filters on ``day`` prune folders of both."""
    if compacted_to is None:
        return _log(spark, path)
    days = spark.read.schema(COLUMNS).parquet(f"{path}/days").filter(C("day") < F.lit(compacted_to))
    return days.unionByName(_log(spark, path).filter(C("day") >= F.lit(compacted_to)))
