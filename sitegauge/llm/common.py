"""Input shaping and intermediate tables shared by the training-data operators.

Every operator reads two columns of its input, an id and a text, through :func:`texts`; further columns, whatever
their names, never reach its plan. Rows are documents: a repeated row is a document of its own with the same id.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (long) and ``text`` (string, null becomes empty); rows with a null id stay."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


#: Private folder of a local session that sets none, by application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors and the driver see: ``spark.checkpoint.dir``.

    Only a local session may lack the setting (tests); elsewhere a private folder would lose data, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="llm-")
        _LOCAL[spark.sparkContext.applicationId] = folder
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back, which cuts the lineage for good."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Size of a membership filter in bits, whatever the number of members, and of its rows on the way.
MEMBER_BITS, MEMBER_ROW = 1 << 23, 1 << 12


def member_bits(wanted: DataFrame, places: Callable[[pa.RecordBatch], list[int] | np.ndarray]) -> np.ndarray:
    """The rows of ``wanted`` as MEMBER_BITS flags; ``places`` gives a batch's places. It may hold too much but misses none.

    Used to keep rows without a partner out of a shuffle; an exact join follows. Each task folds its rows into flags of
    this fixed size, which are combined on the executors, so that one set of flags reaches the driver.
    """
    def fold(batches: Iterator[pa.RecordBatch]):
        bits = np.zeros(MEMBER_BITS, bool)
        for batch in batches:
            bits[places(batch)] = True
        used = np.flatnonzero(bits.reshape(-1, MEMBER_ROW).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([np.packbits(bits[r * MEMBER_ROW:(r + 1) * MEMBER_ROW]).tobytes() for r in used], pa.binary())], ["row", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, b in zip(batch.column("row").to_pylist(), batch.column("bits").to_pylist()):
                total[r] = total.get(r, np.zeros(MEMBER_ROW // 8, "u1")) | np.frombuffer(b, "u1")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["row", "bits"])

    out = np.zeros(MEMBER_BITS, bool)
    for r in wanted.mapInArrow(fold, "row long, bits binary").repartition(16, "row").mapInArrow(merge, "row long, bits binary").collect():
        out[r.row * MEMBER_ROW:(r.row + 1) * MEMBER_ROW] = np.unpackbits(np.frombuffer(r.bits, "u1"))
    return out
