"""Session defaults and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

EXCLUDED = "spark.sql.optimizer.excludedRules"
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # an exploded expression would be evaluated a second time just to test that it is not empty
    # state larger than memory, and needed by transformWithState
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    EXCLUDED: "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
}


#: Private folder of a local session that sets none, by application.
_LOCAL: dict[str, str | None] = {}


def build(app: str = "sitegauge", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan relies on; safe to call on a shared session."""
    for key, value in SETTINGS.items():
        if key == EXCLUDED:  # the caller's own exclusions stay
            names = [n for n in (spark.conf.get(key, None) or "").split(",") if n]
            value = ",".join(dict.fromkeys([*names, value]))
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session may go without the setting."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if not folder and current.isDefined():
        folder = current.get()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _LOCAL.setdefault(context.applicationId, None) or tempfile.mkdtemp(prefix="run-checkpoint-")
        _LOCAL[context.applicationId] = folder
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Writes rows to the shared folder and reads them back: computed once, and of a size that the optimizer knows."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``.

    The folder is taken from the session, so on a cluster it is shared storage and the cut survives lost
    executors. Only a local session without the setting gets a private folder.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
