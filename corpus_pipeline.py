"""Corpus preparation: five stages, each a function of ``(spark, docs, sf_dir)`` on all that the stage before it kept.

All but the last return the columns of ``documents``, and any further ones. Documents are rows; a null or repeated id does not
exempt a row. Null and blank texts are scored like others and, where kept, have no lines, links or benchmark items and are packed as a
lone end id; texts of any length are used whole; of equal rows one is left by line dedup; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from sitegauge.llm import contamination, line_dedup, mil, ngram_join, packing
from sitegauge.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier, fitted on the labels of these documents, does not reject."""
    model = mil.fit(docs, table(spark, sf_dir, "labels"), "quality")
    return docs.filter(mil.scorer(model)(F.col("text")) >= 0.5)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that equal or neighbour an earlier line; ``n_chars`` follows the text.

    A document all of whose lines were found earlier has nothing left and goes; one that was blank before stays blank.
    """
    counts = "_".join(["counts", *docs.columns])  # no column of the input has this name
    made = line_dedup.rewrite(docs, info=counts)
    emptied = (F.col(f"`{counts}`.n_lines") > 0) & (F.col(f"`{counts}`.n_lines") == F.col(f"`{counts}`.n_removed"))
    return made.filter(~emptied).drop(counts).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group linked by a similarity of 0.8 or more over 5-word shingles."""
    return ngram_join.first_rows(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return docs.filter(contamination.is_clean(table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1,024 tokens; in small slices, as the executors hold the earlier stages' memory."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), slice_chars=2_000_000)


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontamination),
    ("packing", pack),
]
#: The classifier cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
