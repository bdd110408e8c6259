"""Which stored evidence may be removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

C = F.col


def signal_evidence(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Evidence rows that only repeat a finding's own signals, flagged removable when the finding still has them."""
    rows = evidence.filter(C("type") == "detector_signal").join(findings.select("fingerprint", "signals"), "fingerprint", "left")
    return rows.withColumn("removable", C("signals").isNotNull() & ~C("signals").isin("", "[]", "{}", "null")).drop("signals")


def signal_evidence_counts(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Dry run."""
    return signal_evidence(evidence, findings).agg(
        F.count_if(C("removable")).alias("removable"), F.count_if(~C("removable")).alias("skipped")
    )


def without_signal_evidence(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Evidence table after removal."""
    gone = signal_evidence(evidence, findings).filter("removable").select("fingerprint", "type").distinct()
    return evidence.join(gone, ["fingerprint", "type"], "left_anti")


def stored_evidence(evidence: DataFrame, prefix: str) -> DataFrame:
    return evidence.filter(F.ltrim(C("path"), F.lit("/")).startswith(prefix))


def stored_evidence_counts(evidence: DataFrame, prefix: str) -> DataFrame:
    """Records under the prefix and the distinct files they name."""
    per_file = stored_evidence(evidence, prefix).groupBy("disk", "path").agg(F.count("*").alias("n"))
    return per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count("*").alias("files"))
