"""Site score and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions import finding as fd, vocab
from sitegauge.operators.numbering import top_per_group

C = F.col


def open_findings(findings: DataFrame) -> DataFrame:
    return findings.filter(C("status").isin(*vocab.OPEN_STATUSES))


def status_from_score(score: Column) -> Column:
    return F.when(score < 70, "critical").when(score < 80, "high").when(score < 90, "review").otherwise("healthy")


def site_score(findings: DataFrame, sites: DataFrame) -> DataFrame:
    """Score 0..100 per site from its open findings (website_id, category, severity, confidence, order_key).

    Per site and category the heaviest finding counts fully, the second at 0.42/2 and every later one at 0.15, since
    0.42/rank falls below that floor from the third on. So the ranking is needed for two rows per (site, category)
    only, and the rest is a plain sum: no task ever sorts a whole site. All terms are integers (weight x confidence
    percent x factor percent), so the order of addition cannot change a rounded score.
    """
    rows = findings.select(
        "website_id", "category", "order_key", fd.weight(C("severity")).cast("long").alias("w"),
        F.greatest(F.lit(35), C("confidence")).cast("long").alias("c"),
    ).withColumn("term", C("w") * C("c"))
    base = rows.groupBy("website_id").agg((F.sum("term") * 15).alias("base"), F.count("*").alias("open_findings"))
    head = top_per_group(rows, ["website_id", "category"], [F.desc("w"), F.asc("order_key")], 2, "r")
    extra = head.groupBy("website_id").agg(F.sum(C("term") * F.when(C("r") == 1, 85).otherwise(6)).alias("extra"))
    penalty = F.least(C("base") + C("extra"), F.lit(950_000))
    score = F.floor((F.lit(1_000_000) - penalty + 5_000) / 10_000).cast("int")
    scored = base.join(extra, "website_id").select("website_id", "open_findings", score.alias("score"))
    return sites.select("website_id").join(scored, "website_id", "left").select(
        "website_id", F.coalesce("score", F.lit(100)).alias("score"), F.coalesce("open_findings", F.lit(0)).alias("open_findings")
    )
