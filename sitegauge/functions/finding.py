"""The finding record and the columns derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions import text as tx, vocab

FIELDS = [
    "rule_key", "category", "severity", "confidence", "title", "summary", "policy_reference", "signals", "remediation", "fingerprint",
]


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def fingerprint(rule_key: Column, url: Column, salt: Column | None = None) -> Column:
    return F.sha2(F.concat_ws("|", rule_key, F.lower(url), salt if salt is not None else F.lit("")), 256)


def packed(print_: Column) -> Column:
    """A fingerprint in half the bytes to move: a mark and the digest, or for another text a mark and its bytes."""
    digest = F.concat(F.lit(b"\0"), F.unhex(print_))
    return F.when(print_.rlike("^(?:[0-9a-f]{2})+$"), digest).otherwise(F.concat(F.lit(b"\1"), F.encode(print_, "UTF-8")))


def unpacked(value: Column) -> Column:
    rest = F.substring(value, 2, 1 << 30)
    return F.when(F.substring(value, 1, 1) == F.lit(b"\0"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def clamp_confidence(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), value)).cast("int")


def finding(*, rule_key, category, severity, confidence, title, url: Column, signals: Column, policy="", salt=None, remediation="", summary="") -> Column:
    """Struct with the fields every rule produces; without a summary of its own a finding repeats its title."""
    key = _col(rule_key)
    advice = remediation if isinstance(remediation, Column) else F.array(F.lit(remediation)) if remediation else F.array().cast("array<string>")
    return F.struct(
        key.alias("rule_key"), _col(category).alias("category"), _col(severity).alias("severity"),
        clamp_confidence(_col(confidence)).alias("confidence"), _col(title).alias("title"),
        _col(summary if isinstance(summary, Column) or summary else title).alias("summary"), _col(policy).alias("policy_reference"), signals.alias("signals"), advice.alias("remediation"),
        fingerprint(key, url, salt).alias("fingerprint"),
    )


def validate(findings: DataFrame) -> DataFrame:
    """Clamped confidence and a quarantine reason for an unknown severity (null when valid)."""
    return findings.withColumn("confidence", clamp_confidence(F.col("confidence"))).withColumn(
        "reject_reason", F.when(~F.coalesce(F.col("severity").isin(*vocab.SEVERITIES), F.lit(False)), "severity")
    )


def in_scope(scan_type: Column, rule_key: Column, category: Column, severity: Column) -> Column:
    """Whether a scan of this type keeps a finding."""
    return (
        F.when(rule_key.startswith("publisher."), True)
        .when(scan_type == "copyright", category.isin("Copyright", "Duplicate content"))
        .when(scan_type == "ads", category == "Ad experience")
        .when(scan_type == "privacy", category == "Privacy & consent")
        .when(scan_type == "priority", severity.isin("critical", "high"))
        .otherwise(True)
    )


def scope_categories(scan_type: Column) -> Column:
    """Categories a scan may resolve; null means all, an empty list means none."""
    return (
        F.when(scan_type == "copyright", F.array(F.lit("Copyright"), F.lit("Duplicate content")))
        .when(scan_type == "ads", F.array(F.lit("Ad experience")))
        .when(scan_type == "privacy", F.array(F.lit("Privacy & consent")))
        .when(scan_type == "priority", F.array().cast("array<string>"))
    )


def public_id(created: Column, print_: Column) -> Column:
    """``MG-yymmdd-`` and 16 characters of the fingerprint, so a rerun gives the same id and a day's ids do not collide."""
    return F.concat(F.lit("MG-"), F.date_format(created, "yyMMdd"), F.lit("-"), F.upper(F.substring(print_, 1, 16)))


def label(value: Column) -> Column:
    """Display label from the fixed dictionary; an unknown value is its own label."""
    return F.coalesce(F.try_element_at(tx.lookup(vocab.LABELS), value), value)


def display_text(value: Column) -> Column:
    """Display form of a title, summary or advice; an unknown text is its own display form."""
    return F.coalesce(F.try_element_at(tx.lookup(vocab.TEXT_LABELS), value), value)


def source(rule_key: Column) -> Column:
    return F.when(rule_key.startswith("ai."), "AI").otherwise("Rule")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 1).when(severity == "high", 2).when(severity == "review", 3).otherwise(4)


def weight(severity: Column) -> Column:
    out = F.when(severity == "critical", 32)
    for name in ("high", "review", "info"):
        out = out.when(severity == name, vocab.SEVERITY_WEIGHT[name])
    return out.otherwise(0)


def policy_url(category: Column, reference: Column | None = None) -> Column:
    """Policy document of a finding, by category first and then by words in its reference, in fixed order."""
    r = F.lower(F.coalesce(reference, F.lit(""))) if reference is not None else F.lit("")
    u = vocab.POLICY_URLS
    return (
        F.when((category == "Duplicate content") | r.contains("replicated") | r.contains("trùng lặp"), u["duplicate"])
        .when((category == "Ad experience") | r.contains("ad placement") | r.contains("vị trí quảng cáo"), u["ads"])
        .when((category == "Privacy & consent") | r.contains("privacy") | r.contains("quyền riêng tư"), u["privacy"])
        .when((category == "Deceptive practices") | r.contains("deceptive") | r.contains("lừa đảo"), u["deceptive"])
        .when(category == "Technical trust", u["technical"])
        .when(category == "Content quality", u["quality"])
        .otherwise(u["general"])
    )


def policy_title(category: Column) -> Column:
    return (
        F.when(category.isin("Duplicate content", "Copyright"), "Replicated content and publisher value")
        .when(category == "Ad experience", "Ad placement policies")
        .when(category == "Privacy & consent", "Required privacy policy content")
        .when(category == "Deceptive practices", "Deceptive practices policy")
        .when(category == "Technical trust", "Crawler troubleshooting")
        .when(category == "Content quality", "Content quality for site approval")
        .otherwise("Publisher policies")
    )
