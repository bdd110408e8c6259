"""Incremental scans and the life of findings across re-scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions import finding as fd, text as tx, url as ux, vocab
from sitegauge.operators import merge as mg, scoring as sc
from sitegauge.params import DEFAULT, Params

C = F.col


# ---------------------------------------------------------------- reuse

#: What names a page of a site. Where several pages share a URL, callers add ``page_id``.
PAGE = ("website_id", "url_hash")
TARGET = ("scan_id", "url_hash")


def reuse_decision(documents: DataFrame, previous: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Whether each document's earlier analysis still holds, and if not, the first reason why. ``keys`` name one stored page."""
    prev = previous.select(*keys, C("content_hash").alias("prev_hash"), C("analysis").alias("m"))
    rows = documents.join(prev, list(keys), "left")
    scan_type = F.lit(p.scan_type)
    reason = F.when(F.lit(p.force_rescan), "forced").when(C("prev_hash").isNull(), "new_page")
    reason = reason.when(C("prev_hash") != C("content_hash"), "changed").when(C("m").isNull(), "no_marker")
    reason = reason.when(~C("m.ruleset_version").eqNullSafe(F.lit(p.ruleset)), "ruleset")
    reason = reason.when(~((C("m.scan_type") == "full") | C("m.scan_type").eqNullSafe(scan_type)), "scope")
    if p.use_model:
        reason = reason.when(~(F.coalesce("m.ai_analyzed", F.lit(False)) & C("m.ai_model").eqNullSafe(F.lit(p.model_name))), "model")
    if p.use_browser and p.scan_type in ("full", "ads", "priority"):
        reason = reason.when(~F.coalesce("m.browser_audited", F.lit(False)), "browser")
    if p.use_copy and p.scan_type in ("full", "copyright", "priority"):
        reason = reason.when(~F.coalesce("m.external_copy_checked", F.lit(False)), "copy")
    return rows.withColumn("reason", reason).withColumn("reused", C("reason").isNull()).drop("prev_hash", "m")


def analysis_marker(p: Params, analyzed: Column, browser: Column, copied: Column) -> Column:
    """Marker stored with an analysed page."""
    return F.struct(
        F.lit(p.ruleset).alias("ruleset_version"), F.lit(p.scan_type).alias("scan_type"), analyzed.alias("ai_analyzed"),
        F.when(analyzed, p.model_name).alias("ai_model"), browser.alias("browser_audited"),
        F.when(browser, 1).alias("browser_audit_version"), copied.alias("external_copy_checked"),
        F.when(copied, 1).alias("external_copy_version"), F.lit(p.now).cast("timestamp").alias("analyzed_at"),
    )


def sink_pages(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = PAGE) -> DataFrame:
    """Next page snapshot: a reused page (no new marker) keeps its marker. Titles are stored whole; reports cut them."""
    return mg.upsert(old, new, list(keys), {"analysis": F.coalesce("n.analysis", "o.analysis")})


# ---------------------------------------------------------------- findings

def lifecycle_upsert(
    old: DataFrame, new: DataFrame, now: Column, order: str = "seen_order", keys: list[str] = ["website_id", "fingerprint"]
) -> DataFrame:
    """Next findings snapshot: first sighting is kept, worked-on statuses are kept, anything else (re)opens."""
    old, new = (rows.withColumn("fingerprint", fd.packed(C("fingerprint"))) for rows in (old, new))
    latest = mg.latest_per_key(new, keys, order)
    print_ = fd.unpacked(C("fingerprint"))
    return mg.upsert(old, latest, keys, {
        "status": F.when(C("o.status").isin("investigating", "remediating"), C("o.status")).otherwise("open"),
        "first_seen_at": F.coalesce("o.first_seen_at", now), "last_seen_at": now,
        "resolved_at": F.lit(None).cast("timestamp"), "public_id": F.coalesce("o.public_id", fd.public_id(now, print_)),
    } if "public_id" in old.columns else {
        "status": F.when(C("o.status").isin("investigating", "remediating"), C("o.status")).otherwise("open"),
        "first_seen_at": F.coalesce("o.first_seen_at", now), "last_seen_at": now, "resolved_at": F.lit(None).cast("timestamp"),
    }).withColumn("fingerprint", print_)


RESOLVE_SCOPES = ("local", "ai", "browser", "copy", "duplicates")


def _scope(name: str, rule: Column) -> Column:
    ai, browser, copied = rule.startswith("ai."), rule.startswith("ads.browser-"), rule == "copyright.external-content-match"
    return {
        "ai": ai, "browser": browser, "copy": copied, "duplicates": rule.startswith("duplicate."), "local": ~ai & ~browser & ~copied,
    }[name]


def resolve_missing(
    findings: DataFrame, pages: DataFrame, seen: DataFrame, started: Column, now: Column, scope: str, p: Params = DEFAULT
) -> DataFrame:
    """Resolves open findings of a scope that were not seen again on the given pages.

    ``pages`` (website_id, page_id) are those on which the scope's analyser succeeded; for ``duplicates`` they
    include reused pages. A priority scan resolves nothing; typed scans resolve their own categories only.
    """
    allowed = p.scan_type in ("full", "copyright") if scope == "duplicates" else p.scan_type != "priority"
    if not allowed:
        return findings
    stale = C("status").isin(*vocab.OPEN_STATUSES) & (C("last_seen_at") < started) & _scope(scope, C("rule_key"))
    if scope != "duplicates" and p.scan_type in ("copyright", "ads", "privacy"):
        stale = stale & F.array_contains(fd.scope_categories(F.lit(p.scan_type)), C("category"))
    # a finding that cannot be resolved stays where it is; null keys are on no page
    stale = F.coalesce(stale & C("website_id").isNotNull() & C("page_id").isNotNull(), F.lit(False))
    rows = findings.filter(stale)
    for table, keys, flag in ((pages, ["website_id", "page_id"], "_on_page"), (seen, ["website_id", "fingerprint"], "_was_seen")):
        rows = rows.join(table.select(*keys).distinct().withColumn(flag, F.lit(True)), keys, "left")
    gone = C("_on_page").isNotNull() & C("_was_seen").isNull()
    rows = rows.withColumns({
        "resolved_at": F.when(gone, now).otherwise(C("resolved_at")), "status": F.when(gone, "resolved").otherwise(C("status")),
    }).drop("_on_page", "_was_seen")
    return findings.filter(~stale).unionByName(rows)


def finding_transition(findings: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Manual changes (fingerprint, new_status, new_assignee, optionally changed_at): the assignee stays when none is given.

    The last change of a finding counts, by ``changed_at`` and then by status; a status that does not exist is ignored.
    """
    if "changed_at" not in updates.columns:
        updates = updates.withColumn("changed_at", F.lit(0))
    known = updates.withColumn("new_status", F.when(C("new_status").isin(*vocab.OPEN_STATUSES, "resolved"), C("new_status")))
    latest = mg.latest_per_key(known, ["fingerprint"], F.struct("changed_at", "new_status", "new_assignee")).drop("changed_at")
    rows = findings.join(latest, "fingerprint", "left")
    moved = C("new_status").isNotNull()
    return rows.withColumns({
        "resolved_at": F.when(moved, F.when(C("new_status") == "resolved", now)).otherwise(C("resolved_at")),
        "assigned_to": F.coalesce("new_assignee", "assigned_to"), "status": F.coalesce("new_status", "status"),
    }).drop("new_status", "new_assignee")


# ---------------------------------------------------------------- scans and targets

def scan_request_validate(requests: DataFrame, sites: DataFrame) -> DataFrame:
    """Expands requests (request_id, site, type, max_urls) to sites, with a reject reason when invalid.

    A site is named by domain or slug; ``all-sites`` means every site. Names are looked up by equality, one branch each.
    """
    reason = (
        F.when(~F.coalesce(C("type").isin(*vocab.SCAN_TYPES), F.lit(False)), "type")
        .when(C("max_urls").isNotNull() & ~C("max_urls").between(1, 100_000), "max_urls")
    )
    rows = requests.withColumn("reject_reason", reason)
    names = sites.select("website_id", F.explode(F.array_distinct(F.array("domain", "slug"))).alias("site"))
    named = rows.filter(C("site") != "all-sites").join(names, "site", "left").withColumn(
        "reject_reason", F.coalesce("reject_reason", F.when(C("website_id").isNull(), "site"))
    )
    whole = rows.filter(C("site") == "all-sites")
    refused = whole.filter(C("reject_reason").isNotNull()).withColumn("website_id", F.lit(None).cast(sites.schema["website_id"].dataType))
    # an accepted request for all sites names every site: that product is the requested output
    everything = whole.filter(C("reject_reason").isNull()).crossJoin(sites.select("website_id"))
    return named.unionByName(refused).unionByName(everything)


def scan_supersede(requests: DataFrame, scans: DataFrame, sites: DataFrame) -> DataFrame:
    """Requests that may start: the site is enabled, has no active scan, and only its first request counts."""
    first = requests.groupBy("website_id").agg(F.min("request_id").alias("request_id"))
    active = scans.filter(C("status").isin(*vocab.ACTIVE_SCAN_STATUSES)).select("website_id").distinct()
    enabled = sites.filter(C("status") != "disabled").select("website_id")
    return first.join(active, "website_id", "left_anti").join(enabled, "website_id", "left_semi")


def sink_targets(old: DataFrame, new: DataFrame) -> DataFrame:
    return mg.insert_or_ignore(old, new, ["scan_id", "url_hash"])


def target_document_match(targets: DataFrame, documents: DataFrame, keys: tuple[str, ...] = TARGET) -> DataFrame:
    """The first document of each target, matched on the source URL (final URL when there is none)."""
    source = F.coalesce("source_url", "url")
    docs = documents.withColumn("url_hash", ux.url_hash(source)).groupBy(*keys).agg(F.min("document_id").alias("document_id"))
    return targets.join(docs, list(keys))


MISSING_DOCUMENT = "No HTML document was returned for this URL."


def target_missing_failed(targets: DataFrame, matched: DataFrame, errors: DataFrame, keys: tuple[str, ...] = TARGET) -> DataFrame:
    """Targets without a document become failed, with their recorded error or the default text. ``keys`` name one target."""
    missing = targets.join(matched.select(*keys), list(keys), "left_anti")
    return missing.join(errors.select(*keys, "error"), list(keys), "left").withColumns({
        "status": F.lit("failed"), "error_message": F.coalesce("error", F.lit(MISSING_DOCUMENT)),
    }).drop("error")


def scan_empty_failed(scans: DataFrame, targets: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(failed scans without any usable target, released sites with their status)."""
    used = targets.filter(C("status").isin("completed", "reused")).select("scan_id").distinct()
    failed = scans.join(used, "scan_id", "left_anti").select("scan_id", "website_id", F.lit("failed").alias("status"), F.lit(100).alias("progress"))
    back = sites.join(failed.select("website_id").distinct(), "website_id", "left_semi")
    return failed, back.select("website_id", released_status().alias("status"))


def released_status() -> Column:
    """Status of a site no longer being scanned."""
    return F.when(C("last_scanned_at").isNotNull(), sc.status_from_score(C("overall_score"))).otherwise("pending")


def scan_due_sites(sites: DataFrame, now: Column) -> DataFrame:
    return sites.filter(
        ~C("status").isin("disabled", "scanning") & (C("next_scan_at").isNull() | (C("next_scan_at") <= now))
    )


def scan_stale(scans: DataFrame, sites: DataFrame, now: Column, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(scans to cancel, sites to release): active scans without an update for the stale period."""
    limit = F.timestamp_add("MINUTE", F.lit(-p.stale_minutes), now)
    active = scans.filter(C("status").isin(*vocab.ACTIVE_SCAN_STATUSES))
    stale = active.filter(C("updated_at") <= limit)
    busy = active.filter(C("updated_at") > limit).select("website_id").distinct()
    free = stale.select("website_id").distinct().join(busy, "website_id", "left_anti")
    return (
        stale.select("scan_id", "website_id", F.lit("cancelled").alias("status")),
        sites.join(free, "website_id", "left_semi").select("website_id", released_status().alias("status")),
    )


def scan_partial(truncated: Column, sitemap_errors: Column, confidence: Column, failed: Column, scanned: Column, discovered: Column) -> Column:
    return (
        F.coalesce(truncated, F.lit(False)) | (F.coalesce(sitemap_errors, F.lit(0)) > 0)
        | (F.coalesce(confidence, F.lit("low")) == "low") | (F.coalesce(failed, F.lit(0)) > 0) | (scanned < discovered)
    )


def scan_complete(scans: DataFrame, progress: DataFrame, scores: DataFrame, scan_findings: DataFrame, page_counts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(finished scans, refreshed sites); a site with several scans takes its values from the one with the highest id.

    ``scans``: scan_id, website_id, pages_discovered, discovery_truncated, sitemap_errors, discovery_confidence;
    ``progress``: per-scan target counts; ``scores``: website_id, score, open_findings.
    """
    rows = (
        scans.join(progress, "scan_id", "left")
        .join(scan_findings.groupBy("scan_id").agg(F.count("*").alias("findings_count")), "scan_id", "left")
        .join(scores, "website_id", "left").join(page_counts, "website_id", "left")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    rows = rows.withColumns({"scanned": (zero("completed") + zero("reused")).cast("int"), "failed_targets": zero("failed").cast("int")})
    rows = rows.withColumn("discovered", F.greatest(C("scanned") + C("failed_targets"), C("pages_discovered")))
    rows = rows.withColumns({
        "partial": scan_partial(C("discovery_truncated"), C("sitemap_errors"), C("discovery_confidence"), C("failed_targets"), C("scanned"), C("discovered")),
        "score": F.coalesce("score", F.lit(100)),
    })
    coverage = F.when(C("discovered") > 0, F.round(C("scanned") / C("discovered") * 100, 2)).otherwise(F.lit(0.0))
    done = rows.select(
        "scan_id", "website_id", F.when(C("partial"), "partial").otherwise("completed").alias("status"), F.lit(100).alias("progress"),
        C("discovered").alias("pages_discovered"), C("scanned").alias("pages_scanned"), zero("findings_count").alias("findings_count"),
        "score", coverage.alias("coverage_percent"), now.alias("finished_at"),
    )
    latest = mg.latest_per_key(rows, ["website_id"], "scan_id")
    sites = latest.select(
        "website_id", sc.status_from_score(C("score")).alias("status"), C("score").alias("overall_score"), zero("pages").alias("pages_count"),
        C("discovered").alias("last_discovered_pages"), C("scanned").alias("last_scanned_pages"), C("partial").alias("last_scan_partial"),
        zero("open_findings").alias("open_findings_count"), now.alias("last_scanned_at"), F.timestamp_add("DAY", F.lit(1), now).alias("next_scan_at"),
    )
    return done, sites


def scan_progress(targets: DataFrame, scans: DataFrame) -> DataFrame:
    """Counts, progress and coverage per scan; progress never falls below its stored value."""
    unfinished = C("status").isin("queued", "running")
    count = lambda s: F.count_if(C("status") == s).alias(s)
    # batches first: one row per (scan, batch), so distinct counting never expands a hot scan
    batches = targets.groupBy("scan_id", "batch_number").agg(
        *[count(s) for s in ("queued", "running", "completed", "reused", "failed")],
        F.max(unfinished).alias("open"), F.sum("findings_count").alias("findings_count"), F.sum("ai_findings_count").alias("ai_findings_count"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count_if(C("ai_attempted") & ~C("ai_analyzed")).alias("ai_errors"),
    )
    sums = ("queued", "running", "completed", "reused", "failed", "findings_count", "ai_findings_count", "input_tokens", "output_tokens", "ai_errors")
    rows = batches.groupBy("scan_id").agg(
        *[F.sum(s).alias(s) for s in sums], F.count("*").alias("batches_total"), F.count_if(~C("open")).alias("batches_completed"),
    ).join(scans.select("scan_id", "pages_discovered", "progress"), "scan_id")
    found = F.greatest(C("pages_discovered"), F.lit(1))
    done = C("completed") + C("reused")
    live = F.least(F.lit(94), 5 + F.floor((done + C("failed")) * 89 / found)).cast("int")
    return rows.select(
        "scan_id", *sums, "batches_total", "batches_completed", done.alias("pages_scanned"),
        F.greatest("progress", live).alias("progress"), F.round(done / found * 100, 2).alias("coverage_percent"),
    )
