"""Aggregates and report queries over sites, scans, pages, findings and targets.

A finding's site and page are looked up with ``lookup``: one site may own any share of the findings, many have no page.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sitegauge.functions import finding as fd, text as tx, url as ux, vocab
from sitegauge.operators import scoring as sc
from sitegauge.operators.numbering import lookup, top_per_group
from sitegauge.params import DEFAULT, Params

C = F.col


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def with_site(rows: DataFrame, sites: DataFrame, *columns: str, by: str = "fingerprint") -> DataFrame:
    return lookup(rows, sites.select("website_id", *columns), "website_id", by)


def with_page(rows: DataFrame, pages: DataFrame, *columns: str, by: str = "fingerprint") -> DataFrame:
    """Left lookup by page id; rows without a page do not meet in one task."""
    return lookup(rows, pages.select("page_id", *columns), "page_id", by)


# ---------------------------------------------------------------- scan aggregates

def crawl_counters(responses: DataFrame) -> DataFrame:
    """Blocked, failed and non-HTML counts per scan; ``allowed`` is the result of ``robots_allowed``."""
    from sitegauge.operators.sources import response_state

    blocked = ~C("allowed")
    return response_state(responses).groupBy(C("grp").alias("scan_id")).agg(
        F.count_if(blocked).alias("blocked_by_robots"), F.count_if(C("response_state") == "failed").alias("failed_requests"),
        F.count_if(C("response_state") == "non_html").alias("non_html_responses"),
    )


def coverage_percent(scanned: Column, discovered: Column) -> Column:
    return F.when(discovered > 0, F.round(scanned / discovered * 100, 2)).otherwise(F.lit(0.0))


def queue_utilization(targets: DataFrame, p: Params = DEFAULT) -> DataFrame:
    running = F.count_if(C("status") == "running")
    capacity = max(1, max(1, p.page_workers) * p.page_batch)
    return targets.agg(
        running.alias("running"), F.count_if(C("status") == "queued").alias("queued"),
        F.least(F.lit(100), F.round(running * 100 / capacity)).cast("int").alias("utilization"),
    )


# ---------------------------------------------------------------- site aggregates

def site_page_profile(sites: DataFrame, pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Word, ad and error totals of each site's scanned pages, in one aggregation; zeros for a site without any."""
    w, a = C("word_count"), C("ad_count")
    totals = pages.filter("scanned").groupBy("website_id").agg(
        F.count("*").alias("pages"), F.sum(w).alias("total_words"), F.round(F.avg(w), 1).alias("average_words"),
        F.min(w).alias("minimum_words"), F.max(w).alias("maximum_words"), F.sum(a).alias("total_ads"), F.round(F.avg(a), 1).alias("average_ads"),
        F.count_if(w < p.thin_words).alias("thin_pages"), F.count_if(a > 0).alias("pages_with_ads"), F.count_if(C("status_code") >= 400).alias("error_pages"),
    )
    return sites.select("website_id").join(totals, "website_id", "left").fillna(0)


def site_distributions(pages: DataFrame) -> DataFrame:
    """Counts by status code, language and required page type in one pass: one aggregation of (dimension, value) pairs."""
    pair = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value"))
    pairs = F.array(
        pair("status_code", C("status_code")), pair("language", C("language")),
        F.when(C("essential_page_type").isNotNull(), pair("essential_page_type", C("essential_page_type"))),
    )
    rows = pages.filter("scanned").select("website_id", F.explode(F.array_compact(pairs)).alias("d"))
    return rows.groupBy("website_id", "d.dimension", "d.value").agg(F.count("*").alias("n"))


def site_titles_sample(sites: DataFrame, pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A report's sample of each site: its first titles by page id, cut; an empty list for a site without any."""
    n = p.shown_titles
    rows = top_per_group(pages.filter("scanned").filter(C("title").isNotNull()), ["website_id"], [F.asc("page_id")], n)
    titles = F.array_sort(F.collect_list(F.struct("page_id", F.substring("title", 1, p.shown_title).alias("title"))))
    lists = rows.groupBy("website_id").agg(F.transform(titles, lambda t: t["title"]).alias("titles"))
    listed = sites.select("website_id").join(lists, "website_id", "left")
    return listed.withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))


def affected_pages(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct pages per key (no page counts as page 0), deduplicated before counting so a hot key stays spread."""
    return findings.select(*keys, F.coalesce("page_id", F.lit(0)).alias("p")).distinct().groupBy(*keys).agg(F.count("*").alias("affected_urls"))


def finding_groups(findings: DataFrame) -> DataFrame:
    """Open findings by category, severity, rule and title."""
    keys = ["website_id", "category", "severity", "rule_key", "title"]
    per_page = sc.open_findings(findings).groupBy(*keys, F.coalesce("page_id", F.lit(0)).alias("p")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("total")
    )
    return per_page.groupBy(*keys).agg(
        F.sum("n").alias("findings_count"), F.count("*").alias("affected_urls"),
        F.round(F.sum("total") / F.sum("n")).cast("int").alias("average_confidence"),
    ).withColumn("severity_rank", fd.severity_rank(C("severity")))


def missing_types(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Required page types not found among a site's scanned pages; all of them for a site without any."""
    every = F.array(*[F.lit(t) for t in vocab.LINKED_TYPES])
    found = F.collect_set("essential_page_type")  # at most eight values
    left = pages.filter("scanned").groupBy("website_id").agg(F.array_except(every, found).alias("missing"))
    return sites.select("website_id").join(left, "website_id", "left").withColumn("missing", F.coalesce("missing", every))


def policy_evidence() -> dict[str, Column]:
    """Value of each kind of evidence over a site's joined counts; lists count their entries."""
    found = {"privacy_page_found": "privacy", "about_page_found": "about", "contact_page_found": "contact", "editorial_policy_found": "editorial"}
    by_category = {
        "privacy_or_consent_findings": "Privacy & consent", "deceptive_practice_findings": "Deceptive practices",
        "publisher_requirement_findings": "Publisher requirements", "content_quality_findings": "Content quality",
        "duplicate_content_findings": "Duplicate content", "copyright_findings": "Copyright", "prohibited_content_findings": "Prohibited content",
        "ad_experience_findings": "Ad experience", "technical_trust_findings": "Technical trust",
    }
    plain = {
        "missing_privacy_link_findings": "missing_privacy_link", "missing_consent_signal_findings": "missing_consent_signal",
        "thin_content_pages": "thin_pages", "average_words_per_page": "average_words", "ai_analyzed_pages": "ai_pages_analyzed",
        "pages_with_ads": "pages_with_ads", "average_ads_per_page": "average_ads", "browser_ad_audit_findings": "browser_findings", "http_error_pages": "error_pages",
    }
    values = {name: F.array_contains("found", kind) for name, kind in found.items()}
    values |= {name: C(column) for name, column in (by_category | plain).items()}
    return values | {"scan_partial": C("scan_status") == "partial", "found_page_types": F.size("found"), "missing_page_types": F.size("missing")}


def policy_matrix(sites: DataFrame, findings: DataFrame, pages: DataFrame, scans: DataFrame) -> DataFrame:
    """Evidence for each area of the policy review per site: area, its requirement and policy, evidence, value, page types.

    Pages are aggregated once. The scan behind the review is the site's last finished one.
    """
    cat, rule = C("category"), C("rule_key")
    counts = sc.open_findings(findings).groupBy("website_id").agg(
        *[F.count_if(cat == c).alias(c) for c in vocab.CATEGORIES],
        F.count_if(rule == "privacy.missing-disclosure-link").alias("missing_privacy_link"),
        F.count_if(rule == "privacy.consent-signal-missing").alias("missing_consent_signal"),
        F.count_if(rule.startswith("ads.browser-")).alias("browser_findings"),
    )
    kinds = F.array_sort(F.collect_set(F.when(C("essential_page_type") != "home", C("essential_page_type"))))  # at most seven values
    profile = pages.filter("scanned").groupBy("website_id").agg(
        F.round(F.avg("word_count"), 1).alias("average_words"), F.round(F.avg("ad_count"), 1).alias("average_ads"),
        F.count_if(C("word_count") < DEFAULT.thin_words).alias("thin_pages"), F.count_if(C("ad_count") > 0).alias("pages_with_ads"),
        F.count_if(C("status_code") >= 400).alias("error_pages"), kinds.alias("found"),
    )
    last = scans.filter(C("status").isin("completed", "partial")).groupBy("website_id").agg(
        F.max_by(F.struct("status", "ai_pages_analyzed"), F.struct("finished_at", "scan_id")).alias("s"),
    ).select("website_id", C("s.status").alias("scan_status"), "s.ai_pages_analyzed")
    row = sites.select("website_id").join(counts, "website_id", "left").join(profile, "website_id", "left").join(last, "website_id", "left")
    row = row.fillna(0).fillna("", ["scan_status"]).withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    row = row.withColumn("missing", F.array_except(F.array(*[F.lit(t) for t in vocab.LINKED_TYPES]), C("found")))
    values, lists = policy_evidence(), {"found_page_types": C("found"), "missing_page_types": C("missing")}
    cells = [
        F.struct(
            F.lit(area).alias("area"), F.lit(level).alias("requirement_level"), F.lit(expects).alias("google_expectation"), F.lit(url).alias("policy_url"),
            F.lit(name).alias("evidence"), values[name].cast("double").alias("value"), lists.get(name, F.lit(None).cast("array<string>")).alias("page_types"))
        for area, level, expects, url, names in vocab.POLICY_AREAS for name in names
    ]
    return row.select("website_id", F.inline(F.array(*cells)))


def site_policy_groups(sites: DataFrame, findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Five policy groups per site: affected pages, all pages, worst open severity."""
    group = F.lit(None).cast("string")
    for name, categories in vocab.POLICY_GROUPS.items():
        group = F.when(C("category").isin(*categories), name).otherwise(group)
    rows = sc.open_findings(findings).withColumn("policy", group).filter(C("policy").isNotNull())
    per_page = rows.groupBy("website_id", "policy", F.coalesce("page_id", F.lit(0)).alias("p")).agg(F.min(fd.severity_rank(C("severity"))).alias("rank"))
    counted = per_page.groupBy("website_id", "policy").agg(F.count("*").alias("violating_urls"), F.min("rank").alias("rank"))
    last = latest_per_site(scans.filter(C("status").isin("completed", "partial")), "finished_at", "pages_scanned")
    names = F.explode(F.array(*[F.lit(n) for n in vocab.POLICY_GROUPS])).alias("policy")
    total = sites.join(last, "website_id", "left").select(
        "website_id", names, F.coalesce(F.nullif("pages_scanned", F.lit(0)), F.nullif("last_scanned_pages", F.lit(0)), "pages_count", F.lit(0)).alias("total_urls")
    )
    worst = F.lit("healthy")
    for name, rank in vocab.SEVERITY_RANK.items():
        worst = F.when(C("rank") == rank, name).otherwise(worst)
    return total.join(counted, ["website_id", "policy"], "left").select(
        "website_id", "policy", F.coalesce("violating_urls", F.lit(0)).alias("violating_urls"), "total_urls", worst.alias("status")
    )


def latest_per_site(scans: DataFrame, order: str, *columns: str) -> DataFrame:
    """Latest scan per site by a time column (highest scan id on ties)."""
    return scans.groupBy("website_id").agg(
        F.max_by(F.struct("scan_id", *columns), F.struct(order, "scan_id")).alias("s")
    ).select("website_id", "s.*")


def site_row(sites: DataFrame, findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Site list row: affected pages per severity, coverage, partial flag, latest active scan."""
    per = affected_pages(sc.open_findings(findings), ["website_id", "severity"])
    counts = per.groupBy("website_id").pivot("severity", vocab.SEVERITIES).agg(F.first("affected_urls"))
    active = latest_per_site(scans.filter(C("status").isin(*vocab.ACTIVE_SCAN_STATUSES)), "created_at", "progress")
    rows = sites.join(counts, "website_id", "left").join(active, "website_id", "left").fillna(0, vocab.SEVERITIES)
    legacy = (C("last_discovered_pages") == 0) & C("last_scanned_at").isNotNull()
    rows = rows.withColumns({
        "discovered": F.when(legacy, C("pages_count")).otherwise(C("last_discovered_pages")),
        "scanned_pages": F.when(legacy, C("pages_count")).otherwise(C("last_scanned_pages")),
    })
    found = C("discovered") > 0
    return rows.select(
        "website_id", "domain", "status", "overall_score", *vocab.SEVERITIES, "discovered", "scanned_pages",
        F.when(found, F.least(F.lit(100), F.round(C("scanned_pages") / C("discovered") * 100).cast("int"))).otherwise(0).alias("coverage"),
        (C("last_scan_partial") | (found & (C("scanned_pages") < C("discovered")))).alias("coverage_partial"),
        C("scan_id").alias("active_scan_id"), C("progress").alias("active_progress"),
    )


def site_top_risk(sites: DataFrame, findings: DataFrame) -> DataFrame:
    """Title of each site's worst open finding."""
    top = sc.open_findings(findings).groupBy("website_id").agg(
        F.min_by("title", F.struct(fd.severity_rank(C("severity")), "fingerprint")).alias("title")
    )
    return sites.select("website_id").join(top, "website_id", "left").select(
        "website_id", F.coalesce("title", F.lit("No blocking issue")).alias("top_risk")
    )


# ---------------------------------------------------------------- portfolio

def portfolio_metrics(sites: DataFrame, findings: DataFrame) -> DataFrame:
    s = sites.agg(
        F.count("*").alias("total"), F.count("last_scanned_at").alias("monitored"),
        F.round(F.coalesce(F.avg("overall_score"), F.lit(100.0))).cast("int").alias("average_score"),
    )
    f = sc.open_findings(findings).agg(
        F.count_if(C("severity") == "critical").alias("open_critical"), F.count_if(C("severity") == "high").alias("open_high")
    )
    return s.crossJoin(f)  # one row by one row


def portfolio_health(sites: DataFrame) -> DataFrame:
    h = sites.agg(
        F.count("*").alias("total"), F.count_if(C("status") == "healthy").alias("healthy"),
        F.count_if(C("status").isin("review", "high", "pending", "scanning")).alias("review"), F.count_if(C("status") == "critical").alias("critical"),
    )
    return h.withColumns({
        "healthy_percent": coverage_percent(C("healthy"), C("total")), "review_percent": coverage_percent(C("healthy") + C("review"), C("total")),
    })


def portfolio_trend(scans: DataFrame, n: int = 16) -> DataFrame:
    """Latest completed scores, oldest first; [100] when there are none."""
    last = scans.filter((C("status") == "completed") & C("score").isNotNull()).orderBy(F.desc("finished_at"), F.desc("scan_id")).limit(n)
    ordered = F.array_sort(F.collect_list(F.struct("finished_at", "scan_id", "score")))
    return last.agg(F.transform(ordered, lambda x: x["score"]).alias("scores")).select(
        F.when(F.size("scores") > 0, C("scores")).otherwise(F.array(F.lit(100))).alias("scores")
    )


def finding_cards(findings: DataFrame, now: Column) -> DataFrame:
    is_open = C("status").isin(*vocab.OPEN_STATUSES)
    return findings.agg(
        F.count_if(is_open & (C("severity") == "critical")).alias("critical"), F.count_if(is_open & (C("severity") == "high")).alias("high"),
        F.count_if(C("status") == "remediating").alias("remediating"),
        F.count_if((C("status") == "resolved") & (C("resolved_at") >= F.date_trunc("month", now))).alias("resolved_month"),
    )


def admin_metrics(users: DataFrame, sites: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    parts = [
        users.agg(F.count("*").alias("users")), sites.agg(F.count("*").alias("sites")),
        scans.agg(F.count_if(C("status").isin(*vocab.ACTIVE_SCAN_STATUSES)).alias("running_scans")),
        scans.filter("ai_assessed").select("website_id").distinct().agg(F.count("*").alias("sites_assessed")),
        sc.open_findings(findings).agg(F.count("*").alias("open_findings"), F.count_if(C("severity") == "critical").alias("critical_findings")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # single rows


def traffic_join(pages: DataFrame, views: DataFrame) -> DataFrame:
    """Seven-day views per stored page, zero when its path had none. ``views`` has one row per path."""
    return pages.withColumn("path", ux.path_or_root(C("url"))).join(views, "path", "left").withColumn(
        "ga4_views_7d", F.coalesce("views", F.lit(0))
    ).drop("views")


def highest_value_pages(pages: DataFrame, n: int = 20) -> DataFrame:
    return pages.filter("ga4_views_7d > 0").orderBy(F.desc("ga4_views_7d"), "page_id").limit(n)


# ---------------------------------------------------------------- query surface

def filter_findings(findings: DataFrame, scans: DataFrame | None = None, severity=None, category=None, status=None, scan_id=None, active_scan=False) -> DataFrame:
    for column, value in (("severity", severity), ("category", category), ("status", status), ("scan_id", scan_id)):
        if value is not None:
            findings = findings.filter(C(column) == value)
    if active_scan:
        active = scans.filter(C("status").isin(*vocab.ACTIVE_SCAN_STATUSES)).select("scan_id")
        findings = findings.join(active, "scan_id", "left_semi")
    return findings


def search_findings(findings: DataFrame, sites: DataFrame, pages: DataFrame, term: str) -> DataFrame:
    """Literal, case-insensitive search over finding texts, site domain and page URL.

    The term is looked for where a text is stored once, on the site and on the page; a finding then only meets the ids
    of sites and pages that hit, and is read once.
    """
    has = lambda c: F.coalesce(F.lower(c).contains(F.lit(term.lower())), F.lit(False))
    site_hits = sites.filter(has("domain")).select("website_id", F.lit(True).alias("_site"))
    page_hits = pages.filter(has("url")).select("page_id", F.lit(True).alias("_page"))
    rows = lookup(lookup(findings, site_hits, "website_id", "fingerprint"), page_hits, "page_id", "fingerprint")
    own = reduce(lambda a, b: a | b, [has(c) for c in ("title", "summary", "public_id")])
    return rows.filter(own | C("_site").isNotNull() | C("_page").isNotNull()).drop("_site", "_page")


def search_sites(sites: DataFrame, term: str | None = None, status: str | None = None) -> DataFrame:
    if term:
        needle = F.lit(term.lower())
        sites = sites.filter(F.lower("name").contains(needle) | F.lower("domain").contains(needle))
    if status in ("pending", "scanning", "critical", "high", "review", "healthy", "disabled"):
        sites = sites.filter(C("status") == status)
    return sites


def visible_sites(sites: DataFrame, user_id: int | None, is_admin: bool = False) -> DataFrame:
    return sites if is_admin or user_id is None else sites.filter(C("user_id") == user_id)


def tenant_scope(rows: DataFrame, sites: DataFrame, user_id: int | None, is_admin: bool = False) -> DataFrame:
    """Rows of the user's own sites."""
    if is_admin or user_id is None:
        return rows
    return rows.join(visible_sites(sites, user_id).select("website_id"), "website_id", "left_semi")


def parent_counts(parents: DataFrame, children: DataFrame, key: str, **conditions: Column) -> DataFrame:
    """Conditional child counts per parent."""
    counts = children.groupBy(key).agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])
    return parents.join(counts, key, "left").fillna(0, list(conditions))


def severity_order(findings: DataFrame, *then: Column) -> DataFrame:
    return findings.orderBy(fd.severity_rank(C("severity")), *then)


def paginate(rows: DataFrame, order: list[Column], page: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(rows of one page, one row with current_page, last_page, total, first, last). The page is a bounded top-n."""
    page = max(1, page)
    shown = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    total = C("total")
    first = F.when(total > (page - 1) * size, (page - 1) * size + 1)
    meta = rows.agg(F.count("*").alias("total")).select(
        F.lit(page).alias("current_page"), F.greatest(F.lit(1), F.ceil(total / size)).cast("int").alias("last_page"), "total",
        first.alias("first"), F.when(first.isNotNull(), F.least(F.lit(page * size), total)).alias("last"),
    )
    return shown, meta


@dataclass(frozen=True)
class Ordered:
    """A stored copy of a list in its order, cut into ranges, and how many rows lie before each range.

    Any page reads the one or two ranges it lies in, however deep; the driver sees the counts (one row per range) and the
    rows of the page.
    """

    path: str
    order: tuple[str, ...]  # column names, "-" before a descending one; together unique

    def _columns(self) -> list[Column]:
        return [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in self.order]

    def build(self, rows: DataFrame, ranges: int) -> "Ordered":
        dealt = rows.repartitionByRange(ranges, *self._columns()).withColumn("part", F.spark_partition_id())
        dealt.sortWithinPartitions(*self._columns()).write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rows")
        spark = rows.sparkSession
        counts = spark.read.parquet(f"{self.path}/rows").groupBy("part").agg(F.count("*").alias("n"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/counts")
        return self

    def page(self, spark: SparkSession, page: int, size: int) -> DataFrame:
        """Rows of a page in order; a page beyond the end is empty."""
        first, parts, before, skip = (max(1, page) - 1) * size, [], 0, 0
        for r in sorted(spark.read.parquet(f"{self.path}/counts").collect(), key=lambda r: r.part):
            if before < first + size and before + r.n > first:
                skip = skip if parts else first - before
                parts.append(r.part)
            before += r.n
        stored = spark.read.parquet(f"{self.path}/rows").filter(C("part").isin(parts)) if parts else spark.read.parquet(f"{self.path}/rows").limit(0)
        return stored.orderBy(*self._columns()).offset(skip).limit(size).drop("part")


def scan_detail(targets: DataFrame, pages: DataFrame, events: DataFrame) -> DataFrame:
    """Targets with their page columns and event counts."""
    counts = events.groupBy("page_id").agg(F.count("*").alias("events_count"))
    rows = with_page(targets, pages, "title", "word_count", by="position")
    return lookup(rows, counts, "page_id", "position").withColumn("events_count", F.coalesce("events_count", F.lit(0)))


def target_timeline(events: DataFrame, target_id: int) -> DataFrame:
    return events.filter(C("target_id") == target_id).orderBy("event_id")


def live_scans(scans: DataFrame, sites: DataFrame, findings: DataFrame, targets: DataFrame, n: int = 10) -> DataFrame:
    """Newest scans with site, child counts and values read from their open JSON."""
    top = scans.orderBy(F.desc("created_at"), F.desc("scan_id")).limit(n)  # n rows: every join below has a tiny side
    st = C("status")
    counted = top.join(F.broadcast(findings.join(F.broadcast(top.select("scan_id")), "scan_id", "left_semi").groupBy("scan_id").agg(F.count("*").alias("findings_total"))), "scan_id", "left")
    per = targets.join(F.broadcast(top.select("scan_id")), "scan_id", "left_semi").groupBy("scan_id").agg(
        F.count_if(st == "queued").alias("targets_queued"), F.count_if(st == "running").alias("targets_running"), F.count_if(st == "failed").alias("targets_failed"))
    rows = counted.join(per, "scan_id", "left").join(sites.select("website_id", "domain"), "website_id", "left")
    meta = lambda path, default: F.coalesce(F.get_json_object("meta", path), F.lit(default))
    return rows.select(
        "scan_id", "domain", "type", "status", "progress", "pages_scanned", "pages_discovered",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("findings_total", "targets_queued", "targets_running", "targets_failed")],
        meta("$.ai_errors", "0").cast("int").alias("ai_errors"), meta("$.is_sampled", "false").cast("boolean").alias("is_sampled"),
        meta("$.sampling_mode", "all_urls").alias("sampling_mode"),
        F.coalesce(F.get_json_object("meta", "$.available_urls").cast("int"), C("pages_discovered")).alias("available_urls"),
    )


def live_findings(findings: DataFrame, sites: DataFrame, pages: DataFrame, n: int = 100) -> DataFrame:
    """Newest findings with site, URL, label and source."""
    top = findings.orderBy(F.desc("last_seen_at"), "fingerprint").limit(n)
    rows = top.join(sites.select("website_id", "domain", "start_url"), "website_id", "left").join(pages.select("page_id", "url"), "page_id", "left")
    return rows.select(
        "fingerprint", "public_id", "scan_id", "domain", F.coalesce("url", "start_url").alias("url"), "title",
        fd.label(C("category")).alias("category"), "severity", "confidence", "status", fd.source(C("rule_key")).alias("source"),
    )


def backfill_essential_type(pages: DataFrame) -> DataFrame:
    """Typed column filled from the open JSON where that names a known type."""
    stored = F.get_json_object("meta", "$.essential_page_type")
    return pages.withColumn("essential_page_type", F.coalesce("essential_page_type", F.when(stored.isin(*vocab.PAGE_TYPES), stored)))


def site_delete(sites: DataFrame, scans: DataFrame, doomed: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after deleting the sites in ``doomed`` (website_id) that have no active scan."""
    busy = scans.filter(C("status").isin(*vocab.ACTIVE_SCAN_STATUSES)).select("website_id").distinct()
    gone = doomed.select("website_id").distinct().join(busy, "website_id", "left_anti")
    tables = {"sites": sites, "scans": scans, **children}
    return {name: t.join(gone, "website_id", "left_anti") for name, t in tables.items()}


# ---------------------------------------------------------------- exports

def export_findings(findings: DataFrame, sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Nine columns."""
    rows = with_page(with_site(findings, sites, "domain"), pages, "url")
    return rows.select(
        C("public_id").alias("id"), C("domain").alias("website"), "url", fd.label(C("category")).alias("category"),
        fd.label(C("severity")).alias("severity"), "confidence", fd.label(C("status")).alias("status"), "title", _iso("last_seen_at").alias("last_seen"),
    )


def export_findings_wide(findings: DataFrame, sites: DataFrame, pages: DataFrame) -> DataFrame:
    """Sixteen columns, every value as text. To the look-ups a finding brings its texts as one column, and its keys."""
    texts = {
        "id": C("public_id"), "rule": C("rule_key"), "title": C("title"), "remediation": F.array_join("remediation", "\n"), "policy": C("policy_reference"),
        "category": C("category"), "severity": C("severity"), "status": C("status"), "first_seen": _iso("first_seen_at"), "last_seen": _iso("last_seen_at"),
        "confidence": C("confidence").cast("string"), "scan_id": C("scan_id").cast("string"), "summary": C("summary"),
    }
    # rows without a key are spread by the fingerprint, which is not moved itself
    keyless = F.when(C("website_id").isNull() | C("page_id").isNull(), F.pmod(F.xxhash64("fingerprint"), F.lit(1 << 15))).otherwise(0).cast("short")
    lean = findings.select("website_id", "page_id", keyless.alias("_by"), tx.packed(list(texts.values())).alias("_texts"))
    rows = with_site(with_page(lean, pages, "url", by="_by"), sites, "domain", "start_url", by="_by")
    parts = [part.alias(name) for name, part in zip(texts, tx.unpacked(C("_texts"), len(texts)))]
    return rows.select("domain", F.coalesce("url", "start_url").alias("url"), *parts).select(
        "id", "scan_id", C("domain").alias("website"), "url", fd.source(C("rule")).alias("source"), "rule", fd.label(C("category")).alias("category"),
        fd.label(C("severity")).alias("severity"), "confidence", fd.label(C("status")).alias("status"),
        "title", "summary", "policy", "first_seen", "last_seen", "remediation",
    )


def export_sites(sites: DataFrame) -> DataFrame:
    """Ten columns."""
    return sites.select(
        "name", "domain", fd.label(C("status")).alias("status"), C("overall_score").alias("score"), C("pages_count").alias("pages"),
        C("last_discovered_pages").alias("discovered"), C("last_scanned_pages").alias("scanned"),
        F.when(C("last_scan_partial"), "có").otherwise("không").alias("partial"), C("open_findings_count").alias("open_findings"), _iso("last_scanned_at").alias("last_scanned"),
    )


def export_site_findings(findings: DataFrame, sites: DataFrame, pages: DataFrame) -> DataFrame:
    """JSON rows of a site's open findings."""
    rows = with_page(with_site(sc.open_findings(findings), sites, "start_url"), pages, "url")
    path = F.when(C("url").isNull(), "/").otherwise(ux.path_or_root(C("url")))
    return rows.select("website_id", "fingerprint", F.to_json(F.struct(
        C("public_id").alias("id"), F.coalesce("url", "start_url").alias("url"), path.alias("path"), fd.label(C("category")).alias("category"),
        "title", "severity", fd.label(C("severity")).alias("severity_label"), "confidence",
    )).alias("row"))


def write_csv(df: DataFrame, path: str, order: str | None = None) -> None:
    """CSV with a header; ordered output is range-partitioned, never gathered."""
    (df.orderBy(order) if order else df).write.mode("overwrite").option("header", True).csv(path)
