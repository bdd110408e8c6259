"""Third-party results (moderation, model replies, rendered layouts, assessments) in the finding format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sitegauge.functions import finding as fd, text as tx, url as ux, vocab
from sitegauge.operators.numbering import first_per_group, first_ranked, lookup
from sitegauge.operators import merge as mg
from sitegauge.params import DEFAULT, Params

C = F.col
STRINGS = "array<string>"


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("website_id", "scan_id", "page_id") if c in df.columns]


def _emit(df: DataFrame, record: Column) -> DataFrame:
    keys = _keys(df)
    return df.select(*keys, "url", record.alias("f")).select(*keys, "url", "f.*")


def moderation_findings(replies: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One finding per moderation class at or above the threshold; not subject to the scan scope."""
    ok = replies.filter(C("status") == "success")
    if "text" in replies.columns:
        ok = ok.filter(tx.trim(C("text")) != "")
    rows = ok.select(*_keys(replies), "url", "request_id", F.explode("classes").alias("class", "score")).filter(
        (C("class") != "available") & (C("score") >= p.moderation_threshold)
    )
    name = F.replace(C("class"), F.lit("_"), F.lit(" "))
    return _emit(rows, fd.finding(
        rule_key=F.concat(F.lit("sightengine."), "class"), category="Third-party moderation",
        severity=F.when(C("score") >= 0.85, "high").otherwise("review"), confidence=F.round(C("score") * 100).cast("int"),
        title=F.concat(F.lit("Moderation model reported "), name), url=C("url"),
        summary=F.concat(F.lit("The moderation model scores the text "), F.format_number("score", 2), F.lit(" for "), name, F.lit(".")),
        signals=F.to_json(F.struct("class", "score", "request_id")), policy=F.concat(F.lit("text moderation: "), C("class")),
        remediation="Review the page in context.",
    ))


REPLY_SCHEMA = (
    "findings array<struct<policy_code:string,severity:string,confidence:double,title:string,summary:string,"
    "evidence:array<string>,remediation:array<string>>>"
)


def _entries(values: Column) -> Column:
    """Trimmed texts of a list without empty ones; stored whole, cut only where they are shown."""
    trimmed = F.transform(F.coalesce(values, F.array().cast(STRINGS)), lambda x: tx.trim(F.coalesce(x, F.lit(""))))
    return F.filter(trimmed, lambda x: ~x.isin("", "0"))


def llm_findings(replies: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Findings of structured model replies (url, reply, response_id): known policy codes with enough confidence."""
    floor = max(0, min(100, p.model_min_confidence))
    codes = tx.lookup(vocab.MODEL_CODES)
    rows = replies.select(
        *_keys(replies), "url", "response_id", F.explode(F.from_json("reply", REPLY_SCHEMA)["findings"]).alias("r")
    )
    rows = rows.withColumns({
        "code": C("r.policy_code"),
        "confidence": fd.clamp_confidence(F.coalesce(C("r.confidence"), F.lit(0.0)).cast("int")),
        "category": F.try_element_at(codes, C("r.policy_code")),
    }).filter(C("category").isNotNull() & (C("confidence") >= floor))
    advice = _entries(C("r.remediation"))
    title = tx.trim(F.coalesce(C("r.title"), F.initcap(F.replace(C("code"), F.lit("_"), F.lit(" ")))))
    return _emit(rows, fd.finding(
        rule_key=F.concat(F.lit("ai."), "code"), category=C("category"),
        severity=F.when(C("r.severity").isin("high", "review", "info"), C("r.severity")).otherwise("review"),
        confidence=C("confidence"), url=C("url"),
        title=title, summary=F.coalesce(F.nullif(tx.trim(F.coalesce("r.summary", F.lit(""))), F.lit("")), title),
        signals=F.to_json(F.struct(
            F.lit(p.model_name).alias("model"), "response_id", C("code").alias("policy_code"), _entries(C("r.evidence")).alias("evidence"),
        )),
        policy=F.concat(F.lit("publisher policies: "), F.replace(C("code"), F.lit("_"), F.lit(" "))),
        remediation=F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("Review the quoted evidence and record a decision."))),
    ))


def browser_findings(viewports: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Layout findings per page over all its viewports."""
    keys = _keys(viewports)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("int")
    pages = viewports.groupBy(*keys, "url").agg(
        total("nearInteractiveCount").alias("near"), total("intrusiveOverlayCount").alias("overlay"),
        total("misleadingLabelCount").alias("misleading"), F.coalesce(F.max("viewportCoverage"), F.lit(0.0)).alias("coverage"),
        total("popupAttempts").alias("popups"), total("adRefreshCount").alias("refreshes"),
    )
    high = lambda cond: F.when(cond, "high").otherwise("review")
    rules = [
        ("ads.browser-accidental-click-risk", C("near") > 0, high(C("near") >= 3), 92, "Ads too close to controls"),
        ("ads.browser-intrusive-overlay", C("overlay") > 0, F.lit("high"), 94, "Overlay ads cover the content"),
        ("ads.browser-misleading-label", C("misleading") > 0, F.lit("high"), 88, "Misleading label next to an ad"),
        ("ads.browser-viewport-dominance", C("coverage") >= 0.30, high(C("coverage") >= 0.50), 86, "Ads dominate the first screen"),
        ("ads.browser-popup-or-refresh", (C("popups") > 0) | (C("refreshes") > 0), high(C("popups") > 0), 84, "Popup or ad refresh behaviour"),
    ]
    measured = F.to_json(F.struct("near", "overlay", "misleading", "coverage", "popups", "refreshes"))
    found = F.array_compact(F.array(*[
        F.when(cond, fd.finding(rule_key=k, category="Ad experience", severity=sev, confidence=conf, title=title, url=C("url"),
                                signals=measured, policy="ad placement policies", remediation="Adjust the ad layout."))
        for k, cond, sev, conf, title in rules
    ]))
    return pages.select(*keys, "url", F.explode(found).alias("f")).select(*keys, "url", "f.*")


def addon_budget(targets: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(first ``limit`` targets per scan in position order, scans whose budget is used up). Zero means unlimited."""
    if limit <= 0:
        return targets, targets.select("scan_id").limit(0)
    taken = first_ranked(targets, ["scan_id"], [F.asc("position")], limit, "budget_rank")
    full = targets.groupBy("scan_id").agg(F.count("*").alias("n")).filter(C("n") >= limit).select("scan_id")
    return taken, full


def llm_usage(targets: DataFrame) -> DataFrame:
    """Token and error totals per scan."""
    return targets.groupBy("scan_id").agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count_if("ai_attempted").alias("attempted"), F.count_if("ai_analyzed").alias("analyzed"),
        F.count_if(C("ai_attempted") & ~C("ai_analyzed")).alias("errors"),
    )


SECTIONS = ["content_overview", "transparency_overview", "adsense_requirements_overview", "policy_overview"]
ASSESSMENT_SCHEMA = (
    "risk_level string, headline string, summary string, content_overview string, transparency_overview string, "
    "adsense_requirements_overview string, policy_overview string, "
    "policy_references array<struct<section:string,issue:string,relevance:string,policy_url:string>>, "
    "recommendations array<string>, priorities array<string>, limitations array<string>, "
    "key_issues array<struct<title:string,why_it_matters:string>>"
)


def section_of_url(url: Column) -> Column:
    return (
        F.when(url.contains("/11190248") | url.contains("/81904"), SECTIONS[0])
        .when(url.contains("/11185755"), SECTIONS[1]).when(url.contains("/1348695"), SECTIONS[2]).otherwise(SECTIONS[3])
    )


def section_of_category(category: Column) -> Column:
    return (
        F.when(category.isin("Copyright", "Duplicate content", "Content quality"), SECTIONS[0])
        .when(category.isin("Deceptive practices", "Publisher requirements"), SECTIONS[1])
        .when(category == "Privacy & consent", SECTIONS[2]).otherwise(SECTIONS[3])
    )


def assessment_references(assessments: DataFrame) -> DataFrame:
    """Usable policy references of each assessment (scan_id, payload): allow-listed, complete, unique, all of them in order."""
    r = F.from_json("payload", ASSESSMENT_SCHEMA)["policy_references"]
    rows = assessments.select("scan_id", F.posexplode(r).alias("i", "r")).filter(C("r.policy_url").isin(*vocab.POLICY_URLS.values()))
    rows = rows.select(
        "scan_id", "i",
        F.when(C("r.section").isin(*SECTIONS), C("r.section")).otherwise(section_of_url(C("r.policy_url"))).alias("section"),
        tx.trim(F.coalesce("r.issue", F.lit(""))).alias("issue"),
        tx.trim(F.coalesce("r.relevance", F.lit(""))).alias("relevance"), C("r.policy_url").alias("policy_url"),
    ).filter((C("issue") != "") & (C("relevance") != ""))
    once = first_per_group(rows, ["scan_id", "section", "policy_url"], ["i"])
    in_order = F.row_number().over(W.partitionBy("scan_id").orderBy("i"))  # entries of one payload
    return once.withColumn("reference_rank", in_order)


def assessment_references_fallback(assessed: DataFrame, references: DataFrame, open_findings: DataFrame) -> DataFrame:
    """One reference per open finding category for assessed sites that kept none."""
    bare = assessed.select("scan_id", "website_id").join(references.select("scan_id").distinct(), "scan_id", "left_anti")
    categories = open_findings.select("website_id", "category").distinct()
    return bare.join(categories, "website_id").select(
        "scan_id", "website_id", section_of_category(C("category")).alias("section"), fd.label(C("category")).alias("issue"),
        fd.policy_url(C("category")).alias("policy_url"), fd.policy_title(C("category")).alias("policy_title"),
    )


def assessment_normalize(assessments: DataFrame) -> DataFrame:
    """Text fields and lists of each assessment, whole; :func:`shown_assessment` cuts them for a report."""
    a = assessments.withColumn("a", F.from_json("payload", ASSESSMENT_SCHEMA))
    text = lambda c, d="": tx.trim(F.coalesce(C(c), F.lit(d)))
    issues = F.array_join(F.filter(F.transform(
        F.coalesce("a.key_issues", F.array().cast("array<struct<title:string,why_it_matters:string>>")),
        lambda i: F.trim(F.concat(F.coalesce(i["title"], F.lit("")), F.lit(". "), F.coalesce(i["why_it_matters"], F.lit(""))))),
        lambda x: x != ""), " ")
    lines = lambda c: F.coalesce(c, F.array().cast(STRINGS))
    return a.select(
        "scan_id", F.when(C("a.risk_level").isin("critical", "high", "review", "healthy"), C("a.risk_level")).otherwise("review").alias("risk_level"),
        text("a.headline", "Website assessment").alias("headline"),
        *[text(f"a.{c}").alias(c) for c in ("summary", "content_overview", "transparency_overview", "adsense_requirements_overview")],
        tx.trim(F.coalesce("a.policy_overview", issues)).alias("policy_overview"),
        F.transform(lines(F.coalesce("a.recommendations", "a.priorities")), lambda x: tx.trim(x)).alias("priorities"),
        lines(C("a.limitations")).alias("limitations"),
    )


def shown_assessment(assessments: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Normalised assessments cut for a report: lengths and list sizes are the ``shown_*`` parameters."""
    texts = [c for c in ("headline", "summary", *SECTIONS) if c in assessments.columns]
    short = {c: F.substring(c, 1, p.shown_headline if c == "headline" else p.shown_text) for c in texts}
    lists = {"priorities": p.shown_priorities, "limitations": p.shown_limitations}
    return assessments.withColumns(short | {
        c: F.transform(F.slice(c, 1, n), lambda x: F.substring(x, 1, p.shown_line)) for c, n in lists.items()})


def evidence_quotes(signals: Column) -> Column:
    """Distinct non-empty quotes of a finding, in order."""
    s = F.from_json(signals, "evidence array<string>, matching_phrases array<string>")
    none = F.array().cast(STRINGS)
    joined = F.concat(F.coalesce(s["evidence"], none), F.coalesce(s["matching_phrases"], none))
    clean = F.filter(F.transform(joined, lambda x: tx.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.array_distinct(clean)


def evidence_source_urls(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Valid distinct source URLs of each finding, including the address entered by a reviewer."""
    s = F.from_json("signals", "external_image_urls array<string>, source_urls array<string>, source_url string, matched_url string")
    none = F.array().cast(STRINGS)
    rows = lookup(findings, reviews.select("page_id", C("matched_url").alias("reviewed_url")), "page_id", "fingerprint").withColumn("s", s)
    urls = F.concat(
        F.coalesce("s.external_image_urls", none), F.coalesce("s.source_urls", none), F.array("s.source_url", "s.matched_url", "reviewed_url")
    )
    valid = F.filter(F.array_compact(urls), lambda u: ux.is_valid(u))
    return rows.select("fingerprint", "page_id", F.array_distinct(valid).alias("source_urls"))


def copyright_review_upsert(reviews: DataFrame, updates: DataFrame, pages: DataFrame) -> DataFrame:
    """One review per (website, page): the last update replaces status, match and notes; the search text is the quoted title."""
    quoted = F.concat(F.lit('"'), F.substring(F.coalesce("title", F.lit("")), 1, 180), F.lit('"'))
    updates = mg.latest_per_key(updates, ["website_id", "page_id"], F.struct("reviewed_at", "status", "matched_url", "notes"))
    fresh = updates.join(pages.select("page_id", "title"), "page_id", "left").select(
        "website_id", "page_id", C("status").alias("n_status"), quoted.alias("n_query"), C("matched_url").alias("n_url"),
        C("notes").alias("n_notes"), C("reviewed_at").alias("n_at"), F.lit(True).alias("is_new"),
    )
    both = reviews.join(fresh, ["website_id", "page_id"], "full_outer")
    pick = lambda new, old: F.when(C("is_new"), C(new)).otherwise(C(old)).alias(old)
    return both.select(
        "website_id", "page_id", pick("n_status", "status"), pick("n_query", "google_query"), pick("n_url", "matched_url"),
        pick("n_notes", "notes"), pick("n_at", "reviewed_at"),
    )
