"""Page rules as Column expressions.

A rule is a predicate and the fields of its finding. All rules of a page become one array expression in the same
projection as the page signals, so the whole rule set costs one narrow stage.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sitegauge.functions import finding as fd, text as tx, url as ux, vocab
from sitegauge.params import DEFAULT, Params

C = F.col


@dataclass(frozen=True)
class Rule:
    """User rules are built the same way: expressions over the page-signal columns, no Python functions per row."""

    key: Column | str
    predicate: Column
    category: Column | str
    severity: Column | str
    confidence: Column | int
    signals: Column
    title: Column | str = ""
    policy: Column | str = ""
    remediation: str = ""
    summary: Column | str = ""

    def column(self, url: Column) -> Column:
        record = fd.finding(
            rule_key=self.key, category=self.category, severity=self.severity, confidence=self.confidence,
            title=self.title, url=url, signals=F.to_json(self.signals), policy=self.policy, remediation=self.remediation, summary=self.summary,
        )
        return F.when(self.predicate, record)


def _high_if(condition: Column) -> Column:
    return F.when(condition, "high").otherwise("review")


def _home() -> Column:
    return ux.home(C("url"))


def _ratio() -> Column:
    return F.floor(C("word_count") / F.greatest(C("ad_count"), F.lit(1))).cast("int")


def rule_content_thin(p: Params = DEFAULT) -> Rule:
    return Rule(
        "content.thin-page", C("word_count") < p.thin_words, "Content quality", _high_if(C("word_count") < 150), 92,
        F.struct("word_count", "paragraph_count"), vocab.RULE_TITLES["content.thin-page"],
        "publisher policies: low-value content", "Add original, useful content or stop monetising the page.",
        F.concat(F.lit("The page has "), C("word_count"), F.lit(" words in "), C("paragraph_count"), F.lit(" paragraphs.")),
    )


def rule_content_structure(p: Params = DEFAULT) -> Rule:
    return Rule(
        "content.low-editorial-structure",
        (C("word_count") >= p.thin_words) & (C("word_count") < p.low_value_words) & (C("paragraph_count") < 3),
        "Content quality", "review", 76, F.struct("word_count", "paragraph_count"), vocab.RULE_TITLES["content.low-editorial-structure"],
        "publisher policies: valuable inventory", "Structure the article and name sources and authors.",
        F.concat(C("word_count"), F.lit(" words stand in only "), C("paragraph_count"), F.lit(" paragraphs.")),
    )


def rule_document_structure(p: Params = DEFAULT) -> Rule:
    return Rule(
        "content.document-structure", (C("title") == "") | (C("h1_count") != 1), "Content quality", "info", 98,
        F.struct((C("title") != "").alias("title_present"), "h1_count"), "Page title or heading structure needs review",
        remediation="Add a descriptive title and one main heading.",
        summary=F.concat(F.when(C("title") == "", "No title and ").otherwise("A title and "), C("h1_count"), F.lit(" main headings were found.")),
    )


def attribution(text: Column) -> Column:
    """Visible credit words as whole words; the boundary is spelled out so every engine agrees on it."""
    return tx.let(F.lower(text), lambda t: reduce(or_, [t.contains(w) for w in ("source", "credit", "courtesy", "licens", "photo by", "©")]) & t.rlike(
        r"(?:^|[^\p{L}\p{N}_])(?:source|credit|courtesy|licensed?|photo by)(?:[^\p{L}\p{N}_]|$)"
        r"|[\p{L}\p{N}_]©[\p{L}\p{N}_]"
    ))


def rule_copyright_media(p: Params = DEFAULT) -> Rule:
    many = C("external_images") >= 3
    return Rule(
        "copyright.media-provenance-unverified", (C("external_images") > 0) & ~attribution(C("text")), "Copyright",
        _high_if(many), F.when(many, 82).otherwise(68),
        F.struct(
            "external_images", "external_image_urls",
            F.lit(False).alias("visible_attribution"), F.lit("unverified_external_media").alias("source_status"),
        ),
        vocab.RULE_TITLES["copyright.media-provenance-unverified"], "publisher policies: intellectual property",
        "Verify ownership or licences of all media.",
        F.concat(C("external_images"), F.lit(" images come from other sites and the page names no source.")),
    )


def _ad_signals(state: str | None = None) -> Column:
    extra = [F.lit(state).alias("content_state")] if state else []
    return F.struct("ad_count", "word_count", _ratio().alias("words_per_ad"), *extra)


def _ads_beside_words() -> Column:
    return F.concat(C("ad_count"), F.lit(" ads stand beside "), C("word_count"), F.lit(" words."))


def rule_ads_no_content(p: Params = DEFAULT) -> Rule:
    return Rule(
        "ads.on-page-without-content", (C("ad_count") > 0) & (C("word_count") < p.ad_empty_words), "Ad experience", "high",
        96, _ad_signals("empty_or_nearly_empty"), "Ads on a page without content",
        "publisher policies: inventory without content", "Remove ad code until the page has content.", _ads_beside_words(),
    )


def rule_ads_thin(p: Params = DEFAULT) -> Rule:
    return Rule(
        "ads.on-thin-content-page",
        (C("ad_count") > 0) & (C("word_count") >= p.ad_empty_words) & (C("word_count") < p.ad_thin_words),
        "Ad experience", _high_if((C("word_count") < 150) | (_ratio() < 100)), 93, _ad_signals("thin"),
        "Ads on a thin page", "publisher policies: low-value inventory", "Pause ads or extend the content.", _ads_beside_words(),
    )


def rule_ads_density(p: Params = DEFAULT) -> Rule:
    return Rule(
        "ads.density-review",
        (C("ad_count") > 0) & (C("word_count") >= p.ad_empty_words) & (C("word_count") >= p.ad_thin_words)
        & ((C("ad_count") > p.max_ads) | (_ratio() < p.words_per_ad)),
        "Ad experience", _high_if((C("ad_count") >= p.max_ads + 3) | (_ratio() < 100)), 88, _ad_signals(),
        vocab.RULE_TITLES["ads.density-review"], "publisher policies: more ads than content", "Reduce ad units.",
        _ads_beside_words(),
    )


def rule_ads_txt_missing(p: Params = DEFAULT) -> Rule:
    return Rule(
        "ads-txt.missing-or-empty", _home() & ~F.coalesce("ads_txt_present", F.lit(False)), "Ad experience", "high", 98,
        F.struct(C("ads_txt_status").alias("http_status"), F.lit(0).alias("authorized_lines")),
        vocab.RULE_TITLES["ads-txt.missing-or-empty"], "ads.txt authorisation", "Publish a valid ads.txt at the root domain.",
        "The site has no ads.txt with an authorised seller.",
    )


def rule_ads_txt_google(p: Params = DEFAULT) -> Rule:
    return Rule(
        "ads-txt.google-entry-review",
        _home() & F.coalesce("ads_txt_present", F.lit(False)) & ~F.coalesce("ads_txt_has_google", F.lit(False)),
        "Ad experience", "review", 86,
        F.struct(C("ads_txt_lines").alias("authorized_lines"), F.lit(False).alias("google_entry")),
        vocab.RULE_TITLES["ads-txt.google-entry-review"], "ads.txt authorisation", "Compare ads.txt with the account.",
        F.concat(F.lit("None of the "), C("ads_txt_lines"), F.lit(" lines of ads.txt names the expected seller.")),
    )


def rule_privacy_link(p: Params = DEFAULT) -> Rule:
    return Rule(
        "privacy.missing-disclosure-link", _home() & ~C("has_privacy_link"), "Privacy & consent", "high", 94,
        F.struct(F.lit(False).alias("privacy_link_found")), vocab.RULE_TITLES["privacy.missing-disclosure-link"],
        "publisher policies: privacy disclosures", "Publish and link a privacy policy.",
        "The home page links to no privacy policy.",
    )


def rule_privacy_consent(p: Params = DEFAULT) -> Rule:
    return Rule(
        "privacy.consent-signal-missing", _home() & (C("ad_count") > 0) & ~C("has_consent_signal"), "Privacy & consent",
        "review", 72, F.struct("ad_count", F.lit(False).alias("cmp_signal_found")),
        vocab.RULE_TITLES["privacy.consent-signal-missing"], "consent requirements", "Verify the consent banner in a browser.",
        F.concat(F.lit("The home page shows "), C("ad_count"), F.lit(" ads and no sign of a consent banner.")),
    )


def _names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def rule_publisher_missing(p: Params = DEFAULT) -> Rule:
    present = F.filter("linked_types", lambda t: t != "home")
    missing = F.array_except(_names(vocab.LINKED_TYPES), present)
    return Rule(
        "publisher.required-pages-missing", (C("essential_page_type") == "home") & (F.size(missing) > 0),
        "Publisher requirements", "high", 96,
        F.struct(_names(vocab.LINKED_TYPES).alias("required_types"), present.alias("present_types"), missing.alias("missing_types")),
        "Required publisher pages are not linked", "publisher policies: transparency", "Create and link the missing pages.",
        F.concat(F.lit("Not linked from the home page: "), F.array_join(missing, ", "), F.lit(".")),
    )


def required_page_checks(kind: str) -> dict[str, Column]:
    """Named checks a required page of this kind must pass; terms are matched in the hyphen-normalised text."""
    checks = {
        name: reduce(or_, [C("body_slug").contains(t.replace(" ", "-")) for t in terms])
        for name, terms in vocab.PAGE_TERMS.get(kind, {}).items()
    }
    if kind == "contact":
        # one character before the sign is enough, and a text without the sign need not be searched
        checks["direct_contact"] = C("has_contact_markup") | (C("text").contains("@") & C("text").rlike(
            r"(?i)[\p{L}\p{N}_.+-]@[\p{L}\p{N}_.-]+\.[a-z]{2,}"
        ))
    checks["length"] = C("word_count") >= vocab.PAGE_MIN_WORDS[kind]
    return checks


def failed_checks() -> Column:
    """Names of the checks that a required page of its kind does not meet; null for other pages."""
    kind = C("essential_page_type")
    out = F.when(F.lit(False), F.array().cast("array<string>"))
    for k in vocab.LINKED_TYPES:
        out = out.when(kind == k, F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in required_page_checks(k).items()])))
    return out


def rule_publisher_incomplete(kind: str, p: Params = DEFAULT) -> Rule:
    failed = C("failed_checks")
    private = kind == "privacy"
    return Rule(
        f"publisher.required-page-incomplete.{kind}", (C("essential_page_type") == kind) & (F.size(failed) > 0),
        "Privacy & consent" if private else "Publisher requirements", "high" if private else "review", 90,
        F.struct("essential_page_type", failed.alias("failed_checks"), "word_count"),
        f"Required page is incomplete: {kind}", "publisher policies: " + ("privacy disclosures" if private else "transparency"),
        "Complete the page and link it site-wide.",
        F.concat(F.lit("The page does not meet: "), F.array_join(failed, ", "), F.lit(".")),
    )


def rule_no_https(p: Params = DEFAULT) -> Rule:
    return Rule(
        "technical.no-https", ux.scheme(C("url")) != "https", "Technical trust", "high", 100,
        F.struct(ux.scheme(C("url")).alias("scheme")), vocab.RULE_TITLES["technical.no-https"],
        remediation="Serve the whole site over HTTPS.", summary="The page was delivered without encryption.",
    )


def rule_identity_links(p: Params = DEFAULT) -> Rule:
    return Rule(
        "trust.publisher-identity-links", _home() & (~C("has_about_link") | ~C("has_contact_link")), "Content quality",
        "review", 84, F.struct(C("has_about_link").alias("about_link"), C("has_contact_link").alias("contact_link")),
        vocab.RULE_TITLES["trust.publisher-identity-links"], remediation="Link About and Contact pages from the home page.",
        summary="The home page does not link to both an About and a Contact page.",
    )


RULES: list[Callable[[Params], Rule]] = [
    # evaluation order of the rule groups: content, copyright, ads, ads.txt, privacy, required pages, technical
    rule_content_thin, rule_content_structure, rule_document_structure, rule_copyright_media,
    rule_ads_no_content, rule_ads_thin, rule_ads_density, rule_ads_txt_missing, rule_ads_txt_google,
    rule_privacy_link, rule_privacy_consent, rule_publisher_missing,
    *[lambda p, k=k: rule_publisher_incomplete(k, p) for k in vocab.LINKED_TYPES],
    rule_no_https, rule_identity_links,
]


def rule_registry(p: Params = DEFAULT, extra: list[Rule] | None = None) -> list[Rule]:
    """Active rules in order; user rules follow the built-in ones."""
    rules = [make(p) for make in RULES] + list(extra or [])
    for r in rules:
        if not isinstance(r, Rule):
            raise TypeError(f"not a Rule: {r!r}")
    return rules


def apply_rules(pages: DataFrame, rules: list[Rule], scan_type: Column | str = "full") -> DataFrame:
    """Findings of every page: one array expression, scope-filtered and exploded; page text is not carried on."""
    kind = scan_type if isinstance(scan_type, Column) else F.lit(scan_type)
    hits = F.array_compact(F.array(*[r.column(C("url")) for r in rules]))
    kept = F.filter(hits, lambda f: fd.in_scope(kind, f["rule_key"], f["category"], f["severity"]))
    keys = [c for c in ("website_id", "scan_id", "grp", "page_id", "position") if c in pages.columns]
    if "text" in pages.columns and "body_slug" not in pages.columns:
        # only required pages need the hyphen-normalised text, and all their checks share it
        pages = tx.computed(pages, {"body_slug": F.when(C("essential_page_type").isin(*vocab.LINKED_TYPES), tx.slug(C("text")))})
    if {"text", "body_slug", "word_count", "has_contact_markup"} <= set(pages.columns) and "failed_checks" not in pages.columns:
        # texts are searched once, not for each field of a finding
        pages = tx.computed(pages, {"failed_checks": failed_checks()})
    return pages.select(*keys, "url", F.posexplode(kept).alias("rule_position", "f")).select(*keys, "url", "rule_position", "f.*")


def rules_local(pages: DataFrame, scan_type: Column | str = "full", p: Params = DEFAULT, extra: list[Rule] | None = None) -> DataFrame:
    return apply_rules(pages, rule_registry(p, extra), scan_type)


FINDING_TYPE = (
    "array<struct<rule_key:string,category:string,severity:string,confidence:int,title:string,summary:string,"
    "policy_reference:string,signals:string,remediation:array<string>>>"
)


def apply_arrow_rules(pages: DataFrame, columns: list[str], detect) -> DataFrame:
    """Escape hatch: ``detect(frame) -> list of finding lists`` runs on Arrow batches of the named columns only."""
    import pandas as pd

    def run(batch: pd.DataFrame) -> pd.Series:
        return pd.Series(detect(batch))

    run.__annotations__ = {"batch": pd.DataFrame, "return": pd.Series}
    run = F.pandas_udf(run, FINDING_TYPE)

    rows = pages.withColumn("f", F.explode(run(F.struct(*columns)))).select(
        *[c for c in ("website_id", "page_id") if c in pages.columns], "url", "f.*"
    )
    rows = rows.withColumn("fingerprint", fd.fingerprint(C("rule_key"), C("url")))
    return fd.validate(rows).filter(C("reject_reason").isNull()).drop("reject_reason")


def register_udtf(spark) -> None:
    """SQL table function ``explode_findings(json)``: rows of a JSON array of findings."""
    allowed = tuple(vocab.SEVERITIES)

    class ExplodeFindings:
        def eval(self, payload: str):
            import json

            for f in json.loads(payload or "[]"):
                if f.get("severity") in allowed:
                    yield f.get("rule_key"), f.get("category"), f["severity"], max(0, min(100, int(f.get("confidence", 0))))

    handler = F.udtf(ExplodeFindings, returnType="rule_key string, category string, severity string, confidence int")
    spark.udtf.register("explode_findings", handler)
