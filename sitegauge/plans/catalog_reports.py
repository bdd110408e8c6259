"""Registered queries: scores, aggregates, report queries, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions import finding as fd, vocab
from sitegauge.operators import reports as rp, scoring as sc, sources as so
from sitegauge.operators.numbering import top_per_group
from sitegauge.plans import catalog_lifecycle as cl, oracle as o, views as v
from sitegauge.streaming.live import scratch

C = F.col
ENTRIES: dict = {}
OPEN = "status <> 'resolved'"
LABEL = "MAP {" + ", ".join(f"{o.q(k)}: {o.q(x)}" for k, x in vocab.LABELS.items()) + "}"
NOW = "timestamp '2001-06-15 00:00:00'"
W = "case severity when 'critical' then 32 when 'high' then 18 when 'review' then 8 when 'info' then 2 else 0 end"


def add(name, fn, sql=None):
    ENTRIES[name] = (fn, sql)


def label(x):
    return f"coalesce({LABEL}[{x}], {x})"


# ---------------------------------------------------------------- scores
def big_scores(s, d):
    f = v.findings(s, d)
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "confidence")
    return sc.site_score(sc.open_findings(f).withColumn("order_key", key), f.select("website_id").distinct())


_S = (f"select website_id, greatest(0, least(100, floor(100 - least(950000, sum(w * greatest(35, confidence) * case r when 1 then 100 when 2 then 21 else 15 end)) / 10000.0 + 0.5)))::int as score, count(*) as open_findings "
      f"from (select *, row_number() over (partition by website_id, category order by w desc, l_linenumber, l_partkey, l_suppkey, confidence) as r from (select *, {W} as w from fb where {OPEN})) group by 1")
_SC = f"with {o.FINDINGS}, s1 as ({_S}), ss as (select w.website_id, coalesce(score, 100) as score, coalesce(open_findings, 0) as open_findings from (select distinct website_id from fb) w left join s1 using (website_id))"
add("site_score", big_scores, f"{_SC} select * from ss")
add("site_status", lambda s, d: big_scores(s, d).groupBy(sc.status_from_score(C("score")).alias("status")).agg(F.count("*").alias("sites")),
    f"{_SC} select case when score < 70 then 'critical' when score < 80 then 'high' when score < 90 then 'review' else 'healthy' end as status, count(*) as sites from ss group by 1")
add("open_findings", lambda s, d: sc.open_findings(v.findings(s, d)).groupBy("status", "severity").agg(F.count("*").alias("n")), f"with {o.FINDINGS} select status, severity, count(*) as n from fb where {OPEN} group by all")

# ---------------------------------------------------------------- aggregates
SP, SF, WS, SC, ST = f"with {o.SITE_PAGES}", f"with {o.SITE_FINDINGS}", f"with {o.SITES}", f"with {o.SCANS}", f"with {o.SCAN_TARGETS}"
add("site_page_profile", lambda s, d: rp.site_page_profile(v.sites(s, d), v.site_pages(s, d)),
    f"{SP}, {o.SITES} select ws.website_id, count(page_id) as pages, coalesce(sum(word_count), 0)::bigint as total_words, coalesce(round(avg(word_count), 1), 0) as average_words, coalesce(min(word_count), 0) as minimum_words, coalesce(max(word_count), 0) as maximum_words, coalesce(sum(ad_count), 0)::bigint as total_ads, coalesce(round(avg(ad_count), 1), 0) as average_ads, "
    "count(*) filter (where word_count < 300) as thin_pages, count(*) filter (where ad_count > 0) as pages_with_ads, count(*) filter (where status_code >= 400) as error_pages from ws left join sp on sp.website_id = ws.website_id and scanned group by 1")
add("site_distributions", lambda s, d: rp.site_distributions(v.site_pages(s, d)).withColumn("value", F.coalesce("value", F.lit("-"))),
    f"{SP} select website_id, 'status_code' as dimension, status_code::varchar as value, count(*) as n from sp where scanned group by all union all select website_id, 'language', coalesce(language, '-'), count(*) from sp where scanned group by all "
    "union all select website_id, 'essential_page_type', essential_page_type, count(*) from sp where scanned and essential_page_type is not null group by all")
add("site_titles_sample", lambda s, d: rp.site_titles_sample(v.sites(s, d), v.site_pages(s, d)).select("website_id", F.array_join("titles", "|").alias("titles")),
    f"{SP}, {o.SITES}, r as (select *, row_number() over (partition by website_id order by page_id) as n from sp where scanned) select ws.website_id, coalesce(string_agg(left(title, 180), '|' order by page_id), '') as titles from ws left join r on r.website_id = ws.website_id and n <= 60 group by 1")
add("finding_groups", lambda s, d: rp.finding_groups(v.site_findings(s, d)),
    f"{SF} select website_id, category, severity, rule_key, title, count(*) as findings_count, count(distinct coalesce(page_id, 0)) as affected_urls, round(avg(confidence))::int as average_confidence, {o.severity_rank()} as severity_rank from sf where {OPEN} group by all")
add("missing_types", lambda s, d: rp.missing_types(v.sites(s, d), v.site_pages(s, d)).select("website_id", F.array_join("missing", ",").alias("missing")),
    f"{SP}, {o.SITES} select ws.website_id, array_to_string(list_filter([{', '.join(o.q(t) for t in vocab.LINKED_TYPES)}], lambda t: not list_contains(coalesce(list(distinct essential_page_type) filter (where essential_page_type is not null), []), t)), ',') as missing from ws left join sp on sp.website_id = ws.website_id and scanned group by 1")
_CNT = lambda c: f"count(*) filter (where category = {o.q(c)})"
_SQL_VALUES = {
    "privacy_page_found": "list_contains(ft, 'privacy')::int", "about_page_found": "list_contains(ft, 'about')::int", "contact_page_found": "list_contains(ft, 'contact')::int", "editorial_policy_found": "list_contains(ft, 'editorial')::int",
    "privacy_or_consent_findings": "c4", "deceptive_practice_findings": "c6", "publisher_requirement_findings": "c8", "content_quality_findings": "c3", "duplicate_content_findings": "c1", "copyright_findings": "c0",
    "prohibited_content_findings": "c5", "ad_experience_findings": "c2", "technical_trust_findings": "c7", "missing_privacy_link_findings": "ml", "missing_consent_signal_findings": "mc", "thin_content_pages": "thin",
    "average_words_per_page": "aw", "ai_analyzed_pages": "ai", "pages_with_ads": "ads", "average_ads_per_page": "aa", "browser_ad_audit_findings": "bf", "http_error_pages": "err", "scan_partial": "(ss = 'partial')::int",
    "found_page_types": "len(ft)", "missing_page_types": "7 - coalesce(len(ft), 0)",
}
add("policy_matrix", lambda s, d: rp.policy_matrix(v.sites(s, d), v.site_findings(s, d), v.site_pages(s, d), v.scans(s, d)).withColumn("page_types", F.coalesce(F.array_join(F.array_sort("page_types"), ","), F.lit("-"))),
    f"with {o.SITE_FINDINGS}, {o.SITES}, {o.SITE_PAGES}, {o.SCANS}, c as (select website_id, {', '.join(f'{_CNT(c)} as c{i}' for i, c in enumerate(vocab.CATEGORIES))}, count(*) filter (where rule_key = 'privacy.missing-disclosure-link') as ml, "
    f"count(*) filter (where rule_key = 'privacy.consent-signal-missing') as mc, count(*) filter (where prefix(rule_key, 'ads.browser-')) as bf from sf where {OPEN} group by 1), "
    "p as (select website_id, round(avg(word_count), 1) as aw, round(avg(ad_count), 1) as aa, count(*) filter (where word_count < 300) as thin, count(*) filter (where ad_count > 0) as ads, count(*) filter (where status_code >= 400) as err, "
    "coalesce(list_sort(list(distinct essential_page_type) filter (where essential_page_type <> 'home')), []) as ft from sp where scanned group by 1), "
    "l as (select website_id, arg_max(status, (finished_at, scan_id)) as ss, arg_max(ai_pages_analyzed, (finished_at, scan_id)) as ai from sc where status in ('completed', 'partial') group by 1), "
    f"x as (select * from ws left join c using (website_id) left join p using (website_id) left join l using (website_id)), all_ as (select [{', '.join(o.q(t) for t in vocab.LINKED_TYPES)}] as every) " + " union all ".join(
        f"select website_id, {o.q(area)} as area, {o.q(level)} as requirement_level, {o.q(expects)} as google_expectation, {o.q(url)} as policy_url, {o.q(name)} as evidence, coalesce({_SQL_VALUES[name]}, 0)::double as value, "
        + {"found_page_types": "coalesce(array_to_string(ft, ','), '')", "missing_page_types": "array_to_string(list_sort(list_filter(every, lambda t: not coalesce(list_contains(ft, t), false))), ',')"}.get(name, "'-'") + " as page_types from x, all_"
        for area, level, expects, url, names in vocab.POLICY_AREAS for name in names))
_LAST = "la as (select website_id, arg_max(pages_scanned, (finished_at, scan_id)) as ls from sc where status in ('completed', 'partial') group by 1)"
_GRP = " ".join(f"when {o.inside('category', cs)} then {o.q(n)}" for n, cs in vocab.POLICY_GROUPS.items())
add("site_policy_groups", lambda s, d: rp.site_policy_groups(v.sites(s, d), v.site_findings(s, d), v.scans(s, d)),
    f"with {o.SITE_FINDINGS}, {o.SITES}, {o.SCANS}, {_LAST}, g as (select website_id, case {_GRP} end as policy, count(distinct coalesce(page_id, 0)) as n, min({o.severity_rank()}) as r from sf where {OPEN} group by all), "
    f"t as (select website_id, coalesce(nullif(ls, 0), nullif(last_scanned_pages, 0), pages_count, 0) as total_urls, unnest([{', '.join(o.q(n) for n in vocab.POLICY_GROUPS)}]) as policy from ws left join la using (website_id)) "
    "select website_id, policy, coalesce(n, 0) as violating_urls, total_urls, coalesce((['critical', 'high', 'review', 'info'])[r], 'healthy') as status from t left join g using (website_id, policy)")
add("site_row", lambda s, d: rp.site_row(v.sites(s, d), v.site_findings(s, d), v.scans(s, d)).withColumns({"active_scan_id": F.coalesce("active_scan_id", F.lit(-1)), "active_progress": F.coalesce("active_progress", F.lit(-1))}),
    f"with {o.SITE_FINDINGS}, {o.SITES}, {o.SCANS}, g as (select website_id, {', '.join(f'count(distinct coalesce(page_id, 0)) filter (where severity = {o.q(x)}) as {x}' for x in vocab.SEVERITIES)} from sf where {OPEN} group by 1), "
    "a as (select website_id, arg_max(scan_id, (created_at, scan_id)) as sid, arg_max(progress, (created_at, scan_id)) as pr from sc where status in ('queued', 'running') group by 1), "
    "x as (select ws.*, g.critical, g.high, g.review, g.info, sid, pr, case when last_discovered_pages = 0 and last_scanned_at is not null then pages_count else last_discovered_pages end as discovered, "
    "case when last_discovered_pages = 0 and last_scanned_at is not null then pages_count else last_scanned_pages end as scanned_pages from ws left join g using (website_id) left join a using (website_id)) "
    "select website_id, domain, status, overall_score, coalesce(critical, 0) as critical, coalesce(high, 0) as high, coalesce(review, 0) as review, coalesce(info, 0) as info, discovered, scanned_pages, "
    "case when discovered > 0 then least(100, round(scanned_pages / discovered * 100)) else 0 end::int as coverage, last_scan_partial or (discovered > 0 and scanned_pages < discovered) as coverage_partial, coalesce(sid, -1) as active_scan_id, coalesce(pr, -1) as active_progress from x")
add("site_top_risk", lambda s, d: rp.site_top_risk(v.sites(s, d), v.site_findings(s, d)),
    f"with {o.SITE_FINDINGS}, {o.SITES}, t as (select website_id, arg_min(title, ({o.severity_rank()}, fingerprint)) as title from sf where {OPEN} group by 1) select website_id, coalesce(title, 'No blocking issue') as top_risk from ws left join t using (website_id)")
add("portfolio_metrics", lambda s, d: rp.portfolio_metrics(v.sites(s, d), v.site_findings(s, d)),
    f"with {o.SITE_FINDINGS}, {o.SITES} select (select count(*) from ws) as total, (select count(last_scanned_at) from ws) as monitored, (select round(avg(overall_score))::int from ws) as average_score, count(*) filter (where severity = 'critical') as open_critical, count(*) filter (where severity = 'high') as open_high from sf where {OPEN}")
add("portfolio_health", lambda s, d: rp.portfolio_health(v.sites(s, d)),
    f"{WS}, h as (select count(*) as total, count(*) filter (where status = 'healthy') as healthy, count(*) filter (where status in ('review', 'high', 'pending', 'scanning')) as review, count(*) filter (where status = 'critical') as critical from ws) "
    "select *, round(healthy / total * 100, 2) as healthy_percent, round((healthy + review) / total * 100, 2) as review_percent from h")
add("portfolio_trend", lambda s, d: rp.portfolio_trend(v.scans(s, d)).select(F.array_join("scores", ",").alias("scores")),
    f"{SC} select string_agg(score::varchar, ',' order by finished_at, scan_id) as scores from (select * from sc where status = 'completed' order by finished_at desc, scan_id desc limit 16)")
add("finding_cards", lambda s, d: rp.finding_cards(v.findings(s, d), F.expr(NOW)),
    f"with {o.FINDINGS} select count(*) filter (where {OPEN} and severity = 'critical') as critical, count(*) filter (where {OPEN} and severity = 'high') as high, count(*) filter (where status = 'remediating') as remediating, count(*) filter (where status = 'resolved' and resolved_at >= timestamp '2001-06-01') as resolved_month from fb")
add("admin_metrics", lambda s, d: rp.admin_metrics(v.table(s, d, "nation"), v.sites(s, d), v.scans(s, d), v.findings(s, d)),
    f"with {o.FINDINGS}, {o.SCANS} select (select count(*) from nation) as users, (select count(*) from customer) as sites, (select count(*) from sc where status in ('queued', 'running')) as running_scans, (select count(distinct website_id) from sc where ai_assessed) as sites_assessed, count(*) as open_findings, count(*) filter (where severity = 'critical') as critical_findings from fb where {OPEN}")
add("queue_utilization", lambda s, d: rp.queue_utilization(v.targets(s, d)), f"with {o.TARGETS} select count(*) filter (where status = 'running') as running, count(*) filter (where status = 'queued') as queued, least(100, round(count(*) filter (where status = 'running') * 100 / 60))::int as utilization from tg")
add("coverage_percent", lambda s, d: v.scans(s, d).select("scan_id", rp.coverage_percent(C("pages_scanned"), C("pages_discovered")).alias("coverage"), F.least(F.lit(100.0), rp.coverage_percent(C("ai_pages_analyzed"), C("pages_scanned"))).alias("review_coverage")),
    f"{SC} select scan_id, round(pages_scanned / pages_discovered * 100, 2) as coverage, case when pages_scanned > 0 then least(100, round(ai_pages_analyzed / pages_scanned * 100, 2)) else 0 end as review_coverage from sc")


def traffic(s, d):
    k = C("page_id")
    pages = v.site_pages(s, d).select("page_id", F.concat(F.lit("https://e.example/"), (k % 130).cast("string"), F.lit("?x=1")).alias("url"))
    return rp.traffic_join(pages, so.page_views(v.page_views(s, d), F.expr(v.NOW_EVENTS)))


_TR = f"with {o.VIEWS}, pv as (select path, count(*) as views from vw where ts >= timestamp '2024-01-18' and ts < timestamp '2024-01-25' group by 1), tj as (select p_partkey as page_id, coalesce(views, 0) as ga4_views_7d from part left join pv on path = '/' || (p_partkey % 130))"
add("traffic_join", lambda s, d: traffic(s, d).select("page_id", "ga4_views_7d"), f"{_TR} select * from tj")
add("q_highest_value_pages", lambda s, d: rp.highest_value_pages(traffic(s, d)).select("page_id", "ga4_views_7d"), f"{_TR} select * from tj where ga4_views_7d > 0 order by ga4_views_7d desc, page_id limit 20")

# ---------------------------------------------------------------- query surface
add("q_filter_findings", lambda s, d: rp.filter_findings(v.site_findings(s, d), v.scans(s, d), severity="high", category="Copyright", active_scan=True).select("fingerprint", "status"),
    f"{SF}, {o.SCANS} select fingerprint, status from sf where severity = 'high' and category = 'Copyright' and scan_id in (select scan_id from sc where status in ('queued', 'running'))")
add("q_search_findings", lambda s, d: rp.search_findings(v.site_findings(s, d), v.sites(s, d), v.site_pages(s, d), "BOLT/1").select("fingerprint"),
    f"{SF}, {o.SITE_PAGES}, {o.SITES} select fingerprint from sf left join sp using (page_id) left join ws on ws.website_id = sf.website_id where contains(lower(sf.title), 'bolt/1') or contains(lower(summary), 'bolt/1') or contains(lower(public_id), 'bolt/1') or contains(domain, 'bolt/1') or contains(sp.url, 'bolt/1')")
add("q_search_sites", lambda s, d: rp.search_sites(v.sites(s, d), "R#00000001", "critical").select("website_id"), f"{WS} select website_id from ws where (contains(lower(name), 'r#00000001') or contains(domain, 'r#00000001')) and status = 'critical'")
add("q_tenant_scope", lambda s, d: rp.tenant_scope(v.site_findings(s, d), v.sites(s, d), 7).select("fingerprint", "website_id"), f"{SF} select fingerprint, website_id from sf where website_id in (select c_custkey from customer where c_nationkey = 7)")
add("q_semi_join", lambda s, d: v.scans(s, d).join(v.sites(s, d).filter("status = 'healthy'"), "website_id", "left_semi").select("scan_id"), f"{WS}, {o.SCANS} select scan_id from sc where website_id in (select website_id from ws where status = 'healthy')")
add("q_anti_join", lambda s, d: v.sites(s, d).join(v.scans(s, d).filter("status = 'queued'"), "website_id", "left_anti").select("website_id"), f"{WS}, {o.SCANS} select website_id from ws where website_id not in (select website_id from sc where status = 'queued')")
add("q_lookup_join", lambda s, d: rp.with_page(rp.with_site(v.site_findings(s, d), v.sites(s, d), "domain"), v.site_pages(s, d), "url").select("fingerprint", "domain", F.coalesce("url", F.lit("")).alias("url")),
    f"{SF}, {o.SITE_PAGES}, {o.SITES} select fingerprint, domain, coalesce(url, '') as url from sf left join ws using (website_id) left join sp on sp.page_id = sf.page_id")
add("q_parent_counts", lambda s, d: rp.parent_counts(v.sites(s, d).select("website_id"), v.scans(s, d), "website_id", queued=C("status") == "queued", running=C("status") == "running", all=F.lit(True)),
    f"{WS}, {o.SCANS} select ws.website_id, count(scan_id) filter (where sc.status = 'queued') as queued, count(scan_id) filter (where sc.status = 'running') as running, count(scan_id) as \"all\" from ws left join sc using (website_id) group by 1")
add("q_severity_order", lambda s, d: rp.severity_order(sc.open_findings(v.site_findings(s, d)), F.desc("confidence"), F.asc("fingerprint")).limit(25).select("fingerprint", "severity", "confidence"),
    f"{SF} select fingerprint, severity, confidence from sf where {OPEN} order by {o.severity_rank()}, confidence desc, fingerprint limit 25")
add("q_paginate", lambda s, d: rp.paginate(v.site_findings(s, d), [F.desc("last_seen_at"), F.asc("fingerprint")], 3, 30)[0].select("fingerprint"), f"{SF} select fingerprint from sf order by last_seen_at desc, fingerprint limit 30 offset 60")


def deep_page(s, d):
    order = ("-last_seen_at", "fingerprint")
    index = rp.Ordered(scratch(s, "ordered"), order).build(v.site_findings(s, d).select("fingerprint", "last_seen_at", "title"), 32)
    return index.page(s, 150, 30).select("fingerprint", "title")


add("q_paginate_deep", deep_page, f"{SF} select fingerprint, title from sf order by last_seen_at desc, fingerprint limit 30 offset 4470")
add("q_paginate_meta", lambda s, d: rp.paginate(v.site_findings(s, d), [F.asc("fingerprint")], 3, 30)[1], f"{SF} select 3 as current_page, greatest(1, ceil(count(*) / 30))::int as last_page, count(*) as total, 61 as first, least(90, count(*)) as last from sf")
add("q_top_k", lambda s, d: v.sites(s, d).orderBy("overall_score", "website_id").limit(8).select("website_id", "overall_score"), f"{WS} select website_id, overall_score from ws order by overall_score, website_id limit 8")
add("q_latest_per_group", lambda s, d: rp.latest_per_site(v.scans(s, d).filter(C("status").isin("completed", "partial")), "finished_at", "score"),
    f"{SC} select website_id, arg_max(scan_id, (finished_at, scan_id)) as scan_id, arg_max(score, (finished_at, scan_id)) as score from sc where status in ('completed', 'partial') group by 1")
add("q_distinct_count", lambda s, d: rp.affected_pages(v.site_findings(s, d), ["category"]), f"{SF} select category, count(distinct coalesce(page_id, 0)) as affected_urls from sf group by 1")
add("q_exists", lambda s, d: v.scan_targets(s, d).groupBy("scan_id").agg(F.max(C("status").isin("queued", "running")).alias("unfinished")), f"{ST} select scan_id, bool_or(status in ('queued', 'running')) as unfinished from st group by 1")


def numbered_targets(s, d):
    return v.scan_targets(s, d).withColumn("position", F.xxhash64("scan_id", "page_id", "batch_number", "input_tokens"))


add("q_scan_detail", lambda s, d: rp.scan_detail(numbered_targets(s, d), v.site_pages(s, d), v.events(s, d).select(C("user_id").alias("page_id"))).groupBy("scan_id").agg(F.count("*").alias("n"), F.sum("word_count").alias("words"), F.sum("events_count").alias("events")),
    f"{ST}, {o.SITE_PAGES}, e as (select user_id as page_id, count(*) as n from events group by 1) select scan_id, count(*) as n, sum(word_count)::bigint as words, sum(coalesce(e.n, 0))::bigint as events from st left join sp using (page_id) left join e on e.page_id = st.page_id group by 1")
add("q_target_timeline", lambda s, d: rp.target_timeline(v.stage_events(s, d), 8).select("event_id", "stage", "status"), "select event_id, event_type as stage, case when event_id % 2 = 0 then 'running' when event_id % 7 = 0 then 'failed' else 'success' end as status from events where user_id = 8")
add("q_live_scans", lambda s, d: rp.live_scans(v.scans(s, d), v.sites(s, d), v.site_findings(s, d), v.scan_targets(s, d)),
    f"with {o.SITE_FINDINGS}, {o.SCANS}, {o.SITES}, {o.SCAN_TARGETS}, t as (select * from sc order by created_at desc, scan_id desc limit 10), f as (select scan_id, count(*) as findings_total from sf group by 1), "
    "g as (select scan_id, count(*) filter (where status = 'queued') as targets_queued, count(*) filter (where status = 'running') as targets_running, count(*) filter (where status = 'failed') as targets_failed from st group by 1) "
    "select t.scan_id, domain, type, t.status, progress, pages_scanned, pages_discovered, coalesce(findings_total, 0) as findings_total, coalesce(targets_queued, 0) as targets_queued, coalesce(targets_running, 0) as targets_running, coalesce(targets_failed, 0) as targets_failed, "
    "ai_errors, is_sampled, 'all_urls' as sampling_mode, pages_discovered as available_urls from t left join f using (scan_id) left join g using (scan_id) left join ws on ws.website_id = t.website_id")
add("q_live_findings", lambda s, d: rp.live_findings(v.site_findings(s, d), v.sites(s, d), v.site_pages(s, d)),
    f"{SF}, {o.SITE_PAGES}, {o.SITES}, t as (select * from sf order by last_seen_at desc, fingerprint limit 100) select fingerprint, public_id, scan_id, domain, coalesce(url, start_url) as url, t.title, {label('category')} as category, severity, confidence, t.status, "
    "case when prefix(rule_key, 'ai.') then 'AI' else 'Rule' end as source from t left join ws using (website_id) left join sp on sp.page_id = t.page_id")
add("q_backfill_essential_type", lambda s, d: rp.backfill_essential_type(v.site_pages(s, d).withColumn("essential_page_type", F.lit(None).cast("string"))).select("page_id", F.coalesce("essential_page_type", F.lit("")).alias("kind")),
    f"{SP} select page_id, coalesce(essential_page_type, '') as kind from sp")


def deleted(s, d):
    out = rp.site_delete(v.sites(s, d), cl.recent_scans(s, d), v.sites(s, d).filter("website_id % 3 = 0"), {"findings": v.site_findings(s, d), "pages": v.site_pages(s, d)})
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in out.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


add("q_site_delete", deleted,
    f"{SF}, {o.SITE_PAGES}, {o.SITES}, {o.SCANS}, g as (select website_id from ws where website_id % 3 = 0 and website_id not in (select website_id from sc where created_at >= date '1998-05-01' and status in ('queued', 'running'))) "
    "select 'sites' as name, count(*) as n from ws where website_id not in (from g) union all select 'scans', count(*) from sc where website_id not in (from g) union all select 'findings', count(*) from sf where website_id not in (from g) union all select 'pages', count(*) from sp where website_id not in (from g)")

# ---------------------------------------------------------------- exports
_ISO = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S+00:00')"
add("export_findings_csv", lambda s, d: rp.export_findings(v.site_findings(s, d), v.sites(s, d), v.site_pages(s, d)).withColumn("url", F.coalesce("url", F.lit(""))),
    f"{SF}, {o.SITE_PAGES}, {o.SITES} select public_id as id, domain as website, coalesce(url, '') as url, {label('category')} as category, {label('severity')} as severity, confidence, {label('sf.status')} as status, sf.title, {_ISO('last_seen_at')} as last_seen from sf left join ws using (website_id) left join sp on sp.page_id = sf.page_id")
add("export_findings_wide", lambda s, d: rp.export_findings_wide(v.site_findings(s, d), v.sites(s, d), v.site_pages(s, d)),
    f"{SF}, {o.SITE_PAGES}, {o.SITES} select public_id as id, scan_id::varchar as scan_id, domain as website, coalesce(url, start_url) as url, case when prefix(rule_key, 'ai.') then 'AI' else 'Rule' end as source, rule_key as rule, {label('category')} as category, {label('severity')} as severity, confidence::varchar as confidence, "
    f"{label('sf.status')} as status, sf.title, summary, policy_reference as policy, {_ISO('first_seen_at')} as first_seen, {_ISO('last_seen_at')} as last_seen, 'check' || chr(10) || 'fix ' || rule_key as remediation from sf left join ws using (website_id) left join sp on sp.page_id = sf.page_id")
add("export_sites_csv", lambda s, d: rp.export_sites(v.sites(s, d)).withColumn("last_scanned", F.coalesce("last_scanned", F.lit(""))),
    f"{WS} select name, domain, {label('status')} as status, overall_score as score, pages_count as pages, last_discovered_pages as discovered, last_scanned_pages as scanned, case when last_scan_partial then 'có' else 'không' end as partial, open_findings_count as open_findings, coalesce({_ISO('last_scanned_at')}, '') as last_scanned from ws")
add("export_site_findings_json", lambda s, d: rp.export_site_findings(v.site_findings(s, d), v.sites(s, d), v.site_pages(s, d)).select("fingerprint", F.get_json_object("row", "$.path").alias("path"), F.get_json_object("row", "$.severity_label").alias("label"), F.get_json_object("row", "$.url").alias("url")),
    f"{SF}, {o.SITE_PAGES}, {o.SITES} select fingerprint, case when url is null then '/' else {o.path('url')} end as path, {label('severity')} as label, coalesce(url, start_url) as url from sf left join ws using (website_id) left join sp on sp.page_id = sf.page_id where sf.{OPEN}")
