"""Handcrafted cases for single operators."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from sitegauge.functions import html as hx, text as tx, url as ux, vocab
from sitegauge.operators import discovery as dc, lifecycle as lc, normalize as nz, reports as rp, rules as ru, scoring as sc, sources as so
from sitegauge.params import DEFAULT, Params

C = F.col


def one(spark, expr, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr(*[C(f"c{i}") for i in range(len(values))])).first()[0]


def test_urls(spark):
    assert one(spark, ux.normalize, "https://EXAMPLE.com/article/") == "https://example.com/article/"
    assert one(spark, ux.normalize, " HTTP://u:p@Example.com.:8080//a/./b/../c?x=1#f ") == "http://example.com:8080/a/c?x=1"
    assert one(spark, ux.resolve, "https://e.example/a/b", "../c?x=1&amp;y=2") == "https://e.example/c?x=1&y=2"
    assert one(spark, ux.resolve, "https://e.example/a/b", "mailto:x@e.example") is None
    for bad in ("file:///etc/passwd", "http://127.0.0.1/", "http://10.0.0.1/", "http://169.254.169.254/", "http://localhost/", "https://e.example:8443/", "https://u:p@e.example/"):
        assert one(spark, ux.safety, bad) is not None
    assert one(spark, ux.safety, "https://e.example/") is None
    assert one(spark, ux.essential_type, "https://e.example/gi%E1%BB%9Bi-thi%E1%BB%87u", "") == "about"


PAGE = """<html><head><title>T</title><script src="https://pagead2.googlesyndication.com/x.js"></script></head><body><h1>H</h1>
<div data-ad-slot="1"></div><img src="https://cdn.example/a.png"><a href="/privacy-policy">P</a><a href="/lien-he">L</a><a href="/gioi-thieu">G</a><p>a</p><p>b</p></body></html>"""


def test_page_signals(spark):
    r = hx.page_signals(spark.createDataFrame([("https://e.example/x", PAGE)], "url string, html string")).first()
    assert (r.ad_count, r.h1_count, r.external_images, r.paragraph_count) == (2, 1, 1, 2)
    assert r.has_privacy_link and r.has_contact_link and r.has_about_link and r.title == "T" and "ab" in r.text


def fired(spark, body, url="https://e.example/x", ads=None):
    d = hx.page_signals(spark.createDataFrame([(url, f"<html><head><title>t</title></head><body><h1>h</h1>{body}</body></html>")], "url string, html string"), ads)
    return {r.rule_key: r.severity for r in ru.rules_local(d).collect()}


def test_rules(spark):
    ad = '<ins class="adsbygoogle"></ins>'
    text = lambda n: "<p>" + " ".join(f"w{i}" for i in range(n)) + "</p><p>a</p><p>b</p>"
    assert fired(spark, ad + text(25))["ads.on-page-without-content"] == "high"
    assert "ads.on-thin-content-page" in fired(spark, ad * 2 + text(210))
    assert not [k for k in fired(spark, ad + text(800)) if k.startswith("ads.")]
    home = fired(spark, '<a href="/about">About</a><a href="/contact">C</a>', "https://e.example/")
    assert home["publisher.required-pages-missing"] == "high" and "ads-txt.missing-or-empty" in home
    assert fired(spark, "<p>We respect privacy.</p>", "https://e.example/privacy-policy")["publisher.required-page-incomplete.privacy"] == "high"
    txt = spark.createDataFrame([("https://e.example", 200, "google.com, pub-1, DIRECT")], "origin string, status int, text string")
    assert not [k for k in fired(spark, "x", "https://e.example/", txt) if k.startswith("ads-txt")]


def test_required_page_checks_are_evaluated_once_and_as_before(spark):
    page = lambda kind, body, words=500: (f"https://e.example/{kind}/{abs(hash(body))}", kind, body, words, False)
    rows = [
        page("contact", "write to a.b+c@e.example.org now"), page("contact", "x @ y.com a@b a@.c @e.example"), page("contact", "MAIL É@E.EXAMPLE"),
        page("contact", "no sign"), page("about", "Đội ngũ biên tập", 80), page("about", "--ours--"), page("privacy", "We Collect; cookie, Google & purpose: USE"),
        page("home", "x"),
    ]
    d = spark.createDataFrame(rows, "url string, essential_page_type string, text string, word_count int, has_contact_markup boolean")
    rules = [ru.rule_publisher_incomplete(k) for k in vocab.LINKED_TYPES]
    found = ru.apply_rules(d, rules)
    failed = {r.url: json.loads(r.signals)["failed_checks"] for r in found.collect()}
    got = [failed.get(r[0]) for r in rows]
    assert got == [None, ["direct_contact"], None, ["direct_contact"], None, ["identity"], None, None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("nha-xuat-ban") == 1  # texts are searched once for all fields of a finding


def test_slug_and_credit_words(spark):
    for text, want in {"  A--b ": "a-b", "Æß x\n": "aess-x", "": "", "- -": "", "Đội NGŨ": "doi-ngu"}.items():
        assert one(spark, tx.slug, text) == want
    d = spark.createDataFrame([("Photo by X",), ("resource",), ("source",), ("a©b",), ("©",), ("licensee",), ("x\nLicense",), (None,)], "t string")
    assert [r[0] for r in d.select(ru.attribution(C("t"))).collect()] == [True, False, True, True, False, False, True, None]


def score(spark, rows):
    f = spark.createDataFrame([(1, c, s, n, i) for i, (c, s, n) in enumerate(rows)], "website_id long, category string, severity string, confidence int, order_key int")
    return sc.site_score(f, spark.createDataFrame([(1,)], "website_id long")).first().score


def test_scores(spark):
    assert score(spark, []) == 100
    assert score(spark, [("a", "critical", 95)]) == 70
    assert score(spark, [("a", "high", 100), ("a", "high", 100)]) == 78
    assert score(spark, [("a", "review", 95)]) > score(spark, [("a", "critical", 95)])
    model = lambda rows: max(0, min(100, int(100 - min(95, sum({"critical": 32, "high": 18, "review": 8, "info": 2}[s] * max(.35, n / 100) * (1 if i == 0 else max(.15, .42 / (i + 1))) for i, (s, n) in enumerate(rows))) + 0.5)))
    many = [("high", 90), ("high", 80), ("review", 70), ("review", 20), ("info", 50)]
    assert score(spark, [("a", s, n) for s, n in many]) == model(many)


def test_robots(spark):
    text = "Sitemap: https://e.example/a.xml\nSitemap: https://e.example/b.xml\nUser-agent: *\nDisallow: /private/\n"
    rules = dc.robots_rules(spark.createDataFrame([("https://e.example", text)], "origin string, text string"))
    assert rules.filter("field = 'sitemap'").count() == 2
    urls = spark.createDataFrame([("https://e.example/private/x",), ("https://e.example/public/x",), ("https://e.example/public/private/",)], "url string")
    assert {r.url: r.allowed for r in dc.robots_allowed(urls, rules).collect()} == {
        "https://e.example/private/x": False, "https://e.example/public/x": True, "https://e.example/public/private/": True}


URLSET = '<?xml version="1.0"?><urlset xmlns:image="i"><url><loc>https://e.example/{0}1</loc><lastmod>2026-01-0{1}</lastmod><image:image><image:loc>https://e.example/i.png</image:loc></image:image></url><url><loc>https://e.example/{0}2</loc></url></urlset>'


def test_sitemaps_and_plans(spark):
    index = "<sitemapindex><sitemap><loc>https://e.example/post-sitemap.xml</loc></sitemap></sitemapindex>"
    maps = spark.createDataFrame([("https://e.example/sitemap.xml", 200, index), ("https://e.example/post-sitemap.xml", 200, URLSET.format("p", 5))], "url string, status int, body string")
    entries = dc.sitemap_entries(maps).orderBy("url").collect()
    assert [e.kind for e in entries] == ["urlset", "index"] and [e.loc for e in entries[0].entries] == ["https://e.example/p1", "https://e.example/p2"]
    assert entries[0].entries[0].lastmod == "2026-01-05" and entries[0].entries[1].lastmod is None
    seeds = spark.createDataFrame([("e", "https://e.example/", "https://e.example/sitemap.xml", 0, True)], "site string, start_url string, url string, seq int, required boolean")
    files, counters = dc.sitemap_expand(seeds, maps)
    assert counters.first().sitemap_files == 2 and counters.first().sitemap_errors == 0
    cand = dc.sitemap_candidates(files)
    home = spark.createDataFrame([("e", "https://e.example/")], "site string, url string")
    none = spark.createDataFrame([], "site string, url string, kind string, sequence long")
    plan = dc.plan_all_urls(home, none, cand).orderBy("phase", "sequence")
    assert [r.url for r in plan.collect()] == ["https://e.example/", "https://e.example/p1", "https://e.example/p2"]
    req = spark.createDataFrame([("e", "https://e.example/privacy", "privacy", 0)], "site string, url string, kind string, sequence long")
    newest = dc.plan_newest_n(home, req, cand, 1).orderBy("phase", "sequence").collect()
    assert [r.url for r in newest] == ["https://e.example/", "https://e.example/privacy", "https://e.example/p1"]
    adds = spark.createDataFrame([("e", f"u{i}", i, False) for i in range(3)] + [("e", "u0", 9, False), ("e", "r", 10, True)], "site string, url string, sequence long, required boolean")
    kept, cut_off = dc.plan_dedupe_cap(adds, 2)
    assert {r.url for r in kept.collect()} == {"u0", "u1", "r"} and cut_off.first().truncated
    assert not dc.plan_dedupe_cap(adds, 2, sampled=True)[1].first().truncated


def test_priority_keeps_one_url_per_path(spark):
    planned = spark.createDataFrame([("e", "https://e.example/a?x=1", 0), ("e", "https://e.example/b", 1), ("e", "https://e.example/a?x=2", 2)], "site string, url string, position long")
    views = spark.createDataFrame([("e", "/b", 5)], "site string, path string, views long")
    rows = dc.plan_priority_traffic(planned, views).orderBy("order_key").collect()
    assert [r.url for r in rows] == ["https://e.example/b", "https://e.example/a?x=2"]
    assert dc.plan_priority_traffic(planned, views, keep_variants=True).count() == 3


def test_third_party(spark):
    view = spark.createDataFrame([("u", 2, 1, 1, 0.52, 1, 0)], "url string, nearInteractiveCount int, intrusiveOverlayCount int, misleadingLabelCount int, viewportCoverage double, popupAttempts int, adRefreshCount int")
    assert nz.browser_findings(view).count() == 5
    reply = '{"findings":[{"policy_code":"deceptive_or_misleading","confidence":91},{"policy_code":"sensitive_claims","confidence":69}]}'
    rows = nz.llm_findings(spark.createDataFrame([("u", reply, "r")], "url string, reply string, response_id string")).collect()
    assert [(r.rule_key, r.severity) for r in rows] == [("ai.deceptive_or_misleading", "review")]
    t = spark.createDataFrame([("s", i) for i in range(5)], "scan_id string, position long")
    assert nz.addon_budget(t, 3)[0].count() == 3 and nz.addon_budget(t, 0)[0].count() == 5 and nz.addon_budget(t, 3)[1].count() == 1


def test_reuse_and_forced(spark):
    docs = spark.createDataFrame([(1, "h", "c")], "website_id long, url_hash string, content_hash string")
    prev = docs.withColumn("analysis", lc.analysis_marker(DEFAULT, F.lit(False), F.lit(False), F.lit(False)))
    assert lc.reuse_decision(docs, prev).first().reused
    assert lc.reuse_decision(docs, prev, Params(force_rescan=True)).first().reason == "forced"
    assert lc.reuse_decision(docs, prev, Params(scan_type="ads")).first().reused
    narrow = docs.withColumn("analysis", lc.analysis_marker(Params(scan_type="priority"), F.lit(False), F.lit(False), F.lit(False)))
    assert lc.reuse_decision(docs, narrow).first().reason == "scope"
    assert lc.reuse_decision(docs, prev, Params(use_model=True)).first().reason == "model"


def test_stale_scan_and_tenants(spark):
    t = datetime(2026, 1, 1, 12)
    scans = spark.createDataFrame([(1, 1, "queued", datetime(2026, 1, 1, 11))], "scan_id long, website_id long, status string, updated_at timestamp")
    sites = spark.createDataFrame([(1, None, 100, 7), (2, None, 100, 8)], "website_id long, last_scanned_at timestamp, overall_score int, user_id long")
    cancelled, released = lc.scan_stale(scans, sites, F.lit(t))
    assert cancelled.first().status == "cancelled" and released.first().status == "pending"
    assert [r.website_id for r in rp.tenant_scope(sites, sites, 7).collect()] == [1] and rp.tenant_scope(sites, sites, 7, True).count() == 2
    req = spark.createDataFrame([(1, 7, "d"), (2, 8, "d"), (3, 7, "d"), (4, None, "d")], "request_id long, user_id long, domain string")
    known = spark.createDataFrame([(None, "d")], "user_id long, domain string")
    assert sorted(r.request_id for r in ux.site_register(req, known).collect()) == [1, 2]


def test_response_headers(spark):
    rows = [(200, {"CONTENT-type": ["text/HTML", "x"]}), (200, {"content-type": ["image/png"]}), (404, {}), (200, {})]
    df = spark.createDataFrame(rows, "status int, headers map<string,array<string>>")
    assert so.response_counters(df).first().asDict() == {"accepted": 2, "failed_requests": 1, "non_html_responses": 1}


def test_words_of_a_token_with_a_million_parts(spark):
    from sitegauge.functions import text as tx

    df = spark.sql("select repeat('a-', 1000000) || 'b c' as t union all select 'don''t stop_now 12'")
    assert sorted(r[0] for r in df.select(tx.word_count(F.col("t"))).collect()) == [2, 3]


def test_slugs_are_unique(spark):
    from sitegauge.functions import url as ux

    sites = spark.createDataFrame([(1, "foo.example"), (2, "foo-example"), (3, "foo-example-2"), (4, "foo.example"), (5, "bar")], "id long, domain string")
    taken = spark.createDataFrame([("bar",), ("bar-2",)], "slug string")
    got = {r.id: r.slug for r in ux.site_slug(sites, taken).collect()}
    assert len(set(got.values())) == 5 and not set(got.values()) & {"bar", "bar-2"}
    assert got[1] == "foo-example" and got[5] == "bar-3"
    plain = {r.id: r.slug for r in ux.site_slug(sites.filter("id in (1, 2, 5)")).collect()}
    assert plain == {1: "foo-example", 2: "foo-example-2", 5: "bar"}
