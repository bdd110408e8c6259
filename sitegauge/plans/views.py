"""Input views derived from the star-schema, page, document and event tables, one Spark definition each.

The same definitions exist as SQL in ``oracle.py``; queries run over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sitegauge.functions import html as hx, text as tx, url as ux, vocab

C = F.col
NOW = "timestamp'2001-06-15 00:00:00'"       # reference time of the order/lineitem history
NOW_EVENTS = "timestamp'2024-01-25 00:00:00'"  # reference time of the event history


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Spreads a table stored in fewer splits than there are cores before per-row CPU work; a no-op on many splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def pages(spark, sf) -> DataFrame:
    """Raw pages with the lower-case host as site."""
    return balanced(table(spark, sf, "pages"), "page_id").withColumn("grp", F.lower(ux.host(C("url"))))


def responses(spark, sf) -> DataFrame:
    """Fetched responses: some statuses and content types are not usable."""
    return as_responses(balanced(table(spark, sf, "pages"), "page_id"))


def signals(spark, sf) -> DataFrame:
    return hx.page_signals(pages(spark, sf))


def targets(spark, sf) -> DataFrame:
    """Scan targets of one scan per host; positions are page ids (a strictly increasing plan order)."""
    k = C("page_id") % 10
    status = (
        F.when(k == 0, "failed").when(k == 1, "queued").when(k == 2, "running").when(k.isin(3, 4), "reused")
        .otherwise("completed")
    )
    return pages(spark, sf).select(
        C("grp").alias("website_id"), C("grp").alias("scan_id"), "page_id", "url", ux.url_hash(C("url")).alias("url_hash"),
        C("page_id").alias("position"), status.alias("status"),
    )


def previous_pages(spark, sf) -> DataFrame:
    """Page snapshot of an earlier scan."""
    d = signals(spark, sf).filter(C("page_id") % 7 != 0)
    return d.select(
        "page_id", C("grp").alias("website_id"), ux.url_hash(C("url")).alias("url_hash"),
        F.when(C("page_id") % 5 == 0, F.sha2(F.lit("old"), 256)).otherwise(C("content_hash")).alias("content_hash"),
        F.struct(
            F.when(C("page_id") % 13 == 0, "1.1.1").otherwise("1.4.0").alias("ruleset_version"),
            F.when(C("page_id") % 11 == 0, "ads").otherwise("full").alias("scan_type"),
            F.lit(False).alias("ai_analyzed"), F.lit(None).cast("string").alias("ai_model"),
            (C("page_id") % 3 == 0).alias("browser_audited"), F.lit(None).cast("int").alias("browser_audit_version"),
            (C("page_id") % 2 == 0).alias("external_copy_checked"),
            F.lit(None).cast("int").alias("external_copy_version"), F.lit(None).cast("timestamp").alias("analyzed_at"),
        ).alias("analysis"),
    )


def findings(spark, sf) -> DataFrame:
    """Findings from order lines: site = order, page = part."""
    return as_findings(table(spark, sf, "lineitem"))


def as_findings(L: DataFrame, *more: str) -> DataFrame:
    pick = lambda values, key: F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))
    category = pick(vocab.CATEGORIES, C("l_partkey") % 9)
    rule = pick(RULE_KEYS, C("l_suppkey") % len(RULE_KEYS))
    status = (
        F.when(C("l_returnflag") == "R", "resolved").when(C("l_returnflag") == "A", "open")
        .when(C("l_linestatus") == "O", "investigating").otherwise("remediating")
    )
    confidence = (C("l_quantity") * 2).cast("int")
    key = F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", confidence)
    return L.select(
        C("l_orderkey").alias("website_id"), C("l_orderkey").alias("scan_id"), C("l_partkey").alias("page_id"),
        rule.alias("rule_key"), category.alias("category"), pick(vocab.SEVERITIES, C("l_linenumber") % 4).alias("severity"),
        confidence.alias("confidence"), status.alias("status"), F.sha2(key, 256).alias("fingerprint"),
        F.concat(F.lit("Finding "), rule).alias("title"), F.concat(F.lit("part "), C("l_partkey").cast("string")).alias("summary"),
        F.lit("policy reference").alias("policy_reference"),
        F.date_sub("l_shipdate", 30).cast("timestamp").alias("first_seen_at"), C("l_shipdate").alias("last_seen_at"),
        F.when(C("l_returnflag") == "R", C("l_shipdate")).alias("resolved_at"),
        "l_linenumber", "l_partkey", "l_suppkey",
        F.array(F.lit("check"), F.concat(F.lit("fix "), rule)).alias("remediation"), *more,
    )


RULE_KEYS = [
    "content.thin-page", "ai.sensitive_claims", "ads.browser-intrusive-overlay", "copyright.external-content-match",
    "duplicate.internal-near-match", "privacy.missing-disclosure-link", "privacy.consent-signal-missing", "technical.no-https",
    "publisher.required-pages-missing",
]


def scans(spark, sf) -> DataFrame:
    """Scans from orders: site = customer."""
    O = table(spark, sf, "orders")
    status = F.when(C("o_orderstatus") == "F", "completed").when(C("o_orderstatus") == "O", "running").otherwise("partial")
    kind = F.element_at(F.array(*[F.lit(v) for v in vocab.SCAN_TYPES]), (C("o_orderkey") % 5 + 1).cast("int"))
    return O.select(
        C("o_orderkey").alias("scan_id"), C("o_custkey").alias("website_id"),
        F.when((status == "running") & (C("o_orderkey") % 3 == 0), "queued").otherwise(status).alias("status"),
        kind.alias("type"), (C("o_orderkey") % 101).cast("int").alias("score"),
        C("o_orderdate").alias("created_at"), C("o_orderdate").alias("finished_at"),
        (C("o_orderkey") % 97 + 1).cast("int").alias("pages_discovered"),
        (C("o_orderkey") % 89).cast("int").alias("pages_scanned"), (C("o_orderkey") % 13).cast("int").alias("pages_reused"),
        (C("o_orderkey") % 95).cast("int").alias("progress"), (C("o_orderkey") % 7).cast("int").alias("ai_pages_analyzed"),
        (C("o_orderkey") % 2 == 0).alias("ai_assessed"),
        F.to_json(F.struct((C("o_orderkey") % 4).alias("ai_errors"), (C("o_orderkey") % 5 == 0).alias("is_sampled"))).alias("meta"),
    )


def sites(spark, sf) -> DataFrame:
    """Websites from customers."""
    c = table(spark, sf, "customer")
    k = C("c_custkey")
    domain = F.concat(F.lower(F.replace(C("c_name"), F.lit("#"), F.lit("-"))), F.lit(".example"))
    status = (
        F.when(k % 11 == 0, "disabled").when(k % 7 == 0, "scanning").when(k % 5 == 0, "pending")
        .when(k % 101 < 70, "critical").when(k % 101 < 80, "high").when(k % 101 < 90, "review").otherwise("healthy")
    )
    return c.select(
        k.alias("website_id"), C("c_nationkey").cast("long").alias("user_id"), C("c_name").alias("name"), domain.alias("domain"),
        F.concat(F.lit("https://"), domain, F.lit("/")).alias("start_url"), status.alias("status"),
        (k % 101).cast("int").alias("overall_score"), (k % 40).cast("int").alias("pages_count"),
        (k % 23).cast("int").alias("last_discovered_pages"), (k % 19).cast("int").alias("last_scanned_pages"),
        (k % 6 == 0).alias("last_scan_partial"), (k % 17).cast("int").alias("open_findings_count"),
        F.when(k % 3 != 0, F.timestamp_add("DAY", k % 60, F.expr("timestamp'2001-05-01'"))).alias("last_scanned_at"),
        F.when(k % 4 != 0, F.timestamp_add("DAY", k % 90, F.expr("timestamp'2001-05-01'"))).alias("next_scan_at"),
        C("c_mktsegment").alias("segment"),
    )


def site_findings(spark, sf) -> DataFrame:
    """Findings whose website is the order's customer and whose scan is the order; lines meet orders before they grow to findings."""
    o = table(spark, sf, "orders").select(C("o_orderkey").alias("l_orderkey"), C("o_custkey").alias("owner"))
    f = as_findings(table(spark, sf, "lineitem").join(o, "l_orderkey"), "owner").drop("website_id")
    page = F.when(C("l_linenumber") != 7, C("page_id"))
    return f.withColumn("page_id", page).withColumnRenamed("owner", "website_id").withColumn(
        "public_id", F.concat(F.lit("MG-"), F.date_format("first_seen_at", "yyMMdd"), F.lit("-"), F.upper(F.substring("fingerprint", 1, 16)))
    )


def site_pages(spark, sf) -> DataFrame:
    """Stored pages from parts."""
    k = C("p_partkey")
    kind = F.when(k % 12 < 8, F.element_at(F.array(*[F.lit(v) for v in vocab.PAGE_TYPES]), (k % 12 + 1).cast("int")))
    return table(spark, sf, "part").select(
        k.alias("page_id"), (k % 150).alias("website_id"), C("p_name").alias("title"),
        F.concat(F.lit("https://example.com/"), F.lower(F.replace(C("p_name"), F.lit(" "), F.lit("-"))), F.lit("/"), k.cast("string")).alias("url"),
        F.when(k % 29 == 0, 404).when(k % 31 == 0, 301).otherwise(200).alias("status_code"),
        F.when(k % 9 != 0, F.lower(F.substring("p_type", 1, 2))).alias("language"),
        (C("p_size") * 20).cast("int").alias("word_count"), (k % 5).cast("int").alias("ad_count"), kind.alias("essential_page_type"),
        F.when(k % 37 != 0, F.lit(True)).otherwise(False).alias("scanned"),
        F.to_json(F.struct(F.coalesce(kind, F.lit("other")).alias("essential_page_type"))).alias("meta"),
    )


def scan_targets(spark, sf) -> DataFrame:
    """Scan targets from order lines: scan = order, target = line."""
    L = table(spark, sf, "lineitem")
    k = (C("l_partkey") + C("l_linenumber")) % 10
    status = (
        F.when(k == 0, "failed").when(k == 1, "queued").when(k == 2, "running").when(k.isin(3, 4), "reused").otherwise("completed")
    )
    return L.select(
        C("l_orderkey").alias("scan_id"), C("l_partkey").alias("page_id"), C("l_suppkey").alias("batch_number"), status.alias("status"),
        (C("l_linenumber") % 3).cast("int").alias("findings_count"), (C("l_linenumber") % 2).cast("int").alias("ai_findings_count"),
        (C("l_quantity") * 10).cast("long").alias("input_tokens"), C("l_quantity").cast("long").alias("output_tokens"),
        (C("l_linenumber") % 2 == 0).alias("ai_attempted"), (C("l_linenumber") % 4 == 0).alias("ai_analyzed"),
    )


def events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", C("ts").cast("timestamp"))


def stage_events(spark, sf) -> DataFrame:
    """Telemetry from events: even ids start a stage, odd ids finish the latest running one."""
    return events(spark, sf).select(
        "event_id", C("user_id").alias("target_id"), C("event_type").alias("stage"), "ts",
        F.when(C("event_id") % 2 == 0, "running").when(C("event_id") % 7 == 0, "failed").otherwise("success").alias("status"),
    )


def as_telemetry(events: DataFrame) -> DataFrame:
    """Telemetry with context from events; the context carries secrets and a text that must not be stored."""
    k = C("event_id")
    context = F.to_json(F.struct(
        F.lit("secret").alias("api_key"), F.lit("Bearer x").alias("authorization"), F.concat(F.lit("article "), k.cast("string")).alias("text"),
        F.when(k % 3 == 0, 200 + k % 5 * 100).alias("http_status"), F.concat(F.lit("r-"), k.cast("string")).alias("request_id"),
        F.get_json_object("props", "$.k").alias("k")))
    return events.select(
        (C("user_id") % 20).alias("scan_id"), C("user_id").alias("target_id"), "event_id", C("event_type").alias("stage"),
        F.when(k % 2 == 0, "running").when(k % 7 == 0, "failed").otherwise("success").alias("status"),
        F.when(k % 4 == 0, "crawler").otherwise("detector").alias("service"),
        F.concat(F.lit("step "), F.repeat(F.lit("x"), (k % 9000).cast("int"))).alias("message"), context.alias("context"), "ts")


def page_views(spark, sf) -> DataFrame:
    """View events per path."""
    return as_page_views(events(spark, sf))


def as_page_views(events: DataFrame) -> DataFrame:
    return events.filter("event_type = 'view'").select("ts", F.concat(F.lit("/"), F.get_json_object("props", "$.k")).alias("path"), "event_id")


def moderation(spark, sf) -> DataFrame:
    """Moderation responses derived from labels, joined to nothing: one row per document."""
    toxic = F.when((C("toxic") == 1) & (C("doc_id") % 2 == 0), 0.9).when(C("toxic") == 1, 0.6).otherwise(0.2)
    return table(spark, sf, "labels").select(
        "doc_id", F.concat(F.lit("https://docs.example/"), C("doc_id").cast("string")).alias("url"),
        F.when(C("doc_id") % 19 == 0, "failure").otherwise("success").alias("status"),
        F.concat(F.lit("req-"), C("doc_id").cast("string")).alias("request_id"),
        F.create_map(F.lit("toxic"), toxic, F.lit("available"), F.lit(1.0), F.lit("low_quality"), 1.0 - C("quality").cast("double")).alias("classes"),
    )


def documents(spark, sf) -> DataFrame:
    """Documents as pages: id, group, word count; every document counts as content."""
    d = tx.computed(balanced(table(spark, sf, "documents"), "doc_id"), {"word_count": tx.word_count(C("text"))})
    return d.select(
        C("doc_id").alias("id"), C("source").alias("grp"), C("doc_id").alias("position"), "text",
        F.concat(F.lit("https://docs.example/"), C("doc_id").cast("string")).alias("url"),
        "word_count", F.lit("content").alias("page_type"),
    )


def odd_urls(spark, sf) -> DataFrame:
    """Page URLs bent into the shapes the URL operators must cope with."""
    k, u = C("page_id") % 8, C("url")
    odd = (
        F.when(k == 1, F.regexp_replace(u, "^https?://", "HTTPS://user:pw@"))
        .when(k == 2, F.replace(u, F.lit(".example."), F.lit(".EXAMPLE.")))
        .when(k == 3, F.concat(F.regexp_replace(u, "[?#].*$", ""), F.lit("/../x/./y//z/")))
        .when(k == 4, F.concat(F.lit(" \t"), u, F.lit("\n ")))
        .when(k == 5, F.regexp_replace(u, r"\.(com|net|org)", ".$1.:8080"))
        .when(k == 6, F.concat(F.lit("not a url "), C("page_id").cast("string")))
        .when(k == 7, F.replace(u, F.lit("://"), F.lit("://www.")))
        .otherwise(u)
    )
    return pages(spark, sf).select("page_id", "url", "grp", odd.alias("odd"))


def unsafe_urls(spark, sf) -> DataFrame:
    """Page URLs mixed with addresses that must not be fetched."""
    k, n = C("page_id") % 12, C("page_id").cast("string")
    octet = (C("page_id") % 256).cast("string")
    bent = (
        F.when(k == 1, F.concat(F.lit("file:///etc/"), n)).when(k == 2, F.concat(F.lit("http://10.0."), octet, F.lit(".1/")))
        .when(k == 3, F.concat(F.lit("https://172."), octet, F.lit(".0.1/a"))).when(k == 4, F.lit("http://[::1]/x"))
        .when(k == 5, F.concat(F.lit("https://host"), n, F.lit(".internal/")))
        .when(k == 6, F.regexp_replace("url", "^https?://", "https://user:pass@"))
        .when(k == 7, F.regexp_replace("url", r"\.(com|net|org)/", ".$1:8443/"))
        .when(k == 8, F.concat(F.lit("http://"), octet, F.lit(".8.8.8/"))).otherwise(C("url"))
    )
    return pages(spark, sf).select("page_id", bent.alias("candidate"))


def link_rows(spark, sf) -> DataFrame:
    """One row per anchor of every page."""
    d = hx.with_page_text(pages(spark, sf)).select("page_id", "url", "grp", hx.links_with_text(C("elements")).alias("l"))
    return d.select("page_id", "url", "grp", F.posexplode("l").alias("i", "link")).select(
        "page_id", "url", "grp", "i", C("link.href").alias("href"), C("link.text").alias("label")
    )


def odd_links(spark, sf) -> DataFrame:
    """Links of every page bent into relative, protocol-relative, scheme and entity forms."""
    k, h = (C("page_id") + C("i")) % 9, C("href")
    bent = (
        F.when(k == 0, F.substring(h, 2, 1000)).when(k == 1, F.concat(F.lit("//www.cdn.example.com"), h))
        .when(k == 2, F.concat(F.lit("mailto:"), h)).when(k == 3, F.concat(F.lit("#"), h))
        .when(k == 4, F.concat(F.lit("../up"), h, F.lit("?a=1&amp;b=2"))).when(k == 5, F.lit(" "))
        .when(k == 6, F.concat(F.lit("https://other.example.org"), h, F.lit("/img.PNG"))).when(k == 7, F.concat(F.lit("?page="), C("i").cast("string")))
        .otherwise(h)
    )
    return link_rows(spark, sf).withColumn("candidate", bent)


def sitemap_name():
    k = C("page_id") % 5
    n = C("page_id").cast("string")
    return (
        F.when(k == 0, F.concat(F.lit("https://x.example/Post-Sitemap"), n, F.lit(".xml")))
        .when(k == 1, F.concat(F.lit("https://x.example/page-sitemap"), n, F.lit(".xml")))
        .when(k == 2, F.concat(F.lit("https://x.example/a/wp-sitemap-posts-post-"), n, F.lit(".xml.gz?x=1")))
        .when(k == 3, F.lit("https://x.example/posts-sitemap.xml")).otherwise(F.lit("https://x.example/wp-sitemap-posts-page-1.xml"))
    )


def listing_urls(spark, sf) -> DataFrame:
    """Page URLs bent into home, listing and pagination shapes with body classes."""
    k, u = C("page_id") % 9, F.regexp_replace("url", r"[?#].*$", "")
    root = F.regexp_extract("url", r"^https?://[^/]*", 0)
    bent = (
        F.when(k == 0, F.concat(root, F.lit("/"))).when(k == 1, F.concat(root, F.lit("/Tag/x")))
        .when(k == 2, F.concat(u, F.lit("?s=term"))).when(k == 3, F.concat(root, F.lit("/blog/page/2")))
        .when(k == 4, F.concat(root, F.lit("/c%61tegory/x+y"))).when(k == 5, F.concat(u, F.lit("?a=1&cat[]=2#f"))).when(k == 6, root)
        .otherwise(C("url"))
    )
    return pages(spark, sf).select(
        "page_id", bent.alias("u"), F.when(C("page_id") % 9 == 8, "Post Archive-list").otherwise("post tagged").alias("cls")
    )


def essential_urls(spark, sf) -> DataFrame:
    """Page URLs and link texts covering every required page type."""
    root = F.regexp_extract("url", r"^https?://[^/]*", 0)
    slugs = ["/Privacy-Policy", "/legal/dmca/", "/editorial_guidelines", "/mi%E1%BB%85n-tr%E1%BB%AB-tr%C3%A1ch-nhi%E1%BB%87m", "/terms",
             "/li%C3%AAn-h%E1%BB%87", "/gi%E1%BB%9Bi+thi%E1%BB%87u", "/ten-facts-about-cats", "", "/other"]
    labels = ["", "Giới thiệu", "Điều khoản sử dụng", "Cookies", "news"]
    pick = lambda vals, n: F.element_at(F.array(*[F.lit(x) for x in vals]), (C("page_id") % n + 1).cast("int"))
    return pages(spark, sf).select("page_id", F.concat(root, pick(slugs, 10)).alias("u"), pick(labels, 5).alias("label"))


def register_requests(spark, sf) -> DataFrame:
    s = sites(spark, sf)
    return s.select(
        C("website_id").alias("request_id"), F.when(C("user_id") % 5 != 0, C("user_id")).alias("user_id"),
        F.concat(F.lit("site-"), (C("website_id") % 400).cast("string"), F.lit(".example")).alias("domain"),
    )


def registered(spark, sf) -> DataFrame:
    r = register_requests(spark, sf)
    return ux.site_register(r.filter("request_id % 3 <> 0"), r.filter("request_id % 3 = 0")).withColumn(
        "user_id", F.coalesce("user_id", F.lit(-1))
    )


def decorated_pages(spark, sf) -> DataFrame:
    """Pages with images, ad code, consent marks, legal links, a canonical link and a body class added."""
    n = C("page_id").cast("string")
    k = C("page_id") % 4
    ad = (
        '<ins class="x adsbygoogle y" data-ad-slot="1"></ins><div ID="Top-AD-SLOT-1"></div>'
    )
    ads = F.when(k > 0, F.concat(
        F.repeat(F.lit(ad), k.cast("int")),
        F.lit('<script async src="https://pagead2.googlesyndication.com/pagead/js/adsbygoogle.js?client=ca-pub-1"></script>'
              '<script>(adsbygoogle = window.adsbygoogle || []).push({});</script><!-- <ins class="adsbygoogle"></ins> -->'),
    )).otherwise("")
    mark = (
        F.when(C("page_id") % 6 == 1, '<div id="my-Cookie-bar"></div>').when(C("page_id") % 6 == 2, "<p class='top Consent-x'>")
        .when(C("page_id") % 6 == 3, "<section data-cmp></section>").otherwise("<i title='cookie consent'></i>")
    )
    imgs = F.concat(
        F.lit('<img src="/local.png" alt="a"><img src="https://cdn.example/'), n, F.lit('.jpg" alt=" "><IMG alt=\'b &amp; c\' src=\'//cdn.example/x.jpg\'>'
        '<img src="https://cdn.example/'), n, F.lit('.jpg"><img alt="no source">'),
    )
    links = F.when(C("page_id") % 5 == 0, '<a href="/gioi-thieu">x</a><a href="/p1">Chính sách bảo mật</a>').when(
        C("page_id") % 5 == 1, '<a href="/contact"><b>Talk</b></a><a href="https://x.example/"> Home </a>'
    ).otherwise("")
    head = F.when(C("page_id") % 3 == 0, "").otherwise(
        F.concat(F.lit('<link rel="stylesheet" href="/s.css"><LINK href="https://c.example/'), n, F.lit("?a=1&amp;b=2\" rel='Canonical'>"))
    )
    html = F.replace(C("html"), F.lit("<head>"), F.concat(F.lit("<head>"), head))
    html = F.replace(
        html, F.lit("<body>"), F.concat(F.lit('<body class=" post single-'), n, F.lit(' ">'), imgs, ads, mark, links)
    )
    return pages(spark, sf).withColumn("html", html)


def decorated_images(spark, sf) -> DataFrame:
    d = hx.with_page_text(decorated_pages(spark, sf)).select("page_id", F.posexplode(hx.images(C("elements"))).alias("i", "m"))
    return d.select("page_id", "i", "m.src", "m.alt")


def ads_txt(spark, sf) -> DataFrame:
    """ads.txt text per site origin, length and content varying with the site name."""
    g = pages(spark, sf).groupBy("grp").agg(F.count("*").alias("n"))
    k = F.length("grp") % 4
    text = (
        F.when(k == 0, "# only a comment\r\n\n  ").when(k == 1, F.concat(F.lit("Google.com, pub-1, DIRECT\r\n # c\rother.com, "), C("n").cast("string")))
        .when(k == 2, F.concat(F.lit("a.com, 1, RESELLER\n\nb.com, "), C("n").cast("string"))).otherwise("google.com, pub-2")
    )
    return g.select(F.concat(F.lit("https://"), "grp").alias("origin"), F.when(C("n") % 5 == 0, 404).otherwise(200).alias("status"), text.alias("text"))


def signal_rows(spark, sf) -> DataFrame:
    """Page-signal rows for rule checks: texts are the documents, the other signals follow from the id."""
    d = tx.computed(balanced(table(spark, sf, "documents"), "doc_id"), {"word_count": tx.word_count(C("text"))})
    k = C("doc_id")
    kinds = [None, "home", *vocab.LINKED_TYPES]
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 9 + 1).cast("int"))
    scheme = F.when(k % 7 == 0, "http").otherwise("https")
    url = F.concat(scheme, F.lit("://site"), (k % 50).cast("string"), F.lit(".example"), F.when(k % 9 == 1, "/").otherwise(
        F.concat(F.lit("/p/"), k.cast("string"))))
    types = F.filter(F.array(*[F.when(k % (i + 2) != 0, F.lit(t)) for i, t in enumerate(vocab.LINKED_TYPES)]), lambda t: t.isNotNull())
    imgs = F.transform(F.sequence(F.lit(1), (k % 5).cast("int") + 1), lambda i: F.concat(F.lit("https://cdn.example/"), i.cast("string")))
    return d.select(
        k.alias("page_id"), k.alias("position"), F.concat(F.lit("site"), (k % 50).cast("string")).alias("grp"), url.alias("url"), "text",
        F.when(k % 10 == 0, "").otherwise("title").alias("title"), (k % 3).cast("int").alias("h1_count"),
        "word_count", (k % 5).cast("int").alias("paragraph_count"), (k % 12).cast("int").alias("ad_count"),
        (k % 4).cast("int").alias("external_images"), imgs.alias("external_image_urls"), kind.alias("essential_page_type"),
        types.alias("linked_types"), F.array_contains(types, "privacy").alias("has_privacy_link"),
        F.array_contains(types, "about").alias("has_about_link"), F.array_contains(types, "contact").alias("has_contact_link"),
        (k % 2 == 0).alias("has_consent_signal"), (k % 8 == 5).alias("has_contact_markup"),
        F.lit(200).alias("ads_txt_status"), (k % 5 != 0).alias("ads_txt_present"), (k % 6).cast("int").alias("ads_txt_lines"),
        (k % 4 == 0).alias("ads_txt_has_google"), F.lit("content").alias("page_type"),
    )


MODEL_CODE_LIST = [*vocab.MODEL_CODES, "unknown_code"]


def model_replies(spark, sf) -> DataFrame:
    """Stored model replies in the four envelope shapes, derived from labels."""
    k = C("doc_id")
    pick = lambda vals, key: F.element_at(F.array(*[F.lit(x) for x in vals]), (key + 1).cast("int"))
    item = lambda shift: F.struct(
        pick(MODEL_CODE_LIST, (k + shift) % 11).alias("policy_code"), pick(["high", "review", "info", "odd"], (k + shift) % 4).alias("severity"),
        ((k * 7 + shift) % 120 - 5).alias("confidence"), F.when((k + shift) % 3 != 0, F.concat(F.lit(" Title "), k.cast("string"))).alias("title"),
        F.array(F.concat(F.lit("quote "), k.cast("string")), F.lit(" "), F.lit("0")).alias("evidence"),
        F.when((k + shift) % 2 == 0, F.array(F.lit("do it"))).alias("remediation"),
    )
    reply = F.to_json(F.struct(F.array(item(0), item(3)).alias("findings")))
    n = k.cast("string")
    shapes = [
        F.to_json(F.struct(n.alias("id"), F.array(F.struct(F.lit("reasoning").alias("type"), F.array(F.struct(F.lit("x").alias("type"), F.lit("y").alias("text"))).alias("content")),
            F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), reply.alias("text"))).alias("content"))).alias("output"),
            F.struct(k.alias("input_tokens"), (k * 2).alias("output_tokens")).alias("usage"))),
        F.to_json(F.struct(n.alias("responseId"), F.array(F.struct(F.struct(F.array(F.struct(reply.alias("text"))).alias("parts")).alias("content"))).alias("candidates"),
            F.struct(k.alias("promptTokenCount"), (k * 2).alias("candidatesTokenCount")).alias("usageMetadata"))),
        F.to_json(F.struct(F.struct(reply.alias("content")).alias("message"), k.alias("prompt_eval_count"), (k * 2).alias("eval_count"))),
        F.to_json(F.struct(n.alias("id"), F.array(F.struct(F.struct(reply.alias("content")).alias("message"))).alias("choices"),
            F.struct(k.alias("prompt_tokens"), (k * 2).alias("completion_tokens")).alias("usage"))),
    ]
    payload = F.when(k % 4 == 0, shapes[0]).when(k % 4 == 1, shapes[1]).when(k % 4 == 2, shapes[2]).otherwise(shapes[3])
    return table(spark, sf, "labels").select(
        k.alias("page_id"), F.concat(F.lit("https://docs.example/"), n).alias("url"), payload.alias("payload")
    )


def moderation_raw(spark, sf) -> DataFrame:
    """Moderation replies as stored JSON."""
    m = moderation(spark, sf)
    classes = F.map_concat(F.transform_values("classes", lambda k, x: x.cast("string")), F.create_map(F.lit("note"), F.lit("text")))
    return m.select("doc_id", "url", F.to_json(F.struct(
        "status", F.struct(C("request_id").alias("id")).alias("request"), classes.alias("moderation_classes"))).alias("payload"))


def viewports(spark, sf) -> DataFrame:
    """Layout metrics from order lines: page = part, viewport = line number."""
    L = table(spark, sf, "lineitem")
    k = C("l_partkey")
    payload = F.to_json(F.struct(
        F.concat(F.lit("https://v.example/"), k.cast("string")).alias("url"), C("l_linenumber").cast("string").alias("name"),
        F.lit(1280).alias("width"), F.lit(800).alias("height"), F.lit(1).alias("adCount"),
        F.when((k % 6 == 0) & (C("l_linenumber") == 1), 1).when(k % 6 == 0, 0).alias("nearInteractiveCount"),
        F.when((k % 7 == 0) & (C("l_linenumber") == 2), 1).otherwise(0).alias("misleadingLabelCount"),
        F.when((k % 5 == 0) & (C("l_linenumber") == 3), 1).otherwise(0).alias("intrusiveOverlayCount"),
        ((k % 10) * 0.06 + C("l_linenumber") * 0.01).alias("viewportCoverage"),
        F.when((k % 11 == 0) & (C("l_linenumber") == 4), 1).otherwise(0).alias("popupAttempts"),
        F.when((k % 3 == 0) & (C("l_linenumber") == 5), 1).otherwise(0).alias("adRefreshCount"),
    ))
    return L.select(payload.alias("payload"))


def assessments(spark, sf) -> DataFrame:
    """Stored site assessments from assessed scans."""
    k = C("scan_id")
    urls = [*vocab.POLICY_URLS.values(), "https://elsewhere.example/"]
    pick = lambda vals, key: F.element_at(F.array(*[F.lit(x) for x in vals]), (key + 1).cast("int"))
    ref = lambda i: F.struct(
        F.when((k + i) % 3 == 0, F.lit("policy_overview")).alias("section"),
        F.when((k + i) % 5 != 0, F.lit(" issue ")).otherwise(" ").alias("issue"), F.lit("relevance").alias("relevance"),
        pick(urls, (k + i * 2) % 9).alias("policy_url"))
    payload = F.to_json(F.struct(
        pick(["critical", "high", "unknown"], k % 3).alias("risk_level"), F.concat(F.lit(" headline "), k.cast("string")).alias("headline"),
        F.when(k % 2 == 0, F.lit("overview")).alias("policy_overview"),
        F.array(F.struct(F.lit("A").alias("title"), F.lit("b").alias("why_it_matters"))).alias("key_issues"),
        F.transform(F.sequence(F.lit(0), (k % 12).cast("int")), lambda i: F.concat(F.lit(" do "), i.cast("string"))).alias("priorities"),
        F.array(*[F.lit(x) for x in "abcdefg"]).alias("limitations"), F.when(k % 4 != 0, F.array(*[ref(i) for i in range(10)])).alias("policy_references"),
    ))
    return scans(spark, sf).filter("ai_assessed").select("scan_id", "website_id", payload.alias("payload"))


def quoted_findings(spark, sf) -> DataFrame:
    """Findings with evidence in their signals."""
    k = C("l_partkey")
    s = F.to_json(F.struct(
        F.transform(F.sequence(F.lit(0), (k % 9).cast("int")), lambda i: F.concat(F.lit(" quote "), (i % 4).cast("string"))).alias("evidence"),
        F.transform(F.sequence(F.lit(0), (k % 14).cast("int")), lambda i: F.concat(F.lit("phrase "), i.cast("string"))).alias("matching_phrases"),
        F.when(k % 3 == 0, F.concat(F.lit("https://m.example/"), k.cast("string"))).alias("matched_url"),
        F.when(k % 4 == 0, F.lit("not a url")).alias("source_url"),
        F.array(F.lit("https://i.example/a"), F.lit("https://i.example/a"), F.lit("https://i.example/b")).alias("external_image_urls"),
        (k % 101).alias("similarity"), F.lit("sketch").alias("method"),
    ))
    return findings(spark, sf).withColumn("signals", s)


def as_responses(raw: DataFrame) -> DataFrame:
    """Rows of the pages table (batch or stream) as fetched responses."""
    kind = F.when(C("page_id") % 13 == 0, "application/pdf").otherwise("text/html; charset=utf-8")
    headers = F.when(C("page_id") % 11 == 0, F.create_map().cast("map<string,array<string>>")).otherwise(
        F.create_map(F.lit("Content-Type"), F.array(kind))
    )
    return raw.select(
        C("page_id").alias("position"), "page_id", F.lower(ux.host(C("url"))).alias("grp"), "url", "html",
        F.when(C("page_id") % 17 == 0, 404).otherwise(200).alias("status"), headers.alias("headers"),
    )
