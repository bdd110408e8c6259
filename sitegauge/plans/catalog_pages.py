"""Registered queries: sources, URL operators, page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions import html as hx, text as tx, url as ux
from sitegauge.operators import sources as so
from sitegauge.plans import oracle as o, views as v

C = F.col
ENTRIES: dict = {}


def add(name, fn, sql=None):
    ENTRIES[name] = (fn, sql)


# ---------------------------------------------------------------- sources
add("src_responses", lambda s, d: so.response_counters(v.responses(s, d)),
    f"with {o.RESPONSES} select count(*) filter (where status < 400 and (ctype = '' or contains(lower(ctype), 'html'))) as accepted, "
    "count(*) filter (where status >= 400) as failed_requests, "
    "count(*) filter (where status < 400 and ctype <> '' and not contains(lower(ctype), 'html')) as non_html_responses from rs")
add("src_dedupe_final_url",
    lambda s, d: so.dedupe_final_url(v.responses(s, d).withColumn("url", F.regexp_replace("url", r"\?.*$", ""))).select("page_id", "url_hash"),
    f"with {o.RESPONSES}, rr as (select *, regexp_replace(url, '\\?.*$', '') as raw from rs), np as ({o.parts('rr', 'raw', 'x')}), "
    f"nn as (select position, page_id, sha256({o.normalize('x', 'raw')}) as url_hash from np) "
    "select arg_min(page_id, position) as page_id, url_hash from nn group by url_hash")
add("src_response_limit", lambda s, d: so.response_limit(v.responses(s, d), "html", 9000).select("page_id", "bytes", "oversized"),
    f"with {o.RESPONSES} select page_id, strlen(html)::int as bytes, strlen(html) > 9000 as oversized from rs")
add("src_page_views", lambda s, d: so.page_views(v.page_views(s, d), F.expr(v.NOW_EVENTS)),
    f"with {o.VIEWS} select path, count(*) as views from vw where ts >= timestamp '2024-01-18' and ts < timestamp '2024-01-25' group by path")

# ---------------------------------------------------------------- URL operators
add("url_normalize", lambda s, d: v.odd_urls(s, d).select("page_id", ux.normalize(C("odd")).alias("normalized")),
    f"with {o.ODD_URLS} select page_id, {o.normalize('x', 'raw')} as normalized from ({o.parts('odt', 'raw', 'x')})")
add("url_resolve", lambda s, d: v.odd_links(s, d).select("page_id", "i", ux.resolve(C("url"), C("candidate")).alias("resolved")),
    f"with {o.ODD_LINKS} {o.resolved('ol', 'url', 'candidate', 'page_id, i')}")
add("url_host_key", lambda s, d: v.odd_urls(s, d).select("page_id", ux.host_key(tx.trim(C("odd"))).alias("host_key")),
    f"with {o.ODD_URLS} select page_id, {o.host_key('raw')} as host_key from odt")
add("url_origin", lambda s, d: v.odd_urls(s, d).select("page_id", F.coalesce(ux.origin(tx.trim(C("odd"))), F.lit("")).alias("origin")),
    f"with {o.ODD_URLS} select page_id, case when page_id % 8 = 6 then '' else coalesce(nullif(x_s, ''), 'https') || '://' || x_h || coalesce(':' || nullif(x_port, ''), '') end as origin from ({o.parts('odt', 'raw', 'x')})")
add("url_hash", lambda s, d: v.pages(s, d).select("page_id", ux.url_hash(C("url")).alias("url_hash")), "select page_id, sha256(url) as url_hash from pages")
add("url_crawlable",
    lambda s, d: v.odd_links(s, d).withColumn("r", ux.resolve(C("url"), C("candidate"))).filter(C("r").isNotNull()).select("page_id", "i", ux.crawlable(C("url"), C("r")).alias("crawlable")),
    f"with {o.ODD_LINKS}, rz as ({o.resolved('ol', 'url', 'candidate', 'page_id, i, url')}) select page_id, i, "
    f"{o.host_key('url')} <> '' and {o.host_key('url')} = {o.host_key('resolved')} and lower({o.ext('resolved', ux.PATTERN, 1)}) in ('http', 'https') "
    f"and not {o.hit('lower(' + o.path('resolved') + ')', o.vocab.ASSET_SUFFIXES)} as crawlable from rz where resolved is not null")
_V4 = " or ".join(f"ip between {a} and {b}" for a, b in ux.v4_ranges())
add("url_safety",
    lambda s, d: v.unsafe_urls(s, d).select("page_id", F.coalesce(ux.safety(C("candidate")), F.lit("safe")).alias("reason")),
    f"with {o.UNSAFE_URLS}, us1 as (select *, lower({o.sub('x_h', chr(92) + '.+$')}) as hh from ({o.parts('us', 'candidate', 'x')})), "
    f"us2 as (select *, case when {o.hit('hh', '^[0-9]+([.][0-9]+)' + '{3}$')} and list_max(list_transform(string_split(hh, '.'), lambda y: try_cast(y as int))) <= 255 then "
    "list_reduce(list_transform(string_split(hh, '.'), lambda y: try_cast(y as bigint)), lambda a, b: a * 256 + b) end as ip from us1) "
    "select page_id, case when x_s = '' or hh = '' then 'incomplete' when lower(x_s) not in ('http', 'https') then 'scheme' when contains(x_a, '@') then 'credentials' "
    "when x_port not in ('', '80', '443') then 'port' when hh = 'localhost' or suffix(hh, '.localhost') or suffix(hh, '.local') or suffix(hh, '.internal') then 'local_host' "
    f"when {_V4} then 'private_address' when {o.hit('hh', '^.(::1?|::ffff:.*|f[cd].*|fe[89ab].*|ff.*|2001:db8.*|64:ff9b:.*).$')} and hh[1] = '[' then 'private_address' else 'safe' end as reason from us2")
add("url_post_sitemap",
    lambda s, d: v.pages(s, d).withColumn("u", v.sitemap_name()).select("page_id", ux.post_sitemap(C("u")).alias("post")),
    "select page_id, page_id % 5 in (0, 2, 3) as post from pages")
add("url_listing", lambda s, d: v.listing_urls(s, d).select("page_id", ux.listing(C("u"), C("cls")).alias("listing")),
    f"with {o.LISTING_URLS} select page_id, {o.listing('u', 'cls')} as listing from lu")
add("url_home", lambda s, d: v.listing_urls(s, d).select("page_id", ux.home(C("u")).alias("home")),
    f"with {o.LISTING_URLS} select page_id, {o.path('u')} in ('', '/') as home from lu")
add("url_same_site_external",
    lambda s, d: v.odd_urls(s, d).select("page_id", ux.same_site_external(F.regexp_replace("grp", r"^(?:m|blog)\.", ""), tx.trim(C("odd"))).alias("same_site")),
    f"with {o.ODD_URLS}, ss as (select page_id, regexp_replace(grp, '^(?:m|blog)[.]', '') as own, lower({o.host('raw')}) as c from odt) "
    "select page_id, c = own or suffix(c, '.' || own) or suffix(own, '.' || c) as same_site from ss")
add("url_essential_type",
    lambda s, d: v.essential_urls(s, d).select("page_id", F.coalesce(ux.essential_type(C("u"), C("label")), F.lit("none")).alias("kind")),
    f"with {o.ESSENTIAL_URLS} select page_id, coalesce({o.essential('u', 'label')}, 'none') as kind from eu")
add("text_ascii_slug", lambda s, d: v.documents(s, d).select(C("id").alias("doc_id"), F.md5(tx.slug(C("text"))).alias("slug_md5")),
    f"select doc_id, md5({o.slug('text')}) as slug_md5 from documents")
add("site_slug", lambda s, d: ux.site_slug(v.pages(s, d).select(C("page_id").alias("id"), C("grp").alias("domain"))).select("id", "slug"),
    f"with {o.PAGES}, b as (select page_id as id, {o.slug(chr(114) + 'eplace(grp, ' + o.q('.') + ', ' + o.q('-') + ')')} as base from pg), "
    "n as (select *, row_number() over (partition by base order by id) as n from b) select id, case when n = 1 then base else base || '-' || n end as slug from n")
add("site_register",
    v.registered,
    f"with {o.SITES}, rq as (select website_id as request_id, case when user_id % 5 <> 0 then user_id end as user_id, 'site-' || (website_id % 400) || '.example' as domain from ws), "
    "kn as (select distinct user_id, domain from rq where request_id % 3 = 0) "
    "select coalesce(r.user_id, -1) as user_id, r.domain, min(r.request_id) as request_id from rq r where r.request_id % 3 <> 0 and not exists "
    "(select 1 from kn where kn.domain = r.domain and kn.user_id is not distinct from r.user_id) group by all")

# ---------------------------------------------------------------- extraction
def text_query(*columns):
    return lambda s, d: hx.with_page_text(v.pages(s, d)).select("page_id", *[c() for c in columns])


T = f"with {o.TEXT} select page_id, "
add("page_title", text_query(lambda: hx.title(C("clean")).alias("title")),
    T + o.trim(o.unescape(o.ext("clean", r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)"))) + " as title from tx")
add("page_canonical", lambda s, d: hx.with_page_text(v.decorated_pages(s, d)).select("page_id", F.coalesce(hx.canonical(C("clean")), F.lit("")).alias("canonical_url")),
    "select page_id, case when page_id % 3 = 0 then '' else 'https://c.example/' || page_id || '?a=1&b=2' end as canonical_url from pages")
add("page_language", text_query(lambda: F.coalesce(hx.language(C("clean")), F.lit("")).alias("language")),
    T + o.attribute(o.ext("clean", r"(?is)<html\s[^>]*>", 0), "lang") + " as language from tx")
add("page_body_class", lambda s, d: hx.with_page_text(v.decorated_pages(s, d)).select("page_id", hx.body_class(C("clean")).alias("body_class")),
    "select page_id, 'post single-' || page_id as body_class from pages")
add("page_h1_count", text_query(lambda: hx.h1_count(C("elements")).alias("h1_count")), T + f"len({o.every('elements', r'(?i)<h1[\s/>]')})::int as h1_count from tx")
add("page_links", lambda s, d: v.link_rows(s, d).select("page_id", "i", "href", "label"), f"with {o.TEXT}, {o.LINKS} select page_id, (i - 1)::int as i, href, label from ln")
add("page_images", lambda s, d: v.decorated_images(s, d), f"with {o.DECORATED_IMAGES} select page_id, i, src, alt from im")
add("page_ad_count", lambda s, d: hx.with_page_text(v.decorated_pages(s, d)).select("page_id", hx.ad_count(C("clean")).alias("ad_count")),
    "select page_id, (page_id % 4) * 2 + case when page_id % 4 > 0 then 2 else 0 end as ad_count from pages")
add("page_consent", lambda s, d: hx.with_page_text(v.decorated_pages(s, d)).select("page_id", hx.consent(C("elements")).alias("consent")),
    "select page_id, page_id % 6 in (1, 2, 3) as consent from pages")
add("page_text", text_query(lambda: F.md5("text").alias("text_md5"), lambda: F.length("text").alias("chars")), T + "md5(text) as text_md5, length(text)::int as chars from tx")
add("page_word_count", text_query(lambda: tx.word_count(C("text")).alias("word_count")), T + f"{o.words('text')}::int as word_count from tx")
add("page_paragraphs", text_query(lambda: hx.paragraph_count(C("kept")).alias("paragraphs")), T + f"len({o.every('kept', r'(?i)<p[\s/>]')})::int as paragraphs from tx")
add("page_linked_types", lambda s, d: hx.page_signals(v.decorated_pages(s, d)).select("page_id", "has_privacy_link", "has_about_link", "has_contact_link", F.array_join(F.array_sort("linked_types"), ",").alias("types")),
    f"with {o.DECORATED_LINKS}, ty as (select page_id, {o.essential('href', 'label')} as kind from dl) select page_id, coalesce(bool_or(kind = 'privacy'), false) as has_privacy_link, "
    "coalesce(bool_or(kind = 'about'), false) as has_about_link, coalesce(bool_or(kind = 'contact'), false) as has_contact_link, coalesce(string_agg(distinct kind, ',' order by kind), '') as types from ty group by page_id")
add("page_external_images",
    lambda s, d: hx.page_signals(v.decorated_pages(s, d)).select("page_id", "external_images", F.size("external_image_urls").alias("distinct_urls"), "images_missing_alt"),
    f"with {o.DECORATED_IMAGES} select page_id, count(*) filter (where eh <> '' and eh <> own)::int as external_images, count(distinct src) filter (where eh <> '' and eh <> own)::int as distinct_urls, "
    f"count(*) filter (where alt = '')::int as images_missing_alt from (select *, lower({o.host('src')}) as eh from im) group by page_id")
add("page_normalized_text", text_query(lambda: F.md5(tx.normalized(C("text"))).alias("norm_md5")), T + f"md5({o.normalized('text')}) as norm_md5 from tx")
add("page_content_hash", text_query(lambda: tx.content_hash(C("text")).alias("content_hash")), T + f"sha256({o.normalized('text')}) as content_hash from tx")
add("page_type", lambda s, d: v.listing_urls(s, d).select("page_id", hx.page_type(C("u"), C("cls")).alias("page_type")),
    f"with {o.LISTING_URLS} select page_id, case when {o.path('u')} in ('', '/') then 'home' when {o.listing('u', 'cls')} then 'listing' else 'content' end as page_type from lu")
add("ads_txt_signals", lambda s, d: hx.ads_txt_signals(v.ads_txt(s, d)),
    f"with {o.ADS_TXT} select origin, status as ads_txt_status, status < 400 and len(l) > 0 as ads_txt_present, len(l)::int as ads_txt_lines, "
    "len(list_filter(l, lambda x: prefix(lower(x), 'google.com,'))) > 0 as ads_txt_has_google from adt")
add("src_ads_txt", lambda s, d: so.ads_txt_lines(v.ads_txt(s, d)), f"with {o.ADS_TXT} select origin, unnest(range(len(l)))::int as line, unnest(l) as entry from adt")
add("page_signals",
    lambda s, d: hx.page_signals(v.pages(s, d), v.ads_txt(s, d)).select(
        "page_id", "status_code", "title", "language", "word_count", "h1_count", "paragraph_count", "ad_count", "content_hash", "page_type",
        "has_consent_signal", "external_images", "ads_txt_present", F.size("links").alias("n_links"), F.size("links_with_text").alias("n_anchors")),
    f"with {o.SIGNALS}, {o.LINKS}, lc as (select page_id, count(*)::int as n_anchors, count(distinct href)::int as n_links from ln group by 1) "
    f"select sg.page_id, 200 as status_code, title, {o.attribute(o.ext('html', chr(40) + '?is)<html' + chr(92) + 's[^>]*>', 0), 'lang')} as language, word_count::int as word_count, "
    "h1_count::int as h1_count, paragraph_count::int as paragraph_count, 0 as ad_count, content_hash, page_type, false as has_consent_signal, 0 as external_images, false as ads_txt_present, "
    "coalesce(n_links, 0) as n_links, coalesce(n_anchors, 0) as n_anchors from sg left join lc using (page_id)")
