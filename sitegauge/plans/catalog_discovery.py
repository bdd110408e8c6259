"""Registered queries: robots, sitemaps, plans, links. Robots and sitemap texts are built by Spark from the pages table."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from sitegauge.functions import text as tx, url as ux
from sitegauge.operators import discovery as dc, sitemap_files as sf, sources as so
from sitegauge.params import DEFAULT
from sitegauge.plans import oracle as o, views as v
from sitegauge.streaming.live import scratch

C = F.col
ENTRIES: dict = {}


def add(name, fn, sql=None):
    ENTRIES[name] = (fn, sql)


def hosts(s, d):
    g = v.pages(s, d).groupBy("grp").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    return g.select(C("grp").alias("site"), "n", "first", F.concat(F.lit("https://"), "grp").alias("origin"), F.concat(F.lit("https://"), "grp", F.lit("/")).alias("start_url"))


HOSTS = f"{o.PAGES}, ho as (select grp as site, count(*) as n, min(page_id) as first, 'https://' || grp as origin, 'https://' || grp || '/' as start_url from pg group by grp)"


def robots(s, d):
    text = F.concat(
        F.lit("Sitemap: https://"), "site", F.lit("/sitemap.xml\r\nUser-agent: other\nDisallow: /never/\nUser-agent: x\nUser-Agent: *  # all\r"),
        F.lit("Disallow: /en/*3$ # comment\nDisallow:\nAllow: /\nDISALLOW : /fr/\nno colon\nUser-agent: bad\nDisallow: /\nsitemap: not-a-url\n"),
        F.when(C("n") % 2 == 0, F.lit("User-agent: MySiteGauge/1.0\nDisallow: /es/4")).otherwise(""),
    )
    return hosts(s, d).select("origin", F.when(C("n") % 7 == 0, 404).otherwise(200).alias("status"), text.alias("text"))


_RULES = ("rr as (select origin, 0 as line, 'sitemap' as field, origin || '/sitemap.xml' as value from ho union all select origin, 5, 'disallow', '/en/*3$' from ho union all select origin, 8, 'disallow', '/fr/' from ho "
          "union all select origin, 14, 'disallow', '/es/4' from ho where n % 2 = 0)")
add("src_robots", lambda s, d: so.src_robots(hosts(s, d), robots(s, d)).select("site", F.length("robots_text").alias("chars")),
    f"with {HOSTS} select site, case when n % 7 = 0 then 0 else length('Sitemap: https://' || site || '/sitemap.xml' || '__User-agent: other_Disallow: /never/_User-agent: x_User-Agent: *  # all_' || "
    "'Disallow: /en/*3$ # comment_Disallow:_Allow: /_DISALLOW : /fr/_no colon_User-agent: bad_Disallow: /_sitemap: not-a-url_' || case when n % 2 = 0 then 'User-agent: MySiteGauge/1.0_Disallow: /es/4' else '' end) end::int as chars from ho")
add("robots_rules", lambda s, d: dc.robots_rules(robots(s, d)).select("origin", "line", "field", "value"), f"with {HOSTS}, {_RULES} select * from rr")
add("robots_allowed", lambda s, d: dc.robots_allowed(v.pages(s, d).withColumn("url", F.regexp_replace("url", "^http:", "https:")), dc.robots_rules(robots(s, d))).select("page_id", "allowed"),
    f"with {HOSTS}, {_RULES}, p as (select page_id, 'https://' || grp as origin, {o.path_or_root('url')} as pa from pg) select page_id, not coalesce(bool_or(case value when '/en/*3$' then regexp_matches(pa, '^/en/.*3$') else prefix(pa, value) end), false) as allowed "
    "from p left join rr on rr.origin = p.origin and field = 'disallow' group by 1")


# one urlset per site with all its pages, named as post sitemap for two thirds of the sites, under a two-level index
def sitemap_bodies(s, d):
    p = v.pages(s, d).withColumn("loc", F.replace(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^http:", "https:"), F.lit("&"), F.lit("&amp;")))
    mod = F.when(C("page_id") % 4 != 0, F.concat(F.lit("<lastmod>"), F.date_format(F.timestamp_add("DAY", C("page_id") % 300, F.expr("timestamp'2024-01-01'")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("</lastmod>"))).when(
        C("page_id") % 8 == 0, "<lastmod>soon</lastmod>").otherwise("")
    item = F.concat(F.lit("<url>\n<loc> "), "loc", F.lit(" </loc><image:image><image:loc>https://i.example/x.png</image:loc></image:image>"), mod, F.lit("</url>"))
    posts = p.groupBy("grp", (C("page_id") % 3).alias("part")).agg(F.array_sort(F.collect_list(F.struct("page_id", item.alias("x")))).alias("xs"))
    body = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="x"><!-- c -->'), F.array_join(F.transform("xs", lambda x: x["x"]), ""), F.lit("</urlset>"))
    sets = posts.select(_set_url(C("grp"), C("part")).alias("url"), F.lit(200).alias("status"), body.alias("body"))
    index = lambda names: F.concat(F.lit("<sitemapindex>"), *[F.concat(F.lit("<sitemap><loc>"), u, F.lit("</loc><lastmod>"), F.lit(m), F.lit("</lastmod></sitemap>")) for u, m in names], F.lit("</sitemapindex>"))
    h = hosts(s, d)
    top = h.select(F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.lit(200).alias("status"), index([
        (_set_url(C("site"), F.lit(0)), "2024-01-01"), (F.concat("origin", F.lit("/nested.xml")), "2024-03-01"), (F.lit("https://elsewhere.example/s.xml"), "2024-04-01"), (F.concat("origin", F.lit("/missing.xml")), "2024-02-01")]).alias("body"))
    nested = h.select(F.concat("origin", F.lit("/nested.xml")).alias("url"), F.lit(200).alias("status"), index([
        (_set_url(C("site"), F.lit(1)), "2024-01-01"), (_set_url(C("site"), F.lit(2)), "2024-01-02"), (F.concat("origin", F.lit("/sitemap.xml")), "2024-01-03")]).alias("body"))
    return sets.unionByName(top).unionByName(nested)


def _set_url(site, part):
    return F.concat(F.lit("https://"), site, F.when(part == 2, "/page-sitemap.xml").otherwise(F.concat(F.lit("/post-sitemap"), part.cast("string"), F.lit(".xml"))))


def seeds(s, d):
    h = hosts(s, d)
    return h.select("site", "start_url", F.concat("origin", F.lit("/sitemap.xml")).alias("url"), F.lit(0).alias("seq"), F.lit(True).alias("required")).unionByName(
        h.select("site", "start_url", F.concat("origin", F.lit("/wp-sitemap.xml")).alias("url"), F.lit(1).alias("seq"), F.lit(False).alias("required")))


_LOC = "regexp_replace(regexp_replace(url, '#.*$', ''), '^http:', 'https:')"
_MOD = "case when page_id % 4 <> 0 then epoch(timestamp '2024-01-01' + to_days((page_id % 300)::int))::bigint else 0 end"


def stored_sitemaps(s, d):
    """One gzip file per site and part, written by the tasks that hold its pages, and read back."""
    out = scratch(s, "sitemaps")
    item = F.concat(F.lit("<url><loc><![CDATA["), "loc", F.lit("]]></loc><image:image><image:loc>https://i.example/x.png</image:loc></image:image>"), "mod", F.lit("</url>"))
    mod = F.when(C("page_id") % 4 != 0, F.concat(F.lit("<lastmod>"), F.date_format(F.timestamp_add("DAY", C("page_id") % 300, F.expr("timestamp'2024-01-01'")), "dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</lastmod>"))).otherwise("")
    p = v.pages(s, d).select(C("grp").alias("site"), (C("page_id") % 3).alias("part"), "page_id", F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^http:", "https:").alias("loc"), mod.alias("mod"))
    ends = p.select("site", "part").distinct().select("site", "part", F.inline(F.array(
        F.struct(F.lit(-1).cast("long").alias("page_id"), F.lit("<?xml version='1.0'?><urlset>").alias("line")), F.struct(F.lit((1 << 62)).alias("page_id"), F.lit("</urlset>").alias("line")))))
    lines = p.select("site", "part", "page_id", item.alias("line")).unionByName(ends)
    lines = lines.repartition("site", "part").sortWithinPartitions("site", "part", "page_id").select("site", "part", "line")
    lines.write.partitionBy("site", "part").option("compression", "gzip").text(out)
    rows = sf.read_entries(s, out, "*.gz")
    return rows.select(F.regexp_extract("file", "site=([^/]+)", 1).alias("site"), F.regexp_extract("file", "part=([0-9]+)", 1).cast("long").alias("part"), "i", "loc", dc.lastmod_epoch(C("lastmod")).alias("lastmod"))


add("src_sitemaps", stored_sitemaps, f"with {o.PAGES} select grp as site, page_id % 3 as part, row_number() over (partition by grp, page_id % 3 order by page_id) - 1 as i, {_LOC} as loc, {_MOD} as lastmod from pg")
add("sitemap_entries", lambda s, d: dc.entry_rows(dc.sitemap_entries(sitemap_bodies(s, d)).filter("kind = 'urlset'"), ["url"]).select("url", "loc", dc.lastmod_epoch(C("lastmod")).alias("lastmod")),
    f"with {o.PAGES}, x as (select 'https://' || grp || case when page_id % 3 = 2 then '/page-sitemap.xml' else '/post-sitemap' || (page_id % 3) || '.xml' end as url, {_LOC} as loc, {_MOD} as lastmod, page_id from pg) "
    "select url, loc, arg_min(lastmod, page_id) as lastmod from x group by all")
# reading order: 0 sitemap.xml, 1 wp-sitemap.xml, 2 nested, 3 missing, 4 post-sitemap0, 5 page-sitemap, 6 post-sitemap1
_PRESENT = "bool_or(page_id % 3 = 0) as p0, bool_or(page_id % 3 = 1) as p1, bool_or(page_id % 3 = 2) as p2"
add("sitemap_expand", lambda s, d: dc.sitemap_expand(seeds(s, d), sitemap_bodies(s, d))[1],
    f"with {o.PAGES}, g as (select grp as site, {_PRESENT} from pg group by 1) select site, 2 + p0::int + p1::int + p2::int as sitemap_files, 1 + (not p0)::int + (not p1)::int + (not p2)::int as sitemap_errors, false as truncated from g")


def files(s, d):
    return dc.sitemap_expand(seeds(s, d), sitemap_bodies(s, d))[0]


def candidates(s, d):
    return dc.sitemap_candidates(files(s, d))


_CAND = (f"cd0 as (select grp as site, {_LOC} as raw, page_id, {_MOD} as lastmod, page_id % 3 <> 2 as post, case page_id % 3 when 0 then 5 when 2 then 6 else 7 end as file_order from pg), "
         f"cd1 as (select *, {o.normalize('x', 'raw')} as url from ({o.parts('cd0', 'raw', 'x')})), "
         f"cd as (select site, url, min((file_order, page_id)) as sq, arg_min(lastmod, (file_order, page_id)) as lastmod, arg_min(post, (file_order, page_id)) as post from cd1 "
         f"where not {o.hit('lower(' + o.path('url') + ')', o.vocab.ASSET_SUFFIXES)} group by all)")
add("sitemap_candidates", lambda s, d: candidates(s, d).select("site", "url", "lastmod", "post"), f"with {o.PAGES}, {_CAND} select site, url, lastmod, post from cd")


def home_links(s, d):
    """Links of each site's first page, read as its home page, plus legal links on some sites."""
    l = v.link_rows(s, d)
    first = hosts(s, d).select("site", "first")
    own = l.join(first, C("page_id") == C("first")).select("site", F.concat(F.lit("https://"), "site", F.lit("/")).alias("url"), "i", "href", "label")
    extra = hosts(s, d).filter("n % 2 = 0").select("site", "start_url", F.explode(F.array(*[F.struct(F.lit(1000 + i).alias("i"), F.lit(h).alias("href"), F.lit(t).alias("label")) for i, (h, t) in enumerate(
        [("/about", ""), ("contact.html", "x"), ("/legal", "Chính sách bảo mật"), ("https://elsewhere.example/terms", "Terms"), ("/about?x=1", "")])])).alias("e")).select("site", C("start_url").alias("url"), "e.*")
    return own.unionByName(extra)


def required(s, d):
    return dc.required_pages(home_links(s, d))


_REQ_FROM = (
    f"{o.LINKS}, "
    "hl0 as (select site, start_url, i::bigint as i, href, label from ln join ho on ho.first = ln.page_id union all select site, start_url, 1000 + u.i, u.h, u.t from ho, (values (1, '/about', ''), (2, 'contact.html', 'x'), (3, '/legal', 'Chính sách bảo mật'), (5, '/about?x=1', '')) u(i, h, t) where n % 2 = 0), "
    f"hl as ({o.resolved('hl0', 'start_url', 'href', 'site, i, label, start_url')}), hk as (select site, i, resolved as url, {o.essential('resolved', 'label')} as kind from hl where resolved is not null and {o.host_key('resolved')} = site_key(start_url) "
    f"and not {o.hit('lower(' + o.path('resolved') + ')', o.vocab.ASSET_SUFFIXES)}), rq as (select site, url, arg_min(kind, i) as kind from hk where kind is not null and kind <> 'home' group by all)".replace("site_key(start_url)", o.host_key("start_url")))
_REQUIRED = f"{HOSTS}, {o.TEXT[len(o.PAGES) + 2:]}, {_REQ_FROM}"
add("plan_required_pages", lambda s, d: required(s, d).select("site", "url", "kind"), f"with {_REQUIRED} select site, url, kind from rq")


def home(s, d):
    return hosts(s, d).select("site", C("start_url").alias("url"))


_PLAN = ("pa as (select site, start_url as url, 'required_page' as source, 0 as phase, 'home' as kind, 0 as ord from ho union all select site, url, 'required_page', 1, kind, 0 from rq union all select site, url, 'sitemap', 2, '-', 0 from cd), "
         "pn as (select * from pa qualify row_number() over (partition by site, url order by phase) = 1)")
add("plan_all_urls", lambda s, d: dc.plan_all_urls(home(s, d), required(s, d), candidates(s, d)).select("site", "url", "source", "phase", F.coalesce("kind", F.lit("-")).alias("kind")),
    f"with {_REQUIRED}, {_CAND}, {_PLAN} select site, url, source, phase, kind from pn")
_NEW = "hp as (select site, bool_or(post) as hp from cd group by 1), nr as (select cd.*, row_number() over (partition by site order by lastmod desc, sq) as r from cd join hp using (site) where post or not hp)"
add("newest_candidates", lambda s, d: dc.newest_n(candidates(s, d), 3).select("site", "url", "pool_rank"), f"with {o.PAGES}, {_CAND}, {_NEW} select site, url, r::int as pool_rank from nr where r <= 3")
add("plan_newest_n", lambda s, d: dc.plan_newest_n(home(s, d), required(s, d), candidates(s, d), 3).select("site", "url", "source", "phase"),
    f"with {_REQUIRED}, {_CAND}, {_NEW}, pa as (select site, start_url as url, 'required_page' as source, 0 as phase from ho union all select site, url, 'required_page', 1 from rq union all select site, url, 'sitemap', 2 from nr where r <= 3) "
    "select * from pa qualify row_number() over (partition by site, url order by phase) = 1")


def adds(s, d):
    return v.pages(s, d).select(C("grp").alias("site"), F.regexp_replace("url", "[?#].*$", "").alias("url"), C("page_id").alias("sequence"), (C("page_id") % 9 == 0).alias("required"))


add("plan_dedupe_cap", lambda s, d: dc.plan_dedupe_cap(adds(s, d), 4)[0].groupBy("site").agg(F.count("*").alias("planned"), F.sum("sequence").alias("check_sum")).join(dc.plan_dedupe_cap(adds(s, d), 4)[1], "site"),
    f"with {o.PAGES}, f as (select grp as site, regexp_replace(url, '[?#].*$', '') as url, min(page_id) as sequence from pg group by all), n as (select *, sequence % 9 = 0 as req, row_number() over (partition by site, sequence % 9 = 0 order by sequence) as r from f) "
    "select site, count(*) filter (where req or r <= 4) as planned, sum(sequence) filter (where req or r <= 4)::bigint as check_sum, bool_or(not req and r > 4) as truncated from n group by 1")


def metadata(s, d):
    planned = dc.plan_all_urls(home(s, d), required(s, d), candidates(s, d))
    h = hosts(s, d)
    counters = h.filter("n % 3 = 0").select("site", F.lit(1).alias("sitemap_files"))
    return dc.plan_metadata(planned, counters, h.select("site", F.least("n", F.lit(3)).alias("scanned")), h.select("site", C("n").alias("available_urls")))


add("plan_metadata", lambda s, d: metadata(s, d).select("site", "discovered", "required_pages", "discovery_confidence", "coverage_percent", "site_coverage_percent", F.coalesce(F.try_element_at("discovery_sources", F.lit("sitemap")), F.lit(0)).alias("from_sitemap")),
    f"with {_REQUIRED}, {_CAND}, {_PLAN}, k as (select site, count(*) as m, count(*) filter (where source = 'sitemap') as f, count(distinct kind) filter (where kind <> '-') as r from pn group by 1) "
    "select site, m as discovered, r as required_pages, case when n % 3 = 0 then 'high' else 'low' end as discovery_confidence, "
    "round(least(n, 3) / m * 100, 2) as coverage_percent, round(least(least(n, 3), n) / n * 100, 2) as site_coverage_percent, f as from_sitemap from ho join k using (site)")


def planned_paths(s, d):
    planned = v.pages(s, d).select(C("grp").alias("site"), F.concat(F.lit("https://"), "grp", F.lit("/"), (C("page_id") % 40).cast("string"), F.lit("?v="), C("page_id").cast("string")).alias("url"), C("page_id").alias("position"))
    views = so.page_views(v.page_views(s, d), F.expr(v.NOW_EVENTS)).filter("views % 2 = 0")
    return dc.plan_priority_traffic(planned, _site_views(planned, views))


def _site_views(planned, views):
    paths = planned.select("site", ux.path_or_root(C("url")).alias("path")).distinct()
    return paths.join(views, "path")


add("plan_priority_traffic", lambda s, d: planned_paths(s, d).select("site", "url", "position", F.coalesce("views", F.lit(0)).alias("views"), "order_key.unvisited"),
    f"with {o.PAGES}, {o.VIEWS}, pv as (select path, count(*) as views from vw where ts >= timestamp '2024-01-18' and ts < timestamp '2024-01-25' group by 1 having count(*) % 2 = 0), "
    "x as (select grp as site, page_id % 40 as k, max(page_id) as last, min(page_id) as position from pg group by all) select site, 'https://' || site || '/' || k || '?v=' || last as url, position, coalesce(views, 0) as views, views is null as unvisited from x left join pv on path = '/' || k")
add("plan_batches", lambda s, d: dc.plan_batches(v.targets(s, d)).select("page_id", "position", "batch_number"),
    f"with {o.TARGETS} select page_id, row_number() over w - 1 as position, ((row_number() over w - 1) // 10 + 1)::int as batch_number from tg window w as (partition by scan_id order by position)")
add("plan_fetch_schedule", lambda s, d: dc.plan_fetch_schedule(v.targets(s, d).withColumn("host", C("scan_id"))).select("page_id", "start_second"),
    f"with {o.TARGETS} select page_id, round((row_number() over (partition by scan_id order by position) - 1) / 1.5, 3) as start_second from tg")


def links(s, d):
    return v.link_rows(s, d).withColumnRenamed("grp", "site")


_EDGES = f"with {o.TEXT}, {o.LINKS}, rz as ({o.resolved('ln', 'url', 'href', 'page_id, grp, url, i')}), ed as (select grp as site, url as from_url, i - 1 as i, resolved as to_url from rz where resolved is not null and {o.host_key('resolved')} = {o.host_key('url')} and not {o.hit('lower(' + o.path('resolved') + ')', o.vocab.ASSET_SUFFIXES)})"
add("link_edges", lambda s, d: dc.link_edges(links(s, d)).select("from_url", "i", "to_url"), f"{_EDGES} select from_url, i::int as i, to_url from ed")
add("link_frontier", lambda s, d: dc.link_frontier(dc.link_edges(links(s, d)), dc.link_edges(links(s, d)).filter("i % 2 = 0").select("site", ux.url_hash(C("to_url")).alias("url_hash"))).select("site", "url_hash"),
    f"{_EDGES} select distinct site, sha256(to_url) as url_hash from ed where (site, to_url) not in (select site, to_url from ed where i % 2 = 0)")


def numbered_pages(s, d):
    return v.pages(s, d).select(C("grp").alias("site"), "page_id", C("url"), (F.row_number().over(W.partitionBy("grp").orderBy("page_id")) - 1).alias("k"))


def graph(s, d):
    """Links of the pages; as they lead out of the table, a link stands for the page of its site that its length points to."""
    n = hosts(s, d).select("site", "n")
    e = dc.link_edges(links(s, d)).join(n, "site").select("site", "from_url", "i", F.pmod(F.length("to_url"), C("n")).cast("int").alias("k"))
    return e.join(numbered_pages(s, d).select("site", "k", C("url").alias("to_url")), ["site", "k"])


def permitted(s, d):
    p = numbered_pages(s, d).select("site", "url", F.regexp_replace("url", "^http:", "https:").alias("asked"))
    rules = dc.robots_rules(robots(s, d))
    return dc.robots_allowed(p.withColumn("given", C("url")).withColumn("url", C("asked")), rules).filter("allowed").select("site", C("given").alias("url"))


def first_pages(s, d):
    return numbered_pages(s, d).filter("k = 0").select("site", "url")


def refreshed(s, d):
    """Reachability of the whole graph, from that of a part of it: links were added everywhere and taken from some sites."""
    whole, allowed = graph(s, d), permitted(s, d)
    old = whole.filter("i % 2 = 0").select("site", "from_url", "to_url")
    extra = first_pages(s, d).filter("length(site) % 3 = 0").select("site", C("url").alias("from_url"), F.concat("url", F.lit("#gone")).alias("to_url"))
    before = old.join(allowed.select("site", C("url").alias("to_url")), ["site", "to_url"], "left_semi").unionByName(extra, allowMissingColumns=True).select("site", "from_url", "to_url")
    return dc.update_reachable(dc.link_reachable(first_pages(s, d), before), before, whole, first_pages(s, d), allowed)


_REACH = (f"{_EDGES}, {HOSTS[len(o.PAGES) + 2:]}, {_RULES}, np as (select grp as site, url, page_id, row_number() over (partition by grp order by page_id) - 1 as k from pg), "
          f"al as (select np.site, np.url, not coalesce(bool_or(case value when '/en/*3$' then regexp_matches({o.path_or_root('url')}, '^/en/.*3$') else prefix({o.path_or_root('url')}, value) end), false) as ok from np left join rr on rr.origin = 'https://' || np.site and field = 'disallow' group by all), "
          "gr as (select distinct ed.site, ed.from_url, np.url as to_url from ed join ho on ho.site = ed.site join np on np.site = ed.site and np.k = length(ed.to_url) % ho.n join al on al.site = np.site and al.url = np.url and al.ok), "
          "r as (select site, url, 0 as depth from np where k = 0 union select r.site, gr.to_url, r.depth + 1 from r join gr on gr.site = r.site and gr.from_url = r.url join ho on ho.site = r.site where r.depth < ho.n) "
          "select site, url, min(depth) as depth from r group by all").replace("with ", "with recursive ", 1)
add("link_reachable", lambda s, d: dc.link_reachable(first_pages(s, d), graph(s, d), permitted(s, d)), _REACH)
add("link_reachable_update", refreshed, _REACH)
