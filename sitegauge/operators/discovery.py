"""From robots, sitemaps and links to an ordered crawl plan."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sitegauge.functions import text as tx, url as ux
from sitegauge.operators.numbering import first_per_group, first_ranked, number_in_group, spread_join
from sitegauge.params import DEFAULT, Params
from sitegauge.session import cut

C = F.col


# ---------------------------------------------------------------- robots

def robots_rules(robots: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rules of each robots text (origin, text): (origin, line, field, value) for ``disallow`` and ``sitemap``.

    A disallow line counts while the last user-agent line named ``*`` or the bot; sitemap lines count anywhere. The
    text of one origin is a bounded file, so its state is folded inside the row.
    """
    def parsed(line: Column) -> Column:
        clean = tx.trim(F.regexp_replace(line, "#.*", ""))
        return F.struct(
            F.lower(tx.trim(F.regexp_extract(clean, r"^([^:]*):", 1))).alias("field"),
            tx.trim(F.regexp_extract(clean, r"^[^:]*:(.*)$", 1)).alias("value"), clean.contains(":").alias("ok"),
        )

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), lambda x: tx.let(x, parsed))
    rows = robots.select("origin", F.posexplode(lines).alias("line", "l")).filter("l.ok").select("origin", "line", "l.field", "l.value")
    applies = F.when(C("field") == "user-agent", (C("value") == "*") | F.lower("value").contains(p.bot_name))
    state = F.last(applies, ignorenulls=True).over(W.partitionBy("origin").orderBy("line"))
    rows = rows.withColumn("applies", F.coalesce(state, F.lit(False)))
    keep = ((C("field") == "sitemap") & ux.is_valid(C("value"))) | ((C("field") == "disallow") & C("applies") & (C("value") != ""))
    return rows.filter(keep).drop("applies")


def rule_pattern(value: Column) -> Column:
    """Prefix-anchored expression of a disallow value: ``*`` is any run, ``$`` the end."""
    escaped = F.regexp_replace(value, r"([.\\+?\[\]^(){}|<>=!:#\-/&])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("*"), F.lit(".*")))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``allowed``: no rule of the URL's origin matches its path. Rules are one short list per origin."""
    patterns = rules.filter("field = 'disallow'").groupBy("origin").agg(F.collect_set(rule_pattern(C("value"))).alias("patterns"))
    rows = urls.withColumns({
        "origin": ux.origin(C("url")), "_path": ux.path_or_root(C("url")), "_key": F.xxhash64("url"),
    })
    blocked = F.exists(F.coalesce("patterns", F.array().cast("array<string>")), lambda r: F.rlike(C("_path"), r))
    joined = spread_join(rows, patterns, ["origin"], "_key", "left")
    return joined.withColumn("allowed", ~blocked).drop("patterns", "_path", "_key")


# ---------------------------------------------------------------- sitemaps

def sitemap_entries(sitemaps: DataFrame) -> DataFrame:
    """Type and (i, loc, lastmod) entries of each sitemap body; a loc counts once, extension namespaces do not."""
    body = F.regexp_replace("body", r"(?s)<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    root = F.lower(F.regexp_extract(body, r"^\s*<(?:[A-Za-z0-9_]+:)?([A-Za-z]+)", 1))
    kind = F.when(root == "sitemapindex", "index").when(root == "urlset", "urlset").otherwise("unknown")
    item = lambda name: F.regexp_extract_all(C("_b"), F.lit(rf"(?s)<(?:[A-Za-z0-9_]+:)?{name}(?:\s[^>]*)?>(.*?)</(?:[A-Za-z0-9_]+:)?{name}\s*>"), F.lit(1))
    value = lambda block, name: tx.trim(tx.unescape(F.regexp_replace(F.regexp_extract(
        F.regexp_replace(block, r"(?s)<(?:image|video|news):.*?</(?:image|video|news):[a-z_]+\s*>", ""),
        rf"(?s)<(?:[A-Za-z0-9_]+:)?{name}(?:\s[^>]*)?>(.*?)</", 1), r"<!\[CDATA\[|\]\]>", "")))
    rows = sitemaps.withColumns({"_b": body, "kind": kind}).withColumn(
        "_items", F.when(C("kind") == "index", item("sitemap")).when(C("kind") == "urlset", item("url")).otherwise(F.array().cast("array<string>"))
    )
    entries = F.transform("_items", lambda b: F.struct(value(b, "loc").alias("loc"), F.nullif(value(b, "lastmod"), F.lit("")).alias("lastmod")))
    return rows.withColumn("entries", F.filter(entries, lambda e: e["loc"] != "")).drop("_b", "_items", "body")


def entry_rows(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Entries as rows, the first of equal locations per sitemap."""
    rows = parsed.select(*keys, "kind", F.posexplode("entries").alias("i", "e")).select(*keys, "kind", "i", "e.loc", "e.lastmod")
    return first_per_group(rows, [*keys, "loc"], ["i"])


def lastmod_epoch(value: Column) -> Column:
    """Seconds since 1970, zero for a missing or unreadable date. Dates without a zone are UTC.

    ISO forms come first; mail dates and month names are read without the weekday and with GMT, UTC or UT as an offset.
    """
    formats = [
        "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss",
        "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy",
        "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy",
    ]
    plain = F.regexp_replace(tx.trim(value), r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"(?i) (?:GMT|UTC|UT|Z)$", " +0000")
    read = lambda text: F.coalesce(*[F.unix_timestamp(F.try_to_timestamp(text, F.lit(f))) for f in formats], F.lit(0)).cast("long")
    return tx.let(plain, read)


def sitemap_expand(seeds: DataFrame, sitemaps: DataFrame, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Sitemap files reached from the seeds, in reading order, and counters per site.

    ``seeds``: site, start_url, url, seq, required. ``sitemaps``: url, status, body. Every round reads the index files
    found in the round before (their entries newest first) and stops when nothing new turns up. Reading order is
    breadth first: (round, order of the parent, order in the parent). Returns (files, counters).
    """
    stored = sitemap_entries(sitemaps.filter((C("status") < 400) & (tx.trim(C("body")) != "")))
    known = cut(stored.select(ux.normalize(C("url")).alias("url"), "kind", "entries"))
    wave = seeds.select(
        "site", "start_url", ux.normalize(C("url")).alias("url"), F.array(C("seq").cast("long")).alias("order"), "required"
    )
    seen = None
    while True:
        wave = wave.filter(ux.host_key(C("url")) == ux.host_key(C("start_url")))
        wave = first_per_group(wave, ["site", "url"], ["order"])
        if seen is not None:
            wave = wave.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        wave = cut(wave.join(known, "url", "left"))
        if wave.isEmpty():
            break
        seen = wave if seen is None else seen.unionByName(wave)  # a union of finished tables
        children = wave.filter("kind = 'index'").select(
            "site", "start_url", "order", "url",
            F.posexplode(F.array_sort(F.transform("entries", lambda e, i: F.struct((-lastmod_epoch(e["lastmod"])).alias("n"), i.alias("i"), e["loc"].alias("loc"))))).alias("k", "e"),
        )
        wave = children.select(
            "site", "start_url", ux.resolve(C("url"), C("e.loc")).alias("url"), F.concat("order", F.array(C("k").cast("long"))).alias("order"), F.lit(True).alias("required")
        ).filter("url is not null")
    ordered = seen.withColumn("level", F.size("order"))
    most = p.max_sitemaps or (1 << 31) - 2  # zero: no limit
    ranked = first_ranked(ordered, ["site"], [F.asc("level"), F.asc("order")], most, "file_order")
    total = seen.groupBy("site").agg(F.count("*").alias("reached"))
    counters = ranked.groupBy("site").agg(
        F.count_if(C("kind").isin("index", "urlset")).alias("sitemap_files"),
        F.count_if(C("required") & (C("kind").isNull() | (C("kind") == "unknown"))).alias("sitemap_errors"),
    ).join(total, "site").withColumn("truncated", C("reached") > most).drop("reached")
    return ranked.select("site", "start_url", "url", "file_order", "kind", "entries"), counters


def sitemap_candidates(files: DataFrame) -> DataFrame:
    """Crawlable normalised page URLs of the urlset files: first occurrence per site, with reading sequence.

    The sequence is the pair (file order, entry index) packed in one number, so no site is sorted as a whole.
    """
    rows = files.filter("kind = 'urlset'").select("site", "start_url", "url", "file_order", F.posexplode("entries").alias("i", "e"))
    rows = rows.select(
        "site", lastmod_epoch(C("e.lastmod")).alias("lastmod"), ux.post_sitemap(C("url")).alias("post"),
        (C("file_order").cast("long") * (1 << 32) + C("i")).alias("sequence"),
        F.explode(internal(C("start_url"), C("url"), C("e.loc"))).alias("candidate"),
    )
    return first_per_group(rows.withColumnRenamed("candidate", "url"), ["site", "url"], ["sequence"])


# ---------------------------------------------------------------- plans

def required_pages(home_links: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Required publisher pages per site from home-page links (site, url = page, i, href, label) and from candidates.

    Returns site, url, kind, sequence; the home page's links come first.
    """
    rows = home_links.select("site", C("i").cast("long").alias("sequence"), F.explode(internal(C("url"), C("url"), C("href"))).alias("url"), "label")
    rows = rows.select("site", "url", ux.essential_type(C("url"), C("label")).alias("kind"), "sequence").filter("kind <> 'home'")
    if candidates is not None:
        more = candidates.select("site", "url", ux.essential_type(C("url")).alias("kind"), (C("sequence") + (1 << 62)).alias("sequence"))
        rows = rows.unionByName(more.filter("kind is not null"))
    return first_per_group(rows, ["site", "url"], ["sequence"])


def newest_n(candidates: DataFrame, n: int) -> DataFrame:
    """The N newest candidates per site, from post sitemaps when the site has any, else from all."""
    has_posts = candidates.groupBy("site").agg(F.max("post").alias("has_posts"))
    pool = candidates.join(has_posts, "site").filter(C("post") | ~C("has_posts"))
    return first_ranked(pool, ["site"], [F.desc("lastmod"), F.asc("sequence")], n, "pool_rank")


def plan(home: DataFrame, required: DataFrame, regular: DataFrame) -> DataFrame:
    """One plan per site: home, required pages, regular URLs; the first source of a URL wins.

    ``home``: site, url. ``required``: site, url, kind, sequence. ``regular``: site, url, sequence, source.
    Returns site, url, url_hash, source, kind, phase, sequence; (phase, sequence) is the plan order.
    """
    rows = (
        home.select("site", "url", F.lit("required_page").alias("source"), F.lit("home").alias("kind"), F.lit(0).alias("phase"), F.lit(0).cast("long").alias("sequence"))
        .unionByName(required.select("site", "url", F.lit("required_page").alias("source"), "kind", F.lit(1).alias("phase"), "sequence"))
        .unionByName(regular.select("site", "url", "source", F.lit(None).cast("string").alias("kind"), F.lit(2).alias("phase"), "sequence"))
    )
    return first_per_group(rows, ["site", "url"], ["phase", "sequence"]).withColumn("url_hash", ux.url_hash(C("url")))


def plan_all_urls(home: DataFrame, required: DataFrame, candidates: DataFrame) -> DataFrame:
    return plan(home, required, candidates.select("site", "url", "sequence", F.lit("sitemap").alias("source")))


def plan_newest_n(home: DataFrame, required: DataFrame, candidates: DataFrame, n: int) -> DataFrame:
    chosen = newest_n(candidates, n)
    return plan(home, required, chosen.select("site", "url", C("pool_rank").cast("long").alias("sequence"), F.lit("sitemap").alias("source")))


def plan_dedupe_cap(adds: DataFrame, limit: int, sampled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(planned rows, truncated flag per site) for adds (site, url, sequence, required).

    The first add of a URL wins; required ones are outside the limit; a refused add marks the plan truncated unless
    it was sampled. The number of refused rows is a count, so no site is collected.
    """
    first = first_per_group(adds.withColumn("url_hash", ux.url_hash(C("url"))), ["site", "url_hash"], ["sequence"])
    regular = number_in_group(first.filter(~C("required")), ["site"], "sequence", "n", levels=3)
    kept = first.filter("required").unionByName(regular.filter(C("n") <= limit).drop("n"))
    cut_off = first.groupBy("site").agg((F.count_if(~C("required")) > limit).alias("over"))
    return kept, cut_off.select("site", (C("over") & F.lit(not sampled)).alias("truncated"))


def plan_metadata(planned: DataFrame, counters: DataFrame, scanned: DataFrame, available: DataFrame) -> DataFrame:
    """Source counts, confidence and coverage per site."""
    per_source = planned.groupBy("site", "source").agg(F.count("*").alias("n"))
    sources = per_source.groupBy("site").agg(
        F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("discovery_sources"), F.sum("n").alias("discovered"),
        F.max(C("source") == "internal_link").alias("linked"),
    )
    kinds = planned.filter("kind is not null").groupBy("site").agg(F.count_distinct("kind").alias("required_pages"))
    rows = sources.join(kinds, "site", "left").join(counters, "site", "left").join(scanned, "site", "left").join(available, "site", "left")
    files, done, pool = F.coalesce("sitemap_files", F.lit(0)), F.coalesce("scanned", F.lit(0)), F.coalesce("available_urls", F.lit(0))
    return rows.select(
        "site", "discovery_sources", "discovered", F.coalesce("required_pages", F.lit(0)).alias("required_pages"),
        F.when(files > 0, "high").when(C("linked"), "medium").otherwise("low").alias("discovery_confidence"),
        F.round(done / C("discovered") * 100, 2).alias("coverage_percent"),
        F.when(pool > 0, F.round(F.least(done, pool) / pool * 100, 2)).otherwise(F.lit(0.0)).alias("site_coverage_percent"),
    )


def plan_priority_traffic(planned: DataFrame, views: DataFrame, keep_variants: bool = False) -> DataFrame:
    """Plan order by traffic: visited paths first, by views, the rest in plan order.

    ``planned``: site, url, position; ``views``: site, path, views. One URL per path is kept, the last one, at the
    place of the first; ``keep_variants`` keeps all of them. The order key is (visited, views, position).
    """
    rows = planned.withColumn("path", ux.path_or_root(C("url")))
    if not keep_variants:
        rows = rows.groupBy("site", "path").agg(F.max_by("url", "position").alias("url"), F.min("position").alias("position"))
    rows = rows.join(views, ["site", "path"], "left")
    return rows.select(
        "site", "url", "position", "views",
        F.struct(C("views").isNull().alias("unvisited"), F.coalesce(-C("views"), F.lit(0)).alias("n"), "position").alias("order_key"),
    )


def plan_batches(targets: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Dense position per scan and its batch number."""
    rows = number_in_group(targets, ["scan_id"], "position", "n", p.chunk)
    return rows.withColumns({
        "position": C("n") - 1, "batch_number": (F.floor((C("n") - 1) / p.page_batch) + 1).cast("int"),
    }).drop("n")


def plan_fetch_schedule(targets: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Earliest start of each URL in seconds under the per-host rate."""
    rows = number_in_group(targets, ["host"], "position", "n", p.chunk)
    return rows.withColumn("start_second", F.round((C("n") - 1) / p.requests_per_second, 3)).drop("n")


# ---------------------------------------------------------------- links

def internal(start: Column, page: Column, href: Column) -> Column:
    """The link's address as a list of one, empty unless it is a crawlable page of the site; resolved once per link."""
    return F.filter(F.array(ux.resolve(page, href)), lambda u: F.coalesce(ux.crawlable(start, u), F.lit(False)))


def link_edges(links: DataFrame) -> DataFrame:
    """Resolved crawlable internal links (site, from_url, to_url, i) of pages (site, url, i, href)."""
    return links.select("site", C("url").alias("from_url"), "i", F.explode(internal(C("url"), C("url"), C("href"))).alias("to_url"))


def link_frontier(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Linked URLs not known yet: site, url, url_hash."""
    found = edges.select("site", C("to_url").alias("url"), ux.url_hash(C("to_url")).alias("url_hash")).distinct()
    return found.join(known.select("site", "url_hash"), ["site", "url_hash"], "left_anti")


def link_reachable(starts: DataFrame, edges: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Pages reachable from each site's start URLs with their depth, breadth first.

    ``starts``: site, url; ``edges``: site, from_url, to_url; ``allowed``: site, url of pages robots permit.
    """
    return _relax(starts.select("site", "url", F.lit(0).alias("depth")), _graph(edges, allowed), None)


def update_reachable(previous: DataFrame, old: DataFrame, edges: DataFrame, starts: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """:func:`link_reachable` of ``edges``, from its result ``previous`` for the edges ``old`` and only what changed since.

    A new edge or start can only bring pages nearer: the search goes on from there and stops where nothing gets nearer.
    A site that lost an edge or a start is searched again. Other sites are compared, not searched.
    """
    new, before = _graph(edges, allowed), cut(old.select("site", "from_url", "to_url").distinct())
    keys = ["site", "from_url", "to_url"]
    first = starts.select("site", "url", F.lit(0).alias("depth"))
    gone = previous.filter("depth = 0").join(first, ["site", "url"], "left_anti").select("site")
    lost = cut(before.join(new, keys, "left_anti").select("site").unionByName(gone).distinct())
    kept = cut(previous.join(lost, "site", "left_anti"))
    added = new.join(before, keys, "left_anti")
    nearer = added.join(kept.withColumnRenamed("url", "from_url"), ["site", "from_url"]).select("site", C("to_url").alias("url"), (C("depth") + 1).alias("depth"))
    return _relax(nearer.unionByName(first.join(kept, ["site", "url", "depth"], "left_anti")), new, kept)


def _graph(edges: DataFrame, allowed: DataFrame | None) -> DataFrame:
    if allowed is not None:
        edges = edges.join(allowed.select("site", C("url").alias("to_url")), ["site", "to_url"], "left_semi")
    return cut(edges.select("site", "from_url", "to_url").distinct())


def _relax(frontier: DataFrame, edges: DataFrame, known: DataFrame | None) -> DataFrame:
    """Smallest depth of every page that the frontier (site, url, depth) reaches, over what is known already.

    Each round joins only the pages that just came nearer, until there are none; rounds are finished tables, merged into one
    every few rounds.
    """
    keys = ["site", "url"]
    for turn in itertools.count(1):
        best = frontier.groupBy(*keys).agg(F.min("depth").alias("depth"))
        if known is not None:
            seen = known.groupBy(*keys).agg(F.min("depth").alias("_old"))
            best = best.join(seen, keys, "left").filter("_old is null or depth < _old").drop("_old")
        best = cut(best)
        if best.isEmpty():
            return best if known is None else known.groupBy(*keys).agg(F.min("depth").alias("depth"))
        known = best if known is None else known.unionByName(best)
        if turn % 8 == 0:
            known = cut(known.groupBy(*keys).agg(F.min("depth").alias("depth")))
        frontier = best.withColumnRenamed("url", "from_url").join(edges, ["site", "from_url"]).select("site", C("to_url").alias("url"), (C("depth") + 1).alias("depth"))
