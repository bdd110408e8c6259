"""Page extraction from raw HTML as native expressions over the body column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions import text as tx, url as ux, vocab
from sitegauge.params import DEFAULT, Params

COMMENT = r"(?s)<!--.*?(?:-->|\z)"
SCRIPT = r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)"
SCRIPT_BODY = r"(?is)(<script\b[^>]*>).*?(?:</script\s*>|\z)"
STYLE_BODY = r"(?is)(<style\b[^>]*>).*?(?:</style\s*>|\z)"
RAW = "(?is)" + "|".join(
    rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "template", "svg")
)
HEAD = r"(?is)<head\b[^>]*>.*?</head\s*>"
BODY = r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)"
BODY_START = r"(?is)\A.*?<body\b[^>]*+>"
BODY_END = r"(?is)</body\s*>.*+"
TAG = r"(?s)</?[A-Za-z!?][^>]*(?:>|\z)"
OPEN_TAG = r"(?s)<[A-Za-z][^>]*>"
ANCHOR = r"(?is)<a(\s[^>]*)>(.*?)(?:</a\s*>|\z)"
ADS_HINT = r"(?i)adsbygoogle|data-ad-|ad-slot|googlesyndication|doubleclick|google-adsense-account|ca-pub-"
CLASS_ADS = r"""(?i)\sclass\s*=\s*(?:"(?:[^"]*\s)?adsbygoogle(?:\s[^"]*)?"|'(?:[^']*\s)?adsbygoogle(?:\s[^']*)?'|adsbygoogle(?:[\s>/]|\z))"""


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute inside one open tag; empty when absent."""
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return tx.unescape(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))


def has_attribute(tag: Column, name: str) -> Column:
    return tag.rlike(rf"""(?is)\s{name}(?:[\s=>/]|\z)""")


def attribute_contains(name: str, *needles: str) -> str:
    n = "(?:" + "|".join(x.replace(".", r"\.") for x in needles) + ")"
    return rf"""(?is)\s{name}\s*=\s*(?:"[^"]*{n}[^"]*"|'[^']*{n}[^']*'|[^\s"'>]*{n})"""


def _is_ad(tag: Column) -> Column:
    return (
        tag.rlike(CLASS_ADS)
        | has_attribute(tag, "data-ad-(?:client|slot)")
        | tag.rlike(attribute_contains("id", "ad-slot"))
        | tag.rlike(attribute_contains("src", "pagead2.googlesyndication.com", "googleads.g.doubleclick.net"))
        | tag.rlike(r"""(?is)^<meta\s(?:.*\s)?name\s*=\s*["']?google-adsense-account["'\s>/]""")
    )


def ad_count(clean: Column) -> Column:
    """Elements carrying at least one of the eight advertising signs; ``clean`` has no comments."""
    scripts = F.regexp_extract_all(clean, F.lit(SCRIPT), F.lit(0))
    script_ads = F.filter(
        scripts,
        lambda s: _is_ad(F.regexp_extract(s, OPEN_TAG, 0))
        | F.regexp_replace(s, OPEN_TAG, "").rlike("ca-pub-|adsbygoogle"),
    )
    others = F.regexp_extract_all(F.regexp_replace(clean, SCRIPT, ""), F.lit(OPEN_TAG), F.lit(0))
    return F.when(clean.rlike(ADS_HINT), F.size(script_ads) + F.size(F.filter(others, _is_ad))).otherwise(0)


def consent(elements: Column) -> Column:
    tags = F.regexp_extract_all(elements, F.lit(OPEN_TAG), F.lit(0))
    hit = lambda t: (
        t.rlike(attribute_contains("id", "cookie"))
        | t.rlike(attribute_contains("class", "consent"))
        | has_attribute(t, "data-cmp")
    )
    return F.when(elements.rlike("(?i)cookie|consent|data-cmp"), F.exists(tags, hit)).otherwise(False)


def links_with_text(elements: Column) -> Column:
    heads = F.regexp_extract_all(elements, F.lit(ANCHOR), F.lit(1))
    bodies = F.regexp_extract_all(elements, F.lit(ANCHOR), F.lit(2))
    pairs = F.filter(F.arrays_zip(heads.alias("h"), bodies.alias("b")), lambda p: has_attribute(p["h"], "href"))
    return F.transform(
        pairs,
        lambda p: F.struct(
            attribute(p["h"], "href").alias("href"),
            tx.collapse(tx.unescape(F.regexp_replace(p["b"], TAG, ""))).alias("text"),
        ),
    )


def images(elements: Column) -> Column:
    tags = F.filter(
        F.regexp_extract_all(elements, F.lit(r"(?is)<img\s[^>]*>"), F.lit(0)), lambda t: has_attribute(t, "src")
    )
    return F.transform(
        tags, lambda t: F.struct(attribute(t, "src").alias("src"), tx.trim(attribute(t, "alt")).alias("alt"))
    )


def with_page_text(df: DataFrame, body: str = "html") -> DataFrame:
    """Adds ``clean`` (no comments), ``elements`` (no script/style bodies), ``kept`` and ``text``."""
    clean = F.regexp_replace(F.col(body), COMMENT, "")

    def views(c: Column) -> Column:
        return tx.let(F.regexp_replace(c, RAW, ""), lambda kept: F.struct(
            c.alias("clean"), F.regexp_replace(F.regexp_replace(c, SCRIPT_BODY, "$1"), STYLE_BODY, "$1").alias("elements"),
            kept.alias("kept"), visible_text(kept).alias("text"),
        ))

    return df.select(*df.columns, F.inline(F.array(tx.let(clean, views))))


def visible_text(kept: Column) -> Column:
    """Text of the body element with all tags removed and white space collapsed."""
    after = F.regexp_replace(kept, BODY_START, "")
    inner = tx.let(after, lambda x: F.when(
        F.length(x) < F.length(kept), F.regexp_replace(x, BODY_END, "")
    ).otherwise(F.regexp_replace(x, HEAD, "")))
    return tx.collapse(tx.unescape(F.regexp_replace(inner, TAG, "")))


def _null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def title(clean: Column) -> Column:
    return tx.trim(tx.unescape(F.regexp_extract(clean, r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)", 1)))


def canonical(clean: Column) -> Column:
    tags = F.filter(
        F.regexp_extract_all(clean, F.lit(r"(?is)<link\s[^>]*>"), F.lit(0)),
        lambda t: t.rlike(attribute_contains("rel", "canonical")) & has_attribute(t, "href"),
    )
    return _null_if_empty(attribute(F.get(tags, F.lit(0)), "href"))


def language(clean: Column) -> Column:
    return _null_if_empty(attribute(F.regexp_extract(clean, r"(?is)<html\s[^>]*>", 0), "lang"))


def body_class(clean: Column) -> Column:
    return tx.trim(attribute(F.regexp_extract(clean, r"(?is)<body\s[^>]*>", 0), "class"))


def h1_count(elements: Column) -> Column:
    return F.regexp_count(elements, F.lit(r"(?i)<h1[\s/>]"))


def paragraph_count(kept: Column) -> Column:
    return F.regexp_count(kept, F.lit(r"(?i)<p[\s/>]"))


def linked_types(links: Column) -> Column:
    found = F.transform(links, lambda l: ux.essential_type(l["href"], l["text"]))
    return F.array_distinct(F.filter(found, lambda t: t.isNotNull()))


def external_images(page_url: Column, imgs: Column) -> Column:
    foreign = lambda own: F.filter(
        imgs, lambda i: tx.let(F.lower(ux.host(i["src"])), lambda h: (h != "") & (h != own))
    )
    return tx.let(F.lower(ux.host(page_url)), foreign)


def page_type(url: Column, cls: Column) -> Column:
    return F.when(ux.home(url), "home").when(ux.listing(url, cls), "listing").otherwise("content")


def ads_txt_signals(ads: DataFrame) -> DataFrame:
    """One row per origin from (origin, status, text)."""
    lines = F.filter(
        F.transform(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n"), tx.trim),
        lambda l: (l != "") & ~l.startswith("#"),
    )
    return ads.withColumn("lines", lines).select(
        "origin",
        F.col("status").alias("ads_txt_status"),
        (F.coalesce(F.col("status") < 400, F.lit(False)) & (F.size("lines") > 0)).alias("ads_txt_present"),
        F.size("lines").alias("ads_txt_lines"),
        F.exists("lines", lambda l: F.lower(l).startswith("google.com,")).alias("ads_txt_has_google"),
    )


def page_signals(
    responses: DataFrame,
    ads: DataFrame | None = None,
    required: DataFrame | None = None,
    p: Params = DEFAULT,
) -> DataFrame:
    """The per-page record every rule reads. Narrow: no shuffle of page bodies.

    ``responses`` has url, html and optionally status and any key columns, which are carried through.
    ``ads`` (origin, status, text) reaches home pages, ``required`` (url_hash, required_type) reaches its URL;
    both hold one row per key, and Spark chooses the join by their size.
    """
    carried = [c for c in responses.columns if c not in ("html", "status")]
    status = F.col("status") if "status" in responses.columns else F.lit(200)
    df = with_page_text(responses)
    df = df.select(
        *carried, status.cast("int").alias("status_code"), "text",
        title(F.col("clean")).alias("title"),
        canonical(F.col("clean")).alias("canonical_url"),
        language(F.col("clean")).alias("language"),
        body_class(F.col("clean")).alias("body_class"),
        h1_count(F.col("elements")).alias("h1_count"),
        paragraph_count(F.col("kept")).alias("paragraph_count"),
        ad_count(F.col("clean")).alias("ad_count"),
        consent(F.col("elements")).alias("has_consent_signal"),
        links_with_text(F.col("elements")).alias("links_with_text"),
        images(F.col("elements")).alias("images"),
        F.col("html").rlike(r"(?i)mailto:|tel:|<form\b").alias("has_contact_markup"),
    )
    df = tx.computed(df, {
        "word_count": tx.word_count(F.col("text")),
        "content_hash": tx.content_hash(F.col("text")),
        "links": F.array_distinct(F.transform("links_with_text", lambda l: l["href"])),
        "linked_types": linked_types(F.col("links_with_text")),
        "external": external_images(F.col("url"), F.col("images")),
        "page_type": page_type(F.col("url"), F.col("body_class")),
    })
    df = df.withColumns({
        "has_privacy_link": F.array_contains("linked_types", "privacy"),
        "has_about_link": F.array_contains("linked_types", "about"),
        "has_contact_link": F.array_contains("linked_types", "contact"),
        "external_images": F.size("external"),
        "external_image_urls": F.array_distinct(F.transform("external", lambda i: i["src"])),
        "images_missing_alt": F.size(F.filter("images", lambda i: i["alt"] == "")),
        "essential_page_type": ux.essential_type(F.col("url")),
    }).drop("external")
    if required is not None:
        df = (
            df.withColumn("url_hash", ux.url_hash(F.col("url")))
            .join(required.select("url_hash", "required_type"), "url_hash", "left")
            .withColumn("essential_page_type", F.coalesce("required_type", "essential_page_type"))
            .drop("required_type", "url_hash")
        )
    if ads is None:
        return df.withColumns({
            "ads_txt_status": F.lit(None).cast("int"), "ads_txt_present": F.lit(False),
            "ads_txt_lines": F.lit(0), "ads_txt_has_google": F.lit(False),
        })
    # pages that cannot match get their own key each, so a shuffled join stays even
    key = F.when(F.col("page_type") == "home", ux.origin(F.col("url"))).otherwise(
        F.concat(F.lit("#"), F.xxhash64("url").cast("string"))
    )
    return df.withColumn("origin", key).join(ads_txt_signals(ads), "origin", "left").drop("origin").withColumns({
        "ads_txt_present": F.coalesce("ads_txt_present", F.lit(False)),
        "ads_txt_lines": F.coalesce("ads_txt_lines", F.lit(0)),
        "ads_txt_has_google": F.coalesce("ads_txt_has_google", F.lit(False)),
    })
