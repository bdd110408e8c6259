"""URL expressions. One tolerant pattern splits a URL, so odd input never turns into null or an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions import text as tx, vocab

PATTERN = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
HOST_PORT = r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
VALID = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:\[[0-9A-Fa-f:.]+\]|[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.?)(?::[0-9]{1,5})?(?:[/?#][\x21-\x7E]*)?$"


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, PATTERN, 1)


def authority(url: Column) -> Column:
    return F.regexp_extract(url, PATTERN, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATTERN, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PATTERN, 4)


def host(url: Column) -> Column:
    return F.regexp_extract(authority(url), HOST_PORT, 1)


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), HOST_PORT, 2)


def path_or_root(url: Column) -> Column:
    p = path(url)
    return F.when(p == "", "/").otherwise(p)


def split(url: Column, body) -> Column:
    """Binds the parts of a URL once: ``body`` receives a struct with s, a, h, port, p, q and the URL as u."""
    def first(u: Column) -> Column:
        return F.struct(
            u.alias("u"), scheme(u).alias("s"), authority(u).alias("a"), path(u).alias("p"), query(u).alias("q")
        )

    def second(o: Column) -> Column:
        return F.struct(
            o["u"].alias("u"), o["s"].alias("s"), o["a"].alias("a"), o["p"].alias("p"), o["q"].alias("q"),
            F.regexp_extract(o["a"], HOST_PORT, 1).alias("h"), F.regexp_extract(o["a"], HOST_PORT, 2).alias("port"),
        )

    return tx.let(tx.let(tx.let(url, first), second), body)


def _port_suffix(u: Column) -> Column:
    return F.when(u["port"] == "", "").otherwise(F.concat(F.lit(":"), u["port"]))


def _query_suffix(u: Column) -> Column:
    return F.when(u["q"] == "", "").otherwise(F.concat(F.lit("?"), u["q"]))


def _root_path(u: Column) -> Column:
    return F.when(u["p"] == "", "/").otherwise(u["p"])


def _clean_path(p: Column) -> Column:
    def fold(parts: Column) -> Column:
        return F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
                F.concat(acc, F.array(s))
            ),
        )

    parts = F.filter(F.split(p, "/"), lambda s: ~s.isin("", "."))
    joined = tx.let(parts, lambda x: F.concat(F.lit("/"), F.array_join(F.when(p.contains(".."), fold(x)).otherwise(x), "/")))
    return tx.let(joined, lambda j: F.when((j != "/") & p.endswith("/"), F.concat(j, F.lit("/"))).otherwise(j))


def normalize(url: Column) -> Column:
    """Lower scheme and host, clean path, keep port and query, drop fragment and user info."""
    def build(u: Column) -> Column:
        rebuilt = F.concat(
            F.lower(u["s"]), F.lit("://"), F.lower(F.regexp_replace(u["h"], r"\.+$", "")), _port_suffix(u),
            tx.let(_root_path(u), _clean_path), _query_suffix(u),
        )
        return F.when((u["s"] == "") | (u["h"] == ""), u["u"]).otherwise(rebuilt)

    return split(tx.trim(url), build)


def is_valid(url: Column) -> Column:
    return url.rlike(VALID)


def _origin(u: Column) -> Column:
    """Null for an address without a host."""
    return F.when(u["h"] != "", F.concat(F.when(u["s"] == "", "https").otherwise(u["s"]), F.lit("://"), u["h"], _port_suffix(u)))


def origin(url: Column) -> Column:
    return split(url, _origin)


def resolve(base: Column, candidate: Column) -> Column:
    """Absolute normalised form of a link, or null when it is not a page address."""
    def absolute(b: Column, c: Column) -> Column:
        folder = F.regexp_replace(_root_path(b), r"[^/]*$", "")
        return (
            F.when((c["u"] == "") | c["u"].startswith("#") | c["u"].rlike(r"(?i)^(?:mailto|tel|javascript|data):"), None)
            .when(is_valid(c["u"]), c["u"])
            .when((b["s"] == "") | (b["h"] == ""), None)
            .when(c["u"].startswith("//"), F.concat(b["s"], F.lit(":"), c["u"]))
            .when(c["p"].startswith("/"), F.concat(_origin(b), c["p"], _query_suffix(c)))
            .otherwise(F.concat(_origin(b), folder, c["p"], _query_suffix(c)))
        )

    return normalize(split(base, lambda b: split(tx.unescape(tx.trim(candidate)), lambda c: absolute(b, c))))


def host_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(host(url)), r"^www\.", "")


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def crawlable(start: Column, url: Column) -> Column:
    return split(url, lambda u: tx.let(host_key(start), lambda own: (
        (own != "")
        & (own == F.regexp_replace(F.lower(u["h"]), r"^www\.", ""))
        & F.lower(u["s"]).isin("http", "https")
        & ~F.lower(u["p"]).rlike(vocab.ASSET_SUFFIXES)
    )))


def _ipv4(h: Column) -> Column:
    parts = F.split(h, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + F.get(parts, F.lit(i)).try_cast("long")
    ok = h.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}") & h.rlike(r"^[0-9.]+$") & (F.size(parts) == 4)
    return F.when(ok, number)


# private and reserved IPv4 blocks (first address, prefix length)
RESERVED_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12),
    ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24),
    ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]


def v4_ranges() -> list[tuple[int, int]]:
    out = []
    for address, bits in RESERVED_V4:
        first = 0
        for part in address.split("."):
            first = first * 256 + int(part)
        out.append((first, first + 2 ** (32 - bits) - 1))
    return out


def safety(url: Column) -> Column:
    """Reason a URL must not be fetched, or null when its syntax is safe."""
    def reason(u: Column) -> Column:
        s, p = F.lower(u["s"]), u["port"]

        def by_host(h: Column) -> Column:
            def private(ip: Column) -> Column:
                out = F.lit(False)
                for low, high in v4_ranges():
                    out = out | ip.between(low, high)
                return out

            v6 = h.rlike(r"^\[(?:::1?|::ffff:.*|f[cd].*|fe[89ab].*|ff.*|2001:db8.*|64:ff9b:.*)\]$")
            return (
                F.when((s == "") | (h == ""), "incomplete")
                .when(~s.isin("http", "https"), "scheme")
                .when(u["a"].contains("@"), "credentials")
                .when((p != "") & ~p.isin("80", "443"), "port")
                .when((h == "localhost") | h.rlike(r"\.(?:localhost|local|internal)$"), "local_host")
                .when(F.coalesce(tx.let(_ipv4(h), private), F.lit(False)) | v6, "private_address")
            )

        return tx.let(F.lower(F.regexp_replace(u["h"], r"\.+$", "")), by_host)

    return split(url, reason)


def post_sitemap(url: Column) -> Column:
    name = F.lower(F.regexp_extract(path(url), r"([^/]*)/*$", 1))
    return name.rlike(r"^posts?-sitemap\d*\.xml(?:\.gz)?$|^wp-sitemap-posts-post-\d+\.xml(?:\.gz)?$")


def decoded_path(url: Column) -> Column:
    """Percent-decoded path; a plus sign stays a plus sign, broken escapes stay as they are."""
    p = path_or_root(url)
    return F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)


def listing(url: Column, body_class: Column) -> Column:
    p = F.lower(F.regexp_replace(decoded_path(url), r"^/+|/+$", ""))
    return (
        p.rlike(r"(?:^|/)(?:tag|tags|category|categories|author|search)(?:/|$)")
        | p.rlike(r"(?:^|/)(?:blog|news|archive|archives)/page/[0-9]+(?:/|$)")
        | query(url).rlike(r"(?:^|&)(?:tag|cat|category|author|s|search)(?:\[|=|&|$)")
        | F.lower(F.coalesce(body_class, F.lit(""))).rlike(
            r"(?:^|\s)(?:archive|category|tag|tax|author|search|post-type-archive)(?:-|\s|$)"
        )
    )


def home(url: Column) -> Column:
    return path(url).isin("", "/")


def same_site_external(source_host: Column, candidate: Column) -> Column:
    c = F.lower(host(candidate))
    return (
        (c == source_host)
        | c.endswith(F.concat(F.lit("."), source_host))
        | source_host.endswith(F.concat(F.lit("."), c))
    )


def essential_type(url: Column, link_text: Column | None = None) -> Column:
    """Which required publisher page a URL (or its link text) points at."""
    def match(h: Column) -> Column:
        out = F.when(h.startswith("|"), "home")
        for kind, slugs in vocab.PAGE_SLUGS.items():
            out = out.when(h.rlike("|".join(slugs)), kind)
        return out

    p = tx.slug(F.regexp_replace(decoded_path(url), r"^/+|/+$", ""))
    label = F.lit("") if link_text is None else tx.slug(link_text)
    return tx.let(F.concat(p, F.lit("|"), label), match)


def site_slug(sites: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Unique slug per new site; equal base slugs are numbered -2, -3, … in id order.

    ``sites`` holds (id, domain). ``existing`` holds (slug) already taken. A numbered slug may be the base of another
    site or be taken; such sites, the higher ids, get the next numbers of their base until no slug is given twice.
    """
    from sitegauge.operators.numbering import number_in_group
    from sitegauge.session import cut

    base = sites.select("id", "domain", tx.slug(F.replace(F.col("domain"), F.lit("."), F.lit("-"))).alias("base"))
    pending = number_in_group(base, ["base"], "id", "n")
    named = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))
    taken = existing.select("slug").distinct() if existing is not None else None
    given = None
    while True:
        tried = pending.withColumn("slug", named)
        first = tried.groupBy("slug").agg(F.min("id").alias("id"))
        if taken is not None:
            first = first.join(taken, "slug", "left_anti")
        won = cut(tried.join(first, ["slug", "id"], "left_semi").select("id", "domain", "slug", "base", "n"))
        lost = cut(tried.join(won.select("id"), "id", "left_anti").select("id", "domain", "base"))
        given = won if given is None else given.unionByName(won)
        if lost.isEmpty():
            return given.select("id", "domain", "slug")
        top = pending.groupBy("base").agg(F.max("n").alias("top"))
        pending = cut(number_in_group(lost, ["base"], "id", "k").join(top, "base").select("id", "domain", "base", (F.col("k") + F.col("top")).alias("n")))
        taken = won.select("slug") if taken is None else cut(taken.unionByName(won.select("slug")))


def site_register(requests: DataFrame, sites: DataFrame) -> DataFrame:
    """New (user_id, domain) rows; a null user equals a null user; the lowest request id wins."""
    first = requests.groupBy("user_id", "domain").agg(F.min("request_id").alias("request_id"))
    known = sites.select(F.col("user_id").alias("k_user"), F.col("domain").alias("k_domain"))
    return first.join(
        known, (F.col("domain") == F.col("k_domain")) & F.col("user_id").eqNullSafe(F.col("k_user")), "left_anti"
    )
