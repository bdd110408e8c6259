"""SQL building blocks for the reference answers (DuckDB dialect). Used for checking only."""

from __future__ import annotations

from sitegauge.functions import html as hx, text as tx, url as ux, vocab


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def ext(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def every(x: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def trim(x: str) -> str:
    return sub(x, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$")


def collapse(x: str) -> str:
    return f"trim({sub(x, tx.SPACE, ' ')}, ' ')"


_NAMES = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in vocab.ENTITIES.items()) + "}"


def unescape(x: str) -> str:
    named = (
        f"list_reduce(list_distinct({every(x, '&([A-Za-z][A-Za-z0-9]*);', 1)}), "
        f"lambda acc, m: replace(acc, '&' || m || ';', coalesce({_NAMES}[m], '&' || m || ';')), {x})"
    )
    cp = "case when lower(m[1]) = 'x' then ('0x' || m[2:])::int else m::int end"
    numeric = (
        f"list_reduce(list_distinct(regexp_extract_all(n, '&#([0-9]{{1,7}}|[xX][0-9A-Fa-f]{{1,6}});', 1)), "
        f"lambda acc, m: replace(acc, '&#' || m || ';', chr({cp})), n)"
    )
    return f"(select replace({numeric}, '&amp;', '&') from (select {named} as n))"


def slug(x: str) -> str:
    out = f"translate(lower({x}), {q(vocab.ASCII_FROM)}, {q(vocab.ASCII_TO)})"
    for char, pair in vocab.ASCII_PAIRS.items():
        out = f"replace({out}, {q(char)}, {q(pair)})"
    return sub(sub(out, r"[^a-z0-9]+", "-"), r"^-+|-+$")


def normalized(x: str) -> str:
    return collapse(sub(f"lower({x})", r"[^\p{L}\p{N}\s\p{Z}]+", " "))


def words(x: str) -> str:
    return f"len({every(x, tx.WORD.replace('++', '+').replace('*+', '*'))})"


def attribute(tag: str, name: str) -> str:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return unescape(f"({ext(tag, pattern, 1)} || {ext(tag, pattern, 2)} || {ext(tag, pattern, 3)})")


def has_attribute(tag: str, name: str) -> str:
    return hit(tag, rf"""(?is)\s{name}(?:[\s=>/]|\z)""")


def parts(source: str, url: str, prefix: str, keep: str = "*") -> str:
    """SELECT adding <prefix>_s/_a/_p/_q/_h/_port columns for a URL column."""
    a = ext(url, ux.PATTERN, 2)
    return (
        f"select {keep}, {ext(url, ux.PATTERN, 1)} as {prefix}_s, {a} as {prefix}_a, {ext(url, ux.PATTERN, 3)} as {prefix}_p, "
        f"{ext(url, ux.PATTERN, 4)} as {prefix}_q, {ext(a, ux.HOST_PORT, 1)} as {prefix}_h, {ext(a, ux.HOST_PORT, 2)} as {prefix}_port from {source}"
    )


def clean_path(p: str) -> str:
    segs = f"list_filter(string_split({p}, '/'), lambda s: s not in ('', '.'))"
    # '..' folded by counting: a segment survives when no later '..' cancels it
    fold = (
        f"list_reduce({segs}, lambda acc, s: case when s = '..' then regexp_replace(acc, '/[^/]*$', '') else acc || '/' || s end, '')"
    )
    return (
        f"(select case when j = '' then '/' when suffix(pp, '/') then j || '/' else j end "
        f"from (select {fold} as j, {p} as pp))"
    )


def normalize(prefix: str, raw: str) -> str:
    """Normalised URL from the columns made by ``parts``; ``raw`` is the trimmed input."""
    p = f"(case when {prefix}_p = '' then '/' else {prefix}_p end)"
    return (
        f"case when {prefix}_s = '' or {prefix}_h = '' then {raw} else lower({prefix}_s) || '://' || "
        f"lower({sub(f'{prefix}_h', r'\.+$')}) || case when {prefix}_port = '' then '' else ':' || {prefix}_port end || "
        f"{clean_path(p)} || case when {prefix}_q = '' then '' else '?' || {prefix}_q end end"
    )


def host(url: str) -> str:
    return ext(ext(url, ux.PATTERN, 2), ux.HOST_PORT, 1)


def path(url: str) -> str:
    return ext(url, ux.PATTERN, 3)


def path_or_root(url: str) -> str:
    return f"coalesce(nullif({path(url)}, ''), '/')"


def decoded(url: str) -> str:
    return f"url_decode({path_or_root(url)})"


def essential(url: str, label: str = "''") -> str:
    p = slug(sub(decoded(url), r"^/+|/+$"))
    arms = " ".join(f"when {hit('hay', '|'.join(s))} then {q(k)}" for k, s in vocab.PAGE_SLUGS.items())
    return (
        f"(select case when pn = '' then 'home' {arms} end from (select pn, pn || '|' || ln as hay "
        f"from (select {p} as pn, {slug(label)} as ln)))"
    )


def host_key(url: str) -> str:
    return sub(f"lower({host(url)})", r"^www\.")


def listing(url: str, cls: str = "''") -> str:
    p = f"lower({sub(decoded(url), r'^/+|/+$')})"
    return (
        f"({hit(p, r'(?:^|/)(?:tag|tags|category|categories|author|search)(?:/|$)')} or "
        f"{hit(p, r'(?:^|/)(?:blog|news|archive|archives)/page/[0-9]+(?:/|$)')} or "
        f"{hit(ext(url, ux.PATTERN, 4), r'(?:^|&)(?:tag|cat|category|author|s|search)(?:\[|=|&|$)')} or "
        f"{hit(f'lower({cls})', r'(?:^|\s)(?:archive|category|tag|tax|author|search|post-type-archive)(?:-|\s|$)')})"
    )


def inside(x: str, values: list[str]) -> str:
    return f"{x} in ({', '.join(q(v) for v in values)})"


def pick(values: list[str], key: str) -> str:
    return f"([{', '.join(q(v) for v in values)}])[{key} + 1]"


def severity_rank(x: str = "severity") -> str:
    return f"case {x} when 'critical' then 1 when 'high' then 2 when 'review' then 3 else 4 end"


# ------------------------------------------------------------------ shared CTEs

PAGES = f"pg as (select page_id, url, html, lower({host('url')}) as grp from pages)"

RESPONSES = PAGES + """, rs as (select page_id as position, page_id, grp, url, html,
 case when page_id % 17 = 0 then 404 else 200 end as status,
 case when page_id % 11 = 0 then '' when page_id % 13 = 0 then 'application/pdf' else 'text/html; charset=utf-8' end as ctype from pg)"""

_INNER = f"case when {hit('kept', '(?i)<body' + chr(92) + 'b')} then {ext('kept', hx.BODY)} else {sub('kept', hx.HEAD)} end"
TEXT = PAGES + f""", t0 as (select *, {sub('html', hx.COMMENT)} as clean from pg),
t1 as (select *, {sub(sub('clean', hx.SCRIPT_BODY, chr(92) + '1'), hx.STYLE_BODY, chr(92) + '1')} as elements, {sub('clean', hx.RAW)} as kept from t0),
t2 as (select *, {_INNER} as inner_html from t1),
tx as (select *, {collapse(unescape(sub('inner_html', hx.TAG)))} as text from t2)"""

LINKS = (
    "ln as (select page_id, url, grp, i, "
    + attribute("h", "href") + " as href, "
    + collapse(unescape(sub("b", hx.TAG))) + " as label from (select page_id, url, grp, unnest(range(1, len(hs) + 1)) as i, "
    "unnest(hs) as h, unnest(bs) as b from (select page_id, url, grp, "
    + every("elements", hx.ANCHOR, 1) + " as hs, " + every("elements", hx.ANCHOR, 2) + " as bs from tx)) where "
    + has_attribute("h", "href") + ")"
)

SIGNALS = TEXT + f""", sg as (select page_id, url, grp, html, text, {trim(unescape(ext('clean', r'(?is)<title' + chr(92) + r'b[^>]*>(.*?)(?:</title' + chr(92) + r's*>|' + chr(92) + 'z)')))} as title,
 {words('text')} as word_count, len({every('elements', r'(?i)<h1[\s/>]')}) as h1_count, len({every('kept', r'(?i)<p[\s/>]')}) as paragraph_count,
 sha256({normalized('text')}) as content_hash, {normalized('text')} as norm,
 case when {path('url')} in ('', '/') then 'home' when {listing('url')} then 'listing' else 'content' end as page_type,
 {ext('url', ux.PATTERN, 1)} as scheme from tx)"""

_RULES = [
    ("content.thin-page", "word_count < 300", "Content quality", "case when word_count < 150 then 'high' else 'review' end", 92),
    ("content.low-editorial-structure", "word_count >= 300 and word_count < 600 and paragraph_count < 3", "Content quality", "'review'", 76),
    ("content.document-structure", "title = '' or h1_count <> 1", "Content quality", "'info'", 98),
    ("technical.no-https", "scheme <> 'https'", "Technical trust", "'high'", 100),
]
RULE_ROWS = SIGNALS + ", rl as (" + " union all ".join(
    f"select page_id, grp, url, {i} as rule_position, {q(k)} as rule_key, {q(c)} as category, {s} as severity, {conf} as confidence, "
    f"sha256(concat_ws('|', {q(k)}, lower(url), '')) as fingerprint from sg where {pred}"
    for i, (k, pred, c, s, conf) in enumerate(_RULES)
) + ")"

_RULE_KEYS = [
    "content.thin-page", "ai.sensitive_claims", "ads.browser-intrusive-overlay", "copyright.external-content-match",
    "duplicate.internal-near-match", "privacy.missing-disclosure-link", "privacy.consent-signal-missing", "technical.no-https",
    "publisher.required-pages-missing",
]
FINDINGS = f"""fb0 as (select *, (l_quantity * 2)::int as confidence0, {pick(_RULE_KEYS, 'l_suppkey % 9')} as rule0 from lineitem),
fb as (select l_orderkey as website_id, l_orderkey as scan_id, l_partkey as page_id, rule0 as rule_key, {pick(vocab.CATEGORIES, 'l_partkey % 9')} as category,
 {pick(vocab.SEVERITIES, 'l_linenumber % 4')} as severity, confidence0 as confidence,
 case when l_returnflag = 'R' then 'resolved' when l_returnflag = 'A' then 'open' when l_linestatus = 'O' then 'investigating' else 'remediating' end as status,
 sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, confidence0)) as fingerprint,
 'Finding ' || rule0 as title, 'part ' || l_partkey as summary, 'policy reference' as policy_reference,
 (l_shipdate - interval 30 day) as first_seen_at, l_shipdate as last_seen_at,
 case when l_returnflag = 'R' then l_shipdate end as resolved_at, l_linenumber, l_partkey, l_suppkey from fb0)"""

SCANS = f"""sc as (select o_orderkey as scan_id, o_custkey as website_id,
 case when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'O' then (case when o_orderkey % 3 = 0 then 'queued' else 'running' end) else 'partial' end as status,
 {pick(vocab.SCAN_TYPES, 'o_orderkey % 5')} as type, (o_orderkey % 101)::int as score, o_orderdate as created_at, o_orderdate as finished_at,
 (o_orderkey % 97 + 1)::int as pages_discovered, (o_orderkey % 89)::int as pages_scanned, (o_orderkey % 13)::int as pages_reused,
 (o_orderkey % 95)::int as progress, (o_orderkey % 7)::int as ai_pages_analyzed, (o_orderkey % 2 = 0) as ai_assessed,
 (o_orderkey % 4)::int as ai_errors, (o_orderkey % 5 = 0) as is_sampled from orders)"""

SITES = """ws as (select c_custkey as website_id, c_nationkey::bigint as user_id, c_name as name, lower(replace(c_name, '#', '-')) || '.example' as domain,
 'https://' || lower(replace(c_name, '#', '-')) || '.example/' as start_url,
 case when c_custkey % 11 = 0 then 'disabled' when c_custkey % 7 = 0 then 'scanning' when c_custkey % 5 = 0 then 'pending'
  when c_custkey % 101 < 70 then 'critical' when c_custkey % 101 < 80 then 'high' when c_custkey % 101 < 90 then 'review' else 'healthy' end as status,
 (c_custkey % 101)::int as overall_score, (c_custkey % 40)::int as pages_count, (c_custkey % 23)::int as last_discovered_pages,
 (c_custkey % 19)::int as last_scanned_pages, (c_custkey % 6 = 0) as last_scan_partial, (c_custkey % 17)::int as open_findings_count,
 case when c_custkey % 3 <> 0 then timestamp '2001-05-01' + to_days((c_custkey % 60)::int) end as last_scanned_at,
 case when c_custkey % 4 <> 0 then timestamp '2001-05-01' + to_days((c_custkey % 90)::int) end as next_scan_at, c_mktsegment as segment from customer)"""

SITE_FINDINGS = FINDINGS + """, sf as (select fb.* exclude (website_id, page_id), o_custkey as website_id,
 case when l_linenumber <> 7 then page_id end as page_id,
 'MG-' || strftime(first_seen_at, '%y%m%d') || '-' || upper(left(fingerprint, 16)) as public_id from fb join orders on o_orderkey = scan_id)"""

_KIND = f"case when p_partkey % 12 < 8 then {pick(vocab.PAGE_TYPES, 'p_partkey % 12')} end"
SITE_PAGES = f"""sp as (select p_partkey as page_id, (p_partkey % 150) as website_id, p_name as title,
 'https://example.com/' || lower(replace(p_name, ' ', '-')) || '/' || p_partkey as url,
 case when p_partkey % 29 = 0 then 404 when p_partkey % 31 = 0 then 301 else 200 end as status_code,
 case when p_partkey % 9 <> 0 then lower(left(p_type, 2)) end as language, (p_size * 20)::int as word_count, (p_partkey % 5)::int as ad_count,
 {_KIND} as essential_page_type, (p_partkey % 37 <> 0) as scanned from part)"""

TARGETS = f"""tg as (select lower({host('url')}) as scan_id, page_id, url, sha256(url) as url_hash, page_id as position,
 case page_id % 10 when 0 then 'failed' when 1 then 'queued' when 2 then 'running' when 3 then 'reused' when 4 then 'reused' else 'completed' end as status from pages)"""

SCAN_TARGETS = """st as (select l_orderkey as scan_id, l_partkey as page_id, l_suppkey as batch_number,
 case (l_partkey + l_linenumber) % 10 when 0 then 'failed' when 1 then 'queued' when 2 then 'running' when 3 then 'reused' when 4 then 'reused' else 'completed' end as status,
 (l_linenumber % 3)::int as findings_count, (l_linenumber % 2)::int as ai_findings_count, (l_quantity * 10)::bigint as input_tokens,
 l_quantity::bigint as output_tokens, (l_linenumber % 2 = 0) as ai_attempted, (l_linenumber % 4 = 0) as ai_analyzed from lineitem)"""

VIEWS = "vw as (select ts, event_id, '/' || (props->>'$.k') as path from events where event_type = 'view')"

MODERATION = """md as (select doc_id, 'https://docs.example/' || doc_id as url, case when doc_id % 19 = 0 then 'failure' else 'success' end as status,
 case when toxic = 1 and doc_id % 2 = 0 then 0.9 when toxic = 1 then 0.6 else 0.2 end::double as toxic, (1 - quality)::double as low_quality from labels)"""

PREVIOUS = """pv as (select page_id, sha256(url) as url_hash, case when page_id % 5 = 0 then sha256('old') else content_hash end as content_hash,
 case when page_id % 13 = 0 then '1.1.1' else '1.4.0' end as ruleset_version, case when page_id % 11 = 0 then 'ads' else 'full' end as scan_type,
 (page_id % 3 = 0) as browser_audited, (page_id % 2 = 0) as external_copy_checked from sg where page_id % 7 <> 0)"""


def _sketch_sql(source: str) -> str:
    """Sketch rows (grp, id, position, h, sh, n) of eligible rows (grp, id, position, norm)."""
    return f"""w as (select grp, id, position, unnest(string_split(norm, ' ')) as w, unnest(range(1, len(string_split(norm, ' ')) + 1)) as i from {source}),
s4 as (select grp, id, position, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o as sh from w window o as (partition by grp, id order by i)),
shg as (select distinct grp, id, position, sh from s4 where sh is not null),
hs as (select *, left(sha1(sh), 16) as h from shg),
rk as (select *, row_number() over (partition by grp, id order by h) as r from hs),
sk as (select grp, id, position, h, sh, count(*) over (partition by grp, id) as n from rk where r <= 128)"""


MATCH = """pr as (select a.grp, a.id, a.position, b.id as matched_id, b.position as matched_position, a.n as na, b.n as nb, count(*) as shared, min(a.h) as mh
 from sk a join sk b on a.grp = b.grp and a.h = b.h and b.position < a.position group by all),
jc as (select *, shared / (na + nb - shared) as j from pr),
mt as (select * from (select *, row_number() over (partition by grp, id order by j desc, shared desc, mh, matched_position) as r from jc) where r = 1 and j >= 0.86)"""

DUP_PAGES = SIGNALS + ", el as (select grp, page_id as id, page_id as position, norm, url from sg where word_count >= 150 and page_type <> 'listing'), " + _sketch_sql("el") + ", " + MATCH
DUP_PAGES_ALL = SIGNALS + ", el as (select 'all' as grp, page_id as id, page_id as position, norm, url from sg where word_count >= 150 and page_type <> 'listing'), " + _sketch_sql("el") + ", " + MATCH
_DOC = f"el as (select %s as grp, doc_id as id, doc_id as position, {normalized('text')} as norm from documents where {words('text')} >= 150), "
DUP_DOCS = _DOC % "source" + _sketch_sql("el") + ", " + MATCH
DUP_DOCS_ALL = _DOC % "'all'" + _sketch_sql("el") + ", " + MATCH

ODD_URLS = PAGES + """, od as (select page_id, url, grp, case page_id % 8 when 1 then regexp_replace(url, '^https?://', 'HTTPS://user:pw@')
 when 2 then replace(url, '.example.', '.EXAMPLE.') when 3 then regexp_replace(url, '[?#].*$', '') || '/../x/./y//z/'
 when 4 then ' ' || chr(9) || url || chr(10) || ' ' when 5 then regexp_replace(url, '\\.(com|net|org)', '.\\1.:8080')
 when 6 then 'not a url ' || page_id when 7 then replace(url, '://', '://www.') else url end as odd from pg), odt as (select *, """ + trim("odd") + " as raw from od)"

UNSAFE_URLS = """us as (select page_id, case page_id % 12 when 1 then 'file:///etc/' || page_id when 2 then 'http://10.0.' || (page_id % 256) || '.1/'
 when 3 then 'https://172.' || (page_id % 256) || '.0.1/a' when 4 then 'http://[::1]/x' when 5 then 'https://host' || page_id || '.internal/'
 when 6 then regexp_replace(url, '^https?://', 'https://user:pass@') when 7 then regexp_replace(url, '\\.(com|net|org)/', '.\\1:8443/')
 when 8 then 'http://' || (page_id % 256) || '.8.8.8/' else url end as candidate from pages)"""

ODD_LINKS = TEXT + ", " + LINKS + """, ol as (select page_id, url, grp, i - 1 as i, href, label, case (page_id + i - 1) % 9 when 0 then substr(href, 2) when 1 then '//www.cdn.example.com' || href
 when 2 then 'mailto:' || href when 3 then '#' || href when 4 then '../up' || href || '?a=1&amp;b=2' when 5 then ' '
 when 6 then 'https://other.example.org' || href || '/img.PNG' when 7 then '?page=' || (i - 1) else href end as candidate from ln)"""


def resolved(source: str, base: str, candidate: str, keep: str) -> str:
    """CTE text: rows of ``source`` with the resolved link as column ``resolved``."""
    c1 = f"select *, {unescape(trim(candidate))} as c from {source}"
    target = (
        f"case when c = '' or c[1] = '#' or {hit('c', '(?i)^(?:mailto|tel|javascript|data):')} then null "
        f"when {hit('c', ux.VALID)} then c "
        f"when {ext(base, ux.PATTERN, 1)} = '' or {host(base)} = '' then null "
        f"when prefix(c, '//') then {ext(base, ux.PATTERN, 1)} || ':' || c "
        f"else {ext(base, ux.PATTERN, 1)} || '://' || {host(base)} || "
        f"coalesce(':' || nullif({ext(ext(base, ux.PATTERN, 2), ux.HOST_PORT, 2)}, ''), '') || "
        f"case when prefix({path('c')}, '/') then '' else {sub(path_or_root(base), '[^/]*$')} end || {path('c')} || "
        f"coalesce('?' || nullif({ext('c', ux.PATTERN, 4)}, ''), '') end"
    )
    c2 = f"select *, {target} as raw from ({c1})"
    return f"select {keep}, {normalize('r', 'raw')} as resolved from ({parts('(' + c2 + ')', 'raw', 'r')})"

LISTING_URLS = """lu0 as (select page_id, url, regexp_replace(url, '[?#].*$', '') as b, regexp_extract(url, '^https?://[^/]*', 0) as root from pages),
lu as (select page_id, case page_id % 9 when 0 then root || '/' when 1 then root || '/Tag/x' when 2 then b || '?s=term' when 3 then root || '/blog/page/2'
 when 4 then root || '/c%61tegory/x+y' when 5 then b || '?a=1&cat[]=2#f' when 6 then root else url end as u,
 case when page_id % 9 = 8 then 'Post Archive-list' else 'post tagged' end as cls from lu0)"""

ESSENTIAL_URLS = f"""eu as (select page_id, regexp_extract(url, '^https?://[^/]*', 0) || {pick(["/Privacy-Policy", "/legal/dmca/", "/editorial_guidelines", "/mi%E1%BB%85n-tr%E1%BB%AB-tr%C3%A1ch-nhi%E1%BB%87m", "/terms", "/li%C3%AAn-h%E1%BB%87", "/gi%E1%BB%9Bi+thi%E1%BB%87u", "/ten-facts-about-cats", "", "/other"], 'page_id % 10')} as u,
 {pick(["", "Giới thiệu", "Điều khoản sử dụng", "Cookies", "news"], 'page_id % 5')} as label from pages)"""

DECORATED_IMAGES = f"""im as (select page_id, {host('url').join(['lower(', ')'])} as own, unnest([0, 1, 2, 3]) as i,
 unnest(['/local.png', 'https://cdn.example/' || page_id || '.jpg', '//cdn.example/x.jpg', 'https://cdn.example/' || page_id || '.jpg']) as src,
 unnest(['a', '', 'b & c', '']) as alt from pages where contains(html, '<body>'))"""

DECORATED_LINKS = TEXT + ", " + LINKS + """, dl as (select page_id, href, label from ln union all
 select page_id, unnest(case page_id % 5 when 0 then ['/gioi-thieu', '/p1'] when 1 then ['/contact', 'https://x.example/'] else [] end) as href,
 unnest(case page_id % 5 when 0 then ['x', 'Chính sách bảo mật'] when 1 then ['Talk', 'Home'] else [] end) as label from pages)"""

ADS_TXT = PAGES + """, ag as (select grp, count(*) as n from pg group by grp),
adt0 as (select 'https://' || grp as origin, case when n % 5 = 0 then 404 else 200 end as status, case length(grp) % 4
 when 0 then ['# only a comment', '', '  '] when 1 then ['Google.com, pub-1, DIRECT', ' # c', 'other.com, ' || n] when 2 then ['a.com, 1, RESELLER', '', 'b.com, ' || n]
 else ['google.com, pub-2'] end as raw from ag),
adt as (select origin, status, list_filter(list_transform(raw, lambda x: trim(x)), lambda x: x <> '' and x[1] <> '#') as l from adt0)"""

SIGNAL_ROWS = f"""sr0 as (select doc_id as page_id, doc_id as k, text, {words('text')} as word_count, {slug('text')} as body from documents),
sr as (select *, case when k % 7 = 0 then 'http' else 'https' end || '://site' || (k % 50) || '.example' || case when k % 9 = 1 then '/' else '/p/' || k end as url,
 k % 9 = 1 as home, case when k % 10 = 0 then '' else 'title' end as title, k % 3 as h1_count, k % 5 as paragraph_count, k % 12 as ad_count,
 word_count // greatest(k % 12, 1) as ratio, k % 4 as external_images,
 ([null, 'home', {', '.join(q(t) for t in vocab.LINKED_TYPES)}])[k % 9 + 1] as kind,
 {', '.join(f"k % {i + 2} <> 0 as l_{t}" for i, t in enumerate(vocab.LINKED_TYPES))},
 k % 2 = 0 as consent, k % 5 <> 0 as ads_present, k % 4 = 0 as ads_google, k % 8 = 5 as contact_markup from sr0)"""


def _terms(kind: str) -> list[str]:
    checks = [hit("body", "|".join(t.replace(" ", "-") for t in terms)) for terms in vocab.PAGE_TERMS.get(kind, {}).values()]
    if kind == "contact":
        checks.append(f"(contact_markup or {hit('text', r'(?i)[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_.-]+\.[a-z]{2,}')})")
    return checks + [f"word_count >= {vocab.PAGE_MIN_WORDS[kind]}"]


_ATTR = r"(?:^|[^\p{L}\p{N}_])(?:source|credit|courtesy|licensed?|photo by)(?:[^\p{L}\p{N}_]|$)|[\p{L}\p{N}_]©[\p{L}\p{N}_]"
_MISSING = " and ".join(f"l_{t}" for t in vocab.LINKED_TYPES)
RULES = {
    "rule_content_thin": ("content.thin-page", "word_count < 300", "Content quality", "case when word_count < 150 then 'high' else 'review' end", "92"),
    "rule_content_structure": ("content.low-editorial-structure", "word_count >= 300 and word_count < 600 and paragraph_count < 3", "Content quality", "'review'", "76"),
    "rule_document_structure": ("content.document-structure", "title = '' or h1_count <> 1", "Content quality", "'info'", "98"),
    "rule_copyright_media": ("copyright.media-provenance-unverified", f"external_images > 0 and not {hit('lower(text)', _ATTR)}", "Copyright",
                             "case when external_images >= 3 then 'high' else 'review' end", "case when external_images >= 3 then 82 else 68 end"),
    "rule_ads_no_content": ("ads.on-page-without-content", "ad_count > 0 and word_count < 80", "Ad experience", "'high'", "96"),
    "rule_ads_thin": ("ads.on-thin-content-page", "ad_count > 0 and word_count between 80 and 299", "Ad experience", "case when word_count < 150 or ratio < 100 then 'high' else 'review' end", "93"),
    "rule_ads_density": ("ads.density-review", "ad_count > 0 and word_count >= 300 and (ad_count > 6 or ratio < 220)", "Ad experience", "case when ad_count >= 9 or ratio < 100 then 'high' else 'review' end", "88"),
    "rule_ads_txt_missing": ("ads-txt.missing-or-empty", "home and not ads_present", "Ad experience", "'high'", "98"),
    "rule_ads_txt_google": ("ads-txt.google-entry-review", "home and ads_present and not ads_google", "Ad experience", "'review'", "86"),
    "rule_privacy_link": ("privacy.missing-disclosure-link", "home and not l_privacy", "Privacy & consent", "'high'", "94"),
    "rule_privacy_consent": ("privacy.consent-signal-missing", "home and ad_count > 0 and not consent", "Privacy & consent", "'review'", "72"),
    "rule_publisher_missing": ("publisher.required-pages-missing", f"kind = 'home' and not ({_MISSING})", "Publisher requirements", "'high'", "96"),
    "rule_no_https": ("technical.no-https", "not prefix(url, 'https:')", "Technical trust", "'high'", "100"),
    "rule_identity_links": ("trust.publisher-identity-links", "home and not (l_about and l_contact)", "Content quality", "'review'", "84"),
}
INCOMPLETE = {
    kind: (f"publisher.required-page-incomplete.{kind}", f"kind = '{kind}' and not ({' and '.join(_terms(kind))})",
           "Privacy & consent" if kind == "privacy" else "Publisher requirements", "'high'" if kind == "privacy" else "'review'", "90")
    for kind in vocab.LINKED_TYPES
}


def rule_select(rule: tuple) -> str:
    key, pred, cat, sev, conf = rule
    return (f"select page_id, k, {q(key)} as rule_key, {q(cat)} as category, {sev} as severity, ({conf})::int as confidence, "
            f"sha256({q(key + '|')} || lower(url) || '|') as fingerprint from sr where {pred}")


ALL_RULES = SIGNAL_ROWS + ", ar as (" + " union all ".join(rule_select(r) for r in [*RULES.values(), *INCOMPLETE.values()]) + ")"
SCOPE = ("prefix(rule_key, 'publisher.') or case %s when 'copyright' then category in ('Copyright', 'Duplicate content') when 'ads' then category = 'Ad experience' "
         "when 'privacy' then category = 'Privacy & consent' when 'priority' then severity in ('critical', 'high') else true end")

_CODES = [*vocab.MODEL_CODES, "unknown_code"]
MODEL_ITEMS = f"""mi as (select doc_id as page_id, 'https://docs.example/' || doc_id as url, {pick(_CODES, '(doc_id + s) % 11')} as code,
 {pick(['high', 'review', 'info', 'review'], '(doc_id + s) % 4')} as severity, greatest(0, least(100, (doc_id * 7 + s) % 120 - 5))::int as confidence,
 case when (doc_id + s) % 3 <> 0 then 'Title ' || doc_id end as title, (doc_id + s) % 2 = 0 as advised from labels, (values (0), (3)) v(s))"""

VIEWPORTS = """vp as (select l_partkey as k, count(*) filter (where l_partkey % 6 = 0 and l_linenumber = 1) as near, count(*) filter (where l_partkey % 7 = 0 and l_linenumber = 2) as misleading,
 count(*) filter (where l_partkey % 5 = 0 and l_linenumber = 3) as overlay, max((l_partkey % 10) * 0.06::double + l_linenumber * 0.01::double) as coverage,
 count(*) filter (where l_partkey % 11 = 0 and l_linenumber = 4) as popups, count(*) filter (where l_partkey % 3 = 0 and l_linenumber = 5) as refreshes from lineitem group by 1)"""

_URLS = [*vocab.POLICY_URLS.values(), "https://elsewhere.example/"]
ASSESSMENTS = SCANS + f""", rf as (select scan_id, website_id, i, {pick(_URLS, '(scan_id + i * 2) % 9')} as policy_url, (scan_id + i) % 3 = 0 as fixed, (scan_id + i) % 5 <> 0 as ok
 from sc, (select unnest(range(10)) as i) where ai_assessed and scan_id % 4 <> 0),
rf1 as (select *, case when fixed then 'policy_overview' when contains(policy_url, '/11190248') or contains(policy_url, '/81904') then 'content_overview'
 when contains(policy_url, '/11185755') then 'transparency_overview' when contains(policy_url, '/1348695') then 'adsense_requirements_overview' else 'policy_overview' end as section
 from rf where ok and policy_url <> 'https://elsewhere.example/'),
rf2 as (select scan_id, website_id, section, policy_url, min(i) as i from rf1 group by all),
rfs as (select * from (select *, row_number() over (partition by scan_id order by i) as r from rf2))"""
