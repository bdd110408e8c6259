"""Registered queries: finding fields, rules, near duplicates, external copies, third-party results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitegauge.functions import finding as fd, html as hx, text as tx, url as ux, vocab
from sitegauge.operators import copies as cp, duplicates as dp, normalize as nz, rules as ru, scoring as sc, sources as so
from sitegauge.params import DEFAULT
from sitegauge.plans import oracle as o, views as v
from sitegauge.session import cut

C = F.col
ENTRIES: dict = {}


def add(name, fn, sql=None):
    ENTRIES[name] = (fn, sql)


# ---------------------------------------------------------------- flagship: site score, status, open findings
MINIMUM = [ru.rule_content_thin, ru.rule_content_structure, ru.rule_document_structure, ru.rule_no_https]


def site_overview(s, d):
    pages = v.signals(s, d)
    # findings are stored before they are scored, as in a scan; the score reads them twice
    found = cut(ru.apply_rules(pages, [make(DEFAULT) for make in MINIMUM]).withColumn("website_id", C("grp")))
    hosts = v.pages(s, d).select(C("grp").alias("website_id")).distinct()
    return sc.site_score(found.withColumn("order_key", F.concat_ws("|", F.lpad(C("page_id").cast("string"), 12, "0"), C("rule_position").cast("string"))), hosts).withColumn(
        "status", sc.status_from_score(C("score"))).withColumnRenamed("website_id", "site")


_SCORE = ("select website_id, greatest(0, least(100, floor(100 - least(950000, sum(w * greatest(35, confidence) * "
          "case r when 1 then 100 when 2 then 21 else 15 end)) / 10000.0 + 0.5)))::int as score, count(*) as open_findings from "
          "(select *, row_number() over (partition by website_id, category order by w desc, ok) as r from (%s)) group by website_id")
_W = "case severity when 'critical' then 32 when 'high' then 18 when 'review' then 8 when 'info' then 2 else 0 end"
STATUS = "case when score < 70 then 'critical' when score < 80 then 'high' when score < 90 then 'review' else 'healthy' end"
add("site_overview", site_overview,
    f"with {o.RULE_ROWS}, s1 as ({_SCORE % f'select grp as website_id, category, {_W} as w, confidence, (page_id, rule_position) as ok from rl'}) "
    f"select site, score, open_findings, {STATUS} as status from (select distinct grp as site, coalesce(score, 100) as score, coalesce(open_findings, 0) as open_findings "
    "from pg left join s1 on s1.website_id = pg.grp)")

# ---------------------------------------------------------------- finding record
add("finding_fingerprint", lambda s, d: v.signal_rows(s, d).select("page_id", fd.fingerprint(F.lit("content.thin-page"), F.upper("url"), F.sha2("title", 256)).alias("fingerprint")),
    f"with {o.SIGNAL_ROWS} select page_id, sha256('content.thin-page|' || lower(url) || '|' || sha256(title)) as fingerprint from sr")
add("finding_validate",
    lambda s, d: fd.validate(v.findings(s, d).withColumn("severity", F.when(C("l_partkey") % 10 == 0, "odd").otherwise(C("severity"))).withColumn("confidence", C("confidence") * 2 - 20)).groupBy("severity", "confidence").agg(
        F.count("*").alias("n"), F.count_if(C("reject_reason").isNotNull()).alias("rejected")),
    f"with {o.FINDINGS}, x as (select case when l_partkey % 10 = 0 then 'odd' else severity end as severity, greatest(0, least(100, confidence * 2 - 20))::int as confidence from fb) "
    "select severity, confidence, count(*) as n, count(*) filter (where severity = 'odd') as rejected from x group by all")
add("finding_scope_filter",
    lambda s, d: v.findings(s, d).withColumn("scan_type", F.element_at(F.array(*[F.lit(x) for x in vocab.SCAN_TYPES]), (C("l_suppkey") % 5 + 1).cast("int"))).filter(
        fd.in_scope(C("scan_type"), C("rule_key"), C("category"), C("severity"))).groupBy("scan_type", "category", "severity").agg(F.count("*").alias("n")),
    f"with {o.FINDINGS}, x as (select *, {o.pick(vocab.SCAN_TYPES, 'l_suppkey % 5')} as scan_type from fb) select scan_type, category, severity, count(*) as n from x where {o.SCOPE % 'scan_type'} group by all")
add("finding_public_id", lambda s, d: v.findings(s, d).select("fingerprint", fd.public_id(C("first_seen_at"), C("fingerprint")).alias("public_id")),
    f"with {o.FINDINGS} select fingerprint, 'MG-' || strftime(first_seen_at, '%y%m%d') || '-' || upper(left(fingerprint, 16)) as public_id from fb")
_LABEL = "MAP {" + ", ".join(f"{o.q(k)}: {o.q(x)}" for k, x in vocab.LABELS.items()) + "}"
add("finding_labels", lambda s, d: v.findings(s, d).groupBy(fd.label(C("category")).alias("category_label"), fd.label(C("status")).alias("status_label"), fd.label(C("rule_key")).alias("rule_label")).agg(F.count("*").alias("n")),
    f"with {o.FINDINGS} select coalesce({_LABEL}[category], category) as category_label, coalesce({_LABEL}[status], status) as status_label, coalesce({_LABEL}[rule_key], rule_key) as rule_label, count(*) as n from fb group by all")
def _ref():
    return F.element_at(F.array(F.lit("x"), F.lit("REPLICATED content"), F.lit("about Privacy"), F.lit("ad placement"), F.lit("deceptive")), (C("l_suppkey") % 5 + 1).cast("int"))
_PU = vocab.POLICY_URLS
add("finding_policy_url", lambda s, d: v.findings(s, d).withColumn("ref", _ref()).groupBy("category", "ref", fd.policy_url(C("category"), C("ref")).alias("policy_url"), fd.policy_title(C("category")).alias("policy_title")).agg(F.count("*").alias("n")),
    f"with {o.FINDINGS}, x as (select category, {o.pick(['x', 'REPLICATED content', 'about Privacy', 'ad placement', 'deceptive'], 'l_suppkey % 5')} as ref from fb) select category, ref, "
    f"case when category = 'Duplicate content' or ref = 'REPLICATED content' then {o.q(_PU['duplicate'])} when category = 'Ad experience' or ref = 'ad placement' then {o.q(_PU['ads'])} "
    f"when category = 'Privacy & consent' or ref = 'about Privacy' then {o.q(_PU['privacy'])} when category = 'Deceptive practices' or ref = 'deceptive' then {o.q(_PU['deceptive'])} "
    f"when category = 'Technical trust' then {o.q(_PU['technical'])} when category = 'Content quality' then {o.q(_PU['quality'])} else {o.q(_PU['general'])} end as policy_url, "
    "case when category in ('Duplicate content', 'Copyright') then 'Replicated content and publisher value' when category = 'Ad experience' then 'Ad placement policies' "
    "when category = 'Privacy & consent' then 'Required privacy policy content' when category = 'Deceptive practices' then 'Deceptive practices policy' "
    "when category = 'Technical trust' then 'Crawler troubleshooting' when category = 'Content quality' then 'Content quality for site approval' else 'Publisher policies' end as policy_title, count(*) as n from x group by all")
add("finding_source", lambda s, d: v.findings(s, d).groupBy("rule_key", fd.source(C("rule_key")).alias("source")).agg(F.count("*").alias("n")),
    f"with {o.FINDINGS} select rule_key, case when rule_key[1:3] = 'ai.' then 'AI' else 'Rule' end as source, count(*) as n from fb group by all")

# ---------------------------------------------------------------- rules
_COLS = ["page_id", "rule_key", "category", "severity", "confidence", "fingerprint"]


def one_rule(make):
    return lambda s, d: ru.apply_rules(v.signal_rows(s, d), [make(DEFAULT)] if not isinstance(make, list) else [m(DEFAULT) for m in make]).select(*_COLS)


for _name, _rule in o.RULES.items():
    add(_name, one_rule(getattr(ru, _name)), f"with {o.SIGNAL_ROWS} select {', '.join(_COLS)} from ({o.rule_select(_rule)})")
add("rule_publisher_incomplete", one_rule([lambda p, k=k: ru.rule_publisher_incomplete(k, p) for k in vocab.LINKED_TYPES]),
    f"with {o.SIGNAL_ROWS} select {', '.join(_COLS)} from ({' union all '.join(o.rule_select(r) for r in o.INCOMPLETE.values())})")
def _type():
    return F.element_at(F.array(*[F.lit(x) for x in vocab.SCAN_TYPES]), (C("page_id") % 5 + 1).cast("int"))
add("rules_local", lambda s, d: ru.rules_local(v.signal_rows(s, d), _type()).select(*_COLS),
    f"with {o.ALL_RULES}, y as (select *, {o.pick(vocab.SCAN_TYPES, 'k % 5')} as scan_type from ar) select {', '.join(_COLS)} from y where {o.SCOPE % 'scan_type'}")
def _own():
    return ru.Rule("custom.shouting", tx.word_count(F.upper("title")) == 0, "Content quality", "info", 50, F.struct(F.lit(1).alias("x")), "No words in title")
add("rule_registry", lambda s, d: ru.rules_local(v.signal_rows(s, d), "full", DEFAULT, [_own()]).groupBy("rule_key", "severity").agg(F.count("*").alias("n")),
    f"with {o.ALL_RULES} select rule_key, severity, count(*) as n from (select rule_key, severity from ar union all select 'custom.shouting', 'info' from sr where title = '') group by all")


def _arrow(s, d):
    def detect(batch):
        found = {"rule_key": "custom.long", "category": "Content quality", "severity": "info", "confidence": 150,
                 "title": "long", "policy_reference": "", "signals": "{}", "remediation": []}
        return [[found] if w > 500 else [] for w in batch["word_count"]]

    return ru.apply_arrow_rules(v.signal_rows(s, d), ["word_count"], detect).select("page_id", "rule_key", "confidence")


add("rule_arrow_udf", _arrow,
    f"with {o.SIGNAL_ROWS} select page_id, 'custom.long' as rule_key, 100 as confidence from sr where word_count > 500")


def _udtf(s, d):
    ru.register_udtf(s)
    rows = v.findings(s, d).select("fingerprint", F.to_json(F.array(F.struct("rule_key", "category", "severity", "confidence"))).alias("payload"))
    rows.groupBy("payload").agg(F.count("*").alias("k")).createOrReplaceTempView("stored_findings")  # equal payloads are exploded once
    return s.sql("select f.severity, f.category, sum(k) as n, sum(k * f.confidence) as total from stored_findings, lateral explode_findings(payload) f group by f.severity, f.category")


add("udtf_explode_findings", _udtf, f"with {o.FINDINGS} select severity, category, count(*) as n, sum(confidence)::bigint as total from fb group by all")

# ---------------------------------------------------------------- near duplicates
def dup_pages(s, d, group="grp"):
    rows = v.signals(s, d).select("page_id", "url", "grp", "text", "word_count", "page_type")
    rows = dp.eligible(rows).select(C(group).alias("grp") if group else F.lit("all").alias("grp"), C("page_id").alias("id"), C("page_id").alias("position"), "url", "text")
    return cut(dp.dup_sketch(rows).drop("text"))


def sketched_docs(s, d, group="grp"):
    rows = dp.eligible(v.documents(s, d))
    return dp.dup_sketch(rows.withColumn("grp", C(group) if group else F.lit("all"))).select("grp", "id", "position", "url", "sketch")


def dup_docs(s, d, group="grp"):
    return cut(sketched_docs(s, d, group))


_MCOLS = ["grp", "id", "matched_id", "shared", "similarity"]


def shown(df):
    return df.select("grp", "id", "matched_id", "shared", F.round("similarity", 6).alias("similarity"))


_MSQL = "select grp, id, matched_id, shared::int as shared, round(j, 6) as similarity from mt"
add("dup_eligible", lambda s, d: dp.eligible(v.signals(s, d)).select("page_id", "word_count"), f"with {o.SIGNALS} select page_id, word_count::int as word_count from sg where word_count >= 150 and page_type <> 'listing'")
add("dup_shingles", lambda s, d: v.documents(s, d).select(C("id").alias("doc_id"), F.size(dp.shingle_column(C("text"))).alias("n"), F.md5(F.array_join(dp.shingle_column(C("text")), "|")).alias("digest")),
    f"with w as (select doc_id, unnest(string_split({o.normalized('text')}, ' ')) as w, unnest(range(1, len(string_split({o.normalized('text')}, ' ')) + 1)) as i from documents), "
    "s as (select doc_id, i, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o as sh from w window o as (partition by doc_id order by i)) "
    "select doc_id, count(sh)::int as n, md5(coalesce(string_agg(sh, '|' order by i), '')) as digest from s group by doc_id")
add("dup_sketch", lambda s, d: dup_docs(s, d).select("id", F.size("sketch").alias("n"), F.md5(F.array_join("sketch", "|")).alias("digest")),
    f"with {o._DOC % 'source'}{o._sketch_sql('el')} select id, count(*)::int as n, md5(string_agg(h || sh, '|' order by h)) as digest from sk group by id")
_CAND = ("bk as (select *, row_number() over (partition by grp, h order by position) as seq from sk), "
         "cd as (select a.grp, a.id, b.id as candidate_id, b.position as bp, count(*)::int as shared_seen, min(a.h) as mh from bk a join bk b on a.grp = b.grp and a.h = b.h and a.seq - b.seq between 1 and 200 group by all) "
         "select grp, id, candidate_id, shared_seen, r::int as candidate_rank from (select *, row_number() over (partition by grp, id order by shared_seen desc, mh, bp) as r from cd) where r <= 30")
add("dup_candidates", lambda s, d: dp.candidates(sketched_docs(s, d, None)).select("grp", "id", "candidate_id", "shared_seen", "candidate_rank"),
    f"with {o._DOC % o.q('all')}{o._sketch_sql('el')}, {_CAND}")
add("dup_best_match", lambda s, d: shown(dp.best_matches(dup_pages(s, d, None))), f"with {o.DUP_PAGES_ALL} {_MSQL}")
add("dup_findings", lambda s, d: dp.dup_findings(dup_pages(s, d, None)).select("page_id", "severity", "confidence", "fingerprint", F.get_json_object("signals", "$.matched_url").alias("matched_url"),
        F.array_join(F.from_json(F.get_json_object("signals", "$.matching_phrases"), "array<string>"), "|").alias("phrases")),
    f"with {o.DUP_PAGES_ALL}, ph as (select m.id, string_agg(x.sh, '|' order by x.h) as phrases from mt m join (select a.id, b.id as other, a.h, a.sh, row_number() over (partition by a.id, b.id order by a.h) as r from sk a join sk b on a.h = b.h join mt on mt.id = a.id and mt.matched_id = b.id) x on x.id = m.id and x.other = m.matched_id and x.r <= 8 group by m.id) "
    "select m.id as page_id, case when j >= 0.95 then 'high' else 'review' end as severity, round(j * 100)::int as confidence, sha256('duplicate.internal-near-match|' || lower(p.url) || '|' || sha256(q.url)) as fingerprint, "
    "q.url as matched_url, phrases from mt m join pages p on p.page_id = m.id join pages q on q.page_id = m.matched_id join ph on ph.id = m.id")
add("dup_match_rows",
    lambda s, d: dp.dup_match_rows(v.quoted_findings(s, d), v.site_pages(s, d), v.sites(s, d)).groupBy("source_url", "matched_url", "similarity", "method").agg(F.count("*").alias("n")),
    f"with {o.FINDINGS}, {o.SITE_PAGES}, {o.SITES}, x as (select coalesce(sp.url, ws.start_url) as source_url, 'https://m.example/' || fb.page_id as matched_url, (fb.page_id % 101)::int as similarity from fb "
    "left join sp on sp.page_id = fb.page_id left join ws on ws.website_id = fb.website_id where fb.page_id % 3 = 0) select *, 'sketch' as method, count(*) as n from x group by all")
add("dup_site_finalize",
    lambda s, d: dp.site_finalize(v.targets(s, d).withColumn("website_id", F.lit("all")), dup_pages(s, d, None).withColumnRenamed("id", "page_id").select("page_id", "url", "sketch")).select("page_id", "severity", "confidence"),
    f"with {o.SIGNALS}, el as (select 'all' as grp, page_id as id, page_id as position, norm from sg where word_count >= 150 and page_type <> 'listing' and page_id % 10 > 2), {o._sketch_sql('el')}, {o.MATCH} "
    "select id as page_id, case when j >= 0.95 then 'high' else 'review' end as severity, round(j * 100)::int as confidence from mt")
add("dup_documents", lambda s, d: shown(dp.best_matches(dup_docs(s, d))), f"with {o.DUP_DOCS} {_MSQL}")
add("dup_documents_global", lambda s, d: shown(dp.best_matches(dup_docs(s, d, None))), f"with {o.DUP_DOCS_ALL} {_MSQL}")

# ---------------------------------------------------------------- external copies
def texts(s, d):
    return v.balanced(v.table(s, d, "documents"), "doc_id").select(C("doc_id").alias("id"), "text")


def items(s, d):
    return v.table(s, d, "benchmark").select(C("item_id").alias("id"), "text")


def _toks(t):
    return f"list_filter(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+', 0), lambda x: length(x) > 1)"


def _five(source, out):
    return (f"{out}w as (select id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as i from {source}), "
            f"{out}5 as (select id, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o as sh from {out}w window o as (partition by id order by i)), "
            f"{out} as (select distinct id, sh from {out}5 where sh is not null)")


_SETS = (f"dt as (select doc_id as id, {_toks('text')} as ws from documents), bt as (select item_id as id, {_toks('text')} as ws from benchmark), "
         f"{_five('dt', 'ds')}, {_five('bt', 'bs')}, "
         "dn as (select id, count(*) as n from ds group by 1), bn as (select id, count(*) as n from bs group by 1), "
         "px as (select ds.id as d, bs.id as b, count(*) as shared from ds join bs using (sh) group by all)")
add("copy_tokens", lambda s, d: texts(s, d).select(C("id").alias("doc_id"), F.size(tx.tokens(C("text"))).alias("n"), F.md5(F.array_join(tx.tokens(C("text")), " ")).alias("digest")),
    f"select doc_id, len(w)::int as n, md5(array_to_string(w, ' ')) as digest from (select doc_id, {_toks('text')} as w from documents)")
add("copy_query_phrases", lambda s, d: texts(s, d).select(C("id").alias("doc_id"), F.array_join(cp.query_phrases(C("text")), "|").alias("phrases")),
    f"with w as (select doc_id, {_toks('text')} as ws from documents), p as (select doc_id, list_filter(list_transform([0.2::double, 0.5::double, 0.8::double], lambda a: array_to_string(list_slice(ws, least(greatest(len(ws) - 14, 0), floor(len(ws) * a)::bigint) + 1, least(greatest(len(ws) - 14, 0), floor(len(ws) * a)::bigint) + 14), ' ')), lambda x: length(x) >= 50) as ps from w) "
    "select doc_id, coalesce(case when len(ps) = 0 then '' when len(ps) = 1 or ps[2] = ps[1] then (case when len(ps) = 3 and ps[3] <> ps[1] then ps[1] || '|' || ps[3] else ps[1] end) else ps[1] || '|' || ps[2] end, '') as phrases from p")


def benchmark_pairs(s, d):
    return cp.copy_pairs(items(s, d), texts(s, d), DEFAULT.copy_threshold)


_PAIRS = "pr as (select b, d, shared, n from px join bn on bn.id = b where round(shared / n, 4) >= 0.35)"
add("copy_containment", lambda s, d: cp.copy_containment(benchmark_pairs(s, d), items(s, d), texts(s, d)).select("source_id", "candidate_id", "shared", "source_shingles", "similarity"),
    f"with {_SETS}, {_PAIRS} select b as source_id, d as candidate_id, shared::int as shared, n::int as source_shingles, round(shared / n, 4) as similarity from pr")
add("copy_phrases", lambda s, d: cp.copy_containment(benchmark_pairs(s, d), items(s, d), texts(s, d)).select("source_id", "candidate_id", F.array_join("phrases", "|").alias("phrases")),
    f"with {_SETS}, {_PAIRS}, "
    "wi as (select b, d, unnest(range(0, len(ws) - 11, 6)) as i, ws from pr join bt on bt.id = b), "
    "ck as (select b, d, i, array_to_string(ws[i+1:i+12], ' ') as ph, unnest(list_transform(range(1, 9), lambda k: array_to_string(ws[i+k:i+k+4], ' '))) as sh from wi), "
    "ok as (select b, d, i, ph from ck left join ds on ds.id = d and ds.sh = ck.sh group by all having count(*) = count(ds.sh)), "
    "rk as (select *, row_number() over (partition by b, d order by i) as r from ok) "
    "select pr.b as source_id, pr.d as candidate_id, coalesce(string_agg(ph, '|' order by i), '') as phrases from pr left join rk on rk.b = pr.b and rk.d = pr.d and r <= 3 group by all")
add("copy_corpus_scan", lambda s, d: cp.copy_corpus_scan(texts(s, d), items(s, d)).select("source_id", "candidate_id", "shared", "source_shingles", "similarity"),
    f"with {_SETS}, x as (select d as source_id, b as candidate_id, shared::int as shared, n::int as source_shingles, round(shared / n, 4) as similarity from px join dn on dn.id = d) "
    "select source_id, candidate_id, shared, source_shingles, similarity from (select *, row_number() over (partition by source_id order by similarity desc, candidate_id) as r from x where similarity >= 0.35) where r = 1")


def scored(s, d):
    """Scored candidates from order lines: source = part, candidate rank = supplier."""
    L = v.table(s, d, "lineitem")
    k = L.groupBy(C("l_partkey").alias("source_id"), C("l_suppkey").alias("candidate_rank")).agg(F.max("l_quantity").alias("qty"))
    return k.select("source_id", "candidate_rank", F.round(C("qty") / 60, 4).alias("similarity"), F.concat(F.lit("https://c.example/"), C("candidate_rank").cast("string")).alias("candidate_url"),
        F.lit("t").alias("candidate_title"), F.concat(F.lit("https://s.example/"), C("source_id").cast("string")).alias("url"), F.array().cast("array<string>").alias("phrases"))


_SC = "sc0 as (select l_partkey as source_id, l_suppkey as candidate_rank, round(max(l_quantity) / 60, 4) as similarity from lineitem group by all), cb as (select * from (select *, row_number() over (partition by source_id order by similarity desc, candidate_rank) as r from sc0 where similarity >= 0.35) where r = 1)"
add("copy_best", lambda s, d: cp.copy_best(scored(s, d)).select("source_id", "candidate_rank", "similarity"), f"with {_SC} select source_id, candidate_rank, similarity from cb")
add("copy_findings", lambda s, d: cp.copy_findings(cp.copy_best(scored(s, d))).select("page_id", "severity", "confidence", "fingerprint"),
    f"with {_SC} select source_id as page_id, case when similarity >= 0.65 then 'high' else 'review' end as severity, least(96, greatest(60, round(similarity * 100)))::int as confidence, "
    "sha256('copyright.external-content-match|https://s.example/' || source_id || '|' || sha256('https://c.example/' || candidate_rank)) as fingerprint from cb")
add("copy_eligible", lambda s, d: cp.copy_checked(v.signals(s, d)).groupBy(F.coalesce("skipped_reason", F.lit("eligible")).alias("state")).agg(F.count("*").alias("n")),
    f"with {o.SIGNALS} select case when page_type = 'listing' then 'content_listing' when word_count < 250 then 'page_too_short' else 'eligible' end as state, count(*) as n from sg group by 1")


def search_rows(s, d):
    L = v.table(s, d, "lineitem")
    k = C("l_suppkey")
    url = F.when(k % 9 == 0, "not a url").when(k % 9 == 1, F.concat(F.lit("https://www.s"), (C("l_partkey") % 7).cast("string"), F.lit(".example/x"))).otherwise(F.concat(F.lit("https://other"), (k % 40).cast("string"), F.lit(".example/y")))
    return L.select(C("l_partkey").alias("page_id"), F.concat(F.lit("https://s"), (C("l_partkey") % 7).cast("string"), F.lit(".example/a")).alias("page_url"), k.alias("rank"), url.alias("url"))


add("src_copy_candidates", lambda s, d: cp.src_copy_candidates(search_rows(s, d)).select("page_id", "url", "candidate_rank"),
    "with r as (select l_partkey as page_id, 'https://other' || (l_suppkey % 40) || '.example/y' as url, min(l_suppkey) as rank from lineitem where l_suppkey % 9 > 1 group by all), "
    "x as (select *, row_number() over (partition by page_id order by rank, url) as n from r) select page_id, url, n::int as candidate_rank from x where n <= 10")

# ---------------------------------------------------------------- third-party results
add("src_moderation", lambda s, d: so.src_moderation(v.moderation_raw(s, d)).select("url", "status", "request_id", F.round(F.element_at("classes", "toxic"), 3).alias("toxic"), F.size("classes").alias("n")),
    f"with {o.MODERATION} select url, status, 'req-' || doc_id as request_id, toxic, 3 as n from md")
add("moderation_findings", lambda s, d: nz.moderation_findings(so.src_moderation(v.moderation_raw(s, d))).select("url", "rule_key", "severity", "confidence", "fingerprint"),
    f"with {o.MODERATION}, x as (select url, unnest(['toxic', 'low_quality']) as c, unnest([toxic, low_quality]) as v from md where status = 'success') "
    "select url, 'sightengine.' || c as rule_key, case when v >= 0.85 then 'high' else 'review' end as severity, round(v * 100)::int as confidence, sha256('sightengine.' || c || '|' || lower(url) || '|') as fingerprint from x where v >= 0.55")
add("src_llm_responses", lambda s, d: so.src_llm_responses(v.model_replies(s, d)).select("page_id", F.coalesce("response_id", F.lit("")).alias("response_id"), "input_tokens", "output_tokens", F.size(F.from_json("reply", nz.REPLY_SCHEMA)["findings"]).alias("n")),
    "select doc_id as page_id, case when doc_id % 4 = 2 then '' else doc_id::varchar end as response_id, doc_id as input_tokens, doc_id * 2 as output_tokens, 2 as n from labels")
add("llm_findings", lambda s, d: nz.llm_findings(so.src_llm_responses(v.model_replies(s, d))).select("page_id", "rule_key", "category", "severity", "confidence", "title", F.array_join("remediation", "|").alias("advice"), F.get_json_object("signals", "$.evidence[0]").alias("quote")),
    f"with {o.MODEL_ITEMS} select page_id, 'ai.' || code as rule_key, MAP {{{', '.join(f'{o.q(k)}: {o.q(x)}' for k, x in vocab.MODEL_CODES.items())}}}[code] as category, severity, confidence, "
    f"coalesce(title, MAP {{{', '.join(f'{o.q(k)}: {o.q(k.replace(chr(95), chr(32)).title())}' for k in vocab.MODEL_CODES)}}}[code]) as title, "
    "case when advised then 'do it' else 'Review the quoted evidence and record a decision.' end as advice, 'quote ' || page_id as quote from mi where code <> 'unknown_code' and confidence >= 70")
add("src_viewport_metrics", lambda s, d: so.src_viewport_metrics(v.viewports(s, d)).groupBy("url").agg(F.count("*").alias("n"), F.sum("nearInteractiveCount").alias("near"), F.round(F.max("viewportCoverage"), 4).alias("coverage")),
    "select 'https://v.example/' || l_partkey as url, count(*) as n, count(*) filter (where l_partkey % 6 = 0 and l_linenumber = 1) as near, round(max((l_partkey % 10) * 0.06::double + l_linenumber * 0.01::double), 4) as coverage from lineitem group by l_partkey")
add("browser_findings", lambda s, d: nz.browser_findings(so.src_viewport_metrics(v.viewports(s, d))).select("url", "rule_key", "severity", "confidence"),
    f"with {o.VIEWPORTS}, r as (select k, 'ads.browser-accidental-click-risk' as rule_key, case when near >= 3 then 'high' else 'review' end as severity, 92 as confidence from vp where near > 0 union all "
    "select k, 'ads.browser-intrusive-overlay', 'high', 94 from vp where overlay > 0 union all select k, 'ads.browser-misleading-label', 'high', 88 from vp where misleading > 0 union all "
    "select k, 'ads.browser-viewport-dominance', case when coverage >= 0.5 then 'high' else 'review' end, 86 from vp where coverage >= 0.3 union all "
    "select k, 'ads.browser-popup-or-refresh', case when popups > 0 then 'high' else 'review' end, 84 from vp where popups > 0 or refreshes > 0) select 'https://v.example/' || k as url, rule_key, severity, confidence from r")
add("addon_budget", lambda s, d: nz.addon_budget(v.targets(s, d).filter("status = 'completed'"), 3)[0].select("scan_id", "page_id", "budget_rank"),
    f"with {o.TARGETS}, x as (select *, row_number() over (partition by scan_id order by position) as r from tg where status = 'completed') select scan_id, page_id, r::int as budget_rank from x where r <= 3")
add("llm_usage", lambda s, d: nz.llm_usage(v.scan_targets(s, d)),
    f"with {o.SCAN_TARGETS} select scan_id, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, count(*) filter (where ai_attempted) as attempted, count(*) filter (where ai_analyzed) as analyzed, count(*) filter (where ai_attempted and not ai_analyzed) as errors from st group by 1")
add("assessment_references", lambda s, d: nz.assessment_references(v.assessments(s, d)).select("scan_id", "section", "policy_url", "issue", "reference_rank"),
    f"with {o.ASSESSMENTS} select scan_id, section, policy_url, 'issue' as issue, r::int as reference_rank from rfs")
add("assessment_references_fallback",
    lambda s, d: nz.assessment_references_fallback(v.assessments(s, d), nz.assessment_references(v.assessments(s, d)), sc.open_findings(v.site_findings(s, d))).select("scan_id", "section", "policy_url", "issue"),
    f"with {o.ASSESSMENTS}, {o.SITE_FINDINGS}, b as (select scan_id, website_id from sc where ai_assessed and scan_id not in (select scan_id from rfs)), c as (select distinct website_id, category from sf where status <> 'resolved') "
    f"select scan_id, case when category in ('Copyright', 'Duplicate content', 'Content quality') then 'content_overview' when category in ('Deceptive practices', 'Publisher requirements') then 'transparency_overview' when category = 'Privacy & consent' then 'adsense_requirements_overview' else 'policy_overview' end as section, "
    f"case category when 'Duplicate content' then {o.q(_PU['duplicate'])} when 'Ad experience' then {o.q(_PU['ads'])} when 'Privacy & consent' then {o.q(_PU['privacy'])} when 'Deceptive practices' then {o.q(_PU['deceptive'])} when 'Technical trust' then {o.q(_PU['technical'])} when 'Content quality' then {o.q(_PU['quality'])} else {o.q(_PU['general'])} end as policy_url, {_LABEL}[category] as issue from b join c using (website_id)")
add("assessment_normalize", lambda s, d: nz.assessment_normalize(v.assessments(s, d)).select("scan_id", "risk_level", "headline", "policy_overview", F.array_join("priorities", "|").alias("priorities"), F.array_join("limitations", "").alias("limitations")),
    f"with {o.SCANS} select scan_id, {o.pick(['critical', 'high', 'review'], 'scan_id % 3')} as risk_level, 'headline ' || scan_id as headline, case when scan_id % 2 = 0 then 'overview' else 'A. b' end as policy_overview, "
    "array_to_string(list_transform(range(0, scan_id % 12 + 1), lambda i: 'do ' || i), '|') as priorities, 'abcdefg' as limitations from sc where ai_assessed")
add("evidence_quotes", lambda s, d: v.quoted_findings(s, d).select("fingerprint", F.array_join(nz.evidence_quotes(C("signals")), "|").alias("quotes")),
    f"with {o.FINDINGS} select fingerprint, array_to_string(list_concat(list_transform(range(0, least(page_id % 9 + 1, 4)), lambda i: 'quote ' || i), list_transform(range(0, page_id % 14 + 1), lambda i: 'phrase ' || i)), '|') as quotes from fb")


def reviews(s, d):
    p = v.site_pages(s, d)
    return p.filter("page_id % 6 = 0").select("website_id", "page_id", F.lit("open").alias("status"), F.lit("q").alias("google_query"),
        F.when(C("page_id") % 12 == 0, F.concat(F.lit("https://r.example/"), C("page_id").cast("string"))).alias("matched_url"), F.lit("n").alias("notes"), F.lit("2001-01-01").alias("reviewed_at"))


add("evidence_source_urls", lambda s, d: nz.evidence_source_urls(v.quoted_findings(s, d), reviews(s, d)).select("fingerprint", F.array_join("source_urls", "|").alias("urls")),
    f"with {o.FINDINGS} select fingerprint, 'https://i.example/a|https://i.example/b' || case when page_id % 3 = 0 then '|https://m.example/' || page_id else '' end || case when page_id % 12 = 0 then '|https://r.example/' || page_id else '' end as urls from fb")
add("copyright_review_upsert",
    lambda s, d: nz.copyright_review_upsert(reviews(s, d), v.site_pages(s, d).filter("page_id % 4 = 0").select("website_id", "page_id", F.lit("resolved").alias("status"), F.lit("u").alias("matched_url"), F.lit("m").alias("notes"), F.lit("2001-02-01").alias("reviewed_at")), v.site_pages(s, d)).select("website_id", "page_id", "status", "google_query", "notes"),
    f"with {o.SITE_PAGES} select website_id, page_id, case when page_id % 4 = 0 then 'resolved' else 'open' end as status, case when page_id % 4 = 0 then '\"' || title || '\"' else 'q' end as google_query, case when page_id % 4 = 0 then 'm' else 'n' end as notes from sp where page_id % 4 = 0 or page_id % 6 = 0")
