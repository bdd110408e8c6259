"""External copies: 5-token shingle containment of a page in a candidate text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions import finding as fd, text as tx, url as ux
from sitegauge.operators.numbering import first_per_group, spread_join, top_per_group
from sitegauge.params import DEFAULT, Params
from sitegauge.session import cut, stored


def eligible(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    return pages.filter((F.col("word_count") >= max(50, p.copy_min_words)) & (F.col("page_type") != "listing"))


def copy_checked(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Why a page needs no search: short and listing pages count as checked."""
    return pages.withColumn(
        "skipped_reason",
        F.when(F.col("page_type") == "listing", "content_listing")
        .when(F.col("word_count") < max(50, p.copy_min_words), "page_too_short"),
    )


def query_phrases(text: Column, p: Params = DEFAULT) -> Column:
    """Distinct 14-token phrases at 20, 50 and 80 percent of the text, long enough to search for."""
    def pick(words: Column) -> Column:
        n = F.size(words)
        phrases = F.transform(
            F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)),
            lambda at: F.array_join(
                F.slice(words, F.least(F.greatest(n - 14, F.lit(0)), F.floor(n * at).cast("int")) + 1, 14), " "
            ),
        )
        return F.slice(F.array_distinct(F.filter(phrases, lambda x: F.length(x) >= 50)), 1, max(1, min(3, p.copy_queries)))

    return tx.let(tx.tokens(text), pick)


def shingle_set(words: Column) -> Column:
    """Distinct 64-bit hashes of all 5-token shingles."""
    return F.array_distinct(F.transform(tx.shingles(words, 5), lambda s: F.xxhash64(s)))


def matching_phrases(words: Column, common: Column) -> Column:
    """First three 12-token windows, every six tokens, whose shingles are all shared."""
    last = F.size(words) - 12
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(6))).otherwise(F.array().cast("array<int>"))
    found = F.filter(
        starts,
        lambda i: F.forall(
            F.sequence(F.lit(0), F.lit(7)),
            lambda k: F.array_contains(common, F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k + j) for j in range(5)]))),
        ),
    )
    return F.transform(F.slice(found, 1, 3), lambda i: F.array_join(F.slice(words, i + 1, 12), " "))


def _sets(texts: DataFrame, prefix: str) -> DataFrame:
    words = tx.computed(texts, {f"{prefix}_words": tx.tokens(F.col("text"))}, ["id"]).withColumnRenamed("id", f"{prefix}_id")
    return tx.computed(words, {f"{prefix}_set": shingle_set(F.col(f"{prefix}_words"))})


def similarity(shared: Column, size: Column) -> Column:
    return F.when(size > 0, F.round(shared / F.greatest(size, F.lit(1)), 4)).otherwise(F.lit(0.0))


def copy_containment(pairs: DataFrame, sources: DataFrame, candidates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Scores known (source_id, candidate_id) pairs: containment of the source and the copied phrases.

    Only texts that occur in a pair are cut into shingles and moved.
    """
    pairs = stored(pairs)
    named = lambda texts, key: texts.join(pairs.select(F.col(key).alias("id")).distinct(), "id", "left_semi")
    s, c = _sets(named(sources, "source_id"), "source"), _sets(named(candidates, "candidate_id"), "candidate").drop("candidate_words")
    rows = tx.computed(pairs.join(s, "source_id").join(c, "candidate_id"), {"common": F.array_intersect("source_set", "candidate_set")})
    shared = F.size("common")
    return rows.select(
        "source_id", "candidate_id", shared.alias("shared"), F.size("source_set").alias("source_shingles"),
        similarity(shared, F.size("source_set")).alias("similarity"),
        matching_phrases(F.col("source_words"), F.col("common")).alias("phrases"),
    )


def _hash_sets(texts: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(id, t, n, hs): a text's hash, its number of distinct shingles and those of them that are in ``vocabulary``, sorted."""
    rows = tx.computed(texts, {"t": F.xxhash64("text"), "hs": F.sort_array(shingle_set(tx.tokens(F.col("text"))))}, ["id"])
    rows = rows.select("id", "t", F.size("hs").alias("n"), "hs")
    if vocabulary is None:
        return rows.filter("n > 0")
    postings = rows.select("id", "t", "n", F.explode("hs").alias("h")).join(vocabulary, "h", "left_semi")
    return postings.groupBy("id", "t", "n").agg(F.sort_array(F.collect_list("h")).alias("hs"))


def _set_classes(sets: DataFrame, *also: str) -> tuple[DataFrame, DataFrame]:
    """Texts with equal sets share one key: (id, set_key) members and one row per key with its first id."""
    text = F.array_join(F.concat(F.array(*[F.col(c).cast("string") for c in also]), F.transform("hs", lambda h: h.cast("string"))), ",")
    keyed = cut(sets.select("id", "n", "hs", F.unhex(F.sha2(text, 256)).alias("set_key")))
    classes = keyed.groupBy("set_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("hs").alias("hs"))
    return keyed.select("id", "set_key"), cut(classes)


def _characters(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.length("text"))).first()[0] or 0


def copy_corpus_pairs(sources: DataFrame, candidates: DataFrame, threshold: float, p: Params = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All (source set, candidate set) pairs with containment at or above the threshold, exactly.

    The larger side keeps only the shingles that the smaller one has, before anything of it is moved: a text without a
    common shingle leaves at once, and texts with equal remaining shingles (and, for sources, equal counts) are compared
    once. A source is dropped when the shingles it shares with *any* candidate cannot reach
    the threshold; the rest look up candidates on their rarest shingles only, and a shingle held by many candidates
    is cut into blocks. Returns the source members, the candidate members and the
    scored pairs of set keys (with the first candidate id of the set).
    """
    few, many = (sources, candidates) if _characters(sources) <= _characters(candidates) else (candidates, sources)
    small = _hash_sets(few)
    vocabulary = stored(small.select(F.explode("hs").alias("h")).distinct())
    large = _hash_sets(many, vocabulary)
    members, src = _set_classes(small if few is sources else large, "n")
    cand_members, cand = _set_classes(large if few is sources else small)
    postings = cand.select(F.col("set_key").alias("c_key"), F.explode("hs").alias("h"))
    counts = postings.groupBy("h").agg(F.count("*").alias("df"))
    hits = spread_join(src.select("set_key", "n", F.explode("hs").alias("h")), counts, ["h"], "set_key", salts=p.salts)
    need = F.greatest(F.ceil(F.col("n") * F.lit(threshold - 0.00005) - 1e-9), F.lit(1)).cast("int")
    live = (
        hits.groupBy("set_key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("toks"))
        .withColumn("need", need).filter(F.size("toks") >= F.col("need"))
    )
    probe = live.withColumn("t", F.explode(F.slice("toks", 1, F.size("toks") - F.col("need") + 1))).select(
        "set_key", F.col("t.h").alias("h"), F.ceil(F.col("t.df") / p.block).cast("int").alias("blocks")
    ).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    blocked = spread_join(postings, counts, ["h"], "c_key", salts=p.salts).withColumn(
        "blk", F.pmod(F.xxhash64("c_key"), F.ceil(F.col("df") / p.block)).cast("int")
    ).drop("df")
    pairs = probe.join(blocked, ["h", "blk"]).select("set_key", "c_key").distinct()
    rows = spread_join(pairs, src.select("set_key", "n", "hs"), ["set_key"], "c_key", salts=p.salts)
    rows = spread_join(
        rows, cand.select(F.col("set_key").alias("c_key"), F.col("id").alias("candidate_id"), F.col("hs").alias("c_hs")),
        ["c_key"], "set_key", salts=p.salts,
    )
    shared = F.size(F.array_intersect("hs", "c_hs"))
    scored = rows.select(
        "set_key", "c_key", "candidate_id", shared.alias("shared"), F.col("n").alias("source_shingles"),
        similarity(shared, F.col("n")).alias("similarity"),
    )
    return members, cand_members, scored.filter(F.col("similarity") >= threshold)


def copy_pairs(sources: DataFrame, candidates: DataFrame, threshold: float, p: Params = DEFAULT) -> DataFrame:
    """Every (source_id, candidate_id) at or above the threshold; equal texts are expanded again at the end."""
    members, cand_members, pairs = copy_corpus_pairs(sources, candidates, threshold, p)
    rows = members.select(F.col("id").alias("source_id"), "set_key").join(pairs.select("set_key", "c_key"), "set_key")
    return rows.join(cand_members.select(F.col("id").alias("candidate_id"), F.col("set_key").alias("c_key")), "c_key").select(
        "source_id", "candidate_id"
    )


def copy_corpus_scan(sources: DataFrame, candidates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Best candidate of every source text over the whole candidate corpus (first id of equals)."""
    members, _, pairs = copy_corpus_pairs(sources, candidates, p.copy_threshold, p)
    best = pairs.withColumn("order", F.struct((-F.col("similarity")).alias("n"), "candidate_id")).groupBy("set_key").agg(
        F.min_by(F.struct("candidate_id", "shared", "source_shingles", "similarity"), "order").alias("b")
    )
    rows = spread_join(members, best, ["set_key"], "id", salts=p.salts)
    return rows.select(F.col("id").alias("source_id"), "b.*")


def src_copy_candidates(search: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Candidate URLs per page from search results (page_id, page_url, rank, url): valid, off-site, distinct, first ones."""
    own = F.lower(ux.host(F.col("page_url")))
    kept = search.filter(ux.is_valid(F.col("url")) & ~ux.same_site_external(own, F.col("url")))
    once = kept.groupBy("page_id", "url").agg(F.min("rank").alias("rank"))
    return top_per_group(once, ["page_id"], [F.asc("rank"), F.asc("url")], p.copy_candidates, "candidate_rank")


def copy_best(scored: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Best candidate per source at or above the threshold; the first of equals by candidate rank."""
    rows = scored.filter(F.col("similarity") >= p.copy_threshold).withColumn("_n", -F.col("similarity"))
    return first_per_group(rows, ["source_id"], ["_n", "candidate_rank"]).drop("_n")


def copy_findings(best: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Finding rows from (source_id, url, candidate_url, candidate_title, similarity, phrases)."""
    percent = F.round(F.col("similarity") * 100).cast("int")
    record = fd.finding(
        rule_key="copyright.external-content-match", category="Copyright",
        severity=F.when(F.col("similarity") >= p.copy_high_threshold, "high").otherwise("review"),
        confidence=F.least(F.lit(96), F.greatest(F.lit(60), percent)), title="Content matches another website",
        signals=F.to_json(F.struct(
            F.lit("external_copy_search").alias("analysis_source"), F.col("candidate_url").alias("matched_url"),
            F.col("candidate_title").alias("matched_title"), percent.alias("similarity"),
            F.lit("5-word shingle containment").alias("method"), F.col("phrases").alias("matching_phrases"),
        )),
        summary=F.concat(percent, F.lit(" percent of the text is contained in "), F.col("candidate_url"), F.lit(".")),
        policy="publisher policies: replicated content", salt=F.sha2("candidate_url", 256), url=F.col("url"),
        remediation="Verify which page was published first.",
    )
    return best.select(F.col("source_id").alias("page_id"), "url", record.alias("f")).select("page_id", "url", "f.*")
