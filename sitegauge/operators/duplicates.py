"""Near-duplicate pages.

A page's sketch is its 128 smallest distinct 4-word-shingle hashes over the whole text. For every page the best
*earlier* page of its group is wanted: highest Jaccard of the sketches, then more shared hashes, then the smallest
first shared hash, then the earlier position.

``best_matches`` finds it exactly, with no limit on partners:

1. hashes that occur on one page only can never be shared: they are dropped after one counted shuffle, and a page
   left with too few hashes to reach the threshold leaves the job;
2. pages with the same remaining hashes and the same sketch size are interchangeable, so each such class is
   represented by its earliest page and a family of copies costs one row;
3. class representatives meet only on their rarest hashes (prefix filter), and a hash shared by many
   representatives is cut into bounded comparison blocks;
4. every page picks from its class's short candidate list.

``candidates`` is the bounded candidate index (recency window and ranked list); ``bounded_matches`` scores its list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions import text as tx
from sitegauge.operators.numbering import lookup, number_in_group, spread_join
from sitegauge.params import DEFAULT, Params
from sitegauge.session import cut, stored

HASH = 16
#: The highest bit of a 64-bit number.
SIGN = -(1 << 63)


def eligible(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Long enough and not a listing page."""
    return pages.filter((F.col("word_count") >= p.duplicate_min_words) & (F.col("page_type") != "listing"))


def shingle_column(text: Column) -> Column:
    """4-word shingles of the normalised text, in order, over the whole text."""
    return tx.shingles(F.split(tx.normalized(text), " "), 4)


def sketch_column(text: Column, p: Params = DEFAULT) -> Column:
    """Sorted entries ``hash + shingle``; the first 16 characters are the hash."""
    entries = F.transform(
        F.array_distinct(shingle_column(text)), lambda s: F.concat(F.substring(F.sha1(s), 1, HASH), s)
    )
    return F.slice(F.sort_array(entries), 1, p.sketch)


def hashes_of(sketch: Column) -> Column:
    return F.transform(sketch, lambda e: F.substring(e, 1, HASH))


def dup_sketch(df: DataFrame, text: str = "text", p: Params = DEFAULT) -> DataFrame:
    return tx.computed(df, {"sketch": sketch_column(F.col(text), p)})


def numbers_of(sketch: Column) -> Column:
    """The hashes as signed numbers in the order of their hex digits: their highest bit is turned."""
    return F.transform(hashes_of(sketch), lambda h: F.conv(h, 16, -10).cast("long").bitwiseXOR(F.lit(SIGN)))


def jaccard(shared: Column, a: Column, b: Column) -> Column:
    return shared / (a + b - shared)


# ---------------------------------------------------------------- exact best match

def _core_pages(pages: DataFrame, p: Params) -> DataFrame:
    """Pages whose shareable hashes could reach the threshold: grp, id, position, s, c, toks sorted rare first."""
    base = pages.select("grp", "id", "position", F.size("sketch").alias("s"), numbers_of(F.col("sketch")).alias("hs"))
    tokens = base.select("grp", "id", "position", "s", F.explode("hs").alias("h"))
    counts = tokens.groupBy("grp", "h").agg(F.count("*").alias("df")).filter("df > 1")
    core = spread_join(tokens, counts, ["grp", "h"], "id", salts=p.salts)
    rows = core.groupBy("grp", "id").agg(
        F.first("position").alias("position"), F.first("s").alias("s"),
        F.sort_array(F.collect_list(F.struct("df", "h"))).alias("toks"),
    )
    need = F.ceil(F.col("s") * F.lit(p.duplicate_threshold) - 1e-9).cast("int")
    hs = F.array_sort(F.transform("toks", lambda t: t["h"]))
    return (
        rows.withColumn("c", F.size("toks")).withColumn("need", need).filter("c >= need")
        .withColumn("core_key", F.sha2(F.array_join(hs.cast("array<string>"), ","), 256))
    )


def _classes(core: DataFrame) -> DataFrame:
    """One row per set of interchangeable pages, represented by the earliest."""
    return core.groupBy("grp", "core_key", "s").agg(
        F.min(F.struct("position", "id")).alias("rep"), F.count("*").alias("members"),
        F.first("c").alias("c"), F.first("need").alias("need"), F.first("toks").alias("toks"),
    )


def _rep_pairs(classes: DataFrame, p: Params) -> DataFrame:
    """Pairs of class representatives at or above the threshold; ``b`` is the later one."""
    prefix = F.transform(F.slice("toks", 1, F.col("c") - F.col("need") + 1), lambda t: t["h"])
    reps = classes.select(
        "grp", "core_key", "s", "c", "members", "rep", prefix.alias("prefix"),
        F.transform("toks", lambda t: t["h"]).alias("hs"),
    )
    spread = reps.withColumn("token", F.explode("prefix"))
    sizes = spread.groupBy("grp", "token").agg(F.count("*").alias("n")).filter("n > 1").withColumn(
        "blocks", F.ceil(F.col("n") / p.block).cast("int")
    ).drop("n")
    rows = spread_join(spread, sizes, ["grp", "token"], "core_key", salts=p.salts)
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("core_key", "s"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns(
        {"lo": F.least("blk", "other"), "hi": F.greatest("blk", "other")}
    ).drop("other", "blocks")
    a, b = rows.alias("a"), rows.alias("b")
    t = p.duplicate_threshold
    joined = a.join(
        b,
        (F.col("a.grp") == F.col("b.grp")) & (F.col("a.token") == F.col("b.token"))
        & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
        & (F.col("a.rep") < F.col("b.rep"))
        & (F.least("a.blk", "b.blk") == F.col("a.lo")) & (F.greatest("a.blk", "b.blk") == F.col("a.hi"))
        & (F.col("a.c") >= F.col("b.s") * t - 1e-9) & (F.col("b.c") >= F.col("a.s") * t - 1e-9)
        # a pair that shares several prefix hashes is compared once, at the first of them
        & (F.get(F.array_intersect("a.prefix", "b.prefix"), F.lit(0)) == F.col("a.token")),
    )
    common = F.array_intersect("a.hs", "b.hs")
    out = joined.select(
        F.col("a.grp").alias("grp"),
        F.col("a.core_key").alias("a_key"), F.col("a.s").alias("a_s"), F.col("a.c").alias("a_c"),
        F.col("a.members").alias("a_members"), F.col("a.rep").alias("a_rep"),
        F.col("b.core_key").alias("b_key"), F.col("b.s").alias("b_s"), F.col("b.rep").alias("b_rep"),
        common.alias("common"),
    ).withColumns({"shared": F.size("common"), "min_hash": F.array_min("common")}).drop("common")
    return out.withColumn("j", jaccard(F.col("shared"), F.col("a_s"), F.col("b_s"))).filter(F.col("j") >= t)


def _rank(j: Column, shared: Column, min_hash: Column, rep: Column) -> Column:
    """Smallest struct = best candidate."""
    return F.struct(
        (-j).alias("nj"), (-shared).alias("ns"), min_hash.alias("min_hash"),
        rep["position"].alias("position"), rep["id"].alias("id"),
    )


def best_matches(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Exact best earlier match per page from (grp, id, position, sketch).

    Sketches are read several times; store them (as a scan does) or hand over a table that is cheap to read again.
    Returns grp, id, position, matched_id, matched_position, shared, similarity.
    """
    core = cut(_core_pages(pages, p))
    classes = _classes(core)
    pairs = cut(_rep_pairs(classes, p))
    # best earlier representative of each class: a combinable minimum
    earlier = pairs.groupBy("grp", F.col("b_key").alias("core_key"), F.col("b_s").alias("s")).agg(
        F.min(_rank(F.col("j"), F.col("shared"), F.col("min_hash"), F.col("a_rep"))).alias("earlier")
    )
    # later representatives that beat the class's own first page for its remaining members; at most
    # sketch-size x sketch-size rows per class
    own_j = jaccard(F.col("a_c"), F.col("a_s"), F.col("a_s"))
    later = (
        pairs.filter((F.col("a_members") > 1) & (F.col("j") > own_j))
        .groupBy("grp", F.col("a_key").alias("core_key"), F.col("a_s").alias("s"), "j", "shared", "min_hash")
        .agg(F.min("b_rep").alias("rep"))
        .groupBy("grp", "core_key", "s")
        .agg(F.collect_list(_rank(F.col("j"), F.col("shared"), F.col("min_hash"), F.col("rep"))).alias("later"))
    )
    summary = (
        classes.select("grp", "core_key", "s", "c", "rep", "members", F.array_min(F.transform("toks", lambda t: t["h"])).alias("mh"))
        .join(earlier, ["grp", "core_key", "s"], "left").join(later, ["grp", "core_key", "s"], "left")
        .filter(F.col("earlier").isNotNull() | (F.col("members") > 1))
        .withColumn("own", _rank(jaccard(F.col("c"), F.col("s"), F.col("s")), F.col("c"), F.col("mh"), F.col("rep")))
        .drop("c", "members", "mh")
    )
    rows = spread_join(core.select("grp", "core_key", "s", "id", "position"), summary, ["grp", "core_key", "s"], "id", salts=p.salts)
    me = F.struct("position", "id")
    own = F.when(F.col("rep") != me, F.col("own"))
    reachable = F.filter(
        F.coalesce("later", F.array().cast(later.schema["later"].dataType)), lambda r: r["position"] < F.col("position")
    )
    choices = F.filter(F.concat(F.array("earlier"), F.array(own), reachable), lambda r: r.isNotNull())
    return (
        rows.withColumn("best", F.array_min(choices))
        .filter(F.col("best").isNotNull() & (-F.col("best.nj") >= p.duplicate_threshold))
        .select(
            "grp", "id", "position", F.col("best.id").alias("matched_id"),
            F.col("best.position").alias("matched_position"),
            (-F.col("best.ns")).cast("int").alias("shared"), (-F.col("best.nj")).alias("similarity"),
        )
    )


# ---------------------------------------------------------------- bounded candidate index

#: Pages (by id) whose candidates are counted together.
PLACE = 256
#: Bytes of holders after which a task hands its windows on.
SENT = 1 << 24
#: Shared hash, and holders in bytes, of some pages of a place: ``own`` is the first of them that may look back.
_SEEN = "place long, h long, weight long, own int, holders binary"
_FOUND = "id long, position long, candidate_id long, candidate_position long, shared_seen int, least long, candidate_rank int"


def _planes(position, id_, nulls) -> bytes:
    """Sorted positions as steps, ids as distances from them; equal bytes of all numbers side by side, so that small numbers compress."""
    import numpy as np

    numbers = np.concatenate([np.diff(position, prepend=np.int64(0)), id_ - position])
    return numbers.view(np.uint8).reshape(-1, 8).T.tobytes() + nulls.tobytes()


def _holders(planes: bytes):
    import numpy as np

    n = len(planes) // 17
    steps, apart = np.frombuffer(planes, np.uint8, 16 * n).reshape(8, 2 * n).T.copy().view(np.int64).reshape(2, n)
    position = np.cumsum(steps)
    return position, apart + position, np.frombuffer(planes, np.uint8, n, 16 * n)


def _windows(batches, bucket: int):
    """From each block of a hash's holders to each place with pages in it: those pages and all they may look back to."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        seen = batch.column("seen")
        ends, flat = seen.offsets.to_numpy(), seen.values
        filled = [flat.field(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("seq", "position", "id")]
        nulls = sum((flat.field(c).is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << np.uint8(k) for k, c in enumerate(("position", "id"))), np.uint8(0)).astype(np.uint8)
        at, rows, size = batch.column("at").to_numpy(), [[], [], [], []], 0

        def sent():
            take = pa.array(rows[0], pa.int64())
            return pa.RecordBatch.from_arrays(
                [batch.column("grp").take(take), pa.array(rows[1], pa.int64()), *[batch.column(c).take(take) for c in ("h", "weight")],
                 pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary())], ["grp", "place", "h", "weight", "own", "holders"])

        for r in range(batch.num_rows):
            seq, position, id_ = (x[ends[r]:ends[r + 1]] for x in filled)
            marks, order = nulls[ends[r]:ends[r + 1]], np.argsort(seq)
            seq, position, id_, marks = seq[order], position[order], id_[order], marks[order]
            first = int(np.searchsorted(seq, at[r] * bucket, side="right"))  # holders before it are of the block before
            begin = max(first, 1)  # the first holder of all has nothing to look back to
            place = id_[begin:] // PLACE
            for p in np.unique(place):
                mine = np.flatnonzero(place == p) + begin
                low, high = max(0, mine[0] - bucket), mine[-1] + 1
                holders = _planes(position[low:high], id_[low:high], marks[low:high])
                for k, x in zip(rows, (r, p, max(0, begin - low), holders)):
                    k.append(x)
                size += len(holders)
            if size > SENT:
                yield sent()
                rows, size = [[], [], [], []], 0
        yield sent()


def _best_seen(key, table, bucket: int, n: int):
    """The ``n`` best candidates of every page of a place."""
    import numpy as np
    import pyarrow as pa

    place, met = key[1].as_py(), {}
    for h, weight, own, planes in zip(*(table.column(c).to_pylist() for c in ("h", "weight", "own", "holders"))):
        position, id_, nulls = _holders(planes)
        for i in np.flatnonzero(id_[own:] // PLACE == place) + own:
            low = max(0, i - bucket)
            if low < i:
                page = (int(id_[i]), bool(nulls[i] & 2)), (int(position[i]), bool(nulls[i] & 1))
                met.setdefault(page[0], {}).setdefault(page[1], []).append((position[low:i], id_[low:i], nulls[low:i], h, weight))
    found = []
    for page, seen in met.items():
        ranked = []
        for mine, windows in seen.items():
            position, id_, nulls = (np.concatenate([w[k] for w in windows]) for k in range(3))
            sizes = [len(w[0]) for w in windows]
            h, weight = (np.repeat(np.array([w[k] for w in windows], np.int64), sizes) for k in (3, 4))
            order = np.lexsort((id_, nulls, position))
            position, id_, nulls, h, weight = (x[order] for x in (position, id_, nulls, h, weight))
            new = np.flatnonzero(np.r_[True, (np.diff(position) != 0) | (np.diff(id_) != 0) | (np.diff(nulls) != 0)])
            shared, least, position, id_, nulls = np.add.reduceat(weight, new), np.minimum.reduceat(h, new), position[new], id_[new], nulls[new]
            best = np.lexsort((id_, position, 1 - (nulls & 1).astype(np.int64), least, -shared))[:n]
            ranked += [(-int(shared[k]), int(least[k]), not nulls[k] & 1, int(position[k]), int(id_[k]), bool(nulls[k] & 2), mine) for k in best]
        ranked.sort()
        found += [
            (None if page[1] else page[0], None if r[6][1] else r[6][0], None if r[5] else r[4], r[3] if r[2] else None, -r[0], r[1], k + 1)
            for k, r in enumerate(ranked[:n])
        ]
    columns = list(zip(*found)) or [[] for _ in range(7)]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int32()]
    names = [c.split()[0] for c in _FOUND.split(", ")]
    out = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    return out.add_column(0, "grp", pa.array([key[0].as_py()] * len(found), table.schema.field("grp").type))


def candidates(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Ranked candidate list per page: pages seen within the last ``bucket`` holders of a shared hash.

    The recency window and the list length define this operator; ids and positions are whole numbers. Hashes of one page
    only leave first, and of hashes with the same holders (those of a common passage) the smallest stands for all, as every
    one of them meets the same pairs. Holders of a hash are numbered and cut into blocks of ``bucket``, so a hash on a third
    of all pages is spread over as many tasks as it has blocks. Not pairs are moved but windows: each place of ``PLACE`` ids
    gets the holders that its pages may look back to once per hash and block, and counts and ranks there.
    """
    sketches = stored(pages.select("grp", "id", "position", numbers_of(F.col("sketch")).alias("hs")))
    # one shuffle for the counts and for the join: both read the same columns of it
    tokens = sketches.select("grp", "id", "position", F.explode("hs").alias("h")).filter("grp is not null and h is not null").repartition("grp", "h")
    holders = {"n": F.count("*"), "x": F.bit_xor(F.xxhash64("position", "id")), "y": F.bit_xor(F.xxhash64(F.lit("y"), "position", "id"))}
    lists = tokens.groupBy("grp", "h").agg(*[c.alias(k) for k, c in holders.items()]).filter("n > 1")
    alike = lists.groupBy("grp", *holders).agg(F.min("h").alias("h"), F.count("*").alias("weight")).drop("x", "y")
    rows = number_in_group(stored(tokens.join(alike, ["grp", "h"])), ["grp", "h"], "position", "seq", p.chunk)
    block = F.floor((F.col("seq") - 1) / p.bucket)
    later = F.when((block + 1) * p.bucket < F.col("n"), F.array(block, block + 1)).otherwise(F.array(block))
    whole = [F.col(c).cast("long").alias(c) for c in ("position", "id")]
    blocks = rows.withColumn("at", F.explode(later)).groupBy("grp", "h", "at").agg(
        F.first("weight").alias("weight"), F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), *whole)).alias("seen")
    )
    kind = f"grp {pages.schema['grp'].dataType.simpleString()}"
    bucket, n = p.bucket, p.candidates
    windows = blocks.mapInArrow(lambda it: _windows(it, bucket), f"{kind}, {_SEEN}")
    best = windows.groupBy("grp", "place").applyInArrow(lambda key, table: _best_seen(key, table, bucket, n), f"{kind}, {_FOUND}")
    return best.select(
        "grp", *[F.col(c).cast(pages.schema[k].dataType).alias(c) for c, k in (("id", "id"), ("position", "position"), ("candidate_id", "id"), ("candidate_position", "position"))],
        "shared_seen", F.lower(F.lpad(F.hex(F.col("least").bitwiseXOR(F.lit(SIGN))), HASH, "0")).alias("min_hash"), "candidate_rank",
    )


def bounded_matches(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Best match among the bounded candidate list, scored on the full sketches."""
    sketches = pages.select("grp", "id", hashes_of(F.col("sketch")).alias("hs"))
    other = sketches.select("grp", F.col("id").alias("candidate_id"), F.col("hs").alias("c_hs"))
    scored = spread_join(candidates(pages, p).join(sketches, ["grp", "id"]), other, ["grp", "candidate_id"], "id", salts=p.salts)
    shared = F.size(F.array_intersect("hs", "c_hs"))
    scored = scored.withColumn("shared", shared).withColumn(
        "similarity", jaccard(F.col("shared"), F.size("hs"), F.size("c_hs"))
    )
    best = scored.groupBy("grp", "id", "position").agg(
        F.min(F.struct((-F.col("similarity")).alias("n"), "candidate_rank", "candidate_id", "candidate_position", "shared")).alias("m")
    )
    return best.filter(-F.col("m.n") >= p.duplicate_threshold).select(
        "grp", "id", "position", F.col("m.candidate_id").alias("matched_id"),
        F.col("m.candidate_position").alias("matched_position"), F.col("m.shared").alias("shared"),
        (-F.col("m.n")).alias("similarity"),
    )


# ---------------------------------------------------------------- findings

def with_phrases(matches: DataFrame, pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds both URLs and the first eight shared shingles in hash order; ``pages`` also has ``url``."""
    mine = pages.select("grp", "id", "url", "sketch")
    other = pages.select(
        "grp", F.col("id").alias("matched_id"), F.col("url").alias("matched_url"), hashes_of(F.col("sketch")).alias("m_hs")
    )
    rows = spread_join(matches.join(mine, ["grp", "id"]), other, ["grp", "matched_id"], "id", salts=p.salts)
    shared = F.filter("sketch", lambda e: F.array_contains(F.col("m_hs"), F.substring(e, 1, HASH)))
    phrases = F.slice(F.transform(shared, lambda e: F.substring(e, HASH + 1, 1 << 30)), 1, 8)
    return rows.withColumn("phrases", F.filter(phrases, lambda x: x != "")).drop("sketch", "m_hs")


def dup_findings(pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Finding rows from (grp, id, position, url, sketch)."""
    from sitegauge.functions.finding import finding

    pages = cut(pages)
    matches = best_matches(pages, p)
    rows = with_phrases(matches, pages, p)
    percent = F.round(F.col("similarity") * 100).cast("int")
    record = finding(
        rule_key="duplicate.internal-near-match",
        category="Duplicate content",
        severity=F.when(F.col("similarity") >= 0.95, "high").otherwise("review"),
        confidence=percent,
        title="Substantial similarity with another page of the site",
        signals=F.to_json(F.struct(
            percent.alias("similarity"), "matched_url", F.col("phrases").alias("matching_phrases"),
            F.lit("bottom-k sketch of 4-word shingles").alias("method"),
        )),
        policy="publisher policies: replicated content",
        summary=F.concat(percent, F.lit(" percent of the text is also on "), F.col("matched_url"), F.lit(".")),
        salt=F.sha2("matched_url", 256),
        url=F.col("url"),
    )
    return rows.select("grp", F.col("id").alias("page_id"), "url", "position", record.alias("f")).select(
        "grp", "page_id", "url", "position", "f.*"
    )


def dup_match_rows(findings: DataFrame, pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Report rows of duplicate findings: source URL (site start when the page is gone), match, similarity, method."""
    s = F.from_json("signals", "similarity int, matched_url string, method string")
    rows = findings.filter(F.get_json_object("signals", "$.matched_url") != "").withColumn("s", s)
    rows = lookup(rows, pages.select("page_id", F.col("url").alias("page_url")), "page_id", "fingerprint")
    rows = lookup(rows, sites.select("website_id", "start_url"), "website_id", "fingerprint")
    return rows.select(
        "fingerprint", F.coalesce("page_url", "start_url").alias("source_url"), F.col("s.matched_url").alias("matched_url"),
        F.col("s.similarity").alias("similarity"), F.col("s.method").alias("method"),
    )


def site_finalize(targets: DataFrame, pages: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Duplicate findings of a scan over completed and reused targets, in position order, from stored sketches."""
    done = targets.filter(F.col("status").isin("completed", "reused"))
    rows = done.select(F.col("website_id").alias("grp"), F.col("page_id").alias("id"), "position").join(
        pages.select(F.col("page_id").alias("id"), "url", "sketch").filter(F.size("sketch") > 0), "id"
    )
    return dup_findings(rows, p)
