"""How far the word use of sources lies apart, over run-length encoded count columns.

Per language, the kept terms are those in at least ``MIN_DOCS`` documents. A (language, source) group gives each of the V
kept terms p = 1 + floor(10^9 (count + 1) / (N + V)), N being its count of kept terms, and f(p, q) = floor((p - q)^2 / q).
Two audits: the sum of f over all kept terms for each ordered pair of sources, and the terms that a source uses most
beyond its language. All arithmetic is exact in 64-bit integers.

The pair sums use columns, one per source over the vocabulary. The vocabulary is reordered by the terms' count vectors, so
that equal counts cluster: terms with one vector are a single entry with a number of terms. Blocks of entries are
run-length encoded per source; for a pair the boundaries of both columns are intersected, and f is taken once per
stretch and multiplied by its number of terms. Most terms are rare, so most of a column is one run of zeros.

Shuffles carry counts, never texts: each task counts terms per group first. A hot source is a third of the texts but one
column. Blocks are bounded in entries and stored counts; sources of a language meet in tiles of :data:`TILE` columns, whose
sums are the only state of a task. The pairs of sources of a language are the result itself.

Defined results: null text, language and source are empty strings; a group without kept terms takes part with N = 0;
without kept terms in a language all its pair values are 0; a language of one source has no pairs; repeated rows and rows
with a null id count each; an empty table gives no rows; all other input columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sitegauge.llm.common import stored

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
MIN_DOCS, TOP, SCALE = 3, 200, 1000
TILE, BLOCK_ENTRIES, BLOCK_COUNTS, FLUSH, SALTS = 128, 1 << 13, 1 << 16, 1 << 19, 64


def groups_of(docs: DataFrame) -> DataFrame:
    """``lang, source, text`` without nulls; rows stay rows."""
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def count_terms(rows: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of every term in every group, added up per task."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in sums.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()),
                    pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            sums.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n, docs = sums.setdefault((lang, source), (Counter(), Counter()))
                terms, before = TERM.findall(text.lower()), len(n)  # bytes: lower() changes A-Z alone
                n.update(terms)
                docs.update(set(terms))
                held += len(n) - before
                if held >= FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    return rows.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(count, "lang string, source string, term binary, n long, docs long")


def kept_terms(rows: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term, lang_n, entry``: terms in ``min_docs`` documents or more of their language, with ``(s, n)`` per source, by name.

    The rows come added up per task, so they are dealt by term at once and added up there, for sources and then languages.
    """
    dealt = count_terms(rows).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    entry = F.sort_array(F.collect_list(F.struct(F.col("source").alias("s"), "n")))  # one element per source
    whole = dealt.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"), entry.alias("entry"))
    return whole.filter(F.col("docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"), "lang_n", "entry")


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + floor(10^9 (count + 1) / total)``, by long division in steps of 1,000 that never leave 64 bits."""
    rest = counts.astype("i8") + 1
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * SCALE
        out = out * SCALE + rest // total
        rest = rest % total
    return out + 1


def share(count: str, total: str) -> str:
    """:func:`shares` as SQL: decimals of 38 digits hold the product exactly."""
    return f"1 + ((cast({count} + 1 as decimal(19,0)) * cast(1000000000 as decimal(10,0))) div {total})"


def encode(vectors: DataFrame) -> DataFrame:
    """Run-length columns: ``lang, terms, sources, ends, counts`` per block, from ``lang, entry, terms`` sorted in each task.

    An entry lists ``(source, count)`` of the sources that use its terms. For source ``sources[i]`` of a block, the run that
    ends before term ``ends[i][j]`` has count ``counts[i][j]``; sources not listed are zero all over.
    """
    schema = "lang string, terms long, sources array<string>, ends array<array<long>>, counts array<array<long>>"

    def column(at: list[int], n: list[int], start: np.ndarray) -> tuple[list[int], list[int]]:
        values = np.zeros(len(start) - 1, "i8")
        values[at] = n
        last = np.append(values[1:] != values[:-1], True)
        return start[1:][last].tolist(), values[last].tolist()

    def block(lang: str, entries: list, sizes: list[int]) -> dict:
        start, used = np.cumsum([0, *sizes]), {}
        for i, entry in enumerate(entries):
            for x in entry:
                at, n = used.setdefault(x["s"], ([], []))
                at.append(i)
                n.append(x["n"])
        runs = [column(*used[s], start) for s in sorted(used)]
        return {"lang": lang, "terms": int(start[-1]), "sources": sorted(used), "ends": [r[0] for r in runs], "counts": [r[1] for r in runs]}

    arrow = pa.schema([("lang", pa.string()), ("terms", pa.int64()), ("sources", pa.list_(pa.string())),
                       ("ends", pa.list_(pa.list_(pa.int64()))), ("counts", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, entries, sizes, held = None, [], [], 0
        for batch in batches:
            for next_lang, entry, terms in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if entries and (next_lang != lang or len(entries) >= BLOCK_ENTRIES or held >= BLOCK_COUNTS):
                    yield pa.RecordBatch.from_pylist([block(lang, entries, sizes)], arrow)
                    entries, sizes, held = [], [], 0
                lang = next_lang
                entries.append(entry)
                sizes.append(terms)
                held += len(entry)
        if entries:
            yield pa.RecordBatch.from_pylist([block(lang, entries, sizes)], arrow)

    return vectors.mapInArrow(run, schema)


def block_sums(terms: int, used: list[int], ends: list, counts: list, totals: np.ndarray, rows: range) -> np.ndarray:
    """Sum of f over a block's terms, for each source of ``rows`` against every source; ``totals`` is N + V per source.

    Sources are numbers here; ``used`` are those with a run-length column.
    """
    out = np.zeros((len(rows), len(totals)), "i8")
    if not terms:
        return out
    place = {s: i for i, s in enumerate(used)}
    end_of = [np.array(ends[place[s]] if s in place else [terms], "i8") for s in range(len(totals))]
    share_of = [shares(np.array(counts[place[s]] if s in place else [0], "i8"), int(totals[s])) for s in range(len(totals))]
    # all columns end to end: the run of source s that ends at e ends here at s * terms + e
    column_ends = np.concatenate([e + s * terms for s, e in enumerate(end_of)])
    column_shares = np.concatenate(share_of)
    shift = np.arange(len(totals), dtype="i8") * terms
    for k, s in enumerate(rows):
        mine = (end_of[s][None, :] + shift[:, None]).ravel()
        cut = np.sort(np.concatenate([mine, column_ends]))
        cut = cut[np.append(True, cut[1:] != cut[:-1])]
        length = np.diff(cut, prepend=0)
        p = np.tile(share_of[s], len(totals))[np.searchsorted(mine, cut)]
        q = column_shares[np.searchsorted(column_ends, cut)]
        total = np.append(0, np.cumsum((p - q) * (p - q) // q * length))
        out[k] = np.diff(total[np.searchsorted(cut, np.append(0, shift + terms), side="right")])
    return out


def pair_sums(blocks: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of the sources ``tile * TILE ...`` of each row; every task adds its blocks up first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, totals, total = None, [], None, None

        def out() -> Iterator[pa.RecordBatch]:
            for s, sums in zip(names[key[1] * TILE:], total):
                yield pa.RecordBatch.from_pylist([{"lang": key[0], "source": s, "item": o, "value": v} for o, v in zip(names, sums.tolist()) if o != s], schema)

        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["lang"], row["tile"]):
                    if key is not None:
                        yield from out()
                    key, names, total = (row["lang"], row["tile"]), [g["source"] for g in row["groups"]], 0
                    number, totals = {s: i for i, s in enumerate(names)}, np.array([g["total"] for g in row["groups"]], "i8")
                first = key[1] * TILE
                used = [number[s] for s in row["sources"] or []]
                total = total + block_sums(row["terms"] or 0, used, row["ends"], row["counts"], totals, range(first, min(first + TILE, len(names))))
        if key is not None:
            yield from out()

    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    return blocks.mapInArrow(run, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int | None = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has every other source of the language, part ``term`` the
    ``top`` terms (None: all) that the source uses beyond its language; ranks by value, then item in UTF-8 order."""
    rows = groups_of(docs)
    kept = stored(kept_terms(rows, min_docs), "kept-terms")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = kept.select("lang", F.inline("entry")).groupBy("lang", F.col("s").alias("source")).agg(F.sum("n").alias("n_kept"))
    groups = stored(
        rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").select(
            "lang", "source", (F.coalesce("n_kept", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"),
            (F.coalesce("lang_total", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("lang_all")),
        "groups")
    parts = [_pairs(kept, groups), _terms(kept, groups)]
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs, terms = (p.withColumn("rank", F.row_number().over(order)) for p in parts)
    return pairs.unionByName(terms if top is None else terms.filter(F.col("rank") <= top))


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    vectors = kept.groupBy("lang", "entry").agg(F.count("*").alias("terms"))
    # ranges are drawn from short keys, so that the sample of them stays small whatever the number of sources
    blocks = encode(vectors.repartitionByRange("lang", F.slice("entry", 1, 2), F.xxhash64("entry")).sortWithinPartitions("lang", "entry"))
    named = F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups")
    langs = groups.groupBy("lang").agg(named).withColumn("tile", F.explode(F.expr(f"sequence(0, (size(groups) - 1) div {TILE})")))
    # a language's blocks are dealt over salts, as one language may hold most of them; without blocks it keeps empty rows
    salted = stored(blocks, "run-length-blocks").withColumn("salt", F.pmod(F.xxhash64("terms", "ends", "counts"), F.lit(SALTS)).cast("int"))
    tiled = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).join(salted, ["lang", "salt"], "left")
    sums = pair_sums(tiled.sortWithinPartitions("lang", "tile").select("lang", "tile", "groups", "terms", "sources", "ends", "counts"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def _terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    used = kept.select("lang", "term", "lang_n", F.inline("entry")).withColumnRenamed("s", "source")
    shown = used.join(groups, ["lang", "source"])
    both = shown.select("lang", "source", F.col("term").alias("item"), F.expr(share("n", "total")).alias("p"), F.expr(share("lang_n", "lang_all")).alias("q"))
    return both.filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = rf"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, coalesce(text, '') txt from documents),
g as (select distinct lang, source from d),
t as (select r, lang, source, unnest(regexp_extract_all(translate(txt, '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from d),
l as (select lang, term, count(*) n from t group by all having count(distinct r) >= {MIN_DOCS}),
c as (select lang, source, term, count(*) n from t join l using (lang, term) group by all),
v as (select lang, count(*) v, sum(n) n from l group by lang),
s as (select g.lang, g.source, coalesce(sum(c.n), 0) n from g left join c using (lang, source) group by all),
p as (select s.lang, s.source, l.term, coalesce(c.n, 0) n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (s.n + v.v))::hugeint p
      from s join l using (lang) join v using (lang) left join c on c.lang = s.lang and c.source = s.source and c.term = l.term),
pairs as (select a.lang, a.source, b.source item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) as value
          from s a join s b on a.lang = b.lang and a.source <> b.source
          left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
          where x.term is null or y.term is not null group by all),
q as (select l.lang, l.term, (1 + (1000000000::hugeint * (l.n + 1)) // (v.n + v.v))::hugeint q from l join v using (lang)),
terms as (select lang, source, term item, (p - q) * (p - q) // q as value from p join q using (lang, term) where n > 0 and p > q),
both_parts as (select lang, source, 'pair' part, item, value from pairs union all select lang, source, 'term', item, value from terms),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_parts)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP}
"""
