"""Line dedup across the corpus: a line goes if an equal line, or one within one word edit of it, comes earlier.

Lines end at ``\\n``; a line is its sequence of words (runs of anything but ASCII white space) and comes earlier by id, then
row (a hash of its text; equal rows in any order), then place. Lines without a word always stay. Equal lines meet in one combinable minimum. For lines of ``MIN_WORDS`` words or
more, one word replaced, left out or added (Levenshtein distance 1 over words) counts as well, found by their deletion
neighbourhood:

1. Two such lines share one exact half. Lines none of whose halves (of their length and of one word less) is shared by
   another distinct line have no neighbour and are done; the others are marked in a filter of fixed size.
2. Each marked line emits its variants as hashed keys: every word left out, and every gap where a word could have been
   left out, each by the hashes of the words before and after it and of its place. Lines with an equal key are within
   one edit of each other, all of them, so the earliest of a key is a combinable minimum and no pairs are formed.
3. The line and its earliest neighbour are compared word by word before the line is dropped.

A line dropped for its neighbour still counts as the earlier one for others. Only DataFrame functions are used.

Defined results: null and empty texts have no lines and stay empty; a row whose lines all go keeps an empty text; rows
with a null id come first; rows with the same id are told apart by their texts, and of equal rows one keeps its lines
while the others lose them; an empty table gives no rows; all other columns pass through :func:`rewrite` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sitegauge.llm.common import stored, texts
from sitegauge.llm.quality_rules import let

MIN_WORDS = 10
SPACE = r"[\x20\x09-\x0D]+"
#: Size of the filter of marked lines: FILTER_BITS bits in rows of 2**15, at most 4 MB whatever the corpus.
FILTER_BITS = 1 << 25


def _words(line: Column) -> Column:
    """Words of a line; most lines hold no other white space than spaces, and those split faster."""
    return F.array_remove(F.when(line.rlike(r"[\x09-\x0D]"), F.split(line, SPACE)).otherwise(F.split(line, " ")), "")


def _visible(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _contents(docs: DataFrame) -> DataFrame:
    """``doc_id, row, line, content`` of every line; ``row`` tells texts of one id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))


def _hashes(content: str) -> Column:
    return F.transform(_words(F.col(content)), lambda w: F.xxhash64(w))


def _ids(w: Column) -> list[Column]:
    return [F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(1), w).alias("h2")]


def _halves(w: Column) -> Column:
    n = F.size(w)
    a, b = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    head = lambda k: F.xxhash64(F.lit("head"), F.slice(w, F.lit(1), k))
    tail = lambda k: F.xxhash64(F.lit("tail"), F.slice(w, n - k + 1, k))
    return F.when(n >= MIN_WORDS, F.array_distinct(F.array(head(a), head(b), tail(n - a), tail(n - 1 - b)))).otherwise(F.array().cast("array<bigint>"))


def _place(h: str) -> Column:
    return F.pmod(F.col(h), F.lit(FILTER_BITS))


def _filter(lines: DataFrame) -> DataFrame:
    """The lines' first hashes as bitmaps: at most FILTER_BITS / 2**15 rows of 4 KB, so a broadcast of it is bounded."""
    return lines.groupBy(F.bitmap_bucket_number(_place("h1")).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_place("h1"))).alias("bits"))


def _has_bit() -> Column:
    at = F.bitmap_bit_position(_place("h1"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _within_one(a: Column, b: Column) -> Column:
    """Levenshtein distance of two unequal arrays is 1: they agree before and after one place."""
    def common(x: Column, y: Column) -> Column:
        other = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True)
        return F.when(other == 0, F.greatest(F.size(x), F.size(y))).otherwise(other - 1)

    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longer - 1)


def near_lines(docs: DataFrame, first: DataFrame) -> DataFrame:
    """``p`` (place of the first occurrence) of lines that have an earlier neighbour. ``first``: the distinct lines.

    The words of marked lines are read again from the texts: a filter of their places spares all other lines the work.
    """
    halves = first.select("h1", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    marked = stored(halves.join(shared, "half", "left_semi").select("h1").distinct(), "marked")
    # numbers in the order of the places stand for them from here on, so that rows of variants are short
    order = stored(first.join(marked, "h1").select("p").orderBy("p").select("p", F.monotonically_increasing_id().alias("o")), "order")
    places = _contents(docs).withColumn("h1", F.xxhash64("doc_id", "row", "line"))
    wanted = _filter(order.select(F.xxhash64("p.doc_id", "p.row", "p.line").alias("h1")))
    passed = places.withColumn("bucket", F.bitmap_bucket_number(_place("h1"))).join(F.broadcast(wanted), "bucket").filter(_has_bit())
    passed = passed.select(F.struct("doc_id", "row", "line").alias("p"), _hashes("content").alias("w"))
    # equal rows hold a place more than once
    lead = stored(passed.join(order, "p").groupBy("p").agg(F.first("o").alias("o"), F.first("w").alias("w")).select("o", "w"), "lines")

    words = lead.repartition("o").select("o", F.size("w").alias("n"), F.posexplode("w").alias("i", "x"))
    line = W.partitionBy("o")
    before = line.orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    after = line.orderBy("i").rowsBetween(1, W.unboundedFollowing)
    from_start, from_end = F.xxhash64("x", "i"), F.xxhash64("x", F.col("n") - F.col("i"))
    sides = words.select("o", "n", "i", from_start.alias("a"), from_end.alias("b")).select(
        "o", "n", "i", "a", "b", F.coalesce(F.bit_xor("a").over(before), F.lit(0)).alias("head"), F.coalesce(F.bit_xor("b").over(line), F.lit(0)).alias("all"),
        F.coalesce(F.bit_xor("b").over(before), F.lit(0)).alias("done"))
    rest = F.col("all").bitwiseXOR(F.col("done"))  # from this word on
    key = lambda n, i, head, tail: F.xxhash64(n, i, head, tail)
    n, i = F.col("n").cast("int"), F.col("i").cast("int")
    last = F.when(i == n - 1, key(n + 1, n, F.col("head").bitwiseXOR(F.col("a")), F.lit(0).cast("long")))
    variants = stored(sides.select("o", F.explode(F.filter(F.array(
        key(n, i, F.col("head"), rest.bitwiseXOR(F.col("b"))), key(n + 1, i, F.col("head"), rest), last), lambda k: k.isNotNull())).alias("key")), "variants")
    earliest = variants.groupBy("key").agg(F.min("o").alias("q"), F.count("*").alias("n")).filter("n > 1").select("key", "q")
    pairs = variants.join(earliest, "key").filter("q < o").select("o", "q").distinct()
    left, right = lead.select("o", F.col("w").alias("a")), lead.select(F.col("o").alias("q"), F.col("w").alias("b"))
    near = pairs.join(left, "o").join(right, "q").filter(_within_one(F.col("a"), F.col("b"))).select("o").distinct()
    return order.join(near, "o", "left_semi").select("p")


def kept_lines(docs: DataFrame) -> DataFrame:
    """``kept_of`` (id and hash of the text), ``kept``: numbers of the lines that stay, for texts with any. ``docs``: ``doc_id, text``."""
    lines = _contents(docs).select("doc_id", "row", "line", _hashes("content").alias("w")).filter(F.size("w") > 0)
    known = lines.select(F.struct("doc_id", "row", "line").alias("p"), *_ids(F.col("w")), _halves(F.col("w")).alias("halves"))
    first = stored(known.groupBy("h1", "h2").agg(F.min("p").alias("p"), F.first("halves").alias("halves")), "first")
    gone = near_lines(docs, first)
    stay = first.select("p").join(gone, "p", "left_anti")
    return stay.groupBy(F.struct("p.doc_id", "p.row").alias("kept_of")).agg(F.collect_list("p.line").alias("kept"))


def rewrite(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", info: str | None = None) -> DataFrame:
    """``docs`` with the lines of ``text_col`` that stay; ``info``: name of a column of counts to add."""
    kept = kept_lines(texts(docs, id_col, text_col))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    name, of, mine = ("_".join([x, *docs.columns]) for x in ("made", "of", "mine"))  # no column of the input has these names
    # a plain column as the key, by which the joined rows then lie together
    key = lambda doc_id, row: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), row.cast("string"))
    keyed = docs.select("*", key(docs[id_col].cast("long"), F.xxhash64(text)).alias(of))
    lists = kept.select(key(F.col("kept_of.doc_id"), F.col("kept_of.row")).alias(name), F.col("kept").alias(mine))
    joined = keyed.join(lists, F.col(f"`{of}`") == lists[name], "left").drop(lists[name])
    # the join leaves equal rows side by side, so this window needs no shuffle of its own
    again = F.count(F.lit(1)).over(W.partitionBy(F.col(f"`{of}`")).rowsBetween(W.unboundedPreceding, W.currentRow)) > 1
    joined = joined.withColumn(mine, F.when(~again, F.col(f"`{mine}`")))

    def build(lines: Column) -> Column:
        blank = F.filter(F.transform(lines, lambda x, i: F.when(~_visible(x), i)), lambda i: i.isNotNull())
        kept_here = F.filter(F.coalesce(F.col(f"`{mine}`"), F.array().cast("array<int>")), lambda i: i < F.size(lines))

        def chosen(blank: Column) -> Column:
            stay = F.sort_array(F.array_union(kept_here, blank))
            return let(stay, lambda s: F.struct(
                F.array_join(F.transform(s, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(blank)).cast("long").alias("n_lines"),
                (F.size(lines) - F.size(s)).cast("long").alias("n_removed")))

        return let(blank, chosen)

    columns = [docs[c] for c in docs.columns if c != text_col]
    made = joined.select(*columns, let(F.split(text, "\n", -1), build).alias(name))
    out = made.withColumn(text_col, F.col(f"`{name}`.text"))
    if info:
        out = out.withColumn(info, F.struct(F.col(f"`{name}`.n_lines"), F.col(f"`{name}`.n_removed")))
    return out.select(*docs.columns, *([info] if info else []))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_removed, text``: lines with a word, how many of them went, and the rest of the text."""
    out = rewrite(texts(docs, id_col, text_col), info="counts")
    return out.select("doc_id", "counts.n_lines", "counts.n_removed", "text")


KEPT_SQL = r"""
  line as (select doc_id, k - 1 line, content, list_filter(string_split_regex(content, '[\x20\x09-\x0D]+'), lambda x: x <> '') w
           from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) k from {docs})),
  uniq as (select w, min({{'d': doc_id, 'l': line}}) p from line where len(w) > 0 group by w),
  cut as (select p, len(w) n, i, array_to_string(w[1:i - 1], ' ') || chr(10) || array_to_string(w[i + 1:], ' ') k from uniq, unnest(range(1, len(w) + 1)) u(i) where len(w) >= 10
          union all
          select p, len(w) + 1, i, array_to_string(w[1:i - 1], ' ') || chr(10) || array_to_string(w[i:], ' ') from uniq, unnest(range(1, len(w) + 2)) u(i) where len(w) >= 10),
  least_ as (select n, i, k, min(p) q from cut group by n, i, k having min(p) < max(p)),
  stay as (select p from uniq where p not in (select p from cut join least_ using (n, i, k) where q < p)),
  mark as (select line.*, len(w) > 0 has, stay.p is not null keep from line left join stay on stay.p = {{'d': line.doc_id, 'l': line.line}})
"""
ORACLE_SQL = "with " + KEPT_SQL.format(docs="documents").replace("{{", "{").replace("}}", "}") + """
select doc_id, count(*) filter (has) n_lines, count(*) filter (has and not keep) n_removed,
  sha256(coalesce(string_agg(content, chr(10) order by line) filter (not has or keep), '')) kept_sha256
from mark group by doc_id
"""
