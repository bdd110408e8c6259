"""Quality rules as a ledger of failure bits and measurements, with versioned policies applied to the bits.

:func:`ledger` measures a text once and sets one bit per failed rule. :func:`apply_policy` turns the bits into a verdict
by a mask, so a new policy, or the effect of dropping a rule (:func:`ablation`), never reads the texts again. Everything
is column expressions in one projection; only the ablation shuffles, and that one row per pattern of bits.

Words are runs of anything but ASCII white space. Repeated words are the words inside 8-word windows whose text occurs
at least twice in the document, compared by a 64-bit hash per window.

Defined results: a null text is empty: no words, and the word-count rule fails; rows with a null id, repeated rows and
texts of any length are measured each; an empty table gives no rows; all other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.llm.common import texts

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measures; its bit is its place in :data:`RULES`."""

    name: str
    fails: Callable[[], Column]


RULES = [
    Rule("few_words", lambda: F.col("n_words") < 20),
    Rule("repeated_words", lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule("symbols", lambda: 100 * F.col("n_symbols") > 20 * F.col("n_words")),
    Rule("repeated_lines", lambda: 100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
    Rule("upper_case", lambda: 100 * F.col("n_upper") > 50 * F.col("word_chars")),
    Rule("word_length", lambda: (F.col("word_chars") > 16 * F.col("n_words")) | (2 * F.col("word_chars") < 3 * F.col("n_words"))),
]
#: Rules that each version of the policy applies; a version is never changed once documents were judged by it.
POLICIES = {
    1: ["few_words", "repeated_words"],
    2: ["few_words", "repeated_words", "symbols", "repeated_lines", "upper_case", "word_length"],
}


def mask(version: int) -> int:
    return sum(1 << i for i, r in enumerate(RULES) if r.name in POLICIES[version])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once per row, also where a lambda inside uses it for every element."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column) -> Column:
    """Number of words inside windows that occur twice or more in the array."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def places(ordered: Column) -> Column:
        at = F.transform(ordered, lambda w, i: F.when(
            w["h"].eqNullSafe(F.get(ordered, i - 1)["h"]) | w["h"].eqNullSafe(F.get(ordered, i + 1)["h"]), w["i"]))
        return F.sort_array(F.filter(at, lambda p: p.isNotNull()))

    def of_windows(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), let(ordered, lambda o: let(places(o), covered))).otherwise(0)

    def of_hashes(hashes: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        return F.when(F.size(hashes) > WINDOW, let(F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW))), of_windows)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def ledger(docs: DataFrame, **columns: str) -> DataFrame:
    """``doc_id``, the measures and ``failed_bits`` of every document."""
    text = F.col("text")
    visible = F.filter(F.split(text, "\n", -1), lambda line: F.length(_without(line, SPACE)) > 0)
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    measured = texts(docs, **columns).select(
        "doc_id",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeated"))).alias("w"),
        let(visible, lambda v: F.struct(F.size(v).cast("long").alias("n"), (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("same"))).alias("l"),
        F.length(_without(text, SPACE)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    ).select(
        "doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.same").alias("n_dup_lines"),
        F.col("w.repeated").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_upper")
    bits = sum((F.when(r.fails(), F.lit(1 << i)).otherwise(0).cast("long") for i, r in enumerate(RULES)), F.lit(0).cast("long"))
    return measured.withColumn("failed_bits", bits)


def apply_policy(entries: DataFrame, version: int) -> DataFrame:
    """Adds ``policy_version`` and ``kept``: no rule of the version failed."""
    return entries.withColumns({"policy_version": F.lit(version), "kept": F.col("failed_bits").bitwiseAND(F.lit(mask(version))) == 0})


def ablation(entries: DataFrame, version: int) -> DataFrame:
    """For each rule of a version: documents that fail it, that fail nothing else, and that stay if the rule is dropped."""
    patterns = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(version))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit"))
                      for i, r in enumerate(RULES) if r.name in POLICIES[version]])
    each = patterns.select("bits", "n", F.inline(rules))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    total = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    return each.groupBy("rule").agg(total(hit, "failed"), total(hit & (rest == 0), "failed_alone"), total(rest == 0, "kept_without"))


ORACLE_SQL = rf"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') as txt from documents),
w as (select r, regexp_extract_all(txt, '{WORD}') ws from d),
win as (select r, i, array_to_string(list_slice(ws, i, i + 7), ' ') g from w, unnest(range(1, len(ws) - 6)) u(i) where len(ws) >= 8),
twice as (select r, i from win qualify count(*) over (partition by r, g) > 1),
rep as (select r, count(distinct i + k) n from twice, range(8) o(k) group by r),
ln as (select r, count(*) n, count(*) - count(distinct l) same from (select r, unnest(string_split(txt, chr(10))) l from d)
       where regexp_matches(l, '{WORD}') group by r),
m as (select doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
        len(regexp_extract_all(txt, '[#*$%&|<>]'))::bigint n_symbols, coalesce(ln.same, 0)::bigint n_dup_lines,
        coalesce(rep.n, 0)::bigint n_repeat_words, coalesce(ln.n, 0)::bigint n_lines, len(regexp_extract_all(txt, '\p{{Lu}}'))::bigint n_upper
      from d join w using (r) left join rep using (r) left join ln using (r)),
b as (select *, (n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint + 4 * (100 * n_symbols > 20 * n_words)::bigint
        + 8 * (100 * n_dup_lines > 50 * n_lines)::bigint + 16 * (100 * n_upper > 50 * word_chars)::bigint
        + 32 * (word_chars > 16 * n_words or 2 * word_chars < 3 * n_words)::bigint failed_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 as base_failed, failed_bits = 0 as kept, failed_bits from b
"""
