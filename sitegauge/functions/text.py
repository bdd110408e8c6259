"""Text expressions shared by extraction, rules, duplicates and copies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.functions import vocab

SPACE = r"[\s\p{Z}\x{85}]+"
# possessive, so that a token of any number of joined parts is matched without recursion
WORD = r"[\p{L}\p{N}]++(?:['’_-][\p{L}\p{N}]++)*+"
# runs without letters and digits other than one plain space
OTHER_RUN = r"[^\p{L}\p{N} ][^\p{L}\p{N}]*+| [^\p{L}\p{N}]++"


def let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body``, so nested expressions do not multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(values: dict[str, str]) -> Column:
    """A constant map as one folded literal (a map of single literals would burden every planning step)."""
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def computed(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Adds expensive columns that must be evaluated once per row.

    A filter on a plain projected column is pushed below the projection together with a second copy of its
    expression. Columns that come out of a generator stay where they are, so a one-element ``inline`` pins them.
    """
    packed = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*(keep if keep is not None else df.columns), packed)


#: Between the texts of a packed row, and the mark before what stands for these two characters or for null.
BETWEEN, MARK = "\x01", "\x02"


def packed(texts: list[Column]) -> Column:
    """Some texts of a row as one, to be moved: a text column of its own takes eight bytes more, which hardly compress."""
    def marked(text: Column) -> Column:
        plain = F.replace(F.replace(text, F.lit(MARK), F.lit(f"{MARK}m")), F.lit(BETWEEN), F.lit(f"{MARK}b"))
        return F.coalesce(plain, F.lit(f"{MARK}n"))

    return F.concat_ws(BETWEEN, *[marked(t) for t in texts])


def unpacked(value: Column, n: int) -> list[Column]:
    """The texts of ``packed``, in order; ``value`` is best a column, as each text reads it."""
    parts = F.split(value, BETWEEN, -1)

    def plain(part: Column) -> Column:
        return F.replace(F.replace(part, F.lit(f"{MARK}b"), F.lit(BETWEEN)), F.lit(f"{MARK}m"), F.lit(MARK))

    return [F.when(F.get(parts, F.lit(i)) != f"{MARK}n", plain(F.get(parts, F.lit(i)))) for i in range(n)]


def trim(value: Column) -> Column:
    return F.regexp_replace(value, r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")


def collapse(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, SPACE, " "))


def _codepoint(digits: Column) -> Column:
    number = F.when(
        F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 8), 16, 10).try_cast("long")
    ).otherwise(digits.try_cast("long"))
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def unescape(value: Column) -> Column:
    """Named and numeric entities with a closing semicolon; the ampersand itself comes last."""
    names = lookup(vocab.ENTITIES)

    def decode(v: Column) -> Column:
        named = F.aggregate(
            F.array_distinct(F.regexp_extract_all(v, F.lit(r"&([A-Za-z][A-Za-z0-9]*);"), F.lit(1))), v,
            lambda acc, m: F.replace(acc, F.concat(F.lit("&"), m, F.lit(";")), F.coalesce(F.try_element_at(names, m), F.concat(F.lit("&"), m, F.lit(";")))),
        )
        numeric = let(named, lambda n: F.aggregate(
            F.array_distinct(F.regexp_extract_all(n, F.lit(r"&#([0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"), F.lit(1))), n,
            lambda acc, m: F.replace(
                acc, F.concat(F.lit("&#"), m, F.lit(";")), F.coalesce(_codepoint(m), F.concat(F.lit("&#"), m, F.lit(";")))
            ),
        ))
        return F.when(F.instr(v, "&") > 0, F.replace(numeric, F.lit("&amp;"), F.lit("&"))).otherwise(v)

    return let(value, decode)


def slug(value: Column) -> Column:
    """Lower case, transliterated to ASCII, every other run turned into one hyphen."""
    def ascii_(v: Column) -> Column:
        out = F.translate(v, vocab.ASCII_FROM, vocab.ASCII_TO)
        for char, pair in vocab.ASCII_PAIRS.items():
            out = F.replace(out, F.lit(char), F.lit(pair))
        return F.when(F.octet_length(v) == F.length(v), v).otherwise(out)

    out = let(F.lower(value), ascii_)
    return F.trim(F.regexp_replace(out, r"[^a-z0-9]++", "-"), F.lit("-"))


def word_count(value: Column) -> Column:
    return F.regexp_count(value, F.lit(WORD))


def normalized(value: Column) -> Column:
    """Lower-case words separated by single spaces: every run without letters and digits becomes one space."""
    return F.trim(F.regexp_replace(F.lower(value), OTHER_RUN, " "))


def content_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def tokens(text: Column) -> Column:
    """Lower-case letter/digit runs longer than one character."""
    return F.filter(
        F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) > 1
    )


def shingles(words: Column, size: int) -> Column:
    """All runs of ``size`` consecutive words of the whole text, as one string each."""
    def build(w: Column) -> Column:
        last = F.size(w) - size
        return F.when(
            last >= 0,
            F.transform(
                F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)]),
            ),
        ).otherwise(F.array().cast("array<string>"))

    return let(words, build)
