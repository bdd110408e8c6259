"""Benchmark items inside documents: MinHash containment search partitioned by size, verified by exact containment.

An item's set is its distinct 5-word shingles (lower case, ASCII punctuation left out; an item with fewer words is one
shingle of them all). Items are partitioned by the power of two above their set's size. A partition's sketch length ``s``
is such that any document holding ``percent`` % of a set of the partition holds one of the set's ``s`` smallest hashes, so
probing the sketches loses nothing: for m shingles at most ``m - ceil(percent * m / 100)`` can be missing. A document, of
whatever length, is read once: its shingles are looked up in the sketches, a document with fewer shingles than an item
needs is passed over, and each candidate is verified by counting the item's shingles in the document's full set.

Items are the queries. They are read in blocks of bounded size; a block's sketches go to every task and documents are
scanned once per block, in place: documents are never shuffled and no pair is formed that does not share a sketch value.

Defined results: null and empty texts hold nothing; items without words are in no document; rows with null ids keep the
null; repeated rows on either side give a row each; an empty table on either side gives no rows; all other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from sitegauge.llm import grams
from sitegauge.llm.common import texts
from sitegauge.llm.tokens import slices

WORDS = 5
PERCENT = 80
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Bounds of a block of items: how many, and how many characters they have in all.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 16_000_000
_BITS = 22


def _needed(m: int, percent: int) -> int:
    return -(-percent * m // 100)


class Sketches:
    """Sketches of a block of items, ready to be probed."""

    def __init__(self, strings: list[str], n: int = WORDS, percent: int = PERCENT):
        self.percent, self.n = percent, n
        words, at = grams.word_hashes(strings, PUNCTUATION)
        self.widths = sorted({min(n, int(k)) for k in np.diff(at) if k > 0})
        self.sets = grams.gram_sets(strings, n, PUNCTUATION)
        keys, items = [np.empty(0, "u8")], [np.empty(0, "i8")]
        for i, s in enumerate(self.sets):
            top = 1 << int(max(1, len(s)) - 1).bit_length()  # the partition's largest set
            keys.append(s[:top - _needed(top, percent) + 1])
            items.append(np.full(len(keys[-1]), i))
        keys, items = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first, self.items = np.append(first, len(keys)), items[order]
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - _BITS)).astype("i8")] = True

    def search(self, strings: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its ``(item, shared shingles, item's shingles)``."""
        out = [[] for _ in strings]
        if not len(self.keys):
            return out
        words, at = grams.word_hashes(strings, PUNCTUATION)
        found: dict[int, set[int]] = {}
        made = {w: grams.gram_hashes(words, w) for w in self.widths}
        for w, g in made.items():
            place = np.flatnonzero(self.filter[(g >> np.uint64(64 - _BITS)).astype("i8")])
            k = np.minimum(np.searchsorted(self.keys, g[place]), len(self.keys) - 1)
            same = self.keys[k] == g[place]
            place, k = place[same], k[same]
            doc = np.searchsorted(at, place, side="right") - 1
            inside = place + w <= at[doc + 1]
            for d, j in zip(doc[inside].tolist(), k[inside].tolist()):
                found.setdefault(d, set()).update(self.items[self.first[j]:self.first[j + 1]].tolist())
        for d, items in found.items():
            a, b = int(at[d]), int(at[d + 1])
            own = np.unique(np.concatenate([g[a:max(a, b - w + 1)] for w, g in made.items()]))
            for i in sorted(items):
                s = self.sets[i]
                need = _needed(len(s), self.percent)
                if len(own) >= need:
                    shared = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                    if shared >= need:
                        out[d].append((i, shared, len(s)))
        return out


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[list, list[str]]]:
    """The items' ids and texts, one bounded block at a time."""
    items = texts(items, id_col, text_col)
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(-(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(parts):
        part = items.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == k) if parts > 1 else items
        rows = sorted(part.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, r.text))
        yield [r.doc_id for r in rows], [r.text for r in rows]


def _scan(batches: Iterator[pa.RecordBatch], sketches: Sketches, ids: list):
    for batch in batches:
        keys, strings = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in slices(strings):
            rows = [(keys[a + d], ids[i], m, shared) for d, hits in enumerate(sketches.search(strings[a:b])) for i, shared, m in hits]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "n_shingles", "n_shared"])


def search(docs: DataFrame, items: DataFrame, n: int = WORDS, percent: int = PERCENT, **columns: str) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared`` for every item of which a document holds ``percent`` % or more."""
    spark, docs = docs.sparkSession, texts(docs, **columns)
    schema, out = "doc_id long, item_id long, n_shingles long, n_shared long", None
    for ids, strings in blocks(items):
        sketches = spark.sparkContext.broadcast((Sketches(strings, n, percent), ids))
        found = docs.mapInArrow(lambda it, held=sketches: _scan(it, *held.value), schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def is_clean(items: DataFrame, text: str | Column = "text", n: int = WORDS, percent: int = PERCENT) -> Column:
    """Condition on a text column: it holds no item. A filter with it keeps all other columns in place."""
    spark = items.sparkSession
    text, out = F.col(text) if isinstance(text, str) else text, F.lit(True)
    for _, strings in blocks(items):
        sketches = spark.sparkContext.broadcast(Sketches(strings, n, percent))
        out = out & _tester(sketches)(F.coalesce(text, F.lit("")))
    return out


def _tester(sketches) -> Callable[[Column], Column]:
    def clean(batches):
        for strings in batches:
            values = strings.tolist()
            yield pd.Series([not hits for a, b in slices(values) for hits in sketches.value.search(values[a:b])], dtype=bool)

    clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(clean, "boolean")


ORACLE_SQL = r"""
with words as (
  select 0 kind, item_id id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', '', 'g'), '[^\x20\x09-\x0D]+') w from benchmark
  union all
  select 1, doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\[-`{-~]', '', 'g'), '[^\x20\x09-\x0D]+') from documents),
item as (select distinct id, least(5, len(w)) k, array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' ') g
         from words, unnest(range(1, greatest(len(w) - 3, 2))) u(i) where kind = 0 and len(w) > 0),
doc as (select distinct id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') g
        from words, (select distinct k from item) s, unnest(range(1, len(w) - k + 2)) u(i) where kind = 1 and len(w) >= k),
size as (select id, count(*) m from item group by id)
select doc.id doc_id, item.id item_id, any_value(m) n_shingles, count(*) n_shared
from doc join item using (k, g) join size on size.id = item.id group by doc.id, item.id having 100 * count(*) >= 80 * any_value(m)
"""
