"""Periodic runs of words, found with a dictionary of basic factors.

A factor is named for each power of two L: names of length 2L are ranks of pairs of names of length L. Where a factor of
length L occurs again d words later, at the nearest place, and L/2 < d <= L, d is proposed as a period; neighbouring
places that propose the same period are one arithmetic progression, whose ends, extended by words, are those of a run.

Why nothing is missed: let a run have smallest period q and at least 3q words, and L be the power of two with L/2 < q <= L.
A factor of length L < 2q at any place of the run that leaves room recurs q words later. It cannot recur earlier inside
the run, as a primitive block of q words does not equal its own rotation. So every such place proposes exactly q, the
places are neighbours, and no other period longer than L/2 is proposed there. Longer gaps belong to larger L.

A factor that occurs once in its document is dropped, and with it every longer factor that contains it, so that ordinary
prose leaves after two or three lengths. Documents are handled in batches of numpy arrays; the pass is narrow: no
shuffle, one task never holds more than :data:`CHUNK_WORDS` words and its longest document.

Defined results: a null or blank text has no words, no run and an empty collapsed text; rows with a null id and repeated
rows are handled each; an empty table gives no rows; all other input columns are ignored. Words are compared by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.llm.common import texts
from sitegauge.llm.quality_rules import WORD, let

MIN_LENGTH, MIN_REPEATS, CHUNK_WORDS = 24, 3, 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("collapsed", pa.large_binary())])


def factor_levels(ids: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(L, places, gaps)`` for L = 1, 2, 4, ...: places whose factor of length L recurs in its document, and how far on.

    ``ids`` are word numbers and ``doc`` the document number of each place, in ascending order.
    """
    places = np.arange(len(ids))
    keys = doc.astype("i8") * (int(ids.max(initial=0)) + 1) + ids
    name, length = np.empty(len(ids), "i8"), 1
    while len(places):
        order = np.argsort(keys, kind="stable")
        ranked, at = keys[order], places[order]
        same = ranked[1:] == ranked[:-1]
        yield length, at[:-1][same], (at[1:] - at[:-1])[same]
        again = np.append(same, False) | np.append(False, same)
        at, rank = at[again], np.cumsum(np.append(True, ~same))[again]
        name[:] = -1
        name[at] = rank
        places = np.sort(at)
        places = places[places + length < len(ids)]
        places = places[name[places + length] >= 0]  # names are those of one document, so a pair across documents is unique
        places = places[doc[places] == doc[places + length]]
        keys = name[places] * (int(rank.max(initial=0)) + 1) + name[places + length]
        length *= 2


def find_runs(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows ``(first place, length, period)`` of all runs, by first place and period; places count over the whole batch."""
    found = [np.empty((0, 3), "i8")]
    for length, places, gaps in factor_levels(ids, doc):
        near = (gaps <= length) & (2 * gaps > length)
        if not near.any():
            continue
        order = np.lexsort((places[near], gaps[near]))
        at, gap = places[near][order], gaps[near][order]
        first = np.append(True, (np.diff(at) != 1) | (np.diff(gap) != 0) | (doc[at[1:]] != doc[at[:-1]]))
        last = np.append(first[1:], True)
        start, period = at[first], gap[first]
        # the last factor and its next occurrence end the run; both lie in the document
        size = at[last] + length + period - start
        good = size >= np.maximum(MIN_LENGTH, MIN_REPEATS * period)
        found.append(np.stack([start[good], size[good], period[good]], 1))
    runs = np.concatenate(found)
    return np.unique(runs, axis=0)[:, [0, 1, 2]] if len(runs) else runs


def _records(chunk: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
    words = [w for _, ws in chunk for w in ws]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), "i8", len(words))
    begin = np.cumsum([0, *(len(ws) for _, ws in chunk)])
    runs = find_runs(ids, np.repeat(np.arange(len(chunk)), np.diff(begin)))
    cut = np.searchsorted(runs[:, 0], begin)
    out = []
    for k, (doc_id, ws) in enumerate(chunk):
        mine = [(int(s - begin[k]), int(n), int(q)) for s, n, q in sorted(runs[cut[k]:cut[k + 1]].tolist(), key=lambda r: (r[0], r[2]))]
        best, kept = None, ws
        if mine:
            best = dict(zip(("start", "length", "period"), max(mine, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))))
            edge = np.zeros(len(ws) + 1, "i8")
            for s, n, q in mine:
                edge[s + q] += 1
                edge[s + n] -= 1
            kept = [w for w, gone in zip(ws, (np.cumsum(edge[:-1]) > 0).tolist()) if not gone]
        out.append({"doc_id": doc_id, "runs": [dict(zip(("start", "length", "period"), r)) for r in mine], "best": best, "collapsed": b" ".join(kept)})
    return pa.RecordBatch.from_pylist(out, _SCHEMA)


def collapse(docs: DataFrame, **columns: str) -> DataFrame:
    """``doc_id``, ``runs`` by start and period, the ``best`` run (greatest length over period, then first, then shortest
    period; null without a run) and ``collapsed``: the words joined by spaces, of each run only its first period."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                chunk.append((doc_id, text.as_py().split()))  # bytes split at the six ASCII space characters
                size += len(chunk[-1][1])
                if size >= CHUNK_WORDS or len(chunk) >= 1 << 14:
                    yield _records(chunk)
                    chunk, size = [], 0
        if chunk:
            yield _records(chunk)

    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, best struct<start: long, length: long, period: long>, collapsed binary"
    done = texts(docs, **columns).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(scan, schema)
    return done.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """The documents with about every tenth one made periodic from some word on, as a rule of the id's CRC says.

    With h the CRC-32 of the decimal id and g = h div 10: where h mod 10 is 0, word i >= a becomes word a + (i - a) mod p,
    a = g mod n, p = 1 + (n - a) div (3 + g mod 8). Texts without words and rows with a null id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")

        def words_of(rule: Column) -> Column:
            places = F.sequence(F.lit(0).cast("long"), n - 1)
            return F.array_join(F.transform(places, lambda i: F.get(words, F.when(i < rule["a"], i).otherwise(rule["a"] + (i - rule["a"]) % rule["p"]).cast("int"))), " ")

        a = g % n
        return F.when(n > 0, let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + g % 8))).alias("p")), words_of)).otherwise("")

    changed = let(F.regexp_extract_all("text", F.lit(WORD), 0), repeated)
    return texts(docs).select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def digest(done: DataFrame) -> DataFrame:
    """One row of plain columns per document of :func:`collapse`."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
