"""Removal of byte strings of ``LENGTH`` bytes that start in more than one place of the corpus, by prefix-free parsing.

Parsing: a rolling hash of ``ROLL`` bytes marks triggers, which depend on nothing but those bytes. Triggers cut a text
into phrases, and name anchors: the ``ANCHOR`` bytes from a trigger on. A window (a string of LENGTH bytes) is filed under
the smallest anchor inside it, so equal windows share their anchor, and neighbouring windows with one anchor are one
row: the anchor and the hash of the stretch of text they span. Windows without a trigger, as in text that repeats a
word, take their smallest place as anchor.

Deciding: rows with an equal stretch are repeats as a whole (a combinable count). Rows whose anchor occurs nowhere else
are unique. What remains are stretches that share an anchor and differ, the ends of repeats. Their texts are fetched
and ordered in slices: the suffix array of the dictionary of distinct phrases and the suffix array of the parse give
each window its place in corpus order, where equal windows stand side by side. Each distinct window of a slice is then
asked for once, as a packed 64-bit fingerprint, in the bucket that owns it, which answers where it occurs in other
slices. No group of equal windows, anchors or stretches is ever gathered in one task.

Equality of rows is that of 64-bit fingerprints of the bytes. Defined results: null texts are empty; texts shorter than
LENGTH lose nothing; repeated rows repeat all their windows; rows with a null id keep it; an empty table gives no rows;
all other input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from sitegauge.llm.common import MEMBER_BITS, member_bits, stored, texts
from sitegauge.llm.grams import _VALUES, _powers, mix

LENGTH, ROLL, ANCHOR, TRIGGER = 400, 16, 96, 32
#: Bytes that are parsed together; longer texts are taken in stretches of this length that overlap by a window.
PIECE = 2_000_000
#: Bytes of stretches that are put in order together.
SLICE = 1_500_000
ROWS = "rid long, s1 long, s2 long, key long, ctx long, m long"
SPANS = "rid long, s1 long, s2 long"
_NOBODY = np.uint32(0xFFFFFFFF)


class Prints:
    """Fingerprints of any stretch of a byte array."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(1 << int(max(len(data), PIECE)).bit_length())
        self.total = np.zeros(len(data) + 1, "u8")
        np.cumsum(_VALUES[data] * power[:len(data)], out=self.total[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[begin]) * self.inverse[begin] + (end - begin).astype("u8"))

    def triggers(self, n: int) -> np.ndarray:
        if n < ROLL:
            return np.empty(0, "i8")
        at = (self.total[ROLL:n + 1] - self.total[:n + 1 - ROLL]) * self.inverse[:n + 1 - ROLL]
        return np.flatnonzero(mix(at) % np.uint64(TRIGGER) == 0)


def parse(pieces: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Rows of texts: ``(piece, s1, s2, key, ctx, m)`` for windows s1..s2 of a piece, of which there are ``m`` equal ones.

    Equal rows among these texts are known repeats: they come as spans with ``m`` = 0, and one of them as a row that
    tells other tasks.
    """
    data = np.concatenate(pieces)
    end = np.cumsum([len(p) for p in pieces])
    begin = end - [len(p) for p in pieces]
    prints = Prints(data)
    t = prints.triggers(len(data))
    home = np.searchsorted(end, t, side="right")
    inside = t + ANCHOR <= end[home]
    t, home = t[inside], home[inside]
    f = prints.of(t, t + ANCHOR)
    lo, hi = np.maximum(t - (LENGTH - ANCHOR), begin[home]), np.minimum(t, end[home] - LENGTH)
    for k in range(1, len(t)):  # windows that hold two anchors go to the smaller, then to the earlier one
        close = np.flatnonzero(t[k:] - t[:-k] <= LENGTH - ANCHOR)
        if not len(close):
            break
        later = close + k
        first = f[close] <= f[later]
        np.maximum.at(lo, later[first], t[close[first]] + 1)
        np.minimum.at(hi, close[~first], t[later[~first]] - (LENGTH - ANCHOR) - 1)
    used = hi >= lo
    t, home, lo, hi, f = t[used], home[used], lo[used], hi[used], f[used]
    ctx = mix(prints.of(lo, hi + LENGTH) ^ mix((t - lo).astype("u8")))
    free = np.zeros(len(data) + 1, "i4")
    whole = end - begin >= LENGTH
    np.add.at(free, begin[whole], 1)
    np.add.at(free, end[whole] - LENGTH + 1, -1)
    np.add.at(free, lo, -1)
    np.add.at(free, hi + 1, 1)
    more = _without_anchor(prints, np.flatnonzero(np.cumsum(free) > 0))
    lo, hi, key, ctx = (np.concatenate([x, y]) for x, y in zip((lo, hi, f, ctx), more))
    home = np.searchsorted(end, lo, side="right")
    order = np.argsort(lo, kind="stable")
    lo, hi, key, ctx, home = lo[order], hi[order], key[order], ctx[order], home[order]
    _, lead, which, many = np.unique(mix(key) ^ ctx, return_index=True, return_inverse=True, return_counts=True)
    again = np.flatnonzero(many[which] > 1)
    follows = (lo[again][1:] == hi[again][:-1] + 1) & (home[again][1:] == home[again][:-1])
    head = np.flatnonzero(np.append(True, ~follows)) if len(again) else again
    tail = np.append(head[1:], len(again)) - 1 if len(again) else again
    head, tail = again[head], again[tail]
    where, none = np.concatenate([home[lead], home[head]]), np.zeros(len(head), "u8")
    a, b = np.concatenate([lo[lead], lo[head]]) - begin[where], np.concatenate([hi[lead], hi[tail]]) - begin[where]
    return where, a, b, np.concatenate([key[lead], none]), np.concatenate([ctx[lead], none]), np.concatenate([many, none.view("i8")])


def _without_anchor(prints: Prints, bare: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of windows without a trigger's anchor: every place of theirs is an anchor, and the smallest, leftmost one counts."""
    if not len(bare):
        return bare, bare, np.empty(0, "u8"), np.empty(0, "u8")
    width = LENGTH - ANCHOR + 1
    head = np.flatnonzero(np.append(True, bare[1:] != bare[:-1] + 1))
    first, count = bare[head], np.diff(np.append(head, len(bare)))
    size = count + width - 1
    base = np.cumsum(size) - size
    t = np.arange(int(size.sum())) - np.repeat(base - first, size)
    f = mix(prints.of(t, t + ANCHOR) ^ np.uint64(TRIGGER))
    best, span = np.arange(len(t)), 1
    while 2 * span <= width:  # smallest of the ``span`` places from each place on
        other = best[np.minimum(np.arange(len(t)) + span, len(t) - 1)]
        best = np.where(f[other] < f[best], other, best)
        span *= 2
    at = np.repeat(base, count) + bare - np.repeat(first, count)
    left, right = best[at], best[at + width - span]
    chosen = np.where(f[right] < f[left], right, left)
    start = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    lo, hi, chosen = bare[start], bare[np.append(start[1:], len(bare)) - 1], chosen[start]
    return lo, hi, f[chosen], mix(prints.of(lo, hi + LENGTH) ^ mix((t[chosen] - lo).astype("u8")))


def _pieces(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of a text so that every window lies in exactly one of them."""
    data = np.frombuffer(text, "u1")
    for at in range(0, max(1, len(data) - LENGTH + 1), PIECE):
        yield at, data[at:at + PIECE + LENGTH - 1]


def _column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [t.encode() for t in batch.column(name).to_pylist()]


def _parse_rows(batches: Iterator[pa.RecordBatch]):
    def flush():
        where, a, b, key, ctx, m = parse([p for _, _, p in held])
        rid, base = np.array([r for r, _, _ in held], "i8"), np.array([at for _, at, _ in held], "i8")
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[where], a + base[where], b + base[where], key.view("i8"), ctx.view("i8"), m)], ["rid", "s1", "s2", "key", "ctx", "m"])

    held, size = [], 0
    for batch in batches:
        for rid, text in zip(batch.column("rid").to_pylist(), _column(batch, "text")):
            if len(text) < LENGTH:
                continue
            for at, piece in _pieces(text):
                held.append((rid, at, piece))
                size += len(piece)
                if size >= PIECE:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def _ranks(first: np.ndarray, limit: np.ndarray, step: int, longest: int) -> np.ndarray:
    """Ranks of suffixes by prefix doubling; ``limit``: where each suffix's string ends, ``step``: length ranked so far."""
    rank = np.unique(first, return_inverse=True)[1].astype("u8") + np.uint64(1)
    place = np.arange(len(rank))
    while step < longest:
        then = place + step
        next_ = np.where(then < limit, rank[np.minimum(then, len(rank) - 1)], np.uint64(0))
        rank = np.unique(rank << np.uint64(32) | next_, return_inverse=True)[1].astype("u8") + np.uint64(1)
        step *= 2
        if len(rank) and int(rank.max()) == len(rank):
            break
    return rank


def corpus_order(data: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray, home: np.ndarray, prints: Prints) -> np.ndarray:
    """Order of the suffixes at ``starts`` of the stretches ``begin..end`` of ``data``, each ending with its stretch.

    Phrases run from a trigger to the end of the next one. Equal phrases are one entry of the dictionary, whose suffixes
    are ranked; the parse is the sequence of phrases of each stretch, whose suffixes are ranked by the phrases' ranks. A
    window is ordered by the rank of the rest of its phrase and then by the rank of the parse after it.
    """
    t = prints.triggers(len(data))
    at = np.searchsorted(end, t, side="right")
    t = t[(t + ROLL <= end[at]) & (t > begin[at])]
    cut = np.sort(np.concatenate([begin, t]))
    owner = np.searchsorted(begin, cut, side="right") - 1
    stop = np.minimum(np.append(cut[1:], len(data)) + ROLL, end[owner])
    name = prints.of(cut, stop)
    _, lead, word = np.unique(name, return_index=True, return_inverse=True)
    size = (stop - cut)[lead]
    base = np.cumsum(size) - size
    spot = np.arange(int(size.sum()))
    limit = np.repeat(base + size, size)
    letters = data[spot - np.repeat(base, size) + np.repeat(cut[lead], size)].astype("u8") + np.uint64(1)
    packed = np.zeros(len(letters), "u8")
    for k in range(7):  # seven letters of nine bits start the doubling
        packed = packed << np.uint64(9) | np.where(spot + k < limit, letters[np.minimum(spot + k, len(letters) - 1)], np.uint64(0))
    suffix = _ranks(packed, limit, 7, int(size.max()))
    last = np.searchsorted(owner, owner, side="right")
    counts = np.bincount(owner)
    after = _ranks(suffix[base[word]], last, 1, int(counts.max()))
    phrase = np.searchsorted(cut, starts, side="right") - 1
    then = phrase + 1
    rest = np.where(then < last[phrase], after[np.minimum(then, len(after) - 1)], np.uint64(0))
    return np.lexsort((rest, suffix[base[word[phrase]] + starts - cut[phrase]]))


def _ask(batches: Iterator[pa.RecordBatch], buckets: int):
    """Distinct windows of each slice of stretches, by bucket, with the window that wants an answer; repeats within the slice are known."""
    part, number = TaskContext.get().partitionId(), 0

    def flush():
        nonlocal number
        sizes = np.array([len(p) for _, _, p, _ in held])
        data, end = np.concatenate([p for _, _, p, _ in held]), np.cumsum(sizes)
        begin, count = end - sizes, sizes - LENGTH + 1
        home = np.repeat(np.arange(len(held)), count)
        starts = np.arange(len(home)) - np.repeat(np.cumsum(count) - count, count) + begin[home]
        settled = np.array([c > 1 for _, _, _, c in held])[home]
        prints = Prints(data)
        order = corpus_order(data, begin, end, starts, home, prints)
        name = prints.of(starts[order], starts[order] + LENGTH)
        first = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
        many = np.diff(np.append(first, len(name))) > 1
        again = np.repeat(many, np.diff(np.append(first, len(name)))) & ~settled[order]
        known = order[again].astype("<u4")
        asks = order[first].astype("u4")
        asks[many | settled[order[first]]] = _NOBODY
        name = name[first]
        bucket = ((name >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        by = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
        meta = [np.array(x, "<i8").tobytes() for x in ([r for r, _, _, _ in held], [s for _, s, _, _ in held], count)]
        rows = []
        for k in range(buckets):
            mine = by[edge[k]:edge[k + 1]]
            if len(mine):
                rows.append((part << 32 | number, k, name[mine].astype("<u8").tobytes(), asks[mine].astype("<u4").tobytes(), *(meta if not rows else [b""] * 3), known.tobytes() if not rows else b""))
        number += 1
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["slice", "bucket", "names", "asks", "rids", "firsts", "counts", "known"])

    held, size = [], 0
    for batch in batches:
        for rid, text, spans in zip(batch.column("rid").to_pylist(), _column(batch, "text"), batch.column("spans").to_pylist()):
            data = np.frombuffer(text, "u1")
            for s in spans:
                held.append((rid, s["s1"], data[s["s1"]:s["s2"] + LENGTH], s["c"]))
                size += len(held[-1][2])
                if size >= SLICE:
                    yield flush()
                    held, size = [], 0
    if held:
        yield flush()


def _members(batches: Iterator[pa.RecordBatch], bits: np.ndarray):
    for batch in batches:
        yield batch.filter(pa.array(bits[batch.column("rid").to_numpy() % MEMBER_BITS]))


def _answer(batches: Iterator[pa.RecordBatch]):
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    names = np.concatenate([np.frombuffer(r["names"], "<u8") for r in rows])
    order = np.argsort(names)
    same = names[order][1:] == names[order][:-1]
    found = np.zeros(len(names), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    at = 0
    for a in range(0, len(rows), 500):
        out = []
        for r in rows[a:a + 500]:
            asks = np.frombuffer(r["asks"], "<u4")
            hit = asks[found[at:at + len(asks)] & (asks != _NOBODY)]
            at += len(asks)
            if len(hit) or r["rids"]:
                out.append((r["slice"], hit.tobytes() + r["known"], r["rids"], r["firsts"], r["counts"]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["slice", "hits", "rids", "firsts", "counts"])


def _spans(batches: Iterator[pa.RecordBatch]):
    hits, meta = {}, {}
    for batch in batches:
        for r in batch.to_pylist():
            hits.setdefault(r["slice"], []).append(r["hits"])
            if r["rids"]:
                meta[r["slice"]] = [np.frombuffer(r[k], "<i8") for k in ("rids", "firsts", "counts")]
    for k, parts in hits.items():
        window = np.unique(np.frombuffer(b"".join(parts), "<u4")).astype("i8")
        if len(window):
            rids, firsts, counts = meta[k]
            ends = np.cumsum(counts)
            home = np.searchsorted(ends, window, side="right")
            start = window - (ends - counts)[home] + firsts[home]
            head = np.flatnonzero(np.append(True, (home[1:] != home[:-1]) | (start[1:] != start[:-1] + 1)))
            tail = np.append(head[1:], len(window)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(rids[home[head]]), pa.array(start[head]), pa.array(start[tail])], ["rid", "s1", "s2"])


def _cut(batches: Iterator[pa.RecordBatch]):
    """Merges the repeated windows of each text and takes their bytes out."""
    for batch in batches:
        out = []
        for data, spans in zip(_column(batch, "text"), batch.column("spans").to_pylist()):
            runs: list[list[int]] = []
            for a, b in sorted((s["s1"], s["s2"] + LENGTH) for s in spans or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            edges = [0, *(x for r in runs for x in r), len(data)]
            rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(data), len(data) - len(rest), [{"start": a, "end": b} for a, b in runs], rest))
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        if out:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", "n_bytes", "n_removed", "runs", "kept"])


def repeats(docs: DataFrame) -> DataFrame:
    """``rid, s1, s2``: starts s1..s2 of windows of the text of row ``rid`` that occur elsewhere too. ``docs``: ``rid, text``."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(docs.mapInArrow(_parse_rows, ROWS), "rows")
    known, rows = rows.filter("m = 0").select("rid", "s1", "s2"), rows.filter("m > 0")
    classes = rows.groupBy("key", "ctx").agg(F.sum("m").alias("c"), F.min(F.struct("rid", "s1", "s2")).alias("v"))
    classes = stored(classes, "classes")
    shared = classes.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    settled = rows.join(classes.filter("c > 1").select("key", "ctx"), ["key", "ctx"], "left_semi").select("rid", "s1", "s2")
    mixed = classes.join(shared, "key", "left_semi").select("v.*", "c").groupBy("rid").agg(F.collect_list(F.struct("s1", "s2", "c")).alias("spans"))
    mixed = stored(mixed, "mixed")
    bits = spark.sparkContext.broadcast(member_bits(mixed.select("rid"), lambda batch: batch.column("rid").to_numpy() % MEMBER_BITS))
    possible = docs.mapInArrow(lambda it: _members(it, bits.value), docs.schema)
    asked = possible.join(mixed, "rid").mapInArrow(
        lambda it: _ask(it, buckets), "slice long, bucket long, names binary, asks binary, rids binary, firsts binary, counts binary, known binary")
    answers = asked.repartition(buckets, "bucket").mapInArrow(_answer, "slice long, hits binary, rids binary, firsts binary, counts binary")
    return known.unionByName(settled).unionByName(answers.repartition(buckets, "slice").mapInArrow(_spans, SPANS))


def dedup(docs: DataFrame, **columns: str) -> DataFrame:
    """``doc_id, n_bytes, n_removed, runs, kept``: the removed runs of bytes and the bytes that stay."""
    docs = texts(docs, **columns).withColumn("rid", F.xxhash64("doc_id", "text"))
    found = repeats(docs.select("rid", "text")).groupBy("rid").agg(F.collect_list(F.struct("s1", "s2")).alias("spans"))
    joined = docs.join(found, "rid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, runs array<struct<start: long, end: long>>, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    """Counts and SHA-256 of :func:`dedup`'s result."""
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
