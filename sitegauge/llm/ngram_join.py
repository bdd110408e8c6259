"""Documents linked by the Jaccard similarity of their word n-gram sets, and the components of those links.

The overlap counts are a sparse matrix product of the incidence of documents by n-grams with its transpose, restricted
by exact bounds so that unlike documents never meet:

1. ``sets``: size and digest of every set; equal sets are one row of the matrix from here on.
2. ``sharing``: n-grams that occur in one slice of the corpus once are sent, as packed 32-bit values, to the bucket that
   owns them; an n-gram seen once in the whole corpus cannot be shared. A row with more than ``1 - similarity`` of such
   n-grams has no partner and leaves. (Values that collide only keep more rows.)
3. ``keys``: the remaining n-grams are ordered from rare to frequent. Two rows of the wanted similarity share one of
   their first ``n - ceil(similarity * n) + 1``; sizes and places bound the overlap that is still possible.
4. Blocks: the rows of a key that the bounds admit are multiplied block by block: counts of shared n-grams are added up per
   pair, and pairs that fall below the overlap their sizes demand are discarded. First each key's rows meet one pivot
   only, the row with the fewest rarer n-grams, which is the most central of a family. Components of the links are
   formed, and the step is repeated with a pivot of what is still apart until nothing more links. Then rows of a key that
   are still apart are multiplied across components: all rows outside the key's largest component with the rows of the
   others. Links inside a component need no product, so a family around one text costs about one product per member.

Rows of the matrix are named by a 64-bit hash of their set's digest; ids only decide which row of a component is reported
or kept. Overlaps count 64-bit n-gram hashes. Defined results: null and empty texts have no set and no links; fewer than n
words are one n-gram; an empty table gives no rows. In :func:`link` rows with a null id get sizes but no links, each row
of an id has the links of its own text, and all other input columns are ignored. :func:`first_rows` compares all rows,
those with a null id too, and keeps one of each component: the smallest id, null last, then the smallest hash of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from sitegauge.llm import grams
from sitegauge.llm.common import MEMBER_BITS, member_bits, stored, texts
from sitegauge.llm.components import components
from sitegauge.llm.tokens import slices

#: Characters of one slice of documents whose n-grams are made distinct together.
SLICE_CHARS = 1_000_000
#: N-grams of one side of a block of the product, and steps in which a row's n-grams are counted.
BLOCK_GRAMS, PARTS = 250_000, 4


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _slices(batches: Iterator[pa.RecordBatch], column: str):
    for batch in batches:
        strings = batch.column("text").to_pylist()
        for a, b in slices(strings, SLICE_CHARS):
            for k in range(a, b, 1 << 15):
                e = min(b, k + (1 << 15))
                yield batch.column(column).slice(k, e - k), strings[k:e]


#: A row: ids before null, then the hash of the text.
KEY = "struct<absent: boolean, doc_id: long, text: long>"


def _key(doc_id: Column, text: Column) -> Column:
    return F.struct(doc_id.isNull().alias("absent"), doc_id.alias("doc_id"), F.xxhash64(text).alias("text"))


def _sets(batches: Iterator[pa.RecordBatch], n: int):
    for ids, strings in _slices(batches, "key"):
        made = grams.gram_sets(strings, n)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([len(s) for s in made], pa.int64()), pa.array([_digest(s) for s in made], pa.binary())], ["key", "n", "digest"])


def _ask(batches: Iterator[pa.RecordBatch], n: int, buckets: int):
    """Distinct n-grams of each slice, by bucket; an n-gram of one set only names its owner, others name nobody."""
    part, number = TaskContext.get().partitionId(), 0
    for _, strings in _slices(batches, "key"):
        made = {_digest(s): s for s in grams.gram_sets(strings, n) if len(s)}
        if not made:
            continue
        every = np.concatenate(list(made.values()))
        owner = np.repeat(np.arange(len(made), dtype="u2"), [len(s) for s in made.values()])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        single = np.diff(np.append(first, len(every))) == 1
        values = every[first]
        names = np.where(single, owner[first], np.uint16(65535)).astype("<u2")
        bucket = ((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        keys, low, rows = b"".join(made), (values & np.uint64(0xFFFFFFFF)).astype("<u4"), []
        for k in range(buckets):
            a, b = cuts[k], cuts[k + 1]
            if b > a:
                rows.append((part << 32 | number, k, len(made), b"" if rows else keys, low[a:b].tobytes(), names[a:b].tobytes()))
        number += 1
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["slice", "bucket", "docs", "keys", "low", "names"])


def _answer(batches: Iterator[pa.RecordBatch]):
    """For each slice and bucket: how many n-grams of each of its sets occur nowhere else."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    sizes = [len(r["low"]) // 4 for r in rows]
    values = np.frombuffer(b"".join(r["low"] for r in rows), "<u4").astype("u8") | np.repeat(np.array([r["bucket"] for r in rows], "u8") << np.uint64(32), sizes)
    order = np.argsort(values)
    ordered = values[order]
    once = np.ones(len(values), bool)
    same = ordered[1:] == ordered[:-1]
    once[order[1:][same]] = False
    once[order[:-1][same]] = False
    del values, order, ordered
    at = 0
    for a in range(0, len(rows), 1000):
        out = []
        for r, size in zip(rows[a:a + 1000], sizes[a:a + 1000]):
            names = np.frombuffer(r["names"], "<u2")[once[at:at + size]]
            at += size
            out.append((r["slice"], r["keys"], np.bincount(names[names < 65535], minlength=r["docs"]).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["slice", "keys", "own"])


def _gather(batches: Iterator[pa.RecordBatch]):
    keys, own = {}, {}
    for batch in batches:
        for r in batch.to_pylist():
            got = np.frombuffer(r["own"], "<u4")
            own[r["slice"]] = own[r["slice"]] + got if r["slice"] in own else got
            if r["keys"]:
                keys[r["slice"]] = r["keys"]
    for k, total in own.items():
        names = [keys[k][16 * i:16 * i + 16] for i in range(len(total))]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(total.astype("i8"))], ["digest", "own"])


def _rows(batches: Iterator[pa.RecordBatch], n: int, bits: np.ndarray):
    """Sets of the texts whose digest may be wanted."""
    for batch in batches:
        for a, b in slices(strings := batch.column("text").to_pylist(), SLICE_CHARS):
            made = grams.gram_sets(strings[a:b], n)
            names = [_digest(s) for s in made]
            keep = [i for i, name in enumerate(names) if len(made[i]) and bits[_bit(name)]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").slice(a, b - a).take(pa.array(keep, pa.int64())), pa.array([names[i] for i in keep], pa.binary()),
                 pa.array([len(made[i]) for i in keep], pa.int64()), pa.array([made[i].view("i8") for i in keep], pa.list_(pa.int64()))],
                ["least", "digest", "n", "grams"])


def _bit(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little") % MEMBER_BITS


def overlaps(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """One block of the product: for each row of ``left`` the places in ``right`` that reach the similarity.

    ``right`` is read by n-gram. A row adds one to the count of all holders of each of its n-grams, rare ones first; a
    count that can no longer reach the overlap that the two sizes demand is discarded, and a row without others ends.
    """
    sizes = np.array([len(r) for r in right], "i8")
    holders = np.repeat(np.arange(len(right)), sizes)
    values = np.concatenate(right) if right else np.empty(0, "i8")
    order = np.argsort(values, kind="stable")
    values, holders = values[order], holders[order]
    for i, row in enumerate(left):
        need = -(-percent * (len(row) + sizes) // (100 + percent))
        start = np.searchsorted(values, row, "left")
        many = np.searchsorted(values, row, "right") - start
        rare = np.argsort(many, kind="stable")
        total = np.zeros(len(right), "i8")
        alive = np.minimum(len(row), sizes) >= need
        step = -(-len(row) // PARTS)
        for at in range(0, len(row), max(1, step)):
            if not alive.any():
                break
            some = rare[at:at + step]
            m = many[some]
            total += np.bincount(holders[np.repeat(start[some] - np.cumsum(m) + m, m) + np.arange(m.sum())], minlength=len(right))
            alive &= total + np.minimum(max(0, len(row) - at - step), sizes - total) >= need
        yield i, np.flatnonzero(alive & (total >= need))


def _products(batches: Iterator[pa.RecordBatch], percent: int):
    """Links of each block, whose rows come together, those of its left side first."""
    def finish():
        out = [(names[0][i], names[1][j]) for i, found in overlaps(*sides, percent) for j in found.tolist() if names[0][i] != names[1][j]]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    block, names, sides = None, ([], []), ([], [])
    for batch in batches:
        places = zip(*(batch.column(c).to_pylist() for c in ("gram", "i", "j", "side", "node")))
        for k, (gram, i, j, side, node) in enumerate(places):
            if block != (gram, i, j):
                if block is not None:
                    yield finish()
                block, names, sides = (gram, i, j), ([], []), ([], [])
            names[side].append(node)
            sides[side].append(batch.column("grams")[k].values.to_numpy().copy())
    if block is not None:
        yield finish()


def _linked(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` among candidate pairs ``a, n1, b, n2, gram``, by blocks of the product.

    A pair belongs to the smallest n-gram that proposed it; the rows of such an n-gram are cut into parts of about
    BLOCK_GRAMS n-grams, and a block is two parts. So a row's n-grams are sent once a block, not once a pair.
    """
    met = stored(pairs.groupBy("a", "n1", "b", "n2").agg(F.min("gram").alias("gram")), "pairs")
    ends = met.select("gram", F.col("a").alias("node"), F.col("n1").alias("n")).union(met.select("gram", "b", "n2")).distinct()
    parts = ends.groupBy("gram").agg(F.ceil(F.sum("n") / BLOCK_GRAMS).alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c), "parts")
    blocks = met.join(parts, "gram").select("gram", part("a").alias("i"), part("b").alias("j"), "a", "b")
    side = lambda c, k: blocks.select("gram", "i", "j", F.lit(k).alias("side"), F.col(c).alias("node"))
    members = side("a", 0).union(side("b", 1)).distinct().join(rows.select("node", "grams"), "node")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(n, "gram", "i", "j").sortWithinPartitions("gram", "i", "j", "side", "node")
    return dealt.select("gram", "i", "j", "side", "node", "grams").mapInArrow(lambda it: _products(it, percent), "a long, b long").distinct()


def _end(name: str, k: int) -> list[Column]:
    """A row of the matrix as one end of a pair: its name, size and the place of the key among its n-grams."""
    return [F.col("node").alias(name), F.col("n").alias(f"n{k}"), F.col("p").alias(f"p{k}")]


def _possible(percent: int):
    """Size and place bounds: could the rows still reach the similarity if this key is the first they share?"""
    least = F.least(F.col("n1") - F.col("p1"), F.col("n2") - F.col("p2"))
    return (100 * F.least("n1", "n2") >= percent * F.greatest("n1", "n2")) & ((100 + percent) * least >= percent * (F.col("n1") + F.col("n2")))


def _components(docs: DataFrame, n: int, percent: int, nulls: bool) -> tuple[DataFrame, DataFrame]:
    """``key, n, digest`` of every row of ``docs`` (``key, text``), and ``digest, reached``: the least key of a set's component."""
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # a bucket is held whole by a task, in a few arrays
    sets = stored(docs.mapInArrow(lambda it: _sets(it, n), f"key {KEY}, n long, digest binary"), "sets")
    asked = docs.mapInArrow(lambda it: _ask(it, n, buckets), "slice long, bucket long, docs long, keys binary, low binary, names binary")
    answers = asked.repartition(buckets, "bucket").mapInArrow(_answer, "slice long, keys binary, own binary")
    own = answers.repartition(buckets, "slice").mapInArrow(_gather, "digest binary, own long").groupBy("digest").agg(F.min("own").alias("own"))
    named = F.lit(True) if nulls else ~F.col("key.absent")
    classes = sets.filter((F.col("n") > 0) & named).groupBy("digest", "n").agg(F.min("key").alias("least")).withColumn("node", F.xxhash64("digest"))
    some = stored(classes.join(own, "digest").filter(100 * F.col("own") <= (100 - percent) * F.col("n")).select("least", "node", "digest"), "nodes")
    bits = spark.sparkContext.broadcast(member_bits(some.select("digest"), lambda batch: [_bit(d) for d in batch.column("digest").to_pylist()]))
    possible = docs.filter(named).mapInArrow(lambda it: _rows(it, n, bits.value), f"least {KEY}, digest binary, n long, grams array<long>")
    # only equal rows, whose sets are equal, share both; so it does not matter which of them stays
    rows = stored(possible.join(some, ["least", "digest"]).select("node", "n", "grams").dropDuplicates(["node"]), "rows")

    incidence = rows.select("node", "n", F.explode("grams").alias("gram"))
    shared = incidence.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    ordered = incidence.join(shared, "gram").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("o"))
    first = F.col("n") - F.size("o")  # n-grams of this row only come before the others
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1 - first
    keys = stored(ordered.filter(length > 0).select("node", "n", first.alias("first"), F.posexplode(F.slice("o", F.lit(1), length.cast("int"))).alias("i", "x"))
                  .select(F.col("x.gram").alias("gram"), "node", "n", (F.col("first") + F.col("i")).cast("long").alias("p")), "keys")

    first_met = keys.select("gram", *_end("a", 1)).groupBy("gram").agg(F.min(F.struct("p1", "a", "n1")).alias("v")).select("gram", "v.*")
    pairs = first_met.join(keys.select("gram", *_end("b", 2)), "gram").filter((F.col("a") != F.col("b")) & _possible(percent))
    edges = stored(_linked(pairs, rows, percent), "links")
    while True:
        labels = components(edges)
        placed = keys.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        groups = placed.groupBy("gram", "c").agg(F.count("*").alias("m"))
        largest = groups.groupBy("gram").agg(F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("parts")).filter("parts > 1").select("gram", F.col("top.c").alias("top"))
        apart = stored(placed.join(largest, "gram"), "apart")
        few = apart.filter("c <> top").select("gram", *_end("a", 1), F.col("c").alias("c1"))
        others = apart.select("gram", *_end("b", 2), F.col("c").alias("c2"), (F.col("c") != F.col("top")).alias("also"))
        pivots = few.groupBy("gram").agg(F.min(F.struct("p1", "a", "n1", "c1")).alias("v")).select("gram", "v.*")
        more = stored(_linked(pivots.join(others, "gram").filter((F.col("c1") != F.col("c2")) & _possible(percent)), rows, percent), "links")
        if more.isEmpty():
            break
        edges = edges.union(more)
    once = ~F.col("also") | (F.col("a") < F.col("b"))
    last = stored(_linked(few.join(others, "gram").filter((F.col("c1") != F.col("c2")) & once & _possible(percent)), rows, percent), "links")
    if not last.isEmpty():
        labels = components(edges.union(last))

    joined = labels.join(classes.select("node", "least"), "node")
    best = joined.groupBy("component").agg(F.min("least").alias("other"))
    members = classes.join(joined.select("node", "component").join(best, "component").select("node", "other"), "node", "left")
    return sets, members.select("digest", F.coalesce("other", "least").alias("reached"))


def link(docs: DataFrame, n: int = 3, percent: int = 90, **columns: str) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; links are pairs with a similarity of ``percent`` % or more."""
    docs = texts(docs, **columns)
    sets, members = _components(docs.select(_key(F.col("doc_id"), F.col("text")).alias("key"), "text"), n, percent, False)
    doc_id = F.col("key.doc_id")
    found = F.when(doc_id.isNull(), None).when(F.col("n") == 0, doc_id).otherwise(F.coalesce("reached.doc_id", doc_id))
    return sets.join(members, "digest", "left").select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), found.alias("component_id"))


def first_rows(docs: DataFrame, n: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns, of which each component has one; of equal ids and texts the one whose columns come first as JSON stays."""
    key = _key(docs[id_col].cast("long"), F.coalesce(docs[text_col].cast("string"), F.lit("")))
    name = "_".join(["key", *docs.columns])  # no column of the input has this name
    sets, members = _components(texts(docs, id_col, text_col).select(_key(F.col("doc_id"), F.col("text")).alias("key"), "text"), n, percent, True)
    reached = sets.filter("n > 0").join(members, "digest").groupBy("key").agg(F.first("reached").alias("reached"), F.count("*").alias("m"))
    judged = stored(reached.select("key", (F.col("key") == F.col("reached")).alias("first"), "m").filter("not first or m > 1"), "judged")
    keyed = docs.select("*", key.alias(name))
    matches = lambda some: F.col(f"`{name}`") == some["key"]
    alone = keyed.join(judged, matches(judged), "left_anti").select(docs.columns)
    again, row = judged.filter("first"), F.struct(*[docs[c] for c in docs.columns])
    equal = keyed.join(again, matches(again), "left_semi").groupBy(f"`{name}`").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return alone.union(equal.select("row.*"))
