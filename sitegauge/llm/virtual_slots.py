"""Shards of equal size from a fixed number of virtual slots.

Each record is hashed into one of :data:`SLOTS` slots; bytes and rows are summed per slot; a map from slot to shard, of
one entry per slot and so of fixed size, deals the slots so that shards hold nearly equal bytes. Maps are stored under a
version number that is never written twice. :func:`rebalance` edits a map for new weights or another number of shards by
moving single slots; records of slots that stay are not touched.

A hot id cannot fill a slot: the hash covers id and text. Rows equal in both are counted first and cut into pieces of
about n / SLOTS rows, each with a slot of its own, so that one row repeated for a third of the table is spread too.
What travels is the id, hashes and a size; texts are shuffled only where the caller asks for them (:func:`write`).

Defined results: a null text is empty and has size 1; rows with a null id are placed like others; equal rows get one
place each; an empty table gives no rows; ties (equal weights) go to the smaller slot or shard number; all other input
columns are ignored. A document is never cut, so one longer than a shard's share makes its shard that much larger.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sitegauge.llm.common import shared_folder, texts

SLOTS = 1 << 12
_IDENTITY = ["doc_id", "text_hash", "text_crc32", "size"]


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[s]``, ``weight_of[s]`` and ``rows_of[s]`` for every slot s; the shard of a map of this version."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    bytes_of: tuple[int, ...]
    rows_of: tuple[int, ...]

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for shard, n in zip(self.shard_of, self.bytes_of):
            out[shard] += n
        return out


def pieces(docs: DataFrame, slots: int = SLOTS, **columns: str) -> DataFrame:
    """Rows equal in id and text as pieces of ``n`` rows, with their slot; ``text`` costs nothing where it is not selected."""
    rows = texts(docs, **columns).select(
        "doc_id", "text", F.xxhash64("text").alias("text_hash"), F.crc32("text").alias("text_crc32"), (F.octet_length("text") + F.lit(1).cast("long")).alias("size"))
    counted = rows.groupBy(*_IDENTITY).agg(F.count("*").alias("copies"), F.any_value("text").alias("text"))
    step = F.greatest(F.lit(1), F.expr(f"copies div {slots}"))
    cut = counted.withColumn("step", step).select("*", F.explode(F.expr("sequence(0, (copies - 1) div step)")).alias("piece"))
    return cut.select(
        *_IDENTITY, "text", "piece", F.least("step", F.col("copies") - F.col("piece") * F.col("step")).alias("n"),
        F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "text_hash", "piece"), F.lit(slots)).cast("int").alias("virtual_slot"))


def weigh(cut: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot in use: at most one row per slot reaches the driver."""
    sums = cut.groupBy("virtual_slot").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("rows"))
    return {r.virtual_slot: (r.bytes, r.rows) for r in sums.collect()}


def deal(weights: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1: the heaviest slot next to the lightest shard, then moved and swapped while that evens the shards out."""
    heap, shard_of = [(0, k) for k in range(shards)], [s % shards for s in range(slots)]
    for slot in sorted(weights, key=lambda s: (-weights[s][0], s)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + weights[slot][0], shard))
    return _evened(1, shards, shard_of, weights, slots, 0.0)


def rebalance(old: SlotMap, weights: dict[int, tuple[int, int]], shards: int | None = None, tolerance: float = 0.02) -> SlotMap:
    """The next version: an edit of ``old`` for these weights that moves few slots.

    New shards are filled from the heaviest ones, and take slots only into themselves; shards that are given up hand
    their slots to the lightest. Otherwise slots leave only shards beyond the tolerance over the mean.
    """
    shards, slots = shards or old.shards, len(old.shard_of)
    shard_of, load = list(old.shard_of), [0] * shards
    size = lambda s: weights.get(s, (0, 0))[0]
    for s in range(slots):
        if shard_of[s] < shards:
            load[shard_of[s]] += size(s)
    for s in sorted((s for s in range(slots) if shard_of[s] >= shards), key=lambda s: (-size(s), s)):
        shard_of[s] = min(range(shards), key=lambda k: (load[k], k))
        load[shard_of[s]] += size(s)
    if shards > old.shards:
        mean = sum(load) / shards
        for s in sorted(range(slots), key=lambda s: (-size(s), s)):
            new = min(range(old.shards, shards), key=lambda k: (load[k], k))
            if load[shard_of[s]] - size(s) >= mean * (1 - tolerance) and load[new] + size(s) <= mean and shard_of[s] < old.shards:
                load[shard_of[s]] -= size(s)
                load[new] += size(s)
                shard_of[s] = new
        return _map(old.version + 1, shards, shard_of, weights, slots)
    return _evened(old.version + 1, shards, shard_of, weights, slots, tolerance)


def _evened(version: int, shards: int, shard_of: list[int], weights: dict, slots: int, tolerance: float) -> SlotMap:
    """Moves a slot, or swaps two, between the heaviest and the lightest shard as long as their gap shrinks."""
    inside: list[dict[int, int]] = [{} for _ in range(shards)]
    for s, (n, _) in sorted(weights.items()):
        inside[shard_of[s]][s] = n
    load = [sum(x.values()) for x in inside]
    mean = sum(load) / shards
    for _ in range(slots):
        high, low = max(range(shards), key=lambda k: (load[k], -k)), min(range(shards), key=lambda k: (load[k], k))
        gap = load[high] - load[low]
        if load[high] <= mean * (1 + tolerance) or gap <= 1:
            break
        givers = sorted(inside[high].items(), key=lambda x: (x[1], x[0]))
        takers = [(None, 0), *sorted(inside[low].items(), key=lambda x: (x[1], x[0]))]
        best, t = (gap, None, None), 0
        for a, n in givers:  # the difference n - m nearest to half the gap, both lists ascending
            while t + 1 < len(takers) and abs(gap - 2 * (n - takers[t + 1][1])) <= abs(gap - 2 * (n - takers[t][1])):
                t += 1
            best = min(best, (abs(gap - 2 * (n - takers[t][1])), a, takers[t][0]), (abs(gap - 2 * n), a, None), key=lambda x: x[0])
        left, a, b = best
        if a is None or left >= gap:
            break
        for slot, source, target in ((a, high, low), (b, low, high)):
            if slot is not None:
                n = inside[source].pop(slot)
                inside[target][slot] = n
                shard_of[slot] = target
                load[source] -= n
                load[target] += n
    return _map(version, shards, shard_of, weights, slots)


def _map(version: int, shards: int, shard_of: Iterable[int], weights: dict, slots: int) -> SlotMap:
    each = [weights.get(s, (0, 0)) for s in range(slots)]
    return SlotMap(version, shards, tuple(shard_of), tuple(w[0] for w in each), tuple(w[1] for w in each))


def as_frame(spark: SparkSession, slot_map: SlotMap) -> DataFrame:
    """One row per slot; ``first``: rows of the shard in smaller slots."""
    seen, rows = [0] * slot_map.shards, []
    for s, (shard, size, n) in enumerate(zip(slot_map.shard_of, slot_map.bytes_of, slot_map.rows_of)):
        rows.append((slot_map.version, s, shard, size, n, seen[shard], slot_map.shards))
        seen[shard] += n
    return spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long, rows long, first long, shards int").coalesce(1)


def save(spark: SparkSession, slot_map: SlotMap, folder: str) -> str:
    """Writes the map as ``folder/version=N``; a version that exists is an error, so two editors cannot both make it."""
    path = f"{folder}/version={slot_map.version}"
    as_frame(spark, slot_map).drop("version").write.mode("error").parquet(path)
    return path


def load(spark: SparkSession, folder: str, version: int) -> SlotMap:
    rows = sorted(spark.read.parquet(f"{folder}/version={version}").collect(), key=lambda r: r.virtual_slot)
    return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows), tuple(r.bytes for r in rows), tuple(r.rows for r in rows))


def place(cut: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Each row of the pieces with ``shard`` and ``slot``, its place in the shard (gapless from 0, by virtual slot and id).

    Places are counted inside virtual slots, which hold about one row in SLOTS, and moved by the slot's first place.
    """
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_hash", "text_crc32", "size", "piece")
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    entries = F.broadcast(as_frame(cut.sparkSession, slot_map).select("virtual_slot", "shard", "first"))
    numbered = cut.withColumn("before", before).join(entries, "virtual_slot")
    return numbered.select(
        *_IDENTITY, "text", "virtual_slot", "shard", F.explode(F.expr("sequence(first + before, first + before + n - 1)")).alias("slot"))


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, maps: str | None = None, **columns: str) -> DataFrame:
    """All documents of the table placed by a new map, which is stored as version 1 in ``maps`` and used from there."""
    spark = docs.sparkSession
    cut = pieces(docs, slots, **columns)
    maps = maps or f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}"
    save(spark, deal(weigh(cut), shards, slots), maps)
    return place(cut, load(spark, maps, 1))


def write(placed: DataFrame, folder: str) -> None:
    """Writes ``doc_id, text, slot`` of every shard as Parquet under ``folder/shard=K``, one task per shard and slot range."""
    spread = placed.select("doc_id", "text", "slot", "shard", "virtual_slot").repartition("shard", F.expr("virtual_slot div 64"))
    spread.drop("virtual_slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("error").parquet(folder)
