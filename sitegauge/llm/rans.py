"""Token ids in compressed binary shards: interleaved range asymmetric numeral systems with static tables.

One table of symbol frequencies, quantised to 2**20, is counted over the whole corpus and shared by all shards. A shard
file holds blocks; a block codes up to ``block_tokens`` ids on ``lanes`` interleaved 64-bit states that emit 32-bit
words, and depends on nothing but the table, so any block can be decoded alone. The index at the end of a shard is
the list of checkpoints (byte offset, first id, final states) with a CRC-32 of each block's words and of its ids, and
the token count of every document in order.

File layout, little-endian: magic ``RANS0001``; table identity (u64); blocks (lane states u64, words u32); index, zlib
packed: JSON of counts and checkpoints, then document ids (i64), null flags (u8) and token counts (i64); index length
(u64); magic. The table is stored once beside the shards as Parquet.

Defined results: a null or empty text has the end id only; documents with equal ids are adjacent, in the order of a
hash of their tokens, so that an id, or the null id, that holds many rows is spread over shards; rows with a null id come first; an empty table gives no shard and no rows; all other input columns are ignored.
"""

from __future__ import annotations

import functools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from sitegauge.llm import tokens
from sitegauge.llm.common import shared_folder, stored, texts

MAGIC = b"RANS0001"
BITS = 20
LOW = 1 << 31
LANES = 512
BLOCK_TOKENS = 1 << 18
#: Packed token bytes of one range partition when the number of shards is chosen.
SHARD_BYTES = 16 << 20
#: Characters that are encoded together.
SLICE_CHARS = 16_000_000


def quantise(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, at least 1 for each symbol that occurs; deterministic."""
    counts = counts.astype("i8")
    seen = counts > 0
    if not seen.any():
        return counts
    if seen.sum() > 1 << bits:
        raise ValueError("more symbols than the table has room for")
    scaled = np.where(seen, np.maximum(1, counts.astype(object) * (1 << bits) // int(counts.sum())), 0).astype("i8")
    order = np.argsort(-scaled, kind="stable")
    gap = (1 << bits) - int(scaled.sum())
    if gap > 0:
        scaled[order[0]] += gap
    for s in order:  # the symbols with the largest frequencies give what is missing
        if gap >= 0:
            break
        take = min(-gap, int(scaled[s]) - 1)
        scaled[s] -= take
        gap += take
    return scaled


def encode_block(ids: np.ndarray, freq: np.ndarray, start: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """Final states of the lanes and the words in the order in which the decoder reads them."""
    state = np.full(lanes, LOW, "u8")
    words = []
    steps = -(-len(ids) // lanes)
    shift, low32 = np.uint64(32), np.uint64(0xFFFFFFFF)
    for step in range(steps - 1, -1, -1):
        part = ids[step * lanes:(step + 1) * lanes]
        f, c, x = freq[part], start[part], state[:len(part)]
        full = x >= f << np.uint64(63 - BITS)
        words.append((x[full] & low32).astype("<u4"))
        x = np.where(full, x >> shift, x)
        q = x // f
        state[:len(part)] = (q << np.uint64(BITS)) + (x - q * f) + c
    return state, np.concatenate(words[::-1]) if words else np.empty(0, "<u4")


def decode_block(state: np.ndarray, words: np.ndarray, n: int, freq: np.ndarray, start: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block; ``symbol`` maps each slot of the table to its symbol."""
    lanes, at = len(state), 0
    state, out = state.copy(), np.empty(n, "<u4")
    mask, bits, shift = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
    for step in range(-(-n // lanes)):
        x = state[:min(lanes, n - step * lanes)]
        slot = x & mask
        s = symbol[slot]
        out[step * lanes:step * lanes + len(x)] = s
        x = freq[s] * (x >> bits) + slot - start[s]
        need = x < np.uint64(LOW)
        k = int(need.sum())
        x[need] = x[need] << shift | words[at:at + k].astype("u8")
        at += k
        state[:len(x)] = x
    if at != len(words) or (state != np.uint64(LOW)).any():
        raise ValueError("a block's words do not end where its ids end")
    return out


@functools.lru_cache(maxsize=2)
def _tables(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    freq = np.frombuffer(zlib.decompress(packed), "<u4").astype("u8")
    start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype("u8")
    return freq, start, np.repeat(np.arange(len(freq), dtype="i8"), freq.astype("i8")), zlib.crc32(packed)


def shard_bytes(docs: list[tuple[int | None, np.ndarray]], packed: bytes, block_tokens: int = BLOCK_TOKENS, lanes: int = LANES) -> bytes:
    freq, start, _, name = _tables(packed)
    out, points, at = [MAGIC, struct.pack("<Q", name)], [], 16
    ids = np.concatenate([x for _, x in docs]) if docs else np.empty(0, "<u2")
    for a in range(0, len(ids), block_tokens):
        part = ids[a:a + block_tokens]
        state, words = encode_block(part.astype("i8"), freq, start, lanes)
        body = state.astype("<u8").tobytes() + words.tobytes()
        points.append({"at": at, "first": a, "n": len(part), "lanes": lanes, "bytes": len(body), "crc": zlib.crc32(body), "ids_crc": zlib.crc32(part.astype("<u4").data)})
        out.append(body)
        at += len(body)
    head = json.dumps({"docs": len(docs), "tokens": len(ids), "points": points}).encode()
    names = np.array([d or 0 for d, _ in docs], "<i8"), np.array([d is None for d, _ in docs], "u1"), np.array([len(x) for _, x in docs], "<i8")
    index = zlib.compress(struct.pack("<Q", len(head)) + head + b"".join(x.tobytes() for x in names))
    return b"".join([*out, index, struct.pack("<Q", len(index)), MAGIC])


def read_index(data: bytes) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Checkpoints, document ids, null flags and token counts of a shard."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a whole shard")
    size, = struct.unpack("<Q", data[-16:-8])
    raw = zlib.decompress(data[-16 - size:-16])
    n, = struct.unpack("<Q", raw[:8])
    info, rest, k = json.loads(raw[8:8 + n]), raw[8 + n:], 0
    k = info["docs"]
    return info, np.frombuffer(rest[:8 * k], "<i8"), np.frombuffer(rest[8 * k:9 * k], "u1"), np.frombuffer(rest[9 * k:], "<i8")


def read_block(data: bytes, point: dict, packed: bytes) -> np.ndarray:
    """Ids from one checkpoint on; raises on any changed byte."""
    freq, start, symbol, name = _tables(packed)
    if struct.unpack("<Q", data[8:16])[0] != name:
        raise ValueError("the shard was written with another table")
    body = data[point["at"]:point["at"] + point["bytes"]]
    if zlib.crc32(body) != point["crc"]:
        raise ValueError("a block has changed")
    lanes = point["lanes"]
    ids = decode_block(np.frombuffer(body[:8 * lanes], "<u8"), np.frombuffer(body[8 * lanes:], "<u4"), point["n"], freq, start, symbol)
    if zlib.crc32(ids.data) != point["ids_crc"]:
        raise ValueError("decoded ids differ")
    return ids


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, end: int):
    enc = tokens.encoder(path)
    for batch in batches:
        keys, strings = batch.column("doc_id"), batch.column("text").to_pylist()
        for a, b in tokens.slices(strings, SLICE_CHARS):
            yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), tokens.binary(*enc.encode_flat(strings[a:b], end))], ["doc_id", "ids"])


def _count(batches: Iterator[pa.RecordBatch]):
    total = np.zeros(1 << 16, "i8")
    for batch in batches:
        column = batch.column("ids")
        if len(column):  # the values lie one after the other
            first, last = (np.frombuffer(column.buffers()[1], "<i4")[column.offset + k] for k in (0, len(column)))
            total += np.bincount(np.frombuffer(column.buffers()[2], "<u2", (last - first) // 2, first), minlength=1 << 16)
    used = np.flatnonzero(total)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["symbol", "n"])


def _filesystem(folder: str):
    folder = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
    return pafs.FileSystem.from_uri(folder)


def _write(batches: Iterator[pa.RecordBatch], folder: str, packed: bytes):
    """One shard file for a partition; written under a name of this attempt and then moved, so a repeated task is safe."""
    task = TaskContext.get()
    docs = [(k, np.frombuffer(x, "<u2")) for batch in batches for k, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist())]
    if docs:
        files, root = _filesystem(folder)
        data = shard_bytes(docs, packed)
        name, mine = f"{root}/shard-{task.partitionId():08d}.rans", f"{root}/_{task.taskAttemptId()}.part"
        with files.open_output_stream(mine) as f:
            f.write(data)
        files.move(mine, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)]), pa.array([sum(len(x) for _, x in docs)])], ["file", "bytes", "n_tokens"])


def write(docs: DataFrame, vocabulary: str, end: int = tokens.END, folder: str | None = None, shard_size: int = SHARD_BYTES, **columns: str) -> str:
    """Writes all documents in ascending order of id; returns the folder, which must be one that executors share."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/rans-{uuid.uuid4().hex}"
    files, root = _filesystem(folder)
    files.create_dir(f"{root}/shards", recursive=True)
    coded = stored(texts(docs, **columns).mapInArrow(lambda it: _tokenise(it, vocabulary, end), "doc_id long, ids binary"), "ids")
    counts = coded.select("ids").mapInArrow(_count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))
    table = np.zeros(1 << 16, "i8")  # bounded by the 16-bit ids, whatever the corpus
    for r in counts.collect():
        table[r.symbol] = r.n
    freq = quantise(table)
    packed = zlib.compress(freq.astype("<u4").tobytes())
    spark.createDataFrame([(int(s), int(freq[s])) for s in np.flatnonzero(freq)], "symbol int, freq int").coalesce(1).write.parquet(f"{folder}/table")
    size = coded.agg(F.sum(F.length("ids"))).first()[0] or 0
    # rows of one id, or of none, are spread by a hash of their ids and stay in one order
    mixed = F.xxhash64("ids")
    ordered = coded.repartitionByRange(max(1, -(-size // shard_size)), "doc_id", mixed).sortWithinPartitions("doc_id", mixed, "ids")
    ordered.mapInArrow(lambda it: _write(it, f"{folder}/shards", packed), "file string, bytes long, n_tokens long").write.parquet(f"{folder}/files")
    return folder


def _read(batches: Iterator[pa.RecordBatch], packed: bytes):
    for batch in batches:
        for name, data in zip(batch.column("path").to_pylist(), batch.column("content")):
            data = memoryview(data.as_buffer())
            info, keys, nulls, counts = read_index(data)
            blocks = [read_block(data, p, packed) for p in info["points"]]
            ids = np.concatenate(blocks) if blocks else np.empty(0, "<u4")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[b - n:b].data) for b, n in zip(ends.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keys)), pa.array(keys, mask=nulls.astype(bool)), pa.array(ends - counts), pa.array(counts), pa.array(np.array(crc, "i8"))],
                ["shard", "doc_id", "first", "n_tokens", "ids_crc32"])


def read(spark, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard``: every document as decoded from the shard files."""
    freq = np.zeros(1 << 16, "<u4")
    for r in spark.read.schema("symbol int, freq int").parquet(f"{folder}/table").collect():
        freq[r.symbol] = r.freq
    packed = zlib.compress(freq.tobytes())
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.rans").load(f"{folder}/shards").select("path", "content")
    docs = stored(files.mapInArrow(lambda it: _read(it, packed), "shard string, doc_id long, first long, n_tokens long, ids_crc32 long"), "decoded")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    starts = docs.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return docs.join(starts, "shard").select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "shard")
