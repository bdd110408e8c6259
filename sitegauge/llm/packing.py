"""Cost-balanced packing of token ids into sequences of a fixed length.

The cost of a piece of ``n`` tokens is ``linear * n + quadratic * n**2``: attention runs inside one document's piece.
A document gives full sequences of its own for every whole ``length`` tokens. The remainders of a shard are taken in
descending order of cost; each goes to the sequence with the lowest cost that still has room. What does not fit there
comes back as a remainder of its own, so a shard has less than one sequence of padding in all.

A shard is a run of whole documents of one Spark partition with at least ``shard_tokens`` tokens (the last one may
have fewer), so nothing is shuffled, memory follows the shard and the longest document, and a task that is run again
gives the same numbers: a sequence id is the partition's number shifted by 40 bits plus a count.

Defined results: a null or empty text is one end token; rows with a null id are packed and keep the null; repeated
rows are packed each; an empty table gives no rows; all other input columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sitegauge.llm import tokens
from sitegauge.llm.common import texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
#: Tokens of one batch of documents that are held at a time before they are packed.
SHARD_TOKENS = 4_000_000
#: Characters that are encoded together: more take fewer seconds, as distinct words are encoded once, and more memory.
SLICE_CHARS = 16_000_000


@dataclass(frozen=True)
class Cost:
    """Relative cost of a token and of a pair of tokens; the ratio is that of a layer 1,024 wide."""

    linear: float = 1.0
    quadratic: float = 1.0 / 6144

    def __call__(self, n):
        return self.linear * n + self.quadratic * n * n


def assign(sizes: list[int], length: int = 1024, cost: Cost = Cost()) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, size, sequence, offset)`` of items with the given token counts.

    Ties go to the longer remainder's lower item number and to the lower sequence number.
    """
    pieces, sequence, left = [], 0, []
    for item, n in enumerate(sizes):
        for start in range(0, n - length + 1, length):
            pieces.append((item, start, length, sequence, 0))
            sequence += 1
        if n % length:
            left.append((-(n % length), item, n - n % length))
    heapq.heapify(left)
    total = -sum(x[0] for x in left)
    open_ = [(0.0, sequence + k, 0) for k in range(-(-total // length))]
    while left:
        size, item, start = heapq.heappop(left)
        spent, number, used = heapq.heappop(open_)
        n = min(-size, length - used)
        pieces.append((item, start, n, number, used))
        if used + n < length:
            heapq.heappush(open_, (spent + cost(n), number, used + n))
        if n < -size:
            heapq.heappush(left, (size + n, item, start + n))
    return pieces


def _pack(batches: Iterator[pa.RecordBatch], path: str, end: int, length: int, shard_tokens: int, cost: Cost, slice_chars: int):
    pa.default_memory_pool().release_unused()  # a worker comes with what the stages before have left
    enc = tokens.encoder(path)
    number = TaskContext.get().partitionId() << 40
    ids, names, held = [], [], 0

    def flush() -> pa.RecordBatch:
        nonlocal number
        pieces = assign([len(x) for x in ids], length, cost)
        crc = [zlib.crc32(ids[i][a:a + n].astype("<u4").data) for i, a, n, _, _ in pieces]
        item, start, size, seq, offset = (np.array(x, "i8") for x in zip(*pieces))
        counts = np.array([len(x) for x in ids], "i8")
        doc = pa.array(names, pa.int64()).take(pa.array(item))
        out = pa.RecordBatch.from_arrays(
            [doc, *(pa.array(x) for x in (start, size, np.array(crc, "i8"), counts[item], number + seq, offset, cost(size.astype("f8"))))],
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])
        number += int(seq.max()) + 1
        return out

    for batch in batches:
        keys, strings = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in tokens.slices(strings, slice_chars):
            flat, ends = enc.encode_flat(strings[a:b], end)
            ids += [flat[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            names += keys[a:b]
            held += len(flat)
            if held >= shard_tokens:
                yield flush()
                ids, names, held = [], [], 0
    if ids:
        yield flush()


def pack(docs: DataFrame, path: str, end: int = 0, length: int = 1024, shard_tokens: int = SHARD_TOKENS, cost: Cost = Cost(), slice_chars: int = SLICE_CHARS, **columns: str) -> DataFrame:
    """One row per piece (see :data:`SCHEMA`) of every document, ``end`` being its last id; ``path``: vocabulary file."""
    return texts(docs, **columns).mapInArrow(lambda it: _pack(it, path, end, length, shard_tokens, cost, slice_chars), SCHEMA)
