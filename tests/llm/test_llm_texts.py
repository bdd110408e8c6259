"""Token, packing, dedup and rule operators against brute force on awkward documents."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm.shared import awkward, frame, prose
from sitegauge.llm import line_dedup, packing, quality_rules, rans, suffix_dedup, tokens

ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", " a", "a\n", "a b\n\nc d", "a \nb\tc d", "\x1c x\x1cy \x85 z", "a\xa0 b  \n c", "<|endoftext|> x<|endoftext|>y", "0 10 0", "it's I'LL don't ...'s",
       "é́ ́a", "İI ΣΑΣ", "​q \x00 w", "ª×÷ß Straße, naïve"]


def coded(path, texts, end):
    return [np.array([*e.ids, end], "<u4") for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_chunks_equal_library(path):
    texts = ODD + [t or "" for _, t in awkward()]
    expected = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    enc = tokens.ChunkEncoder(path)
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in expected]


def test_rans_block_round_trip_and_checksums():
    rng = np.random.default_rng(5)
    for n in (0, 1, 511, 512, 70_001):
        ids = np.minimum(rng.geometric(0.01, n), 49_000).astype("u2")
        packed = zlib.compress(rans.quantise(np.bincount(ids, minlength=1 << 16)).astype("<u4").tobytes())
        data = rans.shard_bytes([(1, ids)], packed, block_tokens=1 << 14)
        points = rans.read_index(data)[0]["points"]
        assert len(points) == -(-n // (1 << 14))
        assert b"".join(rans.read_block(data, p, packed).tobytes() for p in points) == ids.astype("<u4").tobytes()
        if n > 1000:  # any block alone, and a changed byte is noticed
            assert (rans.read_block(data, points[2], packed) == ids[2 << 14:3 << 14]).all()
            broken = bytearray(data)
            broken[points[1]["at"] + 5000] ^= 1
            with pytest.raises(ValueError):
                rans.read_block(bytes(broken), points[1], packed)


def test_quantised_tables_sum_and_cover():
    counts = np.zeros(1 << 16, "i8")
    counts[:40_000] = 1
    counts[7] = 10**12
    freq = rans.quantise(counts)
    assert freq.sum() == 1 << rans.BITS and (freq[:40_000] > 0).all() and freq[40_000:].sum() == 0


def test_shards_in_order(spark):
    rows = awkward()
    got = sorted([tuple(r) for r in rans.read(spark, rans.write(frame(spark, rows), WORD)).drop("shard").collect()], key=lambda r: r[1])
    ids = coded(WORD, [t or "" for _, t in rows], 2)
    at, want = 0, []
    hashed = spark.createDataFrame([(x.astype("<u2").tobytes(),) for x in ids], "ids binary").selectExpr("ids", "xxhash64(ids) h")
    order = {bytes(r.ids): r.h for r in hashed.collect()}
    place = lambda r: (r[0][0] is not None, r[0][0], order[r[1].astype("<u2").tobytes()])
    for (doc, _), x in sorted(zip(rows, ids), key=place):
        want.append((doc, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert got == want
    assert rans.read(spark, rans.write(frame(spark, [(1, None)]), WORD)).count() == 1
    assert rans.read(spark, rans.write(frame(spark, []), WORD)).count() == 0


def test_rows_without_an_id_are_spread_over_shards(spark):
    rows = [(None, prose(k, 60)) for k in range(600)] + [(7, prose(k, 60)) for k in range(300)]
    read = rans.read(spark, rans.write(frame(spark, rows), WORD, shard_size=16_000))
    sizes = [r["sum(n_tokens)"] for r in read.groupBy("shard").sum("n_tokens").collect()]
    assert len(sizes) > 5 and 2 * max(sizes) < 3 * 16_000
    got = sorted((r.start, r.doc_id is not None, r.n_tokens) for r in read.collect())
    assert [g[1] for g in got] == [False] * 600 + [True] * 300 and all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_random_strings_equal_library(path):
    rng = random.Random(5)
    parts = list("abAB '\n\t.,0é ßÀ×İσΣ\x00\x1c\xa0\u2003\u200b中") + ["'s", "'LL", " the", "  ", "\r\n", "don't", "<|endoftext|>", "<|"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    expected = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    ids, ends = tokens.ChunkEncoder(path).encode_flat(texts, 3)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [[*e.ids, 3] for e in expected]


def test_packing_places_every_id_once(spark):
    rows = awkward()
    out = packing.pack(frame(spark, rows), BYTE).collect()
    ids = {d: x for (d, _), x in zip(rows, coded(BYTE, [t or "" for _, t in rows], 0)) if d is not None}
    places = collections.defaultdict(list)
    for r in out:
        places[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None:
            x = ids[r.doc_id]
            assert r.doc_tokens == len(x) and zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    for runs in places.values():
        runs.sort()
        assert [o for o, _ in runs] == [sum(n for _, n in runs[:k]) for k in range(len(runs))] and sum(n for _, n in runs) <= 1024
    copies = collections.Counter(d for d, _ in rows)
    total = sum(len(x) * copies[d] for d, x in ids.items())
    assert sum(r.length for r in out if r.doc_id is not None) == total
    assert packing.pack(frame(spark, []), BYTE).count() == 0


def test_packing_in_small_slices_covers_the_same_ids(spark):
    docs = frame(spark, [r for r in awkward() if r[0] is not None])
    covered = lambda df: df.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"), F.max(F.col("start") + F.col("length")).alias("e")).collect()
    made = {chars: sorted(map(tuple, covered(packing.pack(docs, BYTE, slice_chars=chars)))) for chars in (500, 16_000_000)}
    assert made[500] == made[16_000_000] and len(made[500]) == len({r[0] for r in awkward()} - {None})


def test_packing_balances_cost():
    sizes = [1000, 30, 20, 10, 500, 524, 900, 124, 1024, 3000, 1] * 40
    pieces = packing.assign(sizes)
    cost, used = collections.Counter(), collections.Counter()
    for _, _, n, s, _ in pieces:
        cost[s] += packing.Cost()(n)
        used[s] += n
    assert sum(used.values()) == sum(sizes) and len(used) == -(-sum(sizes) // 1024) and max(used.values()) <= 1024
    assert sum(len(used) * 1024 - n for n in [sum(sizes)]) < 1024


def brute_repeats(rows, length=suffix_dedup.LENGTH):
    seen = collections.Counter(b[k:k + length] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    out = []
    for doc, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = True
        kept = np.frombuffer(b, "u1")[~gone].tobytes() if len(b) else b""
        out.append((doc, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("piece", [2_000_000, 1500])
def test_byte_repeats(spark, piece, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "SLICE", 2 * piece)
    rows = [r for r in awkward() if r[0] != 12]
    passage = prose(40, 90)
    rows += [(100 + i, prose(50 + i, 40 + i) + " " + passage[i % 9:] + " " + prose(80 + i, 30)) for i in range(25)]
    rows += [(200, "xyz" * 500), (201, "q" * 399), (202, "q" * 400), (203, "q" * 400 + "r")]
    assert sorted([tuple(r) for r in suffix_dedup.digest(suffix_dedup.dedup(frame(spark, rows))).collect()], key=repr) == brute_repeats(rows)
    assert suffix_dedup.dedup(frame(spark, [])).count() == 0


def test_corpus_order_is_suffix_order():
    texts = [prose(i % 3, 60)[i:] for i in range(6)]
    data = np.frombuffer("".join(texts).encode(), "u1")
    end = np.cumsum([len(t) for t in texts])
    begin = end - [len(t) for t in texts]
    home = np.repeat(np.arange(6), end - begin - 250)
    starts = np.concatenate([np.arange(b, e - 250) for b, e in zip(begin, end)])
    order = suffix_dedup.corpus_order(data, begin, end, starts, home, suffix_dedup.Prints(data))
    suffixes = [data[s:end[h]].tobytes() for s, h in zip(starts[order], home[order])]
    assert suffixes == sorted(suffixes)


def brute_lines(rows):
    lines = [(d, k, tuple(ASCII_WORD.findall(c)), c) for d, t in rows for k, c in enumerate((t or "").split("\n"))]
    place = lambda d, k: (d is not None, d or 0, k)
    first = {}
    for d, k, w, _ in lines:
        if w:
            first[w] = min(first.get(w, (2,)), place(d, k))

    def near(a, b):
        if min(len(a), len(b)) < line_dedup.MIN_WORDS or abs(len(a) - len(b)) > 1:
            return False
        x, y = sorted((a, b), key=len)
        return any(x[:i] == y[:i] and (x[i + 1:] if len(x) == len(y) else x[i:]) == y[i + 1:] for i in range(len(y)))

    gone = {w for w, p in first.items() if any(q < p and near(v, w) for v, q in first.items())}
    kept = {p for w, p in first.items() if w not in gone}
    out = []
    for d, t in rows:
        each = (t or "").split("\n")
        mine = [(c, bool(ASCII_WORD.search(c)), place(d, k) in kept) for k, c in enumerate(each)]
        out.append((d, sum(h for _, h, _ in mine), sum(h and not k for _, h, k in mine), "\n".join(c for c, h, k in mine if k or not h)))
    return sorted(out, key=repr)


def test_lines(spark):
    line = prose(30, 16).split()
    variants = [line, line[:5] + ["x"] + line[6:], line[:5] + line[6:], ["y"] + line, line + ["z"], line[1:], line[:5] + ["x"] + line[6:-1], line[::-1], line[:9], line[:8] + ["q"]]
    rows = [(300 + i, " ".join(v) + "\n\n  " + "  ".join(v) + "\t\nonly here " + str(i)) for i, v in enumerate(variants)]
    rows += [(i, t) for i, t in awkward() if i is not None and i not in (1, 9)] + [(1, prose(1, 300)), (9, prose(3, 40))]
    rows = list(dict(rows).items()) + [(None, prose(31, 20) + "\n" + " ".join(line))]
    assert sorted([tuple(r) for r in line_dedup.dedup(frame(spark, rows)).collect()], key=repr) == brute_lines(rows)
    assert line_dedup.dedup(frame(spark, [])).count() == 0
    kept = line_dedup.rewrite(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows)


def test_lines_of_rows_without_an_id_of_their_own(spark):
    line, other = prose(32, 16).split(), prose(33, 16)
    near = " ".join(line[:5] + ["x"] + line[6:])
    rows = [(1, " ".join(line)), (None, f"{near}\n{other}"), (None, "alone here\nand here"), (None, f"alone here\n{other}"), (7, near), (7, "kept for good"), (8, "twice\n\nsame"), (8, "twice\n\nsame")]
    got = collections.Counter(tuple(r)[::3] for r in line_dedup.dedup(frame(spark, rows)).collect())
    left = lambda d: sorted(x for (i, t), n in got.items() if i == d for x in t.split("\n") * n)
    # of neighbours and copies, those without an id come first; whichever of them holds a line first, each is there once
    assert left(None) == sorted([near, other, "alone here", "and here"] + [""] * (len(left(None)) - 4))
    assert left(1) == [""] and left(7) == ["", "kept for good"]
    assert got[8, "twice\n\nsame"] == 1 and got[8, ""] == 1
    assert sum(got.values()) == len(rows)


def test_rule_ledger(spark):
    rows = awkward() + [(400, prose(20, 30) + " " + prose(21, 12) + " and " + prose(21, 12)), (401, "# * $ " * 30), (402, "ABC DEF! " * 20), (403, "x " * 100)]
    got = quality_rules.ledger(frame(spark, rows))
    for r, (d, t) in zip(got.collect(), rows):
        w = ASCII_WORD.findall(t or "")
        grams = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for k in range(8)}
        lines = [x for x in (t or "").split("\n") if ASCII_WORD.search(x)]
        want = (d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), len(lines), sum(c.isupper() for c in t or ""))
        assert tuple(r)[:8] == want
        assert bool(r.failed_bits & 1) == (len(w) < 20) and bool(r.failed_bits & 2) == (100 * len(covered) > 30 * len(w))
    bits = collections.Counter(r.failed_bits for r in got.collect())
    for r in quality_rules.ablation(got, 2).collect():
        bit = 1 << [x.name for x in quality_rules.RULES].index(r.rule)
        assert r.failed == sum(n for b, n in bits.items() if b & bit) and r.failed_alone == bits[bit] and r.kept_without == bits[0] + bits[bit]
    kept = quality_rules.apply_policy(got, 2).filter("kept").count()
    assert kept == bits[0]
    assert quality_rules.ledger(frame(spark, [])).count() == 0
