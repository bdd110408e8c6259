"""Near duplicates against brute force and against a sequential model of the bounded index."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sitegauge.operators import copies as cp, duplicates as dp
from sitegauge.params import Params


def sketch(text, size=128):
    words = text.split(" ")
    entries = {}
    for i in range(len(words) - 3):
        s = " ".join(words[i:i + 4])
        entries[hashlib.sha1(s.encode()).hexdigest()[:16]] = s
    return sorted(h + s for h, s in entries.items())[:size]


def exact_model(pages, threshold):
    out = {}
    for grp, pid, pos, sk in pages:
        mine, best = {e[:16] for e in sk}, None
        for g2, p2, pos2, sk2 in pages:
            if g2 != grp or pos2 >= pos:
                continue
            other = {e[:16] for e in sk2}
            both = mine & other
            if not both:
                continue
            j = len(both) / (len(mine) + len(other) - len(both))
            key = (-j, -len(both), min(both), pos2)
            if best is None or key < best[0]:
                best = (key, p2, j)
        if best and best[2] >= threshold:
            out[pid] = (best[1], round(best[2], 9))
    return out


def bounded_model(pages, p):
    out = {}
    for group in sorted({x[0] for x in pages}):
        seen, index = [], {}
        for _, pid, _, sk in sorted((x for x in pages if x[0] == group), key=lambda x: x[2]):
            hs = [e[:16] for e in sk]
            counts = {}
            for h in hs:
                for i in index.get(h, []):
                    counts[i] = counts.get(i, 0) + 1
            ranked = sorted(counts, key=lambda i: -counts[i])[: p.candidates]
            best, match = 0.0, None
            for i in ranked:
                both = len(set(hs) & set(seen[i][1]))
                j = both / (len(hs) + len(seen[i][1]) - both)
                if j > best:
                    best, match = j, seen[i][0]
            for h in hs:
                index.setdefault(h, []).append(len(seen))
                index[h] = index[h][-p.bucket:]
            seen.append((pid, hs))
            if match is not None and best >= p.duplicate_threshold:
                out[pid] = (match, round(best, 9))
    return out


def corpus(seed, n=160):
    """Families of copies, near copies with unique and with shared edits, repeated texts, and unrelated pages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    bases = [[word() for _ in range(rng.choice([40, 150, 220]))] for _ in range(4)]
    pages = []
    for i in range(n):
        text = list(rng.choice(bases)) if rng.random() < 0.8 else [word() for _ in range(180)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(["red", "blue", f"u{i}x{rng.randrange(9)}"])
        pages.append((rng.choice(["a", "b"]), i, i, sketch(" ".join(text))))
    return pages


SCHEMA = "grp string, id long, position long, sketch array<string>"


def found(df):
    return {r["id"]: (r["matched_id"], round(r["similarity"], 9)) for r in df.collect()}


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 3)])
def test_exact_matches_equal_brute_force(spark, seed, block):
    pages = corpus(seed)
    df = spark.createDataFrame(pages, SCHEMA)
    p = Params(block=block, salts=3, chunk=16)
    expected = exact_model(pages, p.duplicate_threshold)
    assert expected
    assert found(dp.best_matches(df, p)) == expected


@pytest.mark.parametrize("bucket,candidates", [(200, 30), (10, 3)])
def test_bounded_index_equals_sequential_model(spark, bucket, candidates):
    pages = corpus(3)
    p = Params(duplicate_bucket=bucket, duplicate_candidates=candidates, chunk=16, salts=3)
    df = spark.createDataFrame(pages, SCHEMA)
    assert found(dp.bounded_matches(df, p)) == bounded_model(pages, p)


def test_partitioning_and_row_order_do_not_matter(spark):
    pages = corpus(5, 80)
    shuffled = random.Random(0).sample(pages, len(pages))
    one = found(dp.best_matches(spark.createDataFrame(pages, SCHEMA)))
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found(dp.best_matches(spark.createDataFrame(shuffled, SCHEMA).repartition(7))) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_near_duplicate_page_and_phrases(spark):
    words = [f"word{i}" for i in range(220)]
    changed = words[:100] + ["changed"] + words[101:]
    rows = [("s", 1, 1, "https://e.example/a", " ".join(words)), ("s", 2, 2, "https://e.example/b", " ".join(changed))]
    df = dp.dup_sketch(spark.createDataFrame(rows, "grp string, id long, position long, url string, text string"))
    out = dp.dup_findings(df.drop("text"), Params(duplicate_threshold=0.80)).select(
        "page_id", F.get_json_object("signals", "$.matched_url").alias("m"), F.get_json_object("signals", "$.matching_phrases[0]").alias("p")
    ).collect()
    assert [(r.page_id, r.m) for r in out] == [(2, "https://e.example/a")] and out[0].p


def test_containment(spark):
    shared = " ".join(f"shared{i}" for i in range(120))
    src = [(1, shared + " " + " ".join(f"left{i}" for i in range(5))), (2, " ".join(f"aa{i}" for i in range(80)))]
    cand = [(10, shared + " " + " ".join(f"right{i}" for i in range(50))), (11, " ".join(f"bb{i}" for i in range(80)))]
    s, c = spark.createDataFrame(src, "id long, text string"), spark.createDataFrame(cand, "id long, text string")
    pairs = spark.createDataFrame([(1, 10), (2, 11)], "source_id long, candidate_id long")
    rows = {r.source_id: r for r in cp.copy_containment(pairs, s, c).collect()}
    assert rows[1].similarity > 0.9 and len(rows[1].phrases) == 3
    assert rows[2].similarity == 0.0 and rows[2].phrases == []
    assert [(r.source_id, r.candidate_id) for r in cp.copy_corpus_scan(s, c).collect()] == [(1, 10)]


def test_corpus_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    base = [f"t{i}" for i in range(60)]
    texts = [(i, " ".join(base[rng.randrange(30):][: rng.randrange(8, 40)] + [f"x{rng.randrange(20)}y" for _ in range(rng.randrange(6))])) for i in range(60)]
    shingles = lambda t: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)}
    expected = {
        (a, b) for a, ta in texts for b, tb in texts
        if shingles(ta) and shingles(tb) and round(len(shingles(ta) & shingles(tb)) / len(shingles(ta)), 4) >= 0.35
    }
    df = spark.createDataFrame(texts, "id long, text string")
    got = {(r.source_id, r.candidate_id) for r in cp.copy_pairs(df, df, 0.35, Params(block=4, salts=2)).collect()}
    assert got == expected


def test_hashes_as_numbers_keep_the_order_of_their_digits(spark):
    digits = ["0" * 16, "00000000000000ff", "7" + "f" * 15, "8" + "0" * 15, "f" * 16]
    entries = spark.createDataFrame([([d + "some words" for d in digits],)], "sketch array<string>")
    numbers = entries.select(dp.numbers_of(F.col("sketch"))).first()[0]
    assert numbers == sorted(set(numbers)) and len(numbers) == 5
