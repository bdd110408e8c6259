"""Joins, searches and classifiers of the training-data operators."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.shared import awkward, frame, prose
from sitegauge.llm import contamination, licenses, mil, ngram_join, registry, toxicity
from sitegauge.llm.components import components

SF = "/root/testdata/sf0.001"


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_links(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets[d] = {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    parent = {d: d for d in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(parent, d)) for d, s in sets.items()}


@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_components_of_similar_documents(spark, n, percent):
    rng, rows = random.Random(4), [r for r in awkward() if r[0] is not None]
    for family in range(6):  # families whose members differ by shared and own edits, chains included
        words = prose(60 + family, 120).split()
        for k in range(12):
            words = list(words)
            for _ in range(family % 3):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(5)}"
            rows.append((1000 + 20 * family + k, " ".join(words[rng.randrange(3):])))
    got = ngram_join.link(frame(spark, rows + [(None, prose(1, 300)), (None, None)]), n, percent).collect()
    want = brute_links(rows, n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert len(got) == len(rows) + 2 and all(r.component_id is None for r in got if r.doc_id is None)


def test_ids_on_several_rows(spark):
    """Rows are compared by their texts, so an id on several rows hides no link, and a group keeps one row."""
    a, b, c, d = (prose(1500 + i, 60) for i in range(4))
    near = a + " end"
    rows = [(1, a), (1, b), (2, near), (3, b + " end"), (4, c), (4, c), (4, d), (5, near + " more"), (None, d), (None, "only " + c), (None, prose(1510, 60)), (6, ""), (7, None)]
    docs = frame(spark, rows)
    got = collections.Counter(tuple(r) for r in ngram_join.link(docs, 5, 80).select("doc_id", "component_id").collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 4): 3, (5, 1): 1, (None, None): 3, (6, 6): 1, (7, 7): 1}
    kept = ngram_join.first_rows(docs, 5, 80)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter([(1, a), (1, b), (4, c), (4, d), (None, prose(1510, 60)), (6, ""), (7, None)])


def test_overlaps_of_a_block():
    rng = np.random.default_rng(5)
    base = rng.permutation(3000)[:120]
    some = [np.unique(np.concatenate([rng.permutation(base)[:k], rng.integers(0, 3000, 130 - k)])).astype("i8") for k in (0, 40, 90, 100, 110, 115, 120) for _ in range(4)]
    some += [np.array([7], "i8"), some[-1].copy()]
    for percent in (50, 80, 90, 100):
        want = {(i, j) for i, x in enumerate(some) for j, y in enumerate(some) if 100 * len(np.intersect1d(x, y)) >= percent * len(np.union1d(x, y))}
        assert {(i, j) for i, found in ngram_join.overlaps(some, some, percent) for j in found.tolist()} == want
    assert list(ngram_join.overlaps([some[0]], [], 80))[0][1].tolist() == []


def test_blocks_of_few_rows(spark, monkeypatch):
    """Families whose members differ by shared edits, in blocks of a few rows each, have the components of brute force."""
    rng, rows = random.Random(3), []
    for family in range(3):
        base, other = prose(60 + family, 130).split(), prose(80, 130).split()
        for _ in range(25):
            words = base.copy()
            for at in rng.sample(range(10, 120, 10), rng.randrange(6)):
                words[at] = other[at + rng.randrange(2)]
            rows.append((len(rows), " ".join(words)))
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", 700)
    got = {r.doc_id: r.component_id for r in ngram_join.link(frame(spark, rows), 3, 90).collect()}
    assert got == {k: v[1] for k, v in brute_links(rows, 3, 90).items()} and len(set(got.values())) > 6


def test_products_of_a_family_grow_with_its_members(spark, monkeypatch):
    """Members that differ from one text in a word each: candidate pairs grow like the members, not like their square."""
    counts, keep = {}, ngram_join.stored

    def counting(df, name):
        made = keep(df, name)
        if name == "pairs":
            counts[members] = counts.get(members, 0) + made.count()
        return made

    monkeypatch.setattr(ngram_join, "stored", counting)
    base = prose(90, 200).split()
    for members in (100, 400):
        rows = [(0, " ".join(base))] + [(k, " ".join(base[:k % 200] + [f"edit{k}"] + base[k % 200 + 1:])) for k in range(1, members)]
        got = ngram_join.link(frame(spark, rows), 3, 90).select("component_id").distinct().collect()
        assert [r[0] for r in got] == [0]
    assert counts[400] < 6 * counts[100] and counts[400] < 400 * 20


def test_first_rows_keep_any_column(spark):
    docs = frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)])
    docs = docs.withColumn("tags", F.create_map(F.lit("k"), F.col("doc_id")))
    kept = ngram_join.first_rows(docs, 5, 80)
    assert kept.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (True, 0)]


def test_join_of_nothing(spark):
    assert ngram_join.link(frame(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.link(frame(spark, [(3, None)])).collect()] == [(3, 0, 3)]


def test_components_of_a_chain(spark):
    chain = list(range(50))
    random.Random(1).shuffle(chain)
    edges = spark.createDataFrame(list(zip(chain, chain[1:])) + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[v] == 0 for v in chain) and got[100] == got[101] == 100


def test_benchmark_items_inside_documents(spark):
    items = [(i, prose(500 + i, k)) for i, k in enumerate([30, 12, 5, 4, 1, 60, 59, 200])] + [(20, None), (21, ""), (None, prose(530, 20)), (0, prose(500, 30))]
    parts = [t for _, t in items if t]
    words = parts[5].split()
    rows = awkward() + [(600 + i, prose(700 + i, 50) + " " + p.upper() + ", " + prose(800 + i, 5000)) for i, p in enumerate(parts)]
    rows += [(650, " ".join(words[:50] + ["q"] + words[51:])), (651, " ".join(words[:40])), (652, " ".join(words[:52]))]
    got = collections.Counter(tuple(r) for r in contamination.search(frame(spark, rows), frame(spark, items, "item_id long, text string")).collect())
    table = bytes(range(256)).lower()
    split = lambda t: (t or "").encode().translate(table, contamination.PUNCTUATION).split()
    grams = lambda w, n: {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    want = collections.Counter()
    for i, t in items:
        w = split(t)
        n = min(5, len(w))
        if n:
            own = grams(w, n)
            for d, x in rows:
                shared = len(own & grams(split(x), n))
                if 100 * shared >= 80 * len(own):
                    want[d, i, len(own), shared] += 1
    assert got == want and want
    clean = frame(spark, rows).filter(contamination.is_clean(frame(spark, items, "item_id long, text string"))).collect()
    sets = [(min(5, len(split(t))), grams(split(t), min(5, len(split(t))))) for _, t in items if split(t)]
    holds = lambda x: any(100 * len(own & grams(split(x), n)) >= 80 * len(own) for n, own in sets)
    assert collections.Counter(r.doc_id for r in clean) == collections.Counter(d for d, x in rows if not holds(x))
    assert contamination.search(frame(spark, rows), frame(spark, [], "item_id long, text string")).count() == 0
    assert contamination.search(frame(spark, []), frame(spark, items, "item_id long, text string")).count() == 0


def test_items_are_read_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_ITEMS", 3)
    items = frame(spark, [(i, prose(900 + i, 20)) for i in range(10)], "item_id long, text string")
    docs = frame(spark, [(i, prose(900 + i, 20)) for i in range(10)])
    assert {(r.doc_id, r.item_id) for r in contamination.search(docs, items).collect()} == {(i, i) for i in range(10)}


def test_licences(spark):
    mit = "\n".join(licenses.SENTENCES[k] for k in ("mit-grant", "mit-notice", "mit-as-is"))
    wrapped = re.sub(r"(.{60}\S*) ", r"\1\n", mit)
    s = licenses.SENTENCES
    header = f"{s['apache-header']}\n{s['apache-comply']}\n{s['apache-copy']}\n\n    http://example.org/LICENSE-2.0\n\n{s['apache-unless']}\n{s['apache-see']}"
    rows = awkward() + [
        (700, "Some words.\n" + licenses.SENTENCES["apache-short"]), (701, wrapped), (702, "# " + header), (703, mit + "\n" + mit),
        (704, licenses.SENTENCES["mit-as-is"] + " " + licenses.SENTENCES["mit-grant"]), (705, "table | row\n" + licenses.SENTENCES["gpl3-short"].upper() + "\nmore"),
        (706, "We licensed under the apache of things. " + licenses.SENTENCES["cc-by-nc-short"]), (707, "x" * 200_000 + ". Released under the MIT License.")]
    got = collections.defaultdict(list)
    for r in licenses.scan(frame(spark, rows)).collect():
        got[r.doc_id].append((r.license, r.n_sentences))
        assert dict(rows)[r.doc_id][r.start:r.end].strip()
    assert dict(got) == {700: [("Apache-2.0", 1)], 701: [("MIT", 3)], 702: [("Apache-2.0", 4)], 703: [("MIT", 3)] * 2, 705: [("GPL-3.0-only", 1)], 706: [("CC-BY-NC-4.0", 1)], 707: [("MIT", 1)]}
    assert licenses.scan(frame(spark, [])).count() == 0


def test_licences_of_other_wordings(spark):
    s = licenses.SENTENCES
    bsd = [s["bsd-grant"], s["bsd-source"], s["bsd-binary"], "Neither the name of the Example Institute, Inc. nor the names of its contributors may be used to endorse or promote "
           "products derived from this software without specific prior written permission."]
    rows = [
        (1, "\n".join(bsd)), (2, "The code is distributed under the MIT license."), (3, "Licensed under GPL v2."), (4, "licensed under the GNU GPL, version 2 or later"),
        (5, "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR BSD-3-Clause */"), (6, "It is released under the Mozilla Public License 2.0, as is."),
        (7, "Available under the terms of the GNU Lesser General Public License version 2.1"), (8, "released under the AGPLv3+"), (9, "Published under CC0 1.0."),
        (10, "This is free and unencumbered software released into the public domain."), (11, s["zlib-as-is"] + "\n" + s["zlib-grant"]), (12, "Licensed under the Boost Software License, Version 1.0."),
        (13, "Licensed under a BSD 3-Clause license; parts are released under the Apache License v2.0"), (14, "distributed under CC-BY-NC-SA 4.0"), (15, "It was released under the title of MIT."),
        (16, "Licensed under the Eclipse Public License v 2.0"), (17, s["mit-short"])]
    got = collections.defaultdict(list)
    for r in sorted(licenses.scan(frame(spark, rows)).collect(), key=lambda r: r.start):
        got[r.doc_id].append(r.license)
    assert dict(got) == {
        1: ["BSD-3-Clause"], 2: ["MIT"], 3: ["GPL-2.0-only"], 4: ["GPL-2.0-or-later"], 5: ["GPL-2.0-only", "BSD-3-Clause"], 6: ["MPL-2.0"], 7: ["LGPL-2.1-only"], 8: ["AGPL-3.0-or-later"],
        9: ["CC0-1.0"], 10: ["Unlicense"], 11: ["Zlib"], 12: ["BSL-1.0"], 13: ["BSD-3-Clause", "Apache-2.0"], 14: ["CC-BY-NC-SA-4.0"], 16: ["EPL-2.0"], 17: ["MIT"]}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _step(row, x, b, i)
    return row


def _step(row, x, b, i):
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
    return new


def test_automaton_finds_what_edit_distance_finds():
    rng = random.Random(9)
    terms = ["idiot", "worthless", "scum", "trash", "vequ*", "lostra*", "lostre"]
    lexicon = toxicity.Lexicon(terms)
    for _ in range(4000):
        w = list(rng.choice(terms).rstrip("*") + rng.choice(["", "", "ab", "xyz"]))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(w) + 1)
            w[k:k + rng.randrange(2)] = rng.choice(["", "a", "o", "s"])
        w = "".join(w)
        want = {}
        for t in terms:
            row = distance(t.rstrip("*"), w)
            d = min(row) if t[-1] == "*" else row[-1]
            if d <= toxicity.bound(t.rstrip("*")):
                want[t] = d
        assert dict(lexicon.match(w)) == want


def labelled():
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words, bad = prose(2000 + i, 60).split(), i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(60), rng.choice(["badword", "nastier", "quulo" + rng.choice("abcdef")]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 > 0), int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled()
    model = toxicity.fit(frame(spark, rows), frame(spark, labels, "doc_id long, quality int, toxic int"))
    assert {"badword", "nastier"} <= set(model.weights) and any(t.startswith("quulo") for t in model.weights)
    out = mil.judge(frame(spark, rows + awkward()), model, 0.7).collect()
    assert len(out) == len(rows) + len(awkward()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    truth = {d: t for d, _, t in labels}
    held = [r for r in out[:len(rows)] if r.held_out]
    assert len(held) > 200 and all(r.predicted == truth[r.doc_id] for r in held)
    plain = prose(5000, 60)
    near, quoted, abuse = model.score([plain + " you badw0rd and nastie", plain + ' he wrote "badword" once', plain + " badword nastier"])
    assert near >= 0.7 and abuse >= 0.7 and quoted < abuse


def test_quality(spark):
    rows, labels = [], []
    for i in range(600):
        text = prose(3000 + i, 150)
        good = i % 5 > 0
        rows.append((i, text if good else text[:200] + "\n" + " ".join(w + "###" for w in text[200:].split())))
        labels.append((i, int(good), 0))
    model = mil.fit(frame(spark, rows), frame(spark, labels, "doc_id long, quality int, toxic int"))
    out = mil.judge(frame(spark, rows + awkward()), model, 0.5).collect()
    assert all(0 <= r.score <= 1 for r in out) and len(out) == len(rows) + len(awkward())
    held = [r for r in out[:len(rows)] if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 > 0) for r in held) >= 0.98 * len(held)


def test_gradients_of_gated_attention():
    import numpy as np

    rng = np.random.default_rng(1)
    x, begin, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0, 1])
    shape = {"enc": (5, 4), "enc_b": (4,), "att": (4, 4), "gate": (4, 4), "mix": (4,), "out": (4,), "out_b": (1,)}
    w = {k: rng.normal(size=s) for k, s in shape.items()}

    def loss(w):
        p = 1 / (1 + np.exp(-mil._forward(w, x, begin)["logit"]))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for k, g in mil._gradients(w, x, begin, y, 0.0).items():
        for at in np.ndindex(*w[k].shape):
            up, down = ({**w, k: w[k] + e * (np.indices(w[k].shape) == np.array(at).reshape(-1, *[1] * w[k].ndim)).all(0)} for e in (1e-5, -1e-5))
            assert abs((loss(up) - loss(down)) / 2e-5 - g[at]) < 1e-6


@pytest.mark.parametrize("label,module", [("toxic", toxicity), ("quality", mil)])
def test_models_without_labels(spark, label, module):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    out = mil.judge(frame(spark, awkward()), module.fit(frame(spark, awkward()), none, label), 0.5).collect()
    assert len(out) == len(awkward()) and len({r.score for r in out}) == 1
    odd = frame(spark, [(1, None, None), (None, 1, 1), (2, 5, 5), (4, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert mil.judge(frame(spark, []), module.fit(frame(spark, awkward()), odd, label), 0.5).count() == 0


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_registered_sql(spark, name):
    from oracle_compare import compare, oracle_connection

    result, _ = compare(spark, oracle_connection(SF), SF, registry.queries()[name], registry.oracle_sql()[name])
    assert result == "ok", result


def test_pipeline(spark):
    """Each stage takes effect, keeps the columns of documents and leaves clean documents alone."""
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    current, before = docs, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in c.STAGES[:-1]:
        current = c.stored(stage(spark, current, SF), name)
        after = {r.doc_id: r.text for r in current.collect()}
        assert current.columns == docs.columns and set(after) <= set(before)
        if name == "quality_classifier":
            assert all(labels.get(d, 0) == 0 for d in set(before) - set(after)) and all(labels.get(d, 1) == 1 for d in after)
        elif name == "line_dedup":
            assert sorted((d, t) for d, t in after.items()) == sorted((d, t) for d, n, gone, t in brute_lines_of(before) if n == 0 or gone < n)
            assert any(n and gone == n for _, n, gone, _ in brute_lines_of(before))  # documents with nothing left go
        elif name == "ngram_jaccard_join":
            assert set(after) == {d for d, (_, component) in brute_links(list(before.items()), 5, 80).items() if component == d}
        else:
            table = bytes(range(256)).lower()
            split = lambda t: (t or "").encode().translate(table, contamination.PUNCTUATION).split()
            grams = lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
            sets = [grams(split(t)) for t in items]
            assert set(after) == {d for d, t in before.items() if not any(10 * len(s & grams(split(t))) >= 8 * len(s) for s in sets)}
        before = after
    assert {r.doc_id for r in c.STAGES[-1][1](spark, current, SF).collect()} == set(before)


def brute_lines_of(before):
    from llm.test_llm_texts import brute_lines

    return brute_lines(list(before.items()))


def test_pipeline_stages_on_awkward_rows(spark):
    """Null and repeated ids, nulls, blank and very long texts, extra columns with clashing names, empty tables."""
    import corpus_pipeline as c

    rows = [(d, t, "en", None, len(t or "")) for d, t in awkward()] + [(None, prose(31, 40), None, "s", 1)] * 2
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars int")
    for name, stage in c.STAGES[1:4]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0
        docs = c.stored(made, name)
        kept = docs.collect()
        assert kept and all(r.n_chars == len(r.text or "") for r in kept)
        assert sum(r.doc_id is None and r.text == prose(31, 40) for r in kept) == 1  # equal rows: one stays
        assert sum(r.text in (None, "") for r in kept) == 3  # blank before, not by line dedup
    packed = c.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r.start == 0 for r in packed) == len(kept)


def test_wrapped_licences_at_every_width(spark):
    import textwrap

    s = licenses.SENTENCES
    whole = {"MIT": ["mit-grant", "mit-notice", "mit-as-is"], "GPL-3.0-or-later": ["gpl-free", "gpl-hope", "gpl-details"]}
    rows, want = [], {}
    for width in range(18, 110, 3):
        for lead in ("", "# ", " * "):
            for name, keys in whole.items():
                text = "\n".join(lead + line for key in keys for line in [*textwrap.wrap(s[key], width), ""])
                want[len(rows)] = [name]
                rows.append((len(rows), text))
    for text, name in (("License: Apache-2.0", "Apache-2.0"), ("licence : MIT", "MIT"), (s["gpl-free"].replace("This program", "This  program", 1), "GPL-3.0-or-later")):
        want[len(rows)] = [name]
        rows.append((len(rows), text))
    got = collections.defaultdict(list)
    for r in licenses.scan(frame(spark, rows)).collect():
        got[r.doc_id].append(r.license)
    assert {k: got[k] for k in want if got[k] != want[k]} == {}
