"""Toxicity by a learned lexicon: Levenshtein automata run over the lexicon's trie, matches weighed by their context.

Lexicon: words, and stems that begin words, which labelled toxic documents hold and others do not. Terms are kept in a
trie. A text's word is read as a Levenshtein automaton (the row of edit distances to every prefix of the word) and the
automaton is intersected with the trie: a branch is left as soon as no distance within the bound remains, and an end of
a term within the bound is a match, so misspelled terms are caught. A stem may match a beginning of the word.

Context: each match is a mention with the log-likelihood ratio of its term, exact or misspelled, between toxic and other
documents. Inside quotation marks, or with a word of reporting in the window of words around it, it counts as quotation:
all such mentions together weigh no more than the strongest single one, scaled by ``QUOTED``. Other mentions are abuse
and add up. A logistic curve turns the sum, and the sum per hundred words, into the score.

Lexicon and weights are fitted on at most ``MAX_DOCS`` labelled documents picked by a hash of the id, near copies among
them counted once. Scoring is one narrow Arrow pass over whole texts.

Defined results: null and empty texts score as texts without any mention; rows with a null id are scored but never learned from; repeated rows get
the same score; several labels of one id count as their largest; an empty table gives no rows, and without toxic labels
the lexicon is empty and all scores are 0; all other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sitegauge.llm import grams
from sitegauge.llm.mil import sample

MAX_DOCS = 8_000
MIN_STEM = 3
#: Mentions of a term counted in one document, and the least share of toxic documents' among them.
MENTIONS, PURITY = 3, 0.35
#: What a term's log-likelihood statistic must have above the largest one expected among so many candidates by chance.
MARGIN = 6.0
QUOTED = 0.35
WINDOW = 8
REPORTING = frozenset("said says wrote writes quoted quote called calls term word reported reports".split())
_WORD = re.compile(r"\w+")
_OPENS = re.compile("[\"“„«‘]")
_PAIRS = {"“": "”", "„": "“”", "«": "»", "‘": "’", '"': '"'}


def bound(term: str) -> int:
    """Edits allowed in a term of this length."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Trie over terms; a term that ends in ``*`` is a stem."""

    def __init__(self, terms: list[str]):
        self.root: dict = {}
        pieces = set()
        for t in terms:
            node, letters, k = self.root, t.rstrip("*"), bound(t.rstrip("*"))
            for c in letters:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((t, k))
            cut = [len(letters) * i // (k + 1) for i in range(k + 2)]
            pieces |= {letters[a:b] for a, b in zip(cut, cut[1:])}
        self.most = max((bound(t.rstrip("*")) for t in terms), default=0)
        #: k edits leave one of k + 1 pieces of a term as it is, so words without any piece need no automaton.
        self.hint = re.compile("|".join(map(re.escape, sorted(pieces)))) if pieces else None

    def match(self, word: str) -> tuple[tuple[str, int], ...]:
        """Terms within their bound of the word, with the distance."""
        if self.hint is None or not self.hint.search(word):
            return ()
        best: dict[str, int] = {}
        stack = [(self.root, list(range(len(word) + 1)))]
        while stack:
            node, row = stack.pop()
            for c, child in node.items():
                if c == "":
                    for term, k in child:
                        d = min(row) if term[-1] == "*" else row[-1]
                        if d <= k:
                            best[term] = min(d, best.get(term, d))
                    continue
                new, low = [row[0] + 1], row[0] + 1
                for j, x in enumerate(word):
                    d = min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1)
                    new.append(d)
                    low = d if d < low else low
                if low <= self.most:
                    stack.append((child, new))
        return tuple(sorted(best.items()))


@dataclass(frozen=True)
class Model:
    """Weights of an exact and of a misspelled mention of each term, and the curve from their sum to a score."""

    weights: dict[str, tuple[float, float]] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def score(self, strings: list[str]) -> np.ndarray:
        sums = _scorer(tuple(sorted((t, *w) for t, w in self.weights.items()))).score(strings)
        return 1 / (1 + np.exp(-np.clip(_design(sums) @ np.array(self.curve), -30, 30)))


def _design(sums: np.ndarray) -> np.ndarray:
    """Columns of the curve from ``(sum of weights, words)`` of each text."""
    x = np.minimum(sums[:, 0], 30)
    return np.stack([np.ones(len(x)), x, np.minimum(100 * x / (sums[:, 1] + 50), 30)], 1)


@functools.lru_cache(maxsize=2)
def _scorer(weights: tuple) -> Scorer:
    """One per Python worker and model, so that words stay known from batch to batch."""
    return Scorer(weights)


class Scorer:
    MEMO = 1_000_000

    def __init__(self, weights: tuple):
        self.weights = {t: (exact, near) for t, exact, near in weights}
        self.lexicon = Lexicon(list(self.weights))
        self.clean: set[str] = set()
        self.hits: dict[str, float] = {}

    def weight(self, word: str) -> float:
        return max((self.weights[t][d > 0] for t, d in self.lexicon.match(word)), default=0.0)

    def score(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), 2))
        if not self.weights:
            return out
        for i, text in enumerate(strings):
            text = text.lower()
            words = set(_WORD.findall(text))
            for w in words.difference(self.clean, self.hits):
                if v := self.weight(w):
                    self.hits[w] = v
                else:
                    self.clean.add(w)
            found = words.intersection(self.hits) if len(words) < len(self.hits) else self.hits.keys() & words
            if found:
                out[i] = self.document(text, found)
            if len(self.clean) + len(self.hits) > self.MEMO:
                self.clean, self.hits = set(), {}
        return out

    def document(self, text: str, found: set[str]) -> tuple[float, int]:
        """Sum of weights of a text that holds the words ``found``, and its number of words."""
        marks, n = mentions(text, found)
        marks = [(self.hits[w], quoted) for w, quoted in marks]
        return sum(v for v, quoted in marks if not quoted) + QUOTED * max((v for v, quoted in marks if quoted), default=0.0), n


def mentions(text: str, found: set[str]) -> tuple[list[tuple[str, bool]], int]:
    """Every occurrence of the words in ``found``, and whether its context is a quotation; number of words."""
    quoted = quotations(text)
    begins = [a for a, _ in quoted]
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[a:b] for a, b in spans]
    out = []
    for k, w in enumerate(words):
        if w in found:
            i = bisect.bisect_left(begins, spans[k][0]) - 1
            inside = i >= 0 and spans[k][1] <= quoted[i][1]
            out.append((w, inside or not REPORTING.isdisjoint(words[max(0, k - WINDOW):k + WINDOW + 1])))
    return out, len(words)


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks on one line."""
    out, at = [], 0
    while at < len(text):
        m = _OPENS.search(text, at)
        if not m:
            break
        line = text.find("\n", m.end())
        ends = [p for c in _PAIRS[m[0]] if (p := text.find(c, m.end(), line if line >= 0 else len(text))) >= 0]
        if ends:
            out.append((m.start(), min(ends)))
            at = min(ends) + 1
        else:
            at = m.end()
    return out


def _words(batches: Iterator[pa.RecordBatch]):
    """Label, a key that near copies share, and the words of each text, each at most MENTIONS times."""
    for batch in batches:
        strings = batch.column("text").to_pylist()
        keys = [int(s[0] >> np.uint64(1)) if len(s) else -1 for s in grams.gram_sets(strings, 5)]
        words = ["\n".join(w for w, n in sorted(Counter(_WORD.findall(s.lower())).items()) for _ in range(min(n, MENTIONS))) for s in strings]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(keys, pa.int64()), pa.array(words, pa.large_string())], ["y", "key", "words"])


def _features(line: str) -> dict[str, int]:
    """Words and stems of a document with their mentions."""
    total: Counter = Counter()
    for w in line.split("\n"):
        if len(w) >= MIN_STEM:
            total[w] += 1
        for k in range(MIN_STEM, min(len(w), 12)):
            total[w[:k] + "*"] += 1
    return {f: min(n, MENTIONS) for f, n in total.items()}


def evidence(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Log-likelihood statistic of a term being more common in toxic documents."""
    base, share = n_toxic / (n_toxic + n_clean), toxic / (toxic + clean)
    if share <= base:
        return 0.0
    return 2 * (toxic * math.log(share / base) + (clean * math.log((1 - share) / (1 - base)) if clean else 0))


def learn_terms(toxic: list[str], n_clean: int, count_clean) -> list[str]:
    """Terms in order of their evidence, none beginning with another. ``toxic``: words of each toxic document;
    ``count_clean``: from candidate terms to their mentions in the other documents."""
    support: Counter = Counter()
    docs: Counter = Counter()
    for line in toxic:
        support.update(found := _features(line))
        docs.update(found.keys())
    least = max(4, len(toxic) // 200)
    candidates = {f for f, n in docs.items() if n >= least}
    clean, needed = count_clean(candidates), 2 * math.log(max(2, len(candidates))) + MARGIN
    good = {f: e for f in candidates if support[f] >= PURITY * (support[f] + clean.get(f, 0))
            and (e := evidence(support[f], clean.get(f, 0), len(toxic), n_clean)) >= needed}
    out: list[str] = []
    for f in sorted(good, key=lambda f: (-round(good[f], 6), f[-1] == "*", -len(f), f)):
        letters = f.rstrip("*")
        if not any(letters.startswith(t.rstrip("*")) or t.startswith(letters) for t in out):
            out.append(f)
    return out


def weigh(terms: list[str], docs: list[tuple[int, int, list[tuple[str, bool, bool]]]]) -> Model:
    """Weights and curve from labelled documents: label, number of words and mentions ``(term, misspelled, quoted)`` of each."""
    n = [sum(y == k for y, _, _ in docs) for k in (0, 1)]
    total: Counter = Counter((t, near, y) for y, _, marks in docs for t, near, _ in marks)
    weights = {}
    for t in terms:
        exact = total[t, False, 1]
        ratio = lambda near, prior: math.log((total[t, near, 1] + prior) / max(1, n[1])) - math.log((total[t, near, 0] + 0.5) / max(1, n[0]))  # noqa: B023,E731
        weights[t] = (max(0.0, ratio(False, 0.0 if exact else 0.5)), max(0.0, ratio(True, 0.1 * exact)))
    sums = []
    for _, size, marks in docs:
        each = [(weights[t][near], quoted) for t, near, quoted in marks]
        sums.append((sum(v for v, q in each if not q) + QUOTED * max((v for v, q in each if q), default=0.0), size))
    x, y = np.array(sums, "f8"), np.array([y for y, _, _ in docs], "f8")
    keep = (x[:, 0] > 0) | (y == 0)  # toxic documents without a mention say nothing about the curve
    # a logistic regression held near naive Bayes, odds of the labels times the likelihood ratios, which decides where labels do not
    design, y, bayes = _design(x[keep]), y[keep], np.array([math.log(max(1, n[1]) / max(1, n[0])), 1.0, 0.0])
    w, penalty = bayes.copy(), np.array([1.0, 3.0, 3.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + np.diag(penalty)
        w = w + np.clip(np.linalg.solve(h, design.T @ (y - p) - penalty * (w - bayes)), -1, 1)
    return Model(weights, tuple(w.tolist()))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = MAX_DOCS) -> Model:
    """Lexicon, weights and curve; what reaches the driver is bounded by the sample."""
    spark = docs.sparkSession
    seen = sample(docs, labels, label, limit).persist()
    try:
        words = seen.mapInArrow(_words, "y int, key long, words string")
        toxic: dict[int, str] = {}
        for r in words.filter("y = 1").collect():
            toxic[r.key] = min(r.words, toxic.get(r.key, r.words))
        n_clean = seen.filter("y = 0").count()
        if not toxic or not n_clean:
            return Model()

        def count_clean(candidates: set[str]) -> dict[str, int]:
            held = spark.sparkContext.broadcast(candidates)

            def count(batches):
                total = Counter()
                for batch in batches:
                    for line in batch.column("words").to_pylist():
                        total.update({f: n for f, n in _features(line).items() if f in held.value})
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

            others = words.filter("y = 0").select("words").mapInArrow(count, "term string, n long")
            return {r.term: r.n for r in others.groupBy("term").agg(F.sum("n").alias("n")).collect()}

        terms = learn_terms(list(toxic.values()), n_clean, count_clean)
        lexicon = Lexicon(terms)

        def mark(batches):
            known: dict[str, tuple[str, bool] | None] = {}
            for batch in batches:
                lines, sizes = [], []
                for text in batch.column("text").to_pylist():
                    text = text.lower()
                    here = set(_WORD.findall(text))
                    for w in here.difference(known):
                        best = min(lexicon.match(w), key=lambda x: (x[1], terms.index(x[0])), default=None)
                        known[w] = best and (best[0], best[1] > 0)
                    marks, size = mentions(text, {w for w in here if known[w]})
                    lines.append([f"{known[w][0]}\t{known[w][1]:d}\t{q:d}" for w, q in marks])
                    sizes.append(size)
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(sizes, pa.int64()), pa.array(lines, pa.list_(pa.string()))], ["y", "size", "marks"])

        rows = seen.mapInArrow(mark, "y int, size long, marks array<string>").collect()
        return weigh(terms, [(r.y, r.size, [(t, near == "1", q == "1") for t, near, q in (m.split("\t") for m in r.marks)]) for r in rows])
    finally:
        seen.unpersist()
