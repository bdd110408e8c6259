"""Quality classifier: gated-attention multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from its own words (shares of kinds of
characters, lengths, repetition inside the passage and the document) and hashed word counts. A learned layer encodes the
passage, gated attention weighs the passages of a bag, and the weighted passage representation is scored. Labels belong
to documents only; the attention learns which passages matter.

The model is fitted in numpy on the driver on a sample of at most ``MAX_BAGS`` labelled documents and ``MAX_PASSAGES``
passages (whole documents), picked by a hash of the id. Scoring is one narrow Arrow pass over whole texts.

Defined results: null and empty texts are one passage of zeros and get a score too; rows with a null id are scored but
never learned from; repeated rows get the same score; several labels of one id count as their largest; an empty table
gives no rows, and without labels of both kinds the score is the share of good labels, 1 if there are none; all other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from sitegauge.llm import grams
from sitegauge.llm.common import texts
from sitegauge.llm.tokens import slices

PASSAGE = 64
BUCKETS = 32
MAX_BAGS = 4096
MAX_PASSAGES = 60_000
HIDDEN = 24
#: Tasks over which the sampled texts are spread.
SAMPLE_PARTS = 24
_KINDS = np.zeros((6, 256), "f4")  # capitals, digits, marks of markup, other punctuation, exclamation, beyond ASCII
_KINDS[0, 65:91] = _KINDS[1, 48:58] = _KINDS[5, 128:] = 1
_KINDS[2, list(b"#*$%&|<>")] = 1
_KINDS[3, [b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "#*$%&|<>!"]] = 1
_KINDS[4, ord("!")] = 1
N_FEATURES = 6 + 7 + BUCKETS


def encode(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of all texts, and where each text's passages begin (one entry more than texts)."""
    words, at = grams.word_hashes(strings)
    counts = np.diff(at)
    passages = np.maximum(1, -(-counts // PASSAGE))
    begin = np.concatenate([[0], np.cumsum(passages)])
    out = np.zeros((begin[-1], N_FEATURES), "f4")
    if not len(words):
        return out, begin
    data = np.frombuffer(b" ".join(t.encode() for t in strings) + b" ", "u1")
    space = grams._SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    first, last = edge[::2], edge[1::2]
    doc = np.repeat(np.arange(len(strings)), counts)
    nth = np.arange(len(words)) - at[doc]
    passage = begin[doc] + nth // PASSAGE
    n = np.bincount(passage, minlength=begin[-1]).astype("f4")
    safe = np.maximum(n, 1)
    heads = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    tails = np.append(heads[1:], len(words)) - 1
    rows = passage[heads]
    size = (last - first).astype("f4")
    total = np.maximum(np.bincount(passage, size, begin[-1]).astype("f4"), 1)
    for k in range(6):
        sums = np.concatenate([[0], np.cumsum(_KINDS[k][data], dtype="f8")])
        out[rows, k] = (sums[last[tails]] - sums[first[heads]]) / total[rows]
    mean = total / safe
    out[:, 6] = np.where(n > 0, mean / 10, 0)
    out[:, 7] = np.sqrt(np.maximum(np.bincount(passage, size * size, begin[-1]) / safe - mean * mean, 0)) / 10
    out[:, 8] = np.bincount(passage, size <= 1, begin[-1]) / safe
    pair = np.lexsort((words, passage))
    again = np.append(False, (words[pair][1:] == words[pair][:-1]) & (passage[pair][1:] == passage[pair][:-1]))
    out[:, 9] = np.bincount(passage[pair], again, begin[-1]) / safe
    seven = grams.gram_hashes(words, 7)
    if len(seven):
        where = doc[:len(seven)]
        order = np.lexsort((seven, where))
        same = (seven[order][1:] == seven[order][:-1]) & (where[order][1:] == where[order][:-1])
        repeat = np.zeros(len(words), "f4")
        repeat[order[1:][same]] = 1
        repeat[order[:-1][same]] = 1
        out[:, 10] = np.bincount(passage, repeat, begin[-1]) / safe
    out[:, 11] = n / PASSAGE
    out[:, 12] = n == 0
    cells = np.bincount(passage * BUCKETS + (words >> np.uint64(59)).astype("i8"), minlength=begin[-1] * BUCKETS).reshape(-1, BUCKETS)
    out[:, 13:] = np.sqrt(cells / safe[:, None])
    return out, begin


@dataclass(frozen=True)
class Model:
    weights: dict[str, np.ndarray]
    shift: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def score(self, strings: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(strings), self.constant)
        x, begin = encode(strings)
        return 1 / (1 + np.exp(-np.clip(_forward(self.weights, (x - self.shift) / self.scale, begin)["logit"], -30, 30)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray) -> dict:
    """Encoded passages, attention within each bag and the bag's logit."""
    h = np.tanh(x @ w["enc"] + w["enc_b"])
    t, g = np.tanh(h @ w["att"]), 1 / (1 + np.exp(-np.clip(h @ w["gate"], -30, 30)))
    e = (t * g) @ w["mix"]
    bag = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    e = np.exp(e - np.maximum.reduceat(e, begin[:-1])[bag])
    a = e / np.add.reduceat(e, begin[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, begin[:-1])
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "bag": bag, "logit": z @ w["out"] + w["out_b"]}


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    f = _forward(w, x, begin)
    d = (1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) / len(y)
    dz = d[:, None] * w["out"]
    da = (dz[f["bag"]] * f["h"]).sum(1)
    de = f["a"] * (da - np.add.reduceat(f["a"] * da, begin[:-1])[f["bag"]])
    dt, dg = de[:, None] * w["mix"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["mix"] * f["t"] * f["g"] * (1 - f["g"])
    dh = f["a"][:, None] * dz[f["bag"]] + dt @ w["att"].T + dg @ w["gate"].T
    du = dh * (1 - f["h"] ** 2)
    grad = {"out": f["z"].T @ d, "out_b": np.array([d.sum()]), "mix": (f["t"] * f["g"]).T @ de, "att": f["h"].T @ dt, "gate": f["h"].T @ dg, "enc": x.T @ du, "enc_b": du.sum(0)}
    return {k: v + decay * w[k] for k, v in grad.items()}


def train(x: np.ndarray, begin: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.03, decay: float = 1e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the bags' cross entropy; the same input gives the same model."""
    shift, scale = x.mean(0), x.std(0) + 0.05
    x, rng = ((x - shift) / scale).astype("f4"), np.random.default_rng(seed)
    shape = {"enc": (x.shape[1], HIDDEN), "enc_b": (HIDDEN,), "att": (HIDDEN, HIDDEN), "gate": (HIDDEN, HIDDEN), "mix": (HIDDEN,), "out": (HIDDEN,), "out_b": (1,)}
    w = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("enc_b", "out_b") else np.zeros(s)).astype("f4") for k, s in shape.items()}
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    for i in range(1, steps + 1):
        for k, g in _gradients(w, x, begin, y, decay).items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - np.float32(rate * min(1, 2 * (1 - i / steps) + 0.05)) * (m[k] / (1 - 0.9 ** i)) / (np.sqrt(v[k] / (1 - 0.999 ** i)) + 1e-8)
    return Model(w, shift, scale)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """True for ids whose labels are never learned from; null ids count as held out."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, y`` of at most ``limit`` labelled ids outside the held-out third, picked by a hash of the id.

    Only ids and labels pass the driver; texts are dealt out by id. Of rows with one id the smallest text counts.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label].cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out())
    picked = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = texts(docs, id_col, text_col).join(F.broadcast(picked), "doc_id").repartition(SAMPLE_PARTS, "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def _features(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        strings = batch.column("text").to_pylist()
        for a, b in slices(strings):
            x, begin = encode(strings[a:b])
            bags = pa.array([x[i:j].tobytes() for i, j in zip(begin[:-1], begin[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), bags, batch.column("y").slice(a, b - a)], ["doc_id", "x", "y"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_BAGS) -> Model:
    rows = sample(docs, labels, label, limit).mapInArrow(_features, "doc_id long, x binary, y int").collect()
    bags, y, held = [], [], 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        bag = np.frombuffer(r.x, "f4").reshape(-1, N_FEATURES)
        if bags and held + len(bag) > MAX_PASSAGES:
            continue
        bags.append(bag)
        y.append(r.y)
        held += len(bag)
    if len(set(y)) < 2:
        return Model({}, np.zeros(0), np.zeros(0), float(np.mean(y)) if y else 1.0)
    return train(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])]), np.array(y, "f4"))


def scorer(model) -> Callable[[Column], Column]:
    """Column function from whole texts to scores between 0 and 1; ``model``: anything with ``score(list of texts)``."""

    def score(batches):
        for strings in batches:
            values = [s or "" for s in strings]
            parts = [np.asarray(model.score(values[a:b]), "f8") for a, b in slices(values)]
            yield pd.Series(np.concatenate(parts) if parts else np.empty(0))

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return pandas_udf(score, "double")


def judge(docs: DataFrame, model, threshold: float, **columns: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    scored = texts(docs, **columns).select("doc_id", scorer(model)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
