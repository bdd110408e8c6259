"""Hashes of words and word n-grams of many texts at once, in numpy.

Words are runs of anything but ASCII white space, ASCII letters lower-cased. A word's hash is a polynomial over random
byte values modulo 2**64, then mixed; an n-gram's hash is a polynomial over its words' hashes, mixed again.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=8).digest(), "little") | 1 for b in range(256)], "u8")
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8, so that differences of its powers keep many odd factors
_GRAM = np.uint64(0xD6E8FEB86659FD93)
PIECE = 1 << 19


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    def run(b: int) -> np.ndarray:
        out = np.full(n, b, "u8")
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    change = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = change[::2], change[1::2]
    power, inverse = _powers(max(PIECE + 1, 1 << int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, "u8")
    np.cumsum(_VALUES[data] * power[:len(data)], out=total[1:])
    raw = (total[end] - total[start]) * inverse[start]
    return start, mix(raw + (end - start).astype("u8") * np.uint64(_BASE))


def word_hashes(texts: list[str], drop: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and where each text's words begin (one entry more than texts); ``drop``: bytes to leave out."""
    parts = [t.encode().lower() for t in texts]
    if drop:
        parts = [p.translate(None, drop) for p in parts]
    data = np.frombuffer(b" ".join(parts) + b" ", "u1") if parts else np.empty(0, "u1")
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])
    starts, hashes, at = [np.empty(0, "i8")], [np.empty(0, "u8")], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            inside = np.flatnonzero(_SPACE[data[at:end]])
            if len(inside):
                end = at + int(inside[-1]) + 1
            else:  # a word longer than a piece
                more = np.flatnonzero(_SPACE[data[end:]])
                end += int(more[0]) + 1
        s, h = _piece(data[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(starts, begin)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on (``len(words) - n + 1`` of them)."""
    if len(words) < n:
        return np.empty(0, "u8")
    total = np.zeros(len(words) - n + 1, "u8")
    for k in range(n):
        total = total * _GRAM + words[k:len(words) - n + 1 + k]
    return mix(total + np.uint64(n))


def gram_sets(texts: list[str], n: int, drop: bytes = b"") -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; fewer than n words make one gram of them all, no word makes none."""
    words, at = word_hashes(texts, drop)
    grams, out = gram_hashes(words, n), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        out.append(np.unique(grams[a:b - n + 1] if b - a >= n else gram_hashes(words[a:b], b - a)) if b > a else np.empty(0, "u8"))
    return out
