"""Token ids of whole texts, exactly as the ``tokenizers`` library gives them, each distinct word encoded once.

Both vocabularies split a text at the change from a visible character to ASCII white space, whatever stands around
it, so a text's ids are the joined ids of its chunks: words, for the byte-level vocabulary with the one space before
them (texts with other runs of white space around spaces go through the library whole). Distinct chunks of a slice of texts are
encoded once. Plain ones (Latin letters, digits and marks) are cut, all together, into the vocabulary's own pieces, and distinct
pieces go to the library's BPE model together; every other chunk goes through the whole library tokenizer. Nothing is kept
from slice to slice, so memory follows the slice and the longest text; most words of a large corpus are rare.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

END = 2
_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PLAIN = f"^ ?[!-~{_LETTERS}]+(?:\n[!-~{_LETTERS}]+)*$"
#: Stands between strings that are handled together; no plain chunk holds it.
_SEPARATOR = "\0"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
#: Pieces of a plain chunk as the two vocabularies define them.
_WORD_PIECES = re.compile(f"{_SUFFIXES}|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9\0]+|\0")
_BYTE_PIECES = re.compile(f"{_SUFFIXES}| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\s{_LETTERS}0-9\0]+|\n|\0")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as itself where it is printable, the others as letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_WRITTEN = _byte_letters() | {0: "\n"}


def gather(pool: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``pool`` by number, one after the other, and their sizes; stretch i has ``sizes[i]`` ids and follows i - 1."""
    starts, each = np.cumsum(sizes) - sizes, sizes[numbers]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    kind = "i4" if total < 1 << 31 and len(pool) < 1 << 31 else "i8"
    at = np.repeat((starts[numbers] - ends + each).astype(kind), each)
    at += np.arange(total, dtype=kind)
    return pool[at], each


class ChunkEncoder:
    """``spaces``: whether white space belongs to the tokens (byte-level) or only separates them (word ends)."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids are packed as 16 bits")
        self.spaces = self.library.normalizer is None
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")

    def _ids(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the vocabulary's pieces and how many each has."""
        ids, sizes = [np.empty(0, "<u2")], [np.empty(0, "i8")]
        for a in range(0, len(pieces), 1 << 14):
            part = pieces[a:a + (1 << 14)]
            written = _SEPARATOR.join(part).encode().decode("latin-1").translate(_WRITTEN)
            done = self.model.encode_batch([written], add_special_tokens=False)[0]
            ids.append(np.array(done.ids, "<u2"))
            sizes.append(np.bincount(np.array(done.word_ids, "i8"), minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks, how many each has, and which chunks cannot be told from their text alone."""
        plain = pc.and_(pc.match_substring_regex(texts, _PLAIN), pc.invert(pc.match_substring(texts, "<|"))).to_numpy(zero_copy_only=False)
        sizes, numbers, open_ = np.zeros(len(texts), "i8"), np.empty(len(texts), "i8"), np.zeros(len(texts), bool)
        known = np.flatnonzero(plain)
        some = texts.take(pa.array(known))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), _SEPARATOR)[0].as_py() + _SEPARATOR * (len(some) > 0)
        find = _BYTE_PIECES.findall if self.spaces else _WORD_PIECES.findall
        found = pa.array(find(joined if self.spaces else joined.lower()), pa.string()).dictionary_encode()
        names, codes = found.dictionary.to_pylist(), found.indices.to_numpy()
        apart = names.index(_SEPARATOR) if names else -1
        names = ["a" if x == _SEPARATOR else x for x in names]  # its ids are not used
        ends = codes == apart
        ids, each = gather(*self._pieces(names), codes[~ends])
        sizes[known] = np.bincount(np.cumsum(ends)[~ends], each, len(known)).astype("i8")
        others = []
        for i in np.flatnonzero(~plain).tolist():
            s = texts[i].as_py()
            # white space at an end may belong to a run that goes on in the next chunk
            if self.spaces and s != "" and (_WIDE_SPACE.search(s) or s.lstrip(" ") != s.strip() or not s.strip()):
                open_[i] = True
            else:
                others.append((i, s))
        done = self._ids([s for _, s in others])
        rest = [i for i, _ in others]
        sizes[rest] = [len(x) for x in done]
        # plain chunks in their order, then the others: back into the order of the chunks
        order = np.concatenate([known, np.array(rest, "i8"), np.flatnonzero(open_)])
        numbers[order] = np.arange(len(order))
        pool = np.concatenate([ids, np.array([i for x in done for i in x], "<u2")])
        return *gather(pool, sizes[order], numbers), open_

    def encode_flat(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, as unsigned 16-bit integers, and where each text's ids begin (one more
        place than texts); ``end``: an id to put after each text."""
        if not texts:
            return np.empty(0, "<u2"), np.zeros(1, "i8")
        column = pa.array(texts, pa.string())
        lists = pc.split_pattern(column, " ") if self.spaces else pc.ascii_split_whitespace(column)
        bounds, flat = np.asarray(lists.offsets, "i8"), lists.flatten()
        if self.spaces:  # all but a text's first chunk begin with the space before them
            first = np.zeros(len(flat), bool)
            first[bounds[:-1]] = True
            flat = pc.binary_join_element_wise(pc.if_else(pa.array(first), "", " "), flat, "")
        coded = flat.dictionary_encode()
        ids, each, open_ = self._chunks(coded.dictionary)
        codes = coded.indices.to_numpy()
        ids, sizes = gather(ids, each, codes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        if open_.any():
            whole = np.diff(np.concatenate([[0], np.cumsum(open_[codes])])[bounds]) > 0
            parts = [np.array(self._ids([t])[0], "<u2") if w else ids[a:b] for t, w, a, b in zip(texts, whole.tolist(), ends[:-1].tolist(), ends[1:].tolist())]
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        if end is not None:
            out = np.empty(len(ids) + len(texts), "<u2")
            ends = ends + np.arange(len(ends))
            last = np.zeros(len(out), bool)
            last[ends[1:] - 1] = True
            out[last], out[~last] = end, ids
            ids = out
        return ids, ends

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 16-bit integers."""
        ids, ends = self.encode_flat(texts)
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One per Python worker and vocabulary file."""
    return ChunkEncoder(path)


def binary(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Ids of several texts as one binary value per text, without a copy of each."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((2 * ends).astype("<i8")), pa.py_buffer(ids)]).cast(pa.binary())


def slices(texts: list[str], chars: int = 1_000_000) -> list[tuple[int, int]]:
    """Consecutive index ranges of about ``chars`` characters, so that memory follows that and the longest text."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            out.append((start, i + 1))
            start, size = i + 1, 0
    return out + [(start, len(texts))] * (start < len(texts))
