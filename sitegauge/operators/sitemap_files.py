"""Entries of stored sitemap files, plain or gzip, read in pieces.

A file is a row of Spark's binary reader. Its bytes are decompressed and cut into ``<url>`` and ``<sitemap>`` elements piece by
piece, so that what a task holds is the stored file, one piece and one element, not the decompressed text; entries leave in
batches. A gzip file may have several members. A file that breaks off gives the entries before the break and its error.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PIECE, BATCH = 1 << 18, 4096
SCHEMA = "file string, kind string, i long, loc string, lastmod string, error string"
_NOISE = re.compile(rb"<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", re.S)
_ROOT = re.compile(rb"<(?:\w+:)?(sitemapindex|urlset)\b", re.I)
_ELEMENT = re.compile(rb"<(?:[\w]+:)?(url|sitemap)(?:\s[^>]*)?>(.*?)</(?:[\w]+:)?\1\s*>", re.S)
_OPEN = re.compile(rb"<(?:[\w]+:)?(?:url|sitemap)(?:\s[^>]*)?>")
_EXTENSION = re.compile(rb"<(image|video|news|xhtml):.*?(?:</\1:\w+\s*>|/>)", re.S)
_VALUE = {name: re.compile(rb"<(?:\w+:)?" + name + rb"(?:\s[^>]*)?>(.*?)</(?:\w+:)?" + name + rb"\s*>", re.S) for name in (b"loc", b"lastmod")}


def pieces(content: memoryview) -> Iterator[bytes]:
    """The text of a file, piece by piece; members of a gzip file follow each other."""
    if bytes(content[:2]) != b"\x1f\x8b":
        for at in range(0, len(content), PIECE):
            yield bytes(content[at:at + PIECE])
        return
    at, member = 0, zlib.decompressobj(31)
    rest = b""
    while rest or at < len(content):
        if not rest:
            rest, at = bytes(content[at:at + PIECE]), at + PIECE
        if member.eof:  # what follows is the next member, or padding
            rest = rest.lstrip(b"\0")
            if not rest:
                continue
            member = zlib.decompressobj(31)
        text = member.decompress(rest, PIECE)
        rest = member.unused_data if member.eof else member.unconsumed_tail
        if text:
            yield text
    if not member.eof:
        yield member.flush()
        raise EOFError("the compressed file breaks off")


def _value(block: bytes, name: bytes) -> str | None:
    found = _VALUE[name].search(block)
    if not found:
        return None
    raw = found[1].replace(b"<![CDATA[", b"").replace(b"]]>", b"")
    return html.unescape(raw.decode("utf-8", "replace")).strip(" \t\n\r\0\x0b") or None


def entries(content: memoryview) -> Iterator[tuple[str, str, str | None]]:
    """``(kind, loc, lastmod)`` of each element with an address, in order; kind is ``index``, ``urlset`` or ``unknown``."""
    held, kind = b"", None
    for piece in pieces(content):
        held = _NOISE.sub(b"", held + piece)
        if kind is None:
            root = _ROOT.search(held)
            if not root:
                held = held[-4096:] if len(held) > 1 << 20 else held
                continue
            kind, held = ("index" if root[1].lower() == b"sitemapindex" else "urlset"), held[root.end():]
        end = 0
        for found in _ELEMENT.finditer(held):
            end = found.end()
            block = _EXTENSION.sub(b"", found[2])
            loc = _value(block, b"loc")
            if loc and (found[1] == b"sitemap") == (kind == "index"):
                yield kind, loc, _value(block, b"lastmod")
        held = held[end:]
        begun = _OPEN.search(held)
        if not begun and b"<!--" not in held:
            held = held[-256:]  # between elements: only the start of a tag matters


def read_entries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per entry of every file below ``path``; a broken file has one more row, with ``error`` and no address."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("kind", pa.string()), ("i", pa.int64()), ("loc", pa.string()), ("lastmod", pa.string()), ("error", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, i, kind = [], 0, "unknown"
                try:
                    for kind, loc, lastmod in entries(memoryview(content.as_buffer())):
                        rows.append({"file": name, "kind": kind, "i": i, "loc": loc, "lastmod": lastmod, "error": None})
                        i += 1
                        if len(rows) == BATCH:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                except (zlib.error, EOFError) as broken:
                    rows.append({"file": name, "kind": kind, "i": None, "loc": None, "lastmod": None, "error": str(broken)})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)
