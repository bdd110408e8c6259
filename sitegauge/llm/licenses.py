"""Licence recognition by sentence rules.

A text is cut into stretches at full stops, colons and semicolons; each is normalised (lower case; letters, digits and inner
points or hyphens only; single spaces) and looked up in a table of known licence sentences, which are cut alike. The identifiers found, in order of their place, are matched
against ordered rules: a rule holds where all its identifiers occur in order with at most ``gap`` other known sentences
between two of them. Longer rules are tried first and an occurrence is used by one rule only.

Variable parts are read as placeholders: the organisation in the BSD endorsement sentence. Short notices ("Distributed under
the MIT license", "licensed under GPL v2 or later") and SPDX tags are found by templates wherever they stand; a place inside
a sentence or notice already used is not reported again. A notice that names a family without a version gets no number.

Line ends may fall inside a sentence (wrapped licence texts) or end one (headings, lists), so a text is cut in both ways;
a place that both find counts once. Work is one narrow pass: nothing is shuffled and only the fixed tables are shipped.

Defined results: null and empty texts have no licence; every occurrence in a text gives a row; rows with a null id keep
it; repeated rows are scanned each; an empty table gives no rows; all other input columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from sitegauge.llm.common import texts

#: Sentences of public licence texts and the notices by which works refer to them.
SENTENCES = {
    "mit-short": "Released under the MIT License.",
    "mit-short-2": "Licensed under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:"),
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-unless": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "gpl-hope": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
        "in the documentation and/or other materials provided with the distribution."),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission."),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."),
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "gpl2-free": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    "lgpl21-free": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    "lgpl3-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "agpl3-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl2-terms": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
        "available at https://www.eclipse.org/legal/epl-2.0."),
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions:"),
    "bsl-grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying "
        "documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the "
        "Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do "
        "so, all subject to the following:"),
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


@dataclass(frozen=True)
class Rule:
    license: str
    sequence: tuple[str, ...]
    gap: int = 2


RULES = [
    Rule("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    Rule("MIT", ("mit-short",)),
    Rule("MIT", ("mit-short-2",)),
    Rule("Apache-2.0", ("apache-header", "apache-comply", "apache-unless", "apache-see")),
    Rule("Apache-2.0", ("apache-header", "apache-comply")),
    Rule("Apache-2.0", ("apache-short",)),
    Rule("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    Rule("GPL-3.0-or-later", ("gpl-free",)),
    Rule("GPL-3.0-only", ("gpl3-short",)),
    Rule("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    Rule("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("ISC", ("isc-grant",)),
    Rule("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    Rule("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    Rule("CC-BY-4.0", ("cc-by-short",)),
    Rule("CC-BY-4.0", ("cc-by-long",)),
    Rule("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    Rule("GPL-2.0-or-later", ("gpl2-free",)),
    Rule("LGPL-2.1-or-later", ("lgpl21-free",)),
    Rule("LGPL-3.0-or-later", ("lgpl3-free",)),
    Rule("AGPL-3.0-or-later", ("agpl3-free",)),
    Rule("MPL-2.0", ("mpl2-form",)),
    Rule("EPL-2.0", ("epl2-terms",)),
    Rule("Unlicense", ("unlicense-free",)),
    Rule("Zlib", ("zlib-as-is", "zlib-grant")),
    Rule("Zlib", ("zlib-grant",)),
    Rule("BSL-1.0", ("bsl-grant",)),
]
#: Names in short notices: pattern, identifier for a version (``{}``) and for none; GNU names end in -only or -or-later.
NAMES = [
    (r"(?:the\s+)?(?:GNU\s+)?(?:AGPL|Affero\s+(?:GPL|General\s+Public\s+Licen[cs]e))|(?:the\s+)?GNU\s+AGPL", "AGPL-{}", "AGPL"),
    (r"(?:the\s+)?(?:GNU\s+)?(?:LGPL|(?:Lesser|Library)\s+(?:GPL|General\s+Public\s+Licen[cs]e))", "LGPL-{}", "LGPL"),
    (r"(?:the\s+)?(?:GNU\s+)?(?:GPL|General\s+Public\s+Licen[cs]e)", "GPL-{}", "GPL"),
    (r"(?:the\s+)?Apache(?:\s+Software)?", "Apache-{}", "Apache"),
    (r"(?:the\s+)?(?:MPL|Mozilla\s+Public)", "MPL-{}", "MPL"),
    (r"(?:the\s+)?(?:EPL|Eclipse\s+Public)", "EPL-{}", "EPL"),
    (r"(?:the\s+)?(?:BSL|Boost\s+Software)", "BSL-{}", "BSL"),
    (r"(?:an?\s+|the\s+)?(?:Creative\s+Commons|CC)[\s-]+(?:Zero|0)|(?:the\s+)?CC0", "CC0-{}", "CC0"),
    (r"(?:an?\s+|the\s+)?(?:CC[\s-]+BY|Creative\s+Commons\s+Attribution)(?P<nc>[\s-]+(?:NC|Non-?Commercial))?(?P<sa>[\s-]+(?:SA|Share-?Alike))?(?P<nd>[\s-]+(?:ND|No-?Derivatives|NoDerivs))?", "CC-BY-{}", "CC-BY"),
    (r"(?:an?\s+|the\s+)?(?P<bsd>[0234])[\s-]*clause[\s-]+BSD|(?:an?\s+|the\s+)?BSD[\s-]*(?P<bsd2>[0234])[\s-]*clause", "BSD", "BSD"),
    (r"(?:an?\s+|the\s+)?MIT", "MIT", "MIT"),
    (r"(?:an?\s+|the\s+)?ISC", "ISC", "ISC"),
    (r"(?:the\s+)?zlib", "Zlib", "Zlib"),
    (r"(?:the\s+)?Unlicense", "Unlicense", "Unlicense"),
    (r"(?:an?\s+|the\s+)?BSD", "BSD", "BSD"),
]
SCHEMA = "doc_id long, license string, rule string, start long, end long, n_sentences long"

_WRAPPED = re.compile(r"(?:[^.;:!?\n]|\n(?!\s*\n)|[.;:!?](?![\s\"')\]]|\Z))++(?:[.;:!?]++|\Z|\n)")
_ONE_LINE = re.compile(r"(?:[^.;:!?\n]|[.;:!?](?![\s\"')\]]|\Z))++(?:[.;:!?]++|\Z|\n)")
_LEAD = re.compile(r"\b(?:licen[cs]ed|released|distributed|available|published|provided|covered|redistributed)\s+under\s+(?:the\s+terms\s+of\s+)?|\blicen[cs]e\s*:\s*", re.I)
_NAME = [(re.compile(f"(?:{name})(?!v(?!\\.?\\s?\\d)|[a-uw-z_])", re.I), with_, without) for name, with_, without in NAMES]
_VERSION = re.compile(r"(?:[\s,]*\(?(?:public\s+)?licen[cs]e\)?)?(?:[\s,(-]*(?:version|v\.?)\s*|[ -]?)(\d(?:\.\d){0,2})(?![\w%])\)?", re.I)
#: What follows a name without a version: the word licence, or the end of the phrase.
_TAIL = re.compile(r"\s+(?:public\s+)?licen[cs]es?\b|(?=\s*(?:[.,;:)\n]|\Z|(?:and|or)\b))", re.I)
_LATER = re.compile(r"\+|[\s,(]*(?:or|and)\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?(?:later|newer)", re.I)
_NUMBER = re.compile(r"^\d$")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]*[A-Za-z0-9.+)])")
_SPDX_ID = re.compile(r"[A-Za-z0-9.+-]+")
#: The organisation of this sentence may hold full stops, so it is searched for as a whole.
_ENDORSE = re.compile(r"\bneither\s+the\s+names?\s+of\b.{1,300}?\bnor\b.{1,40}?\bcontributors\b.{1,20}?\bmay\b.{1,20}?\bbe\b.{1,20}?\bused\b.{1,200}?\bpermission\.", re.I | re.S)
_OTHER = re.compile(r"[^\w.\-]+|[.\-]+(?!\w)|(?<!\w)[.\-]+|_")


def normalise(sentence: str) -> str:
    return " ".join(_OTHER.sub(" ", sentence.lower()).split())


def notices(text: str) -> list[tuple[int, int, str, str]]:
    """Short notices and SPDX tags ``(start, end, licence, kind)`` of a text in order; each licence of a tag is one."""
    found = []
    for lead in _LEAD.finditer(text):
        for pattern, with_, without in _NAME:
            if not (m := pattern.match(text, lead.end())):
                continue
            end, g = m.end(), m.groupdict()
            kind = [k.upper() for k in ("nc", "sa", "nd") if g.get(k)]
            number = g.get("bsd") or g.get("bsd2")
            name = f"BSD-{number}-Clause" if number else "-".join([without, *kind])
            if "{}" in with_ and (v := _VERSION.match(text, end)):
                end = v.end()
                number = v[1] + ".0" if _NUMBER.match(v[1]) else v[1]
                name = with_.format("-".join([*kind, number]))
                if "GPL" in name:
                    later = _LATER.match(text, end)
                    end, name = (later.end(), name + "-or-later") if later else (end, name + "-only")
            elif not (tail := _TAIL.match(text, end)):
                break
            else:
                end = tail.end()
            found.append((lead.start(), end, name, "notice"))
            break
    if "SPDX-" in text:
        for tag in _SPDX.finditer(text):
            skip = False
            for m in _SPDX_ID.finditer(text, tag.start(1), tag.end(1)):
                # the word after WITH names an exception, not a licence
                if m[0] not in ("AND", "OR", "WITH") and not skip:
                    found.append((m.start(), m.end(), m[0], "spdx"))
                skip = m[0] == "WITH"
    return sorted(found)


def _spans(text: str, pattern: re.Pattern):
    """``(start, end, text)`` of the stretches that a pattern cuts, without bullets and white space before them."""
    for m in pattern.finditer(text):
        lead = m[0].lstrip(" \t\n\r*#/;-\"'(0123456789.)")
        if lead and not lead.isspace():
            yield m.end() - len(lead), m.end() - (len(lead) - len(lead.rstrip())), lead


def _first_word(sentence: str) -> str:
    return sentence.split(" ", 1)[0]


def sentence_table(known: dict[str, str]) -> dict[str, list[tuple[tuple[str, ...], str]]]:
    """Known sentences by their first stretch: all stretches, as colons and semicolons cut a sentence, and the identifier."""
    table: dict[str, list[tuple[tuple[str, ...], str]]] = {}
    for name, sentence in known.items():
        parts = tuple(normalise(x) for _, _, x in _spans(sentence, _WRAPPED))
        table.setdefault(parts[0], []).append((parts, name))
    return table


def first_words(table: dict[str, list[tuple[tuple[str, ...], str]]]) -> set[str]:
    return {_first_word(part) for known in table.values() for parts, _ in known for part in parts}


def sentences(text: str, table: dict[str, list[tuple[tuple[str, ...], str]]], words: set[str]) -> list[tuple[int, int, str]]:
    """Known sentences ``(start, end, identifier)`` of a text in order; ``words``: :func:`first_words` of the table."""
    found = set()
    for pattern in (_ONE_LINE, _WRAPPED):
        # the first normalised word spares most stretches the rest; no known one is 60 characters long
        each = [(a, b, normalise(x) if _first_word(normalise(x[:64])) in words else None) for a, b, x in _spans(text, pattern)]
        for i, (start, _, part) in enumerate(each):
            for parts, name in table.get(part, ()) if part else ():
                if [x[2] for x in each[i:i + len(parts)]] == list(parts):
                    found.add((start, each[i + len(parts) - 1][1], name))
    if any(name == "bsd-endorse" for known in table.values() for _, name in known):
        found |= {(*m.span(), "bsd-endorse") for m in _ENDORSE.finditer(text)}
    return sorted(found)


def match(found: list[tuple[int, int, str]], rules: list[Rule]) -> list[tuple[Rule, int, int]]:
    """Rules that hold, with the character span from the first to the last sentence used."""
    used, out = set(), []
    for rule in sorted(rules, key=lambda r: -len(r.sequence)):
        for i, (start, _, name) in enumerate(found):
            if name != rule.sequence[0] or i in used:
                continue
            places = [i]
            for wanted in rule.sequence[1:]:
                at = next((j for j in range(places[-1] + 1, min(len(found), places[-1] + rule.gap + 2)) if found[j][2] == wanted and j not in used), None)
                if at is None:
                    break
                places.append(at)
            if len(places) == len(rule.sequence):
                used.update(places)
                out.append((rule, start, found[places[-1]][1]))
    return sorted(out, key=lambda x: (x[1], x[2]))


def _scan(batches: Iterator[pa.RecordBatch], table: dict, rules: list[Rule]):
    words = first_words(table)
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            held = match(sentences(text, table, words), rules)
            rows += [(doc, r.license, "+".join(r.sequence), a, b, len(r.sequence)) for r, a, b in held]
            rows += [(doc, name, kind, a, b, 1) for a, b, name, kind in notices(text) if not any(x < b and a < y for _, x, y in held)]
        if rows:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "license", "rule", "start", "end", "n_sentences"])


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: list[Rule] | None = None, **columns: str) -> DataFrame:
    """One row per licence occurrence: licence, rule, character span and number of sentences."""
    known, rules = known or SENTENCES, rules or RULES
    table = sentence_table(known)
    return texts(docs, **columns).mapInArrow(lambda it: _scan(it, table, rules), SCHEMA)
