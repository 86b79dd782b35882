"""License scans by conditional compression, confirmed by exact wording differences."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from difflib import SequenceMatcher
from functools import cache, lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from corpusreview.llm import common

#: A statement of a license must match word for word; of a long text this share of words may differ.
STATEMENT_WORDS = 20
TOLERANCE = 0.1
#: Blocks of up to so many characters are remembered, so many of them at most.
REMEMBERED_CHARS = 2000
REMEMBERED = 10_000
#: Sentences without a cue join a block if this share of their words occurs in the templates.
FAMILIAR = 0.7

# Names and texts of licenses.
NAMES = {
    "MIT": ["MIT License", "MIT license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL v2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL v3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL v3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "ISC": ["ISC License"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
FORMS = [
    "Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.",
    "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
]
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS
IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This
program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received
a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY
THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the
copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
}
#: Every template has one of these words, so a text without any holds no license.
CUE = r"licen[cs]e|copyright|warrant|redistribut|permission|public domain|(?:released|distributed)[^a-z0-9]+under|spdx"
# end of fixed values

_CUE = re.compile(CUE, re.I)
_UNIT = re.compile(r"[^\n]*?[.!?;](?=\s|$)|[^\n]+")
_WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    compressor: zstandard.ZstdCompressor


def _spaced(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(text.translate(_FOLD))]


#: A-Z to lower case one by one, so that places in the text stay the same.
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@cache
def templates() -> list[Template]:
    """All texts and the statements made of names and forms, each with its words and a compressor that knows it."""
    texts = [(license, text) for license, text in TEXTS.items()]
    texts += [(license, form.format(name)) for license, names in NAMES.items() for name in names for form in FORMS]
    texts += [(license, f"SPDX-License-Identifier: {license}") for license in NAMES]
    made: dict[tuple[str, ...], Template] = {}
    for license, text in texts:
        words = tuple(w for w, _, _ in _spaced(text))
        known = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.setdefault(words, Template(license, words, zstandard.ZstdCompressor(level=19, dict_data=known)))
    return list(made.values())


@cache
def _familiar() -> frozenset[str]:
    return frozenset(w for t in templates() for w in t.words)


@cache
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=19)


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring sentences or lines that sound like a license and hold at least one cue, as code point spans."""
    run: list[tuple[int, int]] = []
    cued = False
    # a cue may run over the end of a line, so cues are looked for in the whole text
    cues = [m.span() for m in _CUE.finditer(text)]
    at = 0
    for unit in _UNIT.finditer(text):
        while at < len(cues) and cues[at][1] <= unit.start():
            at += 1
        found = at < len(cues) and cues[at][0] < unit.end()
        if not found:
            own = [w for w, _, _ in _spaced(unit[0])]
            like = bool(own) and sum(w in _familiar() for w in own) >= FAMILIAR * len(own)
        if found or like:
            run.append(unit.span())
            cued = cued or found
            continue
        if not unit[0].strip():
            continue
        if cued:
            yield run[0][0], run[-1][1]
        run, cued = [], False
    if cued:
        yield run[0][0], run[-1][1]


@dataclass(frozen=True)
class Finding:
    start: int
    end: int
    license: str
    saved: float
    edits: int
    missing: str
    added: str


def difference(template: tuple[str, ...], matcher: SequenceMatcher) -> tuple[int, int, list[str], list[str]]:
    """First and last (excluded) matched word, the template's words that are missing and the words added in between.

    ``matcher`` has the searched words as its second sequence, which it indexes once for all templates.
    """
    words = matcher.b
    matcher.set_seq1(template)
    # the longest run of equal words anchors the match, so that stray words far away do not stretch it
    anchor = matcher.find_longest_match()
    low, high = max(0, anchor.b - 2 * len(template)), min(len(words), anchor.b + 2 * len(template))
    matches = [m for m in SequenceMatcher(None, template, words[low:high], autojunk=False).get_matching_blocks() if m.size]
    if not matches:
        return 0, 0, list(template), []
    first, last = matches[0].b, matches[-1].b + matches[-1].size
    held = {i for m in matches for i in range(m.a, m.a + m.size)}
    used = {i for m in matches for i in range(m.b, m.b + m.size)}
    missing = [w for i, w in enumerate(template) if i not in held]
    return low + first, low + last, missing, [words[low + i] for i in range(first, last) if i not in used]


@cache
def _by_first() -> dict[str, list[int]]:
    """The statements by their first word."""
    found: dict[str, list[int]] = {}
    for i, template in enumerate(templates()):
        if len(template.words) <= STATEMENT_WORDS:
            found.setdefault(template.words[0], []).append(i)
    return found


def ranked(words: list[str]) -> list[tuple[float, int]]:
    """The share of the compressed size that each template saves as a dictionary, the largest first."""
    data = " ".join(words).encode()
    plain = len(_plain().compress(data))
    return sorted(((1 - len(t.compressor.compress(data)) / plain, i) for i, t in enumerate(templates())), key=lambda x: (-x[0], x[1]))


def statements(words: list[tuple[str, int, int]], saved: dict[int, float]) -> list[Finding]:
    """All statements that occur word for word, in one pass; where they overlap the longest counts, then by license and place."""
    plain = [w for w, _, _ in words]
    hits = []
    for at, word in enumerate(plain):
        for i in _by_first().get(word, ()):
            template = templates()[i]
            if tuple(plain[at : at + len(template.words)]) == template.words:
                hits.append((-len(template.words), template.license, at, i))
    used = bytearray(len(words))
    found = []
    for size, license, at, i in sorted(hits):
        if not any(used[at : at - size]):
            used[at : at - size] = b"\x01" * -size
            found.append(Finding(words[at][1], words[at - size - 1][2], license, saved[i], 0, "", ""))
    return found


def _identified(block: str) -> tuple[Finding, ...]:
    spans = [(0, len(block))]
    found = []
    while spans:
        start, end = spans.pop()
        words = [(w, start + a, start + b) for w, a, b in _spaced(block[start:end])]
        if not words or not _CUE.search(block, start, end):
            continue
        plain = [w for w, _, _ in words]
        order = ranked(plain)
        matcher = SequenceMatcher(None, (), plain, autojunk=False)
        best = None
        for saved, i in order:
            template = templates()[i]
            if len(template.words) <= STATEMENT_WORDS:
                continue  # all of these in one pass, where no text is found
            low, high, missing, added = difference(template.words, matcher)
            edits = len(missing) + len(added)
            rank = (edits - len(template.words), edits, template.license)
            if edits <= TOLERANCE * len(template.words) and (best is None or rank < best[0]):
                finding = Finding(words[low][1], words[high - 1][2], template.license, saved, edits, " ".join(missing), " ".join(added))
                best = rank, low, high, finding
        if best is None:
            found += statements(words, {i: share for share, i in order})
            continue
        _, low, high, finding = best
        found.append(finding)
        spans += [(start, words[low][1]), (words[high - 1][2], end)]
    return tuple(found)


_remembered = lru_cache(maxsize=REMEMBERED)(_identified)


def identify(block: str) -> tuple[Finding, ...]:
    """The licenses of one block: long texts first, each cut out before what is left is searched, then all statements at once."""
    return _remembered(block) if len(block) <= REMEMBERED_CHARS else _identified(block)


def scan(text: str) -> list[Finding]:
    """All findings in a text, in order."""
    found = [replace(f, start=start + f.start, end=start + f.end) for start, end in blocks(text) for f in identify(text[start:end])]
    return sorted(found, key=lambda f: f.start)


_SCHEMA = "doc_id bigint, start bigint, end bigint, license string, saved double, edits bigint, missing string, added string"


def find_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id, start, end, license, saved, edits, missing, added``: one row per license found in a document.

    Sentences and lines with a cue, and license-like ones around them, form candidate blocks.  A block is compressed alone and
    with every template as a raw dictionary, which ranks them by their savings; the ranking orders the work but never ends it.
    All long texts are compared word by word: a tenth of the words may differ, and the one that explains most words is the
    finding, cut out before the rest is compressed and searched in the same way; statements match exactly, all in one pass.
    ``saved`` is the share of the compressed size that the template saves in what was searched, ``start`` and ``end`` are code
    point places, ``missing`` and ``added`` the differing words.  Whole texts are scanned, however long, and nothing is
    shuffled.  Null and empty texts give no rows; repeated rows give repeated findings.  Other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in common.text_chunks(batches):
            texts = common.plain_texts(piece.column("text"))
            cued = pc.match_substring_regex(texts, CUE, ignore_case=True)
            found = [
                (doc_id, f) for doc_id, text in zip(piece.column("doc_id").filter(cued).to_pylist(), texts.filter(cued).to_pylist()) for f in scan(text)
            ]
            if found:
                columns = {"doc_id": pa.array([d for d, _ in found], pa.int64())}
                for name in ("start", "end", "license", "saved", "edits", "missing", "added"):
                    columns[name] = pa.array([getattr(f, name) for _, f in found])
                yield pa.record_batch(columns)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(common.table(spark, sf_dir, "documents"))

