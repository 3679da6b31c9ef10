"""License scans: conditional compression.

A text is cut into units (lines, and sentences within them).  A unit is
license-like if it holds a keyword or if most of its longer words are words of the
templates; a candidate block is a run of such units with a keyword in it.
The templates are notices, headers and openings of licenses (``TEMPLATES``)
and the terms of whole licenses (``license_texts``).  Templates of at least
``WHOLE_WORDS`` words are first looked for in the words of the whole text, then
all of them in the words of each run of what is left: places that share
enough words with a template, and places that overlap are one block.  Every
block is compressed by zstandard with each of the templates as raw
dictionary, and the templates are ranked by how much smaller than zstandard
alone they make it.  In this order a template's place in the block is a confirmed span if
the template makes it enough smaller and if its words, aligned with the
template's, agree; the words that differ are returned, and no word that tells
a license from others (its name, version or clause) may be among them.
Confirmed spans are cut out, and what is left is searched again until no template is
confirmed.  What then still is a candidate is returned as unconfirmed blocks of
at most ``BLOCK_UNITS`` units, with the template ranked first.

Texts are read whole, one document at a time; nothing is shuffled.

Defined results: null and empty texts have no blocks; null and repeated
doc_ids are scanned row by row; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm.common import batch_of, slices, table
from skyledger.llm.license_texts import TEXTS

#: Public wordings of licenses and of notices that name them.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more "
        "details.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more "
        "details.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more "
        "details.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Text without any of these has no candidate.
KEYWORDS = ("licen", "copyright", "permission", "redistribut", "warrant", "public domain", "spdx")
LIKE = 0.6
#: Shorter words say nothing about what a text is.
LONG = 5
#: Templates of so many words are searched in the whole text, not only in runs.
WHOLE_WORDS = 60
#: Of a block that is not confirmed.
BLOCK_UNITS = 80
#: A template makes the span at least so much smaller ...
LEAST_REDUCTION = 0.25
#: ... and shares at least so many of the words of either, with no difference that identifies().
LEAST_SHARED = 0.8
LEVEL = 9
_UNIT = re.compile(r"[^\n]+?(?:(?<=[.!?])(?=[ \t])|(?=\n)|\Z)")
_WORD = re.compile(r"\w+(?:[.\-/]\w+)*")
_CLOSING = re.compile(r"[^\w\s]*")
#: Words that tell one license from another wherever they stand ...
_CLAUSE = re.compile(r"advertising|\w+-clause|(?:.*-)?(?:noncommercial|sharealike|noderiv\w*)(?:-.*)?|v\d+(?:\.\d+)*|(?:cc-)?by-\w+(?:-.*)?|.*(?:licen[sc]es?|mpl)[/-].*")
#: ... and where a license is named: soon before the word license or a version, or behind "under".
_NAME = re.compile(r"(?:mit|isc|0?bsd|apache|gnu|[al]?gpl\w*|lesser|library|affero|mozilla|mpl\w*|creative|commons|cc\w*|by|nc|nd|sa|attribution|unlicense)(?:-.*)?")
_LICENSE = re.compile(r"licen[sc]e")
_VERSION = re.compile(r"\d+(?:\.\d+)*")
#: Soon behind a template that another license begins with, they make it that one.
_GOES_ON = ("neither", "advertising")
_BEFORE_VERSION = ("version", "v", "ver", "by")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _plain(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


def identifies(ws: list[str], i: int) -> bool:
    """Whether word ``i`` tells a license from others: its name, version or clause."""
    word, before, after = ws[i], ws[max(0, i - 2):i], ws[i + 1:i + 5]
    if _CLAUSE.fullmatch(word):
        return True
    if word == "by":  # an everyday word
        return before[-1:] == ["cc"]
    if _NAME.fullmatch(word):
        return "under" in before or any(_LICENSE.fullmatch(w) or _VERSION.fullmatch(w) for w in after)
    if _VERSION.fullmatch(word) and before:
        # A plain number behind "License." may count a section.
        return before[-1] in _BEFORE_VERSION or bool(_NAME.fullmatch(before[-1])) or "." in word and bool(_LICENSE.fullmatch(before[-1]))
    return False


def _judged(license: str, reduction: float, ws: list[str], own: list[str]) -> tuple[str, float, bool, float, list[str], list[str]]:
    """License, reduction, confirmed, shared words, missing and added words."""
    match = difflib.SequenceMatcher(None, ws, own, autojunk=False)
    shared = sum(m.size for m in match.get_matching_blocks()) / max(1, len(ws), len(own))
    missing, added, same = [], [], True
    for op, a, b, c, d in match.get_opcodes():
        if op != "equal":
            missing += ws[a:b]
            added += own[c:d]
            same = same and not any(identifies(ws, i) for i in range(a, b)) and not any(identifies(own, i) for i in range(c, d))
    return license, reduction, reduction >= LEAST_REDUCTION and shared >= LEAST_SHARED and same, shared, missing, added


def fitted(template: np.ndarray, own: np.ndarray) -> list[tuple[int, int, int]]:
    """``score, first, after`` of the best places of the whole template in
    ``own``, without overlap.

    A shared word counts 1; a missing, an added and a changed word -1.  A span
    that shares ``LEAST_SHARED`` of the longer side scores at least half its
    shared words, so none that could be confirmed is left out."""
    n = len(own)
    one, column = np.int64(1 << 32), np.arange(n + 1, dtype=np.int64)
    ahead = column * one
    best = column.copy()  # the score in the upper half, where the place starts in the lower
    for word in template:
        after = best - one
        np.maximum(after[1:], best[:-1] + np.where(own == word, one, -one), out=after[1:])
        best = np.maximum.accumulate(after + ahead) - ahead
    score, start = best >> 32, best & (one - 1)
    ends = np.flatnonzero((score >= LEAST_SHARED / 2 * len(template)) & (start < column))
    out, used = [], bytearray(n)
    for end in ends[np.argsort(-score[ends], kind="stable")].tolist():
        first = int(start[end])
        if not any(used[first:end]):
            used[first:end] = b"\1" * (end - first)
            out.append((int(score[end]), first, end))
    return out


def overlapping(places: list[tuple]) -> Iterator[list[tuple]]:
    """``places (first, after, ...)`` in groups that overlap."""
    group, end = [], -1
    for place in sorted(places):
        if place[0] >= end and group:
            yield group
            group = []
        group.append(place)
        end = max(end, place[1]) if len(group) > 1 else place[1]
    if group:
        yield group


class Templates:
    def __init__(self):
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_dict_id=False, write_checksum=False)
        self.alone = zstandard.ZstdCompressor(compression_params=params)
        self.each = []
        for license, texts in TEMPLATES.items():
            for text in texts:
                self._add(license, text, params)
        self.vocabulary = {w for _, ws, _ in self.each for w in ws}
        for license, text in TEXTS.items():
            self._add(license, text, params)
        self.whole = [k for k, (_, ws, _) in enumerate(self.each) if len(ws) >= WHOLE_WORDS]
        self.number = {w: i for i, w in enumerate(sorted({w for _, ws, _ in self.each for w in ws}))}
        self.coded = [np.array([self.number[w] for w in ws], np.int64) for _, ws, _ in self.each]
        self.opening = [any(other != license and more[:len(ws)] == ws for other, more, _ in self.each) for license, ws, _ in self.each]
        self.counted = [np.unique(ids, return_counts=True) for ids in self.coded]

    def _add(self, license: str, text: str, params) -> None:
        raw = zstandard.ZstdCompressionDict(_plain(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(compression_params=params)
        self.each.append((license, words(text), zstandard.ZstdCompressor(dict_data=raw, compression_params=params)))

    def runs(self, text: str) -> Iterator[list[re.Match]]:
        """Units of each run of adjacent license-like units with a keyword."""
        low = text.lower()
        if not any(k in low for k in KEYWORDS):
            return
        run, between, named = [], [], False
        for unit in (*_UNIT.finditer(text), None):
            like = key = open_ = False
            if unit is not None:
                here = unit[0].lower()
                key = any(k in here for k in KEYWORDS)
                ws = [w for w in words(here) if len(w) >= LONG]
                known = sum(w in self.vocabulary for w in ws)
                like = key or len(ws) > 2 and known >= LIKE * len(ws)
                open_ = not like and known == len(ws) <= 2  # a number, a short clause: may stand between
            if run and (like or open_):
                if like:
                    run += [*between, unit]
                    between, named = [], named or key
                else:
                    between.append(unit)
                continue
            if named:
                yield run
            run, between, named = ([unit], [], key) if like else ([], [], False)

    def blocks(self, text: str) -> Iterator[tuple[int, int]]:
        """The runs in pieces of at most ``BLOCK_UNITS`` units: their first and last character."""
        for run in self.runs(text):
            for at in range(0, len(run), BLOCK_UNITS):
                piece = run[at:at + BLOCK_UNITS]
                yield piece[0].start() + len(piece[0][0]) - len(piece[0][0].lstrip()), piece[-1].end()

    def spans(self, text: str) -> list[tuple]:
        """``start, end`` and the judgement of each confirmed span, and of each
        block of what is left of the runs."""
        low = text.lower()
        if not any(k in low for k in KEYWORDS):
            return []
        out = self.confirmed(text, "", self.whole)
        for a, b in zip([0, *(x[1] for x in out)], [*(x[0] for x in out), len(text)]):
            out += [(a + c, a + d, *rest) for c, d, *rest in self.in_runs(text[a:b], text[b:b + 100])]
        return sorted(out, key=lambda x: x[:2])

    def in_runs(self, text: str, after: str) -> Iterator[tuple]:
        for run in self.runs(text):
            start, end = run[0].start(), run[-1].end()
            behind = text[end:end + 100] + after
            found = [(start + a, start + b, *rest) for a, b, *rest in self.confirmed(text[start:end], behind, range(len(self.each)))]
            yield from found
            for a, b in zip([start, *(x[1] for x in found)], [*(x[0] for x in found), end]):
                for c, d in self.blocks(text[a:b]):
                    yield a + c, a + d, *self.judge(text[a + c:a + d], text[a + d:a + d + 100] + after)

    def confirmed(self, text: str, after: str, among: Iterable[int]) -> list[tuple]:
        """Confirmed spans of ``text`` without overlap, in order, by the templates
        ``among``; ``after`` is the beginning of what follows it.  What lies between them is
        searched again until no template is confirmed."""
        at = [m.span() for m in _WORD.finditer(text)]
        own = [text[a:b].lower() for a, b in at]
        ids = np.array([self.number.get(w, -1) for w in own], np.int64)
        following = [*own, *words(after)[:4]]
        out, left, seen, ranks = [], [(0, len(own))], {}, {}
        while left:
            first, last = left.pop()
            some = ids[first:last]
            there = np.bincount(some[some >= 0], minlength=len(self.number))
            fits = []
            for k in among:
                which, often = self.counted[k]
                # A confirmed span has so many of the template's words; most templates end here.
                if np.minimum(there[which], often).sum() >= LEAST_SHARED * len(self.coded[k]):
                    fits += [(first + a, first + b, k, score) for score, a, b in fitted(self.coded[k], some)]
            taken, used = [], bytearray(last - first)
            for places in overlapping(fits):
                block = text[at[min(a for a, *_ in places)][0]:at[max(b for _, b, *_ in places) - 1][1]]
                if block not in ranks:
                    ranks[block] = {k: -reduction for reduction, _, k in self.ranked(block)}
                rank = ranks[block]
                for a, b, k, _ in sorted(places, key=lambda x: (rank[x[2]], -x[3], x[2], x[0])):
                    if any(used[a - first:b - first]):
                        continue
                    start, end = at[a][0], _CLOSING.match(text, at[b - 1][1]).end()
                    if self.goes_on(k, following[b:b + 4]):
                        continue
                    key = k, text[start:end]
                    if key not in seen:
                        seen[key] = self.compared(k, own[a:b], key[1])
                    if seen[key][2]:
                        used[a - first:b - first] = b"\1" * (b - a)
                        taken.append((a, b))
                        out.append((start, end, *seen[key]))
            if taken:
                taken.sort()
                left += [(a, b) for a, b in zip([first, *(b for _, b in taken)], [*(a for a, _ in taken), last]) if a < b]
        return sorted(out, key=lambda x: x[:2])

    def goes_on(self, k: int, following: list[str]) -> bool:
        """Whether the words behind template ``k`` make it another license."""
        return self.opening[k] and any(w in _GOES_ON for w in following)

    def compared(self, k: int, own: list[str], span: str) -> tuple[str, float, bool, float, list[str], list[str]]:
        """The judgement of a span by one template."""
        license, ws, compressor = self.each[k]
        data = _plain(span)
        return _judged(license, 1 - len(compressor.compress(data)) / len(self.alone.compress(data)), ws, own)

    def ranked(self, block: str) -> list[tuple[float, str, int]]:
        """Size reduction, license and number of each template, best first."""
        data = _plain(block)
        plain = len(self.alone.compress(data))
        out = [(1 - len(c.compress(data)) / plain, license, k) for k, (license, _, c) in enumerate(self.each)]
        return sorted(out, key=lambda x: (-x[0], x[1], len(self.each[x[2]][1])))

    def judge(self, block: str, after: str = "") -> tuple[str, float, bool, float, list[str], list[str]]:
        """License, reduction, confirmed, shared words, missing and added words."""
        own, ranked, following = words(block), self.ranked(block), words(after)[:4]
        first = best = None
        for reduction, license, k in ranked:
            if first is not None and reduction < LEAST_REDUCTION:
                break
            ws = self.each[k][1]
            if first is not None and min(len(ws), len(own)) < LEAST_SHARED * max(len(ws), len(own)):
                continue  # could not be confirmed, whatever the words
            found = _judged(license, reduction, ws, own)
            if found[2] and self.goes_on(k, following):
                found = *found[:2], False, *found[3:]
            if found[2] and (best is None or len(found[4]) + len(found[5]) < len(best[4]) + len(best[5])):
                best = found
            first = first or found
        return best or first


@lru_cache(maxsize=1)
def templates() -> Templates:
    return Templates()


def scan(docs: DataFrame) -> DataFrame:
    """One row per confirmed span and per block of what is left: ``doc_id, block, start, end, license,
    reduction, confirmed, shared, missing, added``."""
    schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()),
                        ("reduction", pa.float64()), ("confirmed", pa.bool_()), ("shared", pa.float64()),
                        ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])

    def run(batches):
        known = templates()
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for i, span in enumerate(known.spans(text or "")):
                    rows.append((doc_id, i, *span))
            if rows:
                yield batch_of(schema, list(zip(*rows)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, block long, start long, end long, license string, reduction double, confirmed boolean, "
             "shared double, missing array<string>, added array<string>")


def op10_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License scan of every text of ``documents``."""
    return scan(table(spark, sf_dir, "documents"))
