"""License scans: winnowed fingerprints pick candidates, banded alignment measures them."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import mapped, slices

#: Names and wordings of widespread license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
        "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."
    ),
    "isc-disclaimer": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "bsd-disclaimer": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."
    ),
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version. This library is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Affero General Public License for more details."
    ),
    "epl-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law."
    ),
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
#: A table of templates may hold up to so many.
MAX_TEMPLATES = 10_000
#: Words of a fingerprint, fingerprints of a window; a shared run of
#: GRAM + WINDOW - 1 words always meets in the index.
GRAM, WINDOW = 3, 3
MIN_COVERAGE = 0.6
MATCH, MISS, GAP = 2, -1, -1
_WORD = re.compile(r"[^\W_]+(?:[.\-/][^\W_]+)*")


class Index:
    """Winnowed fingerprints of the templates: gram -> (template, place)."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        listed = [[w.lower() for w in _WORD.findall(t)] for t in templates.values()]
        self.vocabulary: dict[str, int] = defaultdict(lambda: -1)
        for words in listed:
            for word in words:
                if word not in self.vocabulary:
                    self.vocabulary[word] = len(self.vocabulary)
        self.vocabulary = _Known(self.vocabulary)
        self.words = [np.array([self.vocabulary[w] for w in words], np.int64) for words in listed]
        self.size = len(self.vocabulary)
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for number, ids in enumerate(self.words):
            grams = self.grams(ids)
            for place in winnowed(grams):
                places[int(grams[place])].append((number, place))
        self.places = dict(places)
        self.keys = np.array(sorted(places), np.int64)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Code of each run of GRAM known words; -1 where a word is unknown."""
        n = len(ids) - GRAM + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(GRAM):
            code = code * self.size + ids[k:k + n]
            known &= ids[k:k + n] >= 0
        return np.where(known, code, -1)


class _Known(dict):
    def __missing__(self, word):
        return -1


def winnowed(grams: np.ndarray) -> list[int]:
    """Places of the least hash of each window, the last of equal ones."""
    hashes = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    if len(grams) <= WINDOW:
        return [int(np.argmin(hashes))] if len(grams) else []
    found = {at + WINDOW - 1 - int(np.argmin(hashes[at:at + WINDOW][::-1])) for at in range(len(grams) - WINDOW + 1)}
    return sorted(found)


def align(template: list[int], words: list[int], shift: int, band: int) -> tuple[int, int, int, int, int]:
    """Best local alignment near the diagonal: word k of the template stands near
    ``words[k + shift]``, at most ``band`` away. Returns matched words, first and last
    place in the template (end exclusive), then in ``words``."""
    best = (0, 0, 0, 0, 0, 0)
    nothing = (0, 0, -1, -1)
    above: dict[int, tuple[int, int, int, int]] = {}
    for k, word in enumerate(template):
        row: dict[int, tuple[int, int, int, int]] = {}
        for at in range(max(0, k + shift - band), min(len(words), k + shift + band + 1)):
            same = words[at] == word
            score, matched, a, b = above.get(at - 1, nothing)
            if a < 0:
                a, b = k, at
            cell = (score + (MATCH if same else MISS), matched + same, a, b)
            for other in (above.get(at, nothing), row.get(at - 1, nothing)):
                if other[0] + GAP > cell[0]:
                    cell = (other[0] + GAP, *other[1:])
            if cell[0] > 0:
                row[at] = cell
                if same and cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], k + 1, cell[3], at + 1)
        above = row
    return best[1:]


def matches(text: str, index: Index) -> list[tuple[str, float, int, int, int, int, int]]:
    """(name, coverage, matched words, start, end, template start, template end): spans
    in code points and in words of the template; the best of overlapping spans of
    one template."""
    ids = np.array([index.vocabulary[w.lower()] for w in _WORD.findall(text)], np.int64)
    grams = index.grams(ids)
    some = np.flatnonzero(grams >= 0)
    some = some[np.isin(grams[some], index.keys)] if some.size else some
    if not some.size:
        return []
    shifts: dict[int, list[int]] = defaultdict(list)
    for at in some.tolist():
        for number, place in index.places[int(grams[at])]:
            shifts[number].append(at - place)
    words, found, spans = ids.tolist(), [], None
    for number, own in shifts.items():
        template = index.words[number].tolist()
        band = max(2, len(template) // 8)
        own = sorted(set(own))
        groups = [[own[0]]]
        for shift in own[1:]:
            if shift - groups[-1][-1] <= band:
                groups[-1].append(shift)
            else:
                groups.append([shift])
        hits = []
        for group in groups:
            middle = group[len(group) // 2]
            reach = max(band, group[-1] - middle, middle - group[0])
            low = max(0, middle - reach)
            window = words[low:middle + reach + len(template) + 1]
            matched, a, b, c, d = align(template, window, middle - low, reach)
            if matched >= GRAM and matched / len(template) >= MIN_COVERAGE:
                hits.append((matched, low + c, low + d, a, b))
        taken: list[tuple[int, int]] = []
        for matched, c, d, a, b in sorted(hits, key=lambda h: (-h[0], h[1])):
            if all(d <= x or y <= c for x, y in taken):
                taken.append((c, d))
                if spans is None:
                    spans = [m.span() for m in _WORD.finditer(text)]
                found.append((index.names[number], matched / len(template), matched, spans[c][0], spans[d - 1][1], a, b))
    return sorted(found, key=lambda f: (f[3], f[0]))


_FIELDS = ["doc_id", "license", "coverage", "matched_words", "start", "end", "template_start", "template_end"]
_KINDS = [pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 5]


def _scanned(templates: dict[str, str]):
    def run(batches):
        index = Index(templates)
        for part in slices(batches):
            rows = [
                (doc_id, *found)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if text
                for found in matches(text, index)
            ]
            columns = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KINDS)], _FIELDS)
    return run


def template_table(templates: DataFrame, name_column: str = "license", text_column: str = "text") -> dict[str, str]:
    """Templates of a table of names and texts, one row per name; null rows are left out."""
    usable = templates.select(F.col(name_column).alias("name"), F.col(text_column).alias("text")).dropna()
    rows = usable.limit(MAX_TEMPLATES + 1).collect()
    out = {r["name"]: r["text"] for r in rows}
    if len(rows) > MAX_TEMPLATES or len(out) < len(rows):
        raise ValueError(f"Templates need names of their own, {MAX_TEMPLATES} at most.")
    return out


def licenses(docs: DataFrame, templates: dict[str, str] | DataFrame = TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per license text found: doc_id, license, coverage (matched words of the
    template's), matched_words, start and end in code points, and the stretch of the
    template that is covered.

    The templates travel with the tasks; they are notices and short licenses, or a
    table of ``license`` and ``text``, such as full texts of long ones. Null and
    empty texts give no rows; rows with null or repeated ids are scanned like any
    other; other columns are not read.
    """
    if isinstance(templates, DataFrame):
        templates = template_table(templates)
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    schema = "doc_id long, license string, coverage double, matched_words long, start long, end long, template_start long, template_end long"
    return mapped(source, _scanned(templates), schema)
