"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment of the candidates."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_parts, utf8
from .tokens import chain, windows

#: Words of a fingerprint, and fingerprints of a winnowing window.
GRAM, WINNOW = 3, 3
#: Words that text and template may drift apart within one match.
BAND = 12
#: Least share of a template's words that a reported match covers.
COVERAGE = 0.7
#: Share of their words that two matches have in common if they are readings of one place.
SAME_PLACE = 0.8

# Public license texts (of long licenses the header that they ask for in a file), and short notices.
TEMPLATES = {
    "0bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "artistic-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License (2.0). You may obtain a copy of the full license at: http://www.perlfoundation.org/artistic_license_2_0 Any use, modification, and distribution of the Standard or Modified Versions is governed by this Artistic License.",
    "beerware": "As long as you retain this notice you can do whatever you want with this stuff. If we meet some day, and you think this stuff is worth it, you can buy me a beer in return.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-4-clause-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.",
    "cddl-1.0-header": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"). You may not use this file except in compliance with the License. See the License for the specific language governing permissions and limitations under the License. When distributing Covered Code, include this CDDL HEADER in each file and include the License file.",
    "curl": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT OF THIRD PARTY RIGHTS. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. Except as contained in this notice, the name of a copyright holder shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization of the copyright holder.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "eupl-1.2-notice": "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\"); You may not use this work except in compliance with the Licence.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "json-clause": "The Software shall be used for Good, not Evil.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "lgpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-notice": "Released under the MIT License.",
    "mpl-1.1-header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/ Software distributed under the License is distributed on an \"AS IS\" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied. See the License for the specific language governing rights and limitations under the License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ms-pl-grant": "Subject to the terms of this license, including the license conditions and limitations in section 3, each contributor grants you a non-exclusive, worldwide, royalty-free copyright license to reproduce its contribution, prepare derivative works of its contribution, and distribute its contribution or any derivative works that you create.",
    "ofl-1.1-notice": "This Font Software is licensed under the SIL Open Font License, Version 1.1. This license is copied below, and is also available with a FAQ at: http://scripts.sil.org/OFL",
    "postgresql": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE TO ANY PARTY FOR DIRECT, INDIRECT, SPECIAL, INCIDENTAL, OR CONSEQUENTIAL DAMAGES, INCLUDING LOST PROFITS, ARISING OUT OF THE USE OF THIS SOFTWARE AND ITS DOCUMENTATION, EVEN IF THE COPYRIGHT HOLDER HAS BEEN ADVISED OF THE POSSIBILITY OF SUCH DAMAGE. THE COPYRIGHT HOLDER SPECIFICALLY DISCLAIMS ANY WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE. THE SOFTWARE PROVIDED HEREUNDER IS ON AN \"AS IS\" BASIS, AND THE COPYRIGHT HOLDER HAS NO OBLIGATIONS TO PROVIDE MAINTENANCE, SUPPORT, UPDATES, ENHANCEMENTS, OR MODIFICATIONS.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "wtfpl-2": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: the last least hash of every window of consecutive grams (fewer: of all)."""
    if not len(grams):
        return np.empty(0, np.int64)
    window = min(window, len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    least = window - 1 - views[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(len(views)) + least)


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each run of letters and digits, A-Z as a-z."""
    parts = list(windows(text, False))
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


@dataclass
class Index:
    """Fingerprint to (template, place): as large as the templates, whatever is scanned."""

    gram: int = GRAM
    window: int = WINNOW
    names: list[str] = field(default_factory=list)
    tokens: list[np.ndarray] = field(default_factory=list)
    distinct: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    postings: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))

    @classmethod
    def of(cls, templates: dict[str, str], gram: int = GRAM, window: int = WINNOW) -> Index:
        """Templates shorter than a gram are one fingerprint of all their words; those without words are left out."""
        out = cls(gram, window)
        for name in sorted(templates):
            h = words(templates[name].encode())[0]
            if not len(h):
                continue
            grams = chain(h, gram)
            for at in winnow(grams, window).tolist():
                out.postings[int(grams[at])].append((len(out.names), at))
            out.names.append(name)
            out.tokens.append(h)
            out.distinct.append(np.unique(h, return_counts=True))
        out.keys = np.array(sorted(out.postings), np.uint64)
        return out

    def shared(self, template: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of a text its number among the template's distinct words (-1: none), and running counts of those
        that have one."""
        own = self.distinct[template][0]
        at = np.minimum(np.searchsorted(own, h), len(own) - 1)
        number = np.where(own[at] == h, at, -1)
        return number, np.concatenate(([0], np.cumsum(number >= 0)))

    def most_equal(self, template: int, number: np.ndarray, running: np.ndarray, low: int, high: int) -> int:
        """No alignment of the template with the text's words from low to high has more equal words: each word of the
        template counts as often as both have it."""
        own, count = self.distinct[template]
        if running[high] == running[low]:
            return 0
        there = number[low:high]
        return int(np.minimum(np.bincount(there[there >= 0], minlength=len(own)), count).sum())

    def candidates(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, first word, last word) of the text where the template may stand: fingerprints of one template on
        nearly one diagonal go together."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n in {min(self.gram, len(t)) for t in self.tokens}:
            if len(h) < n:
                continue
            grams = chain(h, n)
            at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
            for place in np.flatnonzero(self.keys[at] == grams).tolist():
                for template, own in self.postings[int(grams[place])]:
                    if min(self.gram, len(self.tokens[template])) == n:
                        hits[template].append((place - own, place))
        out = []
        for template, found in hits.items():
            size = len(self.tokens[template])
            found.sort()
            start = 0
            for k in range(1, len(found) + 1):
                if k == len(found) or found[k][0] - found[k - 1][0] > BAND:
                    diagonals = [d for d, _ in found[start:k]]
                    low, high = min(diagonals), max(diagonals)
                    for at in range(low, high + 1, max(1, BAND)):
                        out.append((template, max(0, at - BAND), min(len(h), min(at + BAND, high) + size + BAND)))
                    start = k
        return out


def align(template: np.ndarray, text: np.ndarray, band: int = BAND) -> tuple[int, int, int, int, int]:
    """Best local alignment of template and text (+2 an equal word, -1 an unequal, missing or added one): equal words,
    template's first and end word, text's first and end word. Only cells within a band around the diagonals that the
    text's slack over the template spans are filled. Ties: the earliest end in the text, then in the template.

    A row of the table is a word of the template and is filled at once: what a cell has from its left is the largest of
    (score + place) before it, less its own place."""
    m, n = len(template), len(text)
    width = max(0, n - m) + 2 * band
    place = np.arange(n + 1)
    # By column of the row above: score (0: no alignment), equal words, first word of the template and of the text.
    above = np.zeros((4, n + 1), np.int64)
    best, found = 0, (0, 0, 0, 0, 0)
    for i in range(1, m + 1):
        low, high = max(1, i - band), min(n, i + width - band) + 1
        if low >= high:
            break
        j = place[low:high]
        cell = above[:, low - 1 : high - 1].copy()
        fresh = cell[0] == 0
        cell[1, fresh], cell[2, fresh], cell[3, fresh] = 0, i - 1, j[fresh] - 1
        same = text[low - 1 : high - 1] == template[i - 1]
        cell[0] += np.where(same, 2, -1)
        cell[1] += same
        up = above[0, low:high] - 1 > cell[0]
        cell[:, up] = above[:, low:high][:, up]
        cell[0, up] -= 1
        reach = np.maximum(cell[0], 0) + j
        own = np.where(reach >= np.maximum.accumulate(reach), j - low, 0)
        origin = np.maximum.accumulate(own)
        cell = cell[:, origin]
        cell[0] -= j - low - origin
        above = np.zeros_like(above)
        above[:, low:high] = np.where(cell[0] > 0, cell, 0)
        top = int(cell[0].argmax())
        score, end = int(cell[0, top]), int(j[top])
        if score > best or score == best > 0 and end < found[4]:
            best, found = score, (int(cell[1, top]), int(cell[2, top]), i, int(cell[3, top]), end)
    return found


def matches(text: bytes, index: Index, coverage: float = COVERAGE) -> list[tuple]:
    """(template, matched words, template words, coverage, template first, template end, first word, end word, first byte,
    end byte) of each place that a template covers enough; of overlapping places of one template, the best."""
    h, start, end = words(text)
    if not len(h) or not index.names:
        return []
    found: dict[int, list[tuple]] = defaultdict(list)
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for template, low, high in index.candidates(h):
        own = index.tokens[template]
        if template not in known:
            known[template] = index.shared(template, h)
        todo = [(low, high)]
        while todo:  # what is left on both sides of a match may hold the template again
            low, high = todo.pop()
            if index.most_equal(template, *known[template], low, high) < coverage * len(own):
                continue
            equal, a, b, x, y = align(own, h[low:high])
            if equal and equal >= coverage * len(own):
                found[template].append((equal, -(low + x), a, b, low + y))
                todo += [(low, low + x), (low + y, high)]
    out = []
    for template, places in found.items():
        taken: list[tuple[int, int]] = []
        for equal, x, a, b, y in sorted(places, reverse=True):
            if all(y <= p or -x >= q for p, q in taken):
                taken.append((-x, y))
                n = len(index.tokens[template])
                out.append((index.names[template], equal, n, equal / n, a, b, -x, y, int(start[-x]), int(end[y - 1])))
    return closest(sorted(out, key=lambda r: (r[6], r[0])))


def closest(rows: list[tuple]) -> list[tuple]:
    """Matches sorted by their first word, without those whose place another template fits better: where two spans share
    at least SAME_PLACE of either, the one with more words amiss (missing, added or unequal) goes."""
    amiss = [n + (y - x) - 2 * equal for _, equal, n, _, _, _, x, y, *_ in rows]
    gone = set()
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if b[6] >= a[7]:
                break
            if min(a[7], b[7]) - b[6] >= SAME_PLACE * max(a[7] - a[6], b[7] - b[6]) and amiss[i] != amiss[j]:
                gone.add(i if amiss[i] > amiss[j] else j)
    return [r for k, r in enumerate(rows) if k not in gone]


FIELDS = ["template", "matched_words", "template_words", "coverage", "template_start", "template_end", "start_word", "end_word", "start_byte", "end_byte"]
SCHEMA = "doc_id long, template string, matched_words long, template_words long, coverage double, template_start long, template_end long, start_word long, end_word long, start_byte long, end_byte long"


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each place in each whole text that a license template covers to at least `coverage`: doc_id, template,
    matched words, coverage and the spans in words and in UTF-8 bytes. A template that repeats gives a row each time;
    a notice inside a longer header counts as both; of templates that differ by a few words only (closest), the one that
    fits the place best.

    Every gram of the text is looked up among the winnowed fingerprints of the templates, so a match that shares
    GRAM + WINNOW - 1 words in a row with its template is always a candidate. Nothing is shuffled, and a task holds
    one text and the templates. Null and empty texts give no rows; repeated rows give theirs again; null ids are kept.
    No templates or no rows: none. Other columns don't matter.
    """
    index = Index.of(TEMPLATES if templates is None else templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), *[pa.int64()] * 6]
        for batch in small_parts(batches):
            rows = [(k, *m) for k, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True) for m in matches(t, index, coverage)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", *FIELDS])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, SCHEMA)
