"""License scans by patience alignment.

A text and a license template are sequences of lower-cased words. Words that stand
exactly once in both anchor the alignment: the longest increasing subsequence of their
places keeps the anchors in order, and the gaps between anchors are aligned in turn; a
gap without anchors falls back to a longest common subsequence. The share of template
words that align is the template's coverage.

Which windows to align is decided without loss: a text that reaches ``min_coverage``
holds at least one word of any set of more than (1 - min_coverage) of the template's
words, so texts without any of a few telling words need no alignment. Around those words
a text is cut into windows of three times the template's length, so that any span of
twice its length lies whole in one; a window that doesn't share enough words with the
template, each counted as often as the template has it, can't reach the coverage. Each
other window is aligned on its own. The best match of up to twice the template's length
is taken, and what is before and after it is searched in turn, so every copy is found.

Null, empty and short texts hold no license. Repeated rows give repeated results, rows
with a null doc_id are scanned too. An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.batches import text_chunks, texts_of

WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

#: Public license notices, and the standard headers and texts of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
        "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative "
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
    ),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}
MIN_COVERAGE = 0.8
#: What a word between two aligned ones counts against a copy.
STRAY = 0.3


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, for gaps that have no anchors."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        last, row = rows[-1], [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
        rows.append(row)
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each prefix of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _large_common(a: list[str], b: list[str], most_cells: int) -> list[tuple[int, int]]:
    """A longest common subsequence in linear space: halves of ``a`` against the best cut of ``b``."""
    code = {w: i for i, w in enumerate({*a, *b})}
    x, y = (np.array([code[w] for w in s]) for s in (a, b))
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a1 - a0 <= 1 or (a1 - a0) * (b1 - b0) <= most_cells:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        mid = (a0 + a1) // 2
        cut = b0 + int(np.argmax(_row(x[a0:mid], y[b0:b1]) + _row(x[mid:a1][::-1], y[b0:b1][::-1])[::-1]))
        todo += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def _increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience sorting."""
    tops, at, back = [], [], []
    for i, p in enumerate(places):
        k = bisect_left(tops, p)
        if k == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[k], at[k] = p, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str], most_cells: int = 50_000) -> list[tuple[int, int]]:
    """Pairs of places (in a, in b) that align, in order; gaps of more than ``most_cells`` are aligned in linear space."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if cb[w] == 1 and ca[w] == 1}
        single = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        if not single:
            out += [(a0 + i, b0 + j) for i, j in _large_common(a[a0:a1], b[b0:b1], most_cells)]
            continue
        anchors = [single[k] for k in _increasing([j for _, j in single])]
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:]) if i + 1 < k and j + 1 < m]
    return sorted(out)


def probe_words(template: list[str], min_coverage: float = MIN_COVERAGE) -> list[str]:
    """Telling words: together more than (1 - min_coverage) of the template, the longest and rarest first."""
    need = len(template) - int(-(-min_coverage * len(template) // 1)) + 1
    out, have, count = [], 0, Counter(template)
    for w in sorted(count, key=lambda w: (len(w) < 3, count[w], -len(w), w)):
        if have >= need:
            break
        out.append(w)
        have += count[w]
    return out


def _fitting(words: list[str], template: list[str], a0: int, a1: int) -> list[tuple[int, int]]:
    """Pairs of words[a0:a1] that span at most twice the template; far strays go, and what is near is aligned again."""
    most = 2 * len(template)
    while True:
        pairs = [(a0 + i, j) for i, j in align(words[a0:a1], template)]
        if not pairs or pairs[-1][0] + 1 - pairs[0][0] <= most:
            return pairs
        # the densest pairs within reach of each other
        at, lo, best = [i for i, _ in pairs], 0, (0, 0, 0)
        for hi, i in enumerate(at):
            while i + 1 - at[lo] > most:
                lo += 1
            best = max(best, (hi + 1 - lo, -lo, hi))
        near = pairs[-best[1] : best[2] + 1]
        b0, b1 = max(a0, near[-1][0] + 1 - most), min(a1, near[0][0] + most)
        if b1 - b0 >= a1 - a0:
            return near
        a0, a1 = b0, b1


def densest(words: list[str], template: list[str]) -> tuple[int, int]:
    """(start, end) of the stretch that holds most of the template's words in order, each other word counting ``STRAY`` against it.

    The first of equal ones, and the shortest. A neighbouring copy adds more strays than
    words that the first one lacks, so a stretch ends where its copy does.
    """
    code = {w: i for i, w in enumerate({*template})}
    text = np.array([code.get(w, -1) for w in words])
    every, steps = np.arange(len(words) + 1), np.arange(len(words) + 1) * STRAY
    # score and start of the best stretch that ends before each word
    score, start = np.zeros(len(words) + 1), every.copy()
    for w in template:
        hit = text == code[w]
        more = np.where(hit, score[:-1] + 1.0, -np.inf)
        better = more > score[1:]
        score[1:][better], start[1:][better] = more[better], start[:-1][better]
        # a stray word later: the best of what ends earlier, less the way
        level = score + steps
        top = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level >= top, every, 0))
        score, start = top - steps, start[source]
        empty = score <= 1e-9
        score[empty], start[empty] = 0.0, every[empty]
    end = int(np.argmax(score > score.max() - 1e-9))
    return int(start[end]), end


def _best_in(words: list[str], template: list[str], has: Counter, a: int, b: int, min_coverage: float) -> tuple[float, int, int, int] | None:
    """(coverage, start, end, aligned words) of the copy in words[a:b], if any reaches ``min_coverage``."""
    least, there = min_coverage * len(template), Counter(words[a:b])
    if b - a < least or sum(min(there[w], c) for w, c in has.items()) < least:
        return None
    s, e = densest(words[a:b], template)
    pairs = [(a + s + i, j) for i, j in align(words[a + s : a + e], template)]
    if len(pairs) < least or pairs[-1][0] + 1 - pairs[0][0] > 2 * len(template):
        pairs = _fitting(words, template, a, b)
    if len(pairs) < least:
        return None
    return len(pairs) / len(template), pairs[0][0], pairs[-1][0] + 1, len(pairs)


def all_matches(words: list[str], template: list[str], probes: set[str], min_coverage: float) -> list[tuple[float, int, int, int]]:
    """Every copy, (coverage, start, end, aligned words), from left to right.

    A copy spans at most twice the template and holds a telling word. Windows of three
    templates begin at each multiple of its length; one is searched for copies that start
    in its first third, after the end of the last copy.
    """
    n, has, out, done = len(template), Counter(template), [], 0
    blocks = sorted({k for i, w in enumerate(words) if w in probes for k in (i // n - 2, i // n - 1, i // n) if k >= 0})
    for k in blocks:
        while (a := max(done, k * n)) < (k + 1) * n:
            b, m = min(len(words), (k + 3) * n), None
            # a better copy may stand further on: what is before it is searched again
            while (found := _best_in(words, template, has, a, b, min_coverage)) is not None:
                if found[1] < (k + 1) * n:
                    m = found
                b = found[1]
            if m is None:
                break
            out.append(m)
            done = m[2]
    return out


def best_match(words: list[str], template: list[str], probes: set[str], min_coverage: float) -> tuple[float, int, int, int] | None:
    """(coverage, start, end, aligned words) of the copy of highest coverage; of equal ones the shortest, then the first."""
    return max(all_matches(words, template, probes, min_coverage), key=lambda m: (m[0], m[1] - m[2], -m[1]), default=None)


def told_apart(found: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """Of matches (license, coverage, start, end, aligned) that overlap, the one of highest coverage, then of most words."""
    kept: list[tuple[str, float, int, int, int]] = []
    for m in sorted(found, key=lambda m: (-m[1], -m[4], m[0], m[2])):
        if all(m[3] <= k[2] or k[3] <= m[2] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[2])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license_id, coverage, start, end, aligned): one row for each copy of a license that a text holds.

    Licenses that share most of their words cover each other: where matches overlap, the
    license of highest coverage is named.

    ``start`` and ``end`` count words of the text, ``end`` exclusive.
    """
    cut = {k: words_of(v) for k, v in templates.items()}
    probes = {k: frozenset(probe_words(v, min_coverage)) for k, v in cut.items()}
    telling = frozenset().union(*probes.values())
    rows = texts_of(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            out = []
            for d, t in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist()):
                words = words_of(t)
                if telling.isdisjoint(words):
                    continue
                there = telling.intersection(words)
                found = [(k, *m) for k, template in cut.items() if probes[k] & there for m in all_matches(words, template, probes[k], min_coverage)]
                out += [(d, *m) for m in told_apart(found)]
            columns = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "license_id", "coverage", "start", "end", "aligned"])

    return rows.mapInArrow(run, "doc_id long, license_id string, coverage double, start int, end int, aligned int")
