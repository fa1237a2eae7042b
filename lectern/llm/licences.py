"""Licence scans: which licence texts a document carries, where, and how completely.

Templates are cut into words; hashes of ``GRAM`` consecutive words are winnowed (of
every ``WINDOW`` neighbours the smallest is kept) and form an inverted index. Documents
are winnowed alike. A shared fingerprint fixes a diagonal between a document and a
template; hits on near diagonals are one candidate, which a banded alignment of the two
word sequences confirms or drops. Any unchanged run of GRAM + WINDOW - 1 words shares a
fingerprint, so no match of that length is missed.

The templates are a parameter of the caller; their size is checked before they are
broadcast. Documents are independent rows: nothing is shuffled or collected.

A null or empty text has no match; a document without a match gives no row. Repeated
rows are reported each. A template without words never matches. Overlapping matches of
one template are reduced to the best (the first among equals); of different templates,
those are dropped that overlap a more complete match of as many words. Spans are code
points of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kit

GRAM, WINDOW = 3, 3
MIN_COVERAGE = 0.85
MATCH, MISMATCH, GAP = 2, -1, -1
MAX_TEMPLATE_BYTES = 16 << 20

# Notices and texts of common licences (licence, template, text).
TEMPLATES = (
    ("MIT", "mit-notice", "Released under the MIT License."),
    ("MIT", "mit-licensed", "Licensed under the MIT License."),
    ("MIT", "mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Apache-2.0", "apache-notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use
this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under
the License."""),
    ("GPL-3.0", "gpl3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "gpl3-header", """This program is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of
the License, or (at your option) any later version. This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details."""),
    ("GPL-2.0", "gpl2-notice", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "bsd3-notice", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "isc-text", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies."""),
    ("MPL-2.0", "mpl2-header", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "unlicense", """This is free and unencumbered software released into the public domain. Anyone is free
to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means."""),
)


def _words(data: np.ndarray, offsets: np.ndarray):
    data = kit.lower_ascii(data)
    starts, ends, rows = kit.word_spans(data, offsets, kit.NOT_ALPHANUMERIC)
    return kit.span_hashes(kit.prefix_hashes(data), starts, ends), starts, ends, rows


def winnow(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of all rows."""
    grams, whole = kit.shingles(words, rows, GRAM)
    if not whole.any():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(whole)
    grams, rows = grams[at], rows[at]
    chosen = np.zeros(len(at), bool)
    n = len(at) - WINDOW + 1
    if n > 0:
        best, least = np.zeros(n, np.int64), grams[:n].copy()
        for j in range(1, WINDOW):
            lower = grams[j : j + n] <= least
            best[lower], least[lower] = j, grams[j : j + n][lower]
        inside = rows[:n] == rows[WINDOW - 1 :]
        chosen[(np.arange(n) + best)[inside]] = True
    few = kit.row_counts(rows, int(rows.max()) + 1) < WINDOW
    chosen |= few[rows]
    return at[chosen], grams[chosen]


def template_index(templates) -> dict:
    """The templates' words and the inverted index of their fingerprints."""
    if sum(len(t[2].encode()) for t in templates) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates above {MAX_TEMPLATE_BYTES} bytes")
    data, offsets = kit.column_bytes(pa.array([t[2] for t in templates], pa.large_string()))
    words, _, _, rows = _words(data, offsets)
    place, grams = winnow(words, rows)
    first = np.searchsorted(rows, np.arange(len(templates) + 1))
    order = np.argsort(grams, kind="stable")
    keys, begin = np.unique(grams[order], return_index=True)
    return {
        "names": [t[:2] for t in templates], "words": [words[a:b] for a, b in zip(first, first[1:])],
        "keys": keys, "begin": begin, "many": np.diff(np.append(begin, len(order))),
        "template": rows[place][order], "place": (place - first[rows[place]])[order],
    }


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int):
    """Best alignment of the whole template near text[shift:]: matched words, first and last text word.

    Cell (i, d) stands for template word i against text word shift + i + d - band.
    """
    m, width = len(template), 2 * band + 1
    score = np.full((m + 1, width), -(10**6), np.int64)
    d = np.arange(width)
    score[0] = 0
    equal = np.zeros((m, width), bool)
    for i in range(m):
        at = shift + i + d - band
        inside = (at >= 0) & (at < len(text))
        equal[i, inside] = text[at[inside]] == template[i]
        row = score[i] + np.where(equal[i], MATCH, MISMATCH)
        row[:-1] = np.maximum(row[:-1], score[i, 1:] + GAP)
        score[i + 1] = np.maximum.accumulate(row - GAP * d) + GAP * d
    i, j = m, int(score[m].argmax())
    pairs = []
    while i > 0:
        if score[i, j] == score[i - 1, j] + (MATCH if equal[i - 1, j] else MISMATCH):
            if equal[i - 1, j]:
                pairs.append(shift + i - 1 + j - band)
            i -= 1
        elif j + 1 < width and score[i, j] == score[i - 1, j + 1] + GAP:
            i, j = i - 1, j + 1
        else:
            j -= 1
    return len(pairs), pairs[-1] if pairs else 0, pairs[0] if pairs else 0


def find(words: np.ndarray, rows: np.ndarray, index: dict, min_coverage: float) -> list[tuple[int, int, float, int, int, int]]:
    """(row, template, coverage, matched, first word, last word) of all matches, words counted over all rows."""
    place, grams = winnow(words, rows)
    if not len(index["keys"]) or not len(place):
        return []
    slot = np.minimum(np.searchsorted(index["keys"], grams), len(index["keys"]) - 1)
    same = index["keys"][slot] == grams
    place, slot = place[same], slot[same]
    which = kit.ragged(index["begin"][slot], index["many"][slot])
    place = np.repeat(place, index["many"][slot])
    template, start = index["template"][which], place - index["place"][which]
    first = np.searchsorted(rows, np.arange(int(rows.max()) + 2))
    order = np.lexsort((start, template, rows[place]))
    found, last = [], None
    for row, t, s in zip(rows[place][order].tolist(), template[order].tolist(), start[order].tolist()):
        m = len(index["words"][t])
        band = 4 + m // 8
        if last and last[:2] == (row, t) and s - last[2] <= band // 2:
            continue
        last = (row, t, s)
        a, b = first[row], first[row + 1]
        matched, begin, end = align(index["words"][t], words[a:b], s - a, band)
        if matched >= min_coverage * m:
            found.append((row, t, matched / m, matched, a + begin, a + end))
    kept: list = []
    rivals: list = []
    for f in sorted(found, key=lambda f: (f[0], -f[2], -f[3], f[5] - f[4], f[4], f[1])):
        if not rivals or rivals[0][0] != f[0]:
            rivals = []
        # A sibling notice that differs in a word or two yields to the one that fits better.
        if not any(f[5] >= k[4] and f[4] <= k[5] and (k[1] == f[1] or k[2] > f[2] and k[3] >= f[3]) for k in rivals):
            kept.append(f)
            rivals.append(f)
    return kept


def scan(
    docs: DataFrame, templates=TEMPLATES, min_coverage: float = MIN_COVERAGE, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per match: doc_id, licence, template, coverage, matched_words, start_char, end_char."""
    shared = docs.sparkSession.sparkContext.broadcast(template_index(templates))
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_column].dataType), T.StructField("licence", T.StringType()),
        T.StructField("template", T.StringType()), T.StructField("coverage", T.DoubleType()),
        T.StructField("matched_words", T.LongType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for a, b, data, offsets in kit.pieces(batch.column(1)):
                words, starts, ends, rows = _words(data, offsets)
                found = find(words, rows, index, min_coverage) if len(words) else []
                if not found:
                    continue
                points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                row, t, coverage, matched, begin, end = zip(*found)
                base = points[offsets[np.array(row)]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.array(row) + a)), pa.array([index["names"][x][0] for x in t]),
                    pa.array([index["names"][x][1] for x in t]), pa.array(coverage, pa.float64()), pa.array(matched, pa.int64()),
                    pa.array(points[starts[np.array(begin)]] - base), pa.array(points[ends[np.array(end)]] - base),
                ], names=schema.names)

    return kit.map_arrow(docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text")), run, schema)
