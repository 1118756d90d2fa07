"""License scans by patience alignment.

A text's words are aligned with each template's: equal words at both ends are matched, then words that
occur once in both are anchors, of which the longest run in rising order in both is taken, and the gaps
between anchors are aligned in the same way. Coverage is matched words / words of the template.

What can't be there is ruled out first, and exactly: a text that covers the asked-for share of a
template has that many of its words, as often as the template has them. Of a text that has them, a
template of at least LINE words is aligned with the whole, however far apart its words stand, and
with each stretch around one of its rarest words, for texts that hold it more than once. A shorter
one is a notice of one line, whose words anywhere in a long text would mean nothing: it is aligned
with all stretches of its length and a quarter (two words at least) on each side. Every stretch that
covers enough holds one of any set of more words than it may lack, so only those near the rarest
words are looked at. The best place counts: of equal coverage the narrowest, then the first.

Words are runs of other than blanks and ASCII punctuation, in lower case. Nulls: a null text has no
words, a null id is kept. Repeated rows are scanned each. An empty table gives no rows. Texts are
scanned whole, however long. Other columns of the table are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Words of a template from which on it is sought in whole texts.
LINE = 24
_BREAKS = str.maketrans(dict.fromkeys("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", " "))

#: Public notices and texts, by SPDX-like name. Placeholders for names and years are left out.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "all-rights-reserved": "All rights reserved.",
}


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().translate(_BREAKS).split()


def rising(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, x in enumerate(places):
        p = bisect_left(tops, x)
        before.append(piles[p - 1] if p else -1)
        tops[p : p + 1] = [x]
        piles[p : p + 1] = [k]
    found, k = [], piles[-1] if piles else -1
    while k >= 0:
        found.append(k)
        k = before[k]
    return found[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b) by patience alignment, in rising order."""
    found: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, iend, j, jend = stack.pop()
        while i < iend and j < jend and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < iend and j < jend and a[iend - 1] == b[jend - 1]:
            iend, jend = iend - 1, jend - 1
            found.append((iend, jend))
        if i == iend or j == jend:
            continue
        here, there = Counter(a[i:iend]), Counter(b[j:jend])
        at = {w: k for k, w in enumerate(b[j:jend], j) if there[w] == 1 and here.get(w) == 1}
        pairs = [(k, at[w]) for k, w in enumerate(a[i:iend], i) if w in at]
        anchors = [pairs[k] for k in rising([y for _, y in pairs])]
        for x, y in anchors:
            found.append((x, y))
            stack.append((i, x, j, y))
            i, j = x + 1, y + 1
        if anchors:
            stack.append((i, iend, j, jend))
    return sorted(found)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        self.coverage = coverage
        self.templates = {name: words_of(text) for name, text in sorted(templates.items())}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.need = {name: max(1, -int(-coverage * len(words) // 1)) for name, words in self.templates.items()}
        common = Counter(w for words in self.templates.values() for w in words)
        self.starts: dict[str, dict[str, list[int]]] = {}
        for name, words in self.templates.items():
            for k in sorted(range(len(words)), key=lambda k: (common[words[k]], k))[: len(words) - self.need[name] + 1]:
                self.starts.setdefault(words[k], {}).setdefault(name, []).append(k)
        self.words = frozenset(self.starts)

    def stretches(self, words: list[str], name: str) -> Iterator[tuple[int, int]]:
        t, n = len(self.templates[name]), len(words)
        slack = max(2, t // 4)
        if t >= LINE:
            yield 0, n
        rare = {w: places[name] for w, places in self.starts.items() if name in places}
        tried: set[int] = set()
        for p, word in enumerate(words):
            if word in rare:
                for o in (p - k for k in rare[word]) if t >= LINE else range(p - t - slack + 1, p + slack + 1):
                    if o not in tried:
                        tried.add(o)
                        yield max(0, o - slack), min(n, o + t + slack)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, first word, last word) of each template found, at its best place."""
        words = words_of(text)
        if self.words.isdisjoint(words):
            return []
        held = Counter(words)
        found = []
        for name, t in self.templates.items():
            if not t or sum(min(held[w], n) for w, n in self.counts[name].items()) < self.need[name]:
                continue
            best = None
            for low, high in self.stretches(words, name):
                if high - low >= self.need[name]:
                    pairs = align(words[low:high], t)
                    if len(pairs) >= self.need[name]:
                        rank = (len(pairs), pairs[0][0] - pairs[-1][0], -(low + pairs[0][0]), low + pairs[-1][0])
                        best = rank if best is None else max(best, rank)
            if best:
                found.append((name, best[0] / len(t), best[0], -best[2], best[3]))
        return found


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id and matches, an array of (license, coverage, matched, first_word, last_word) by name.

    Nulls, repeated rows and empty tables: as said at the top; a text without a match has an empty array."""
    if not 0 < coverage <= 1:
        raise ValueError("coverage must be in (0, 1]")
    small_batches(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    kind = "array<struct<license:string,coverage:double,matched:long,first_word:long,last_word:long>>"
    names = ["license", "coverage", "matched", "first_word", "last_word"]
    arrow = pa.list_(pa.struct([(names[0], pa.string()), (names[1], pa.float64()), *((n, pa.int64()) for n in names[2:])]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in batches:
            found = [[dict(zip(names, m)) for m in scanner.scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=["doc_id", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, matches {kind}")


def best(matches: DataFrame) -> DataFrame:
    """One row a document: doc_id, license (of the greatest coverage, ties to more words, then the first name; null without one), coverage, matched, first_word, last_word, licenses."""
    order = F.array_sort("matches", lambda a, b: F.when(a["coverage"] != b["coverage"], F.when(a["coverage"] > b["coverage"], -1).otherwise(1)).when(a["matched"] != b["matched"], F.when(a["matched"] > b["matched"], -1).otherwise(1)).when(a["license"] < b["license"], -1).otherwise(1))
    top = matches.withColumn("top", F.get(order, F.lit(0)))
    return top.select("doc_id", "top.license", "top.coverage", "top.matched", "top.first_word", "top.last_word", F.array_join(F.col("matches.license"), ",").alias("licenses"))
