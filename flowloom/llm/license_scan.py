"""License scan: winnowed fingerprints find candidates, banded alignment measures them.

Templates are cut into words; the minimum hash of each window of consecutive word grams is kept as a
fingerprint, and an inverted index maps fingerprints to template places. A document probes the index with all
its grams. Grams have three words and windows two grams, so that four words in a row that document and template
share give a hit (with a fifth of the words missing, a long template still has such a run); templates under LONG
words keep all their grams, those under SHORT words all their pairs of words. Hits of one template
on nearby diagonals are one candidate; a banded alignment (longest common subsequence within BAND
words of the diagonals) of the template against that part of the document gives the matched words, from which
come coverage (matched share of the template's words) and the span. What lies before and after a match is aligned
again, so that repeats side by side are all found. Spans that overlap keep the one with more matched words.

Work per document grows with its words and its hits; nothing is shuffled. The templates are a
parameter; the list here is fixed wording of public licenses: notices, first paragraphs and short whole texts.

Defined cases: null and empty texts match nothing; texts of any length are scanned whole; every occurrence is a
row; repeated rows report the same; ties between templates of equal matched words go to the higher coverage, then
to the name; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .tokens import runs

BAND, COVERAGE = 8, 0.8
#: Templates of fewer words keep all grams; of still fewer, grams of two words.
LONG, SHORT = 20, 10


def gram_size(n: int) -> int:
    return 2 if n < SHORT else 3


def winnow_size(n: int) -> int:
    return 1 if n < LONG else 2


_WORD = re.compile("[a-z0-9]+")

#: Fixed wording: notices, first paragraphs and short whole texts of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "all-rights-reserved": "All rights reserved. No part of this work may be reproduced",
}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def aligned(template: np.ndarray, part: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Longest common subsequence with part index - template index within [low, high]: (matched, first, last + 1 in part).

    Of equally long ones the shortest span that ends first.
    """
    n = len(part)
    best = (0, 0, 0)
    # per part place (row of the band): matched words so far and the start of their span; ends at that place or before
    before: dict[int, tuple[int, int]] = {}
    for i, w in enumerate(template.tolist()):
        now: dict[int, tuple[int, int]] = {}
        carry = (0, 0)
        for j in range(max(0, i + low), min(n, i + high + 1)):
            up = before.get(j, (0, 0))
            if part[j] == w:
                m, start = before.get(j - 1, (0, 0))
                if not m:
                    start = -j
                up = max(up, (m + 1, start))
                if (up[0], up[1] - j) > (best[0], -(best[2] - 1 - best[1]) - best[1] if best[0] else -n - n):
                    best = (up[0], -up[1], j + 1)
            carry = max(carry, up)
            now[j] = carry
        edge = min(n, i + high + 1)
        now[edge] = carry
        before = now
    return best


class Scanner:
    """The inverted index of winnowed template fingerprints."""

    def __init__(self, templates: dict[str, str] = TEMPLATES) -> None:
        self.names = sorted(templates)
        self.vocabulary: dict[str, int] = {}
        self.templates = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(templates[n])], np.int64) for n in self.names]
        self.size = len(self.vocabulary) + 1
        self.index: dict[int, dict[int, list[tuple[int, int]]]] = {2: {}, 3: {}}  # size of grams -> fingerprint -> (template, place)
        for t, ids in enumerate(self.templates):
            index, window = self.index[gram_size(len(ids))], winnow_size(len(ids))
            grams = self.grams(ids, gram_size(len(ids)))
            order = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
            for at in range(max(1, len(grams) - window + 1)) if len(grams) else ():
                k = at + int(order[at : at + window].argmin())
                if (t, k) not in index.setdefault(int(grams[k]), []):
                    index[int(grams[k])].append((t, k))
        self.keys = {k: np.array(sorted(x), np.int64) for k, x in self.index.items()}

    def grams(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Grams of k words as numbers; those that hold a word of no template are -1."""
        if len(ids) < k:
            return np.empty(0, np.int64)
        out, ok = np.zeros(len(ids) - k + 1, np.int64), np.ones(len(ids) - k + 1, bool)
        for i in range(k):
            part = ids[i : len(ids) - k + 1 + i]
            out = out * self.size + part
            ok &= part > 0
        return np.where(ok, out, -1)

    def _matches(self, t: int, ids: np.ndarray, start: int, end: int, a: int, b: int) -> Iterator[tuple]:
        """All matches of a template in the words from start to end, on the diagonals a to b."""
        template = self.templates[t]
        if end - start < COVERAGE * len(template):
            return
        m, x, y = aligned(template, ids[start:end], a - BAND - start, b + BAND - start)
        if m >= COVERAGE * len(template):
            yield m, m / len(template), self.names[t], start + x, start + y
            yield from self._matches(t, ids, start, start + x, a, b)
            yield from self._matches(t, ids, start + y, end, a, b)

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, float]]:
        """Matches of a text: (template, first word, last word + 1, matched words, coverage), in order."""
        words = words_of(text)
        ids = np.array(list(map(self.vocabulary.get, words, [0] * len(words))), np.int64)
        found = []
        by_template: dict[int, list[tuple[int, int]]] = {}
        for size, index in self.index.items():
            grams = self.grams(ids, size)
            for at in map(int, np.flatnonzero(np.isin(grams, self.keys[size])) if (grams >= 0).any() else ()):
                for t, k in index[int(grams[at])]:
                    by_template.setdefault(t, []).append((at - k, at))
        for t, places in by_template.items():
            template = self.templates[t]
            places.sort()
            groups = [[places[0][0], places[0][0]]]
            widest = max(BAND, len(template) // 2)  # so that a candidate holds a few occurrences at most
            for d, _ in places[1:]:
                if d - groups[-1][1] <= BAND and d - groups[-1][0] <= widest:
                    groups[-1][1] = d
                else:
                    groups.append([d, d])
            for a, b in groups:
                found += self._matches(t, ids, max(0, a - BAND), min(len(ids), b + len(template) + BAND), a, b)
        kept: list[tuple[int, int, str, int, float]] = []  # spans in order, none of which overlap
        for m, c, name, x, y in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
            i = bisect_left(kept, (x, y))
            if (i == 0 or kept[i - 1][1] <= x) and (i == len(kept) or y <= kept[i][0]):
                kept.insert(i, (x, y, name, m, c))
        return [(name, x, y, m, c) for x, y, name, m, c in kept]


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row per match: doc_id, license, first_word, end_word, matched_words, coverage, span (the matched words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            rows = []
            keys = iter(b.column("doc_id").to_pylist())
            for text in (t for _, _, texts in runs(b.column("text")) for t in texts):
                key = next(keys)
                for name, x, y, m, c in scanner.scan(text):
                    rows.append((key, name, x, y, m, c, " ".join(words_of(text)[x:y])))
            cols = list(zip(*rows)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "first_word", "end_word", "matched_words", "coverage", "span"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, first_word long, end_word long, matched_words long, coverage double, span string")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(common.table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op3_license_scan": op3_license_scan}
