"""License notices found by winnowed fingerprints and banded alignment.

Templates are cut into word k-grams; of every window of W successive k-gram hashes the least
is kept as fingerprint (winnowing), so any run of K + W - 1 template words holds one. The
inverted index from fingerprint to (template, position) is as large as the templates, not
the corpus, and travels with the tasks. A document's k-grams found in it pick candidate
templates and diagonals; a local alignment in a band around each diagonal then tells
which template words are matched, and from where to where in the text.

Defined results: null, empty or unmatched texts have no rows; a null doc_id is carried as
is; repeated rows give repeated results; an empty table gives an empty result; copies of a notice
that follow one another are reported one by one, equal alignments once; alignments of equal score
end as early as they can; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

K, W = 3, 2
BAND = 6
COVERAGE = 0.8
KNOWN_WORDS = 400_000
MASKED = np.uint64(2**64 - 1)

# Public notices and licence texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
}
_EDGE = b".,;:!?\"'()[]{}<>*#/\\-_"


def word_key(word: bytes) -> bytes:
    """A word without case and surrounding punctuation."""
    return word.lower().strip(_EDGE)


class Index:
    """Inverted index of the templates' winnowed fingerprints."""

    def __init__(self, templates: dict[str, str]):
        import xxhash

        self.hash, self.known = xxhash.xxh3_64_intdigest, {}
        self.names = list(templates)
        self.words = [self.hashes(t.encode().split()) for t in templates.values()]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, w in enumerate(self.words):
            g = self.grams(w)
            for at in {i + int(np.argmin(g[i : i + W])) for i in range(max(1, len(g) - W + 1))} if len(g) else ():
                places[int(g[at])].append((t, at))
        self.places, self.keys = dict(places), np.array(sorted(places), dtype=np.uint64)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        fresh = set(words).difference(self.known)
        if fresh:
            if len(self.known) + len(fresh) > KNOWN_WORDS:
                self.known.clear()
                fresh = set(words)
            self.known.update((w, self.hash(word_key(w)) >> 1) for w in fresh)  # 63 bits, so that MASKED is no word
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def grams(w: np.ndarray) -> np.ndarray:
        n = len(w) - K + 1
        if n < 1:
            return np.empty(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(K):
            h = (h ^ w[i : n + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        return h

    def candidates(self, doc: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """(document position, template position) of fingerprint hits by template."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        g = self.grams(doc)
        if len(g) and len(self.keys):
            at = np.searchsorted(self.keys, g)
            at[at == len(self.keys)] = 0
            for i in np.flatnonzero(self.keys[at] == g):
                for t, j in self.places[int(g[i])]:
                    out[t].append((int(i), j))
        return out


def align(doc: np.ndarray, tpl: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Best local alignment of tpl within `band` of the diagonal: (matched words, first, last document word).

    A match scores 2, a substitution or gap -1; ties prefer the earlier end.
    """
    width = 2 * band + 1
    best = (0, 0, -1, -1)  # score, matches, first, last
    row = [(0, 0, -1)] * width
    for j in range(len(tpl)):
        new = [(0, 0, -1)] * width
        for b in range(width):
            i = diagonal + j + b - band
            if not 0 <= i < len(doc):
                continue
            s, m, first = row[b]
            if doc[i] == tpl[j]:
                cell = (s + 2, m + 1, i if first < 0 else first)
            else:
                cell = (s - 1, m, first)
            if b and new[b - 1][0] - 1 > cell[0]:
                cell = (new[b - 1][0] - 1, *new[b - 1][1:])
            if b + 1 < width and row[b + 1][0] - 1 > cell[0]:
                cell = (row[b + 1][0] - 1, *row[b + 1][1:])
            if cell[0] <= 0:
                cell = (0, 0, -1)
            elif cell[0] > best[0]:
                best = (*cell, i)
            new[b] = cell
        row = new
    return best[1], best[2], best[3]


def matches(index: Index, text: str, coverage: float = COVERAGE) -> list[tuple[str, int, int, int, int]]:
    """(template, matched words, template words, start, end) in code points, end exclusive."""
    raw = text.encode("utf-8", "replace")
    doc = index.hashes(raw.split())
    out, spans = set(), None
    for t, hits in index.candidates(doc).items():
        tpl, tried, left = index.words[t], [], doc.copy()
        for diagonal in sorted({i - j for i, j in hits}):
            if tried and diagonal - tried[-1] <= BAND // 2:
                continue  # within the band already aligned
            tried.append(diagonal)
            while True:
                n, first, last = align(left, tpl, diagonal)
                if not n or n < coverage * len(tpl):
                    break
                if spans is None:
                    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
                start, end = (len(raw[:x].decode("utf-8", "replace")) for x in (spans[first][0], spans[last][1]))
                out.add((index.names[t], n, len(tpl), start, end))
                left[first : last + 1] = MASKED  # words of a reported copy do not hide the next one
    return sorted(out, key=lambda m: (m[3], m[4], m[0]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, template, matched, template_words, coverage, start, end), a row per reported match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            rows = [(key, *m) for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for m in matches(index, text.as_py() or "", coverage)]
            kinds = {"doc_id": pa.int64(), "template": pa.string(), "matched": pa.int64(), "template_words": pa.int64(), "start": pa.int64(), "end": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], names=list(kinds))

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, template string, matched long, template_words long, start long, end long")
    return found.select("doc_id", "template", "matched", "template_words", (F.col("matched") / F.col("template_words")).alias("coverage"), "start", "end")


def op7_winnowed_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
