"""License scans: winnowed fingerprints pick candidates, banded alignment reports what matched and where.

Fingerprints are the smallest hash of every ``WINDOW`` neighbouring runs of ``GRAM`` words, so any ``GRAM + WINDOW - 1`` words that a text
and a template share give a common fingerprint. The inverted index holds the templates only, which are a parameter, and is
sent to the workers with the function. Each text is scanned in its own row: nothing is shuffled, and a hot source costs no more.
Templates that are too short for that at the coverage asked have shorter grams and windows. Hits on neighbouring diagonals are one
candidate; a local alignment within a band around them gives the matched words. Of templates that claim the same words, the one with
the most matched words is reported, then the one of the highest coverage.

Defined cases: null, empty and white texts have no matches; a row appears once per match, repeated rows each; an empty table or no
templates give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from voxloom.llm.shingles import Shingler, mix, pieces
from voxloom.llm.text import whole

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
SCHEMA = "id long, license string, matched long, template_words long, coverage double, start_byte long, end_byte long"

# Whole license texts, and wordings of common notices.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
)
_DEAL = """ (the "Software"), to deal {with} the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions:
"""
_INCLUDED = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {who} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS {with} THE
SOFTWARE."""
_AUTHORS = _NO_WARRANTY.format(who="THE AUTHORS OR COPYRIGHT HOLDERS", **{"with": "IN"})
_MIT = _GRANT + _DEAL.format(**{"with": "in"}) + _INCLUDED
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted"
_BSD = _REDISTRIBUTION + """ provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
"""
_ADVERTISING = """3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes
software developed by the copyright holder.
"""
_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.
"""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""
_CC = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nc": "Attribution-NonCommercial", "by-nd": "Attribution-NoDerivatives",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-notice": "This work is licensed under the GNU General Public License",
    "reserved": "All rights reserved.",
    "mit-clause": _GRANT,
    "mit": _MIT + _AUTHORS,
    "json": _MIT + "The Software shall be used for Good, not Evil.\n" + _AUTHORS,
    "x11": _MIT + _NO_WARRANTY.format(who="THE X CONSORTIUM", **{"with": "IN"}) + """
Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other
dealings in this Software without prior written authorization from the X Consortium.""",
    "ncsa": _GRANT + _DEAL.format(**{"with": "with"}) + """Redistributions of source code must retain the above copyright notice, this list of conditions and
the following disclaimers. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimers in the documentation and/or other materials provided with the distribution. Neither the names of the development group, its institution,
nor the names of its contributors may be used to endorse or promote products derived from this Software without specific prior written permission.
""" + _NO_WARRANTY.format(who="THE CONTRIBUTORS OR COPYRIGHT HOLDERS", **{"with": "WITH"}),
    "bsd-clause": _REDISTRIBUTION,
    "bsd-2-clause": _BSD + _BSD_AS_IS,
    "bsd-3-clause": _BSD + "3. " + _NAMES + _BSD_AS_IS,
    "bsd-4-clause": _BSD + _ADVERTISING + "4. " + _NAMES + _BSD_AS_IS,
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
Public License for more details.""",
} | {f"cc-{k}": f"This work is licensed under a Creative Commons {name} 4.0 International License" for k, name in _CC.items()} | {
    f"cc-{k}-notice": f"Licensed under CC {k.upper()}" for k in _CC
}


def seeds(n: int, gram: int, window: int, coverage: float) -> tuple[int, int]:
    """(gram, window) at most as given, so short that any replacement of words that keeps the coverage leaves a run of gram + window - 1."""
    kept = min(n, max(1, -int(-(coverage * n - 1e-9) // 1)))
    run = -(-kept // (n - kept + 1))
    gram = min(gram, run)
    return gram, min(window, run - gram + 1)


class Scanner:
    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE):
        self.gram, self.window, self.band, self.coverage = gram, window, band, coverage
        self.shingler = Shingler(gram, punctuation=True)
        self.names, self.words = list(templates), []
        self.index: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}  # by (gram, window)
        for t, text in enumerate(templates.values()):
            hashes = self.shingler.words([text.encode()])[0]
            self.words.append(hashes.tolist())
            if len(hashes):
                kind = seeds(len(hashes), gram, window, coverage)
                own = self.index.setdefault(kind, defaultdict(list))
                for at, h in self._fingerprints(hashes, *kind):
                    own[h].append((t, at))
        self.sets = [set(w) for w in self.words]
        self.keys = {kind: np.array(sorted(own), np.uint64) for kind, own in self.index.items()}

    def _fingerprints(self, words: np.ndarray, gram: int, window: int) -> list[tuple[int, int]]:
        grams = self._grams(words, gram)
        return [(at, int(grams[at])) for at in self._chosen(grams, window).tolist()]

    def _grams(self, words: np.ndarray, gram: int) -> np.ndarray:
        n = max(0, len(words) - gram + 1)
        out = np.zeros(n, np.uint64)
        for k in range(gram):
            out = mix(out + words[k : k + n]) + np.uint64(k + 1)
        return out

    def _chosen(self, grams: np.ndarray, window: int) -> np.ndarray:
        """Places of the smallest gram of each window, the last among equals."""
        if len(grams) <= window:
            return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))] if len(grams) else [], np.int64)
        views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
        return np.unique(np.arange(len(views)) + window - 1 - views.argmin(1))

    def _possible(self, words: list[int], t: int, low: int, high: int) -> bool:
        """Whether enough words of the template are in the band at all."""
        there = set(words[max(0, low) : max(0, len(self.words[t]) + high)])
        return sum(w in there for w in self.words[t]) >= self.coverage * len(self.words[t])

    def _told_apart(self, found: list[tuple[int, int, int, int]], words: list[int]) -> list[tuple[int, int, int, int]]:
        """Of matches (template, first, last, matched) that claim the same words, the one with the most, then the highest coverage."""
        kept: list[tuple[int, int, int, int]] = []
        over: dict[int, list[int]] = defaultdict(list)  # by word of the text, the kept matches that span it
        for t, first, last, matched in sorted(found, key=lambda f: (-f[3], len(self.words[f[0]]), f)):
            claimed: dict[int, int] = defaultdict(int)
            for i in range(first, last + 1):
                for k in over.get(i, ()):
                    claimed[k] += kept[k][0] != t and words[i] in self.sets[kept[k][0]]
            if not any(n >= matched for n in claimed.values()):
                for i in range(first, last + 1):
                    over[i].append(len(kept))
                kept.append((t, first, last, matched))
        return sorted(kept)

    def _align(self, words: list[int], template: list[int], low: int, high: int) -> tuple[int, int, int]:
        """(matched words, first and last text word) of the best local alignment on the diagonals low..high."""
        best, before = (0, 0, 0, -1), {}
        for j, want in enumerate(template):
            now = {}
            for i in range(max(0, j + low), min(len(words), j + high + 1)):
                score, hits, first = before.get(i - 1, (0, 0, i))
                if score <= 0:
                    score, hits, first = 0, 0, i
                options = [(score + 2, hits + 1, first)] if words[i] == want else [(score - 1, hits, first)]
                if i in before:
                    options.append((before[i][0] - 1, *before[i][1:]))
                if i - 1 in now:
                    options.append((now[i - 1][0] - 1, *now[i - 1][1:]))
                now[i] = max(options, key=lambda x: (x[0], x[1], x[2]))
                if (now[i][0], now[i][1]) > best[:2]:
                    best = (*now[i], i)
            before = now
        return best[1], best[2], best[3]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, str, int, int, float, int, int]]:
        """(text, license, matched, template words, coverage, start, end) of each match."""
        if not self.keys:
            return
        hashes, owner, start, end = self.shingler.words(texts)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        at: set[int] = set()
        for kind, keys in self.keys.items():
            grams = self._grams(hashes, kind[0])
            if len(grams):
                at.update(np.unique(owner[np.flatnonzero(keys[np.minimum(np.searchsorted(keys, grams), len(keys) - 1)] == grams)]).tolist())
        for k in sorted(at):
            a, b = int(bounds[k]), int(bounds[k + 1])
            own = hashes[a:b]
            hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for kind, index in self.index.items():
                for place, h in self._fingerprints(own, *kind):
                    for t, there in index.get(h, ()):
                        hits[t].append((place - there, place))
            words, spans = own.tolist(), []
            for t, found in hits.items():
                template, groups = self.words[t], []
                # A group is of bounded width, however many matches follow each other. The hits of one match lie within a band of each other,
                # so the group of any of them has all of it; what one group finds is taken out for the next.
                width = self.band + len(template) // 4
                for diagonal, _ in sorted(found):
                    if groups and diagonal - groups[-1][1] <= self.band and diagonal - groups[-1][0] <= width:
                        groups[-1][1] = diagonal
                    else:
                        groups.append([diagonal, diagonal])
                rest = list(words)
                for low, high in groups:
                    while self._possible(rest, t, low - self.band, high + self.band):  # what has been matched is taken out, and the rest of the band searched again
                        matched, first, last = self._align(rest, template, low - self.band, high + self.band)
                        if matched == 0 or matched < self.coverage * len(template):
                            break
                        spans.append((t, first, last, matched))
                        rest[first : last + 1] = [None] * (last + 1 - first)
            for t, first, last, matched in self._told_apart(spans, words):
                n = len(self.words[t])
                yield k, self.names[t], matched, n, matched / n, int(start[a + first] - offsets[k]), int(end[a + last] - offsets[k])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row per license found in a row: id, license, matched, template_words, coverage, start_byte, end_byte."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.encode(whole(F.col(text_col)), "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage=coverage)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        for batch in batches:
            ids, done = batch.column(0).to_pylist(), 0
            for piece in pieces(batch.column(1)):
                found = [(ids[done + k], *rest) for k, *rest in scanner.scan(piece)]
                done += len(piece)
                yield pa.record_batch([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)
