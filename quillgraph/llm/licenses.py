"""License scans: MinHash bands over overlapping windows of words retrieve templates, exact containment verifies.

A text's words are cut into overlapping windows as long as the templates' (long templates are cut into windows of
``WINDOW`` words at every place, so that some window of theirs lines up with any window of a text). The windows'
five-word shingles are signed with MinHash; a window that shares a band with a template's retrieves it. ``BANDS`` bands
of ``ROWS`` values meet with probability 1 - (1 - 0.8 ** ROWS) ** BANDS > 0.9999 at similarity 0.8, and 0.997 at 0.66.
A text shorter than a window is signed as one window of its own length. A template shorter than a shingle is one
shingle of its own length, looked up at every place of a text.
Around each retrieved window the text's own words decide: the share of the template's distinct shingles that one span
of the text contains. Templates are few and short, and go to the tasks with the function.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT = 5, 0.8
#: Words of a template at least: one or two words mark nothing.
LEAST_WORDS = 3
ROWS, BANDS = 2, 10
#: Words of a window over long templates, and the steps between a text's windows as a share of their shingles.
WINDOW, STEPS = 36, 4
#: A span may be this much longer than its template, in words: insertions.
STRETCH = 1.25
#: Words worked on together; words whose hashes a task keeps.
STREAM, MOST_WORDS = 1 << 18, 500_000
#: All templates together, in words, at most: they are sent to every task.
MOST_TEMPLATE_WORDS = 200_000

WORD = re.compile(r"[^\W_]+")

# Notices as their licenses word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program. If not, see https://www.gnu.org/licenses/""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/""",
    "BSD-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.""",
    "BSD-disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product
documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as
being the original software. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
}
#: Notices shorter than a shingle: found word for word.
SHORT_TEMPLATES = {"All-rights-reserved": "All rights reserved"}

_draw = np.random.default_rng(10)
FACTORS = _draw.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
OFFSETS = _draw.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = found = zlib.crc32(word.encode()) << 20 | len(word) & 0xFFFFF
        return found


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of each ``width`` words in a row; the last few places are of no use."""
    padded = np.r_[words, np.zeros(width - 1, np.uint64)]
    rolled = np.zeros(len(words), np.uint64)
    for k in range(width):
        rolled = rolled * BASE + padded[k : k + len(words)]
    rolled ^= rolled >> np.uint64(31)
    return ((rolled * MIX) >> np.uint64(32)).astype(np.uint32)


def window_keys(hashes: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Band keys of the windows of ``size`` shingles at ``starts``: sliding minima by doubling."""
    reach = 1 << (size.bit_length() - 1)
    keys, key = [], None
    for row in range(ROWS * BANDS):
        least, width = hashes * FACTORS[row] + OFFSETS[row], 1
        while width < reach:
            least[:-width] = np.minimum(least[:-width], least[width:])
            width *= 2
        found = least[starts] if reach == size else np.minimum(least[starts], least[starts + size - reach])
        key = found.astype(np.uint64) if row % ROWS == 0 else key * BASE + found
        if row % ROWS == ROWS - 1:
            keys.append(key ^ (key >> np.uint64(32)))
    return keys


def text_keys(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Band keys of windows of ``counts`` shingles each (one at least) at ``starts``, as ``window_keys`` gives them."""
    cuts = np.r_[0, np.cumsum(counts)[:-1]]
    taken = hashes[np.arange(counts.sum()) + np.repeat(starts - cuts, counts)]
    keys, key = [], None
    for row in range(ROWS * BANDS):
        found = np.minimum.reduceat(taken * FACTORS[row] + OFFSETS[row], cuts)
        key = found.astype(np.uint64) if row % ROWS == 0 else key * BASE + found
        if row % ROWS == ROWS - 1:
            keys.append(key ^ (key >> np.uint64(32)))
    return keys


@dataclass
class Template:
    name: str
    words: list[str]
    shingles: set[tuple[str, ...]]
    #: Words of a shingle.
    width: int


class Index:
    """Templates by window size (in shingles): sorted band keys, and for each the templates that have it.

    Templates shorter than a shingle by their number of words: hashes, and for each the templates that have it.
    """

    def __init__(self, templates: dict[str, str]):
        self.hashes = _Hashes()
        self.templates = []
        by_size: dict[int, list[tuple[int, int]]] = {}
        short: dict[int, dict[int, set[int]]] = {}
        for name, text in templates.items():
            words = words_of(text)
            if len(words) < LEAST_WORDS:
                raise ValueError(f"template {name} has fewer than {LEAST_WORDS} words")
            width = min(len(words), SHINGLE)
            shingles = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
            number = len(self.templates)
            self.templates.append(Template(name, words, shingles, width))
            if width < SHINGLE:
                short.setdefault(width, {}).setdefault(int(shingle_hashes(self.numbers(words), width)[0]), set()).add(number)
                continue
            size = min(len(words), WINDOW) - SHINGLE + 1
            by_size.setdefault(size, []).extend((number, at) for at in range(len(words) - SHINGLE + 2 - size))
        if sum(len(t.words) for t in self.templates) > MOST_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MOST_TEMPLATE_WORDS} words")
        self.bands: dict[int, list[tuple[np.ndarray, dict[int, set[int]]]]] = {}
        for size, places in by_size.items():
            owners: list[dict[int, set[int]]] = [{} for _ in range(BANDS)]
            for number in sorted({n for n, _ in places}):
                signed = shingle_hashes(self.numbers(self.templates[number].words))
                starts = np.array([at for n, at in places if n == number])
                for band, keys in enumerate(window_keys(signed, starts, size)):
                    for key in keys.tolist():
                        owners[band].setdefault(key, set()).add(number)
            self.bands[size] = [(self._marks(o), o) for o in owners]
        self.short = {width: (self._marks(o), o) for width, o in short.items()}
        self.least_words = min((t.width for t in self.templates), default=SHINGLE)

    @staticmethod
    def _marks(owners: dict[int, set[int]]) -> np.ndarray:
        """Which low 16 bits some key has: most of a text's windows are told apart by these."""
        marks = np.zeros(1 << 16, bool)
        marks[[key & 0xFFFF for key in owners]] = True
        return marks

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.hashes) > MOST_WORDS:
            self.hashes.clear()
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def retrieve(self, numbers: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """``(template, word place)`` of the windows that share a band with a template; ``ends``: where texts end.

        Places of short templates may reach beyond their text: ``verify`` decides.
        """
        hashes = shingle_hashes(numbers)
        found: set[tuple[int, int]] = set()

        def look_up(keys: np.ndarray, starts: np.ndarray, marks: np.ndarray, owners: dict[int, set[int]]) -> None:
            for k in np.flatnonzero(marks[(keys & keys.dtype.type(0xFFFF)).astype(np.int64)]).tolist():
                for number in owners.get(int(keys[k]), ()):
                    found.add((number, int(starts[k])))

        for width, (marks, owners) in self.short.items():
            look_up(shingle_hashes(numbers, width), np.arange(len(numbers)), marks, owners)
        begins = np.r_[0, ends[:-1]]
        counts = ends - begins - SHINGLE + 1
        whole = (counts > 0) & (counts < max(self.bands, default=0))
        begins, counts = begins[whole], counts[whole]
        signed = text_keys(hashes, begins, counts) if len(begins) else []
        for size, bands in self.bands.items() if signed else ():
            less = counts < size
            for keys, (marks, owners) in zip(signed, bands):
                look_up(keys[less], begins[less], marks, owners)
        for size, bands in self.bands.items():
            step = max(1, size // STEPS)
            starts = self._starts(ends, size, step)
            if not len(starts):
                continue
            for keys, (marks, owners) in zip(window_keys(hashes, starts, size), bands):
                look_up(keys, starts, marks, owners)
        return found

    @staticmethod
    def _starts(ends: np.ndarray, size: int, step: int) -> np.ndarray:
        """Window starts: each step words of every text as long as a window, and a last window that ends with the text."""
        begins = np.r_[0, ends[:-1]]
        last = ends - SHINGLE + 1 - size  # last start of each text
        usable = last >= begins
        begins, last = begins[usable], last[usable]
        counts = (last - begins) // step + 1
        starts = np.repeat(begins, counts) + step * (np.arange(counts.sum()) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]][: len(counts)], counts))
        return np.unique(np.r_[starts, last])


def verify(words: list[str], template: Template, around: list[int], least: float) -> list[tuple[float, int, int]]:
    """Spans apart from each other near word places, ``(containment, first word, end)``, each of ``least`` or more.

    From left to right: the window over the template's shingles grows to the right and drops what is too far off or
    comes again; the best so far is taken once a template's length has passed without a better one.
    """
    reach = max(int(len(template.words) * STRETCH) + 1, len(template.words))
    near: dict[int, tuple[str, ...]] = {}
    for place in around:
        for i in range(max(0, place - reach), min(len(words) - template.width + 1, place + WINDOW + reach)):
            if i not in near and (key := tuple(words[i : i + template.width])) in template.shingles:
                near[i] = key
    places = sorted(near)
    found, right, start = [], 0, 0
    while start < len(places):
        best, inside, left = (0.0, 0, 0), {}, start
        for right in range(start, len(places)):
            i = places[right]
            if best[0] >= least and i >= best[2] + len(template.words):
                break
            inside[near[i]] = inside.get(near[i], 0) + 1
            while i + template.width - places[left] > reach or inside[near[places[left]]] > 1:
                inside[near[places[left]]] -= 1
                if not inside[near[places[left]]]:
                    del inside[near[places[left]]]
                left += 1
            if (share := len(inside) / len(template.shingles)) > best[0]:
                best = (share, places[left], i + template.width)
        if best[0] < least:
            break
        found.append(best)
        while start < len(places) and places[start] < best[2]:
            start += 1
    return found


def scan_texts(texts: list[str | None], index: Index, least: float = CONTAINMENT) -> list[list[tuple[str, float, int, int]]]:
    """For each text its ``(template, containment, start, stop)``, in code points, spans of a template apart."""
    found: list[list[tuple[str, float, int, int]]] = [[] for _ in texts]
    held: list[tuple[int, list[str]]] = []
    size = 0

    def work() -> None:
        ends = np.cumsum([len(w) for _, w in held])
        hits: dict[tuple[int, int], list[int]] = {}
        for number, place in index.retrieve(index.numbers([w for _, ws in held for w in ws]), ends):
            which = int(np.searchsorted(ends, place, side="right"))
            hits.setdefault((which, number), []).append(place - (int(ends[which - 1]) if which else 0))
        for (which, number), places in sorted(hits.items()):
            k, words = held[which]
            at = None
            for share, a, b in verify(words, index.templates[number], places, least):
                at = at or _spans(texts[k])
                found[k].append((index.templates[number].name, share, at[a][0], at[b - 1][1]))

    for k, text in enumerate(texts):
        if text and len(words := words_of(text)) >= index.least_words:
            held.append((k, words))
            size += len(words)
        if held and (size >= STREAM or k == len(texts) - 1):
            work()
            held, size = [], 0
    return found


def _spans(text: str) -> list[tuple[int, int]]:
    """Word spans of the lowered text, taken back to the text where lower case changes its length."""
    if len(text.lower()) == len(text):
        return [m.span() for m in WORD.finditer(text.lower())]
    back = [k for k, c in enumerate(text) for _ in c.lower()] + [len(text)]
    return [(back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer("".join(c.lower() for c in text))]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = CONTAINMENT) -> DataFrame:
    """One row per match: ``(id, license, containment, start, stop)``, the span in code points of the text.

    Texts without a match, null and empty ones give no row; rows with null or repeated ids are scanned like any
    other; other columns are ignored. Texts are scanned whole. An empty table gives no rows. Without ``templates``,
    ``TEMPLATES`` and ``SHORT_TEMPLATES`` are looked for. Templates of fewer than ``LEAST_WORDS`` words are an error.
    """
    chosen = dict(TEMPLATES | SHORT_TEMPLATES if templates is None else templates)
    Index(chosen)  # refuses unusable templates here, not in a task

    def run(batches):
        index = Index(chosen)
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for at in range(0, batch.num_rows, 1024):
                texts = batch.column(1).slice(at, 1024).to_pylist()
                rows += [(ids[at + k], *m) for k, many in enumerate(scan_texts(texts, index, least)) for m in many]
            names = ["id", "license", "containment", "start", "stop"]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, license string, containment double, start long, stop long")
