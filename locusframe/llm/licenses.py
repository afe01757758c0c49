"""License scans by conditional compression.

A text's words are looked up among the three-word sequences of all wordings. Where some stand close together is a
candidate block, however long. Each block is compressed alone and with each template (the wordings of one license, as
text or as name) as raw zstandard dictionary; templates are ranked by how much smaller the block gets. Down the ranking,
wordings are aligned with the block word by word; the differences confirm a winner or refuse it.

A wording is confirmed where at most a tenth of its words differ (none under ten words) and every word in which it differs
from a rival wording, such as a version, is there. Of all confirmed ones the one with the most words, less differences,
wins; as no wording can win by more than its length, the ranking is left as soon as nothing longer is to come. That is the
same finding as aligning everything with everything would give; see the tests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_batches, pick

# Names of public licenses. Each name is put into every opening below; a name beginning with "the " also
# stands without it.
NAMES = {
    "Apache-2.0": ["the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"],
    "MIT": ["the MIT License", "the MIT license", "MIT"],
    "ISC": ["the ISC License", "ISC"],
    "Zlib": ["the zlib License", "Zlib"],
    "Unlicense": ["the Unlicense"],
    "BSD-2-Clause": ["the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "BSD-3-Clause"],
    "MPL-2.0": ["the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"],
    "EPL-2.0": ["the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0", "EPL-2.0"],
    "GPL-2.0-only": ["the GNU General Public License, version 2", "the GNU General Public License version 2", "the GNU General Public License v2.0", "GPL-2.0", "GPL-2.0-only"],
    "GPL-2.0-or-later": ["the GNU General Public License, version 2 or later", "the GNU General Public License, version 2 or any later version", "GPL-2.0-or-later"],
    "GPL-3.0-only": ["the GNU General Public License, version 3", "the GNU General Public License version 3", "the GNU General Public License v3.0", "GPL-3.0", "GPL-3.0-only"],
    "GPL-3.0-or-later": ["the GNU General Public License, version 3 or later", "the GNU General Public License, version 3 or any later version", "GPL-3.0-or-later"],
    "LGPL-2.1-only": ["the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1", "LGPL-2.1"],
    "LGPL-3.0-only": ["the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0", "LGPL-3.0"],
    "AGPL-3.0-only": ["the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0", "AGPL-3.0"],
    "CC0-1.0": ["CC0 1.0", "the Creative Commons Zero 1.0 Universal", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC-BY-NC-ND-4.0"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "the Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC-BY-SA-3.0"],
}
# How a notice begins.
OPENINGS = ["licensed under", "released under", "distributed under", "available under", "published under", "under the terms of", "SPDX-License-Identifier:", "License:", "licensed under either", "licensed under either of"]
_GNU = "This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; {version}."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_LISTS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_MIT_REST = (
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_NOTICE = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_MIT_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Texts of public licenses, and the notices that they ask for. An opening that several licenses share is
# named for all of them.
TEXTS = {
    "MIT": [_MIT, _MIT + _MIT_REST + _MIT_NOTICE + _MIT_END],
    "MIT-0": [_MIT + _MIT_REST + ". " + _MIT_END],
    "BSD": [_BSD],
    "BSD-2-Clause": [f"{_BSD}: {_BSD_LISTS} {_BSD_END}", f"{_BSD}: {_BSD_LISTS}"],
    "BSD-3-Clause": [f"{_BSD}: {_BSD_LISTS} {_BSD_NAMES} {_BSD_END}", f"{_BSD}: {_BSD_LISTS} {_BSD_NAMES}"],
    "ISC": [_ISC, f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"],
    "0BSD": [f"{_ISC}. {_ISC_END}"],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "GPL-2.0-only": [_GNU.format(what=w, name="General Public License", version=v) for w in ("program",) for v in ("version 2 of the License", "version 2")],
    "GPL-2.0-or-later": [_GNU.format(what="program", name="General Public License", version="either version 2 of the License, or (at your option) any later version")],
    "GPL-3.0-only": [_GNU.format(what="program", name="General Public License", version=v) for v in ("version 3 of the License", "version 3")],
    "GPL-3.0-or-later": [_GNU.format(what="program", name="General Public License", version="either version 3 of the License, or (at your option) any later version")],
    "LGPL-2.1-only": [_GNU.format(what="library", name="Lesser General Public License", version="version 2.1 of the License")],
    "LGPL-2.1-or-later": [_GNU.format(what="library", name="Lesser General Public License", version="either version 2.1 of the License, or (at your option) any later version")],
    "LGPL-3.0-only": [_GNU.format(what="library", name="Lesser General Public License", version="version 3 of the License")],
    "LGPL-3.0-or-later": [_GNU.format(what="library", name="Lesser General Public License", version="either version 3 of the License, or (at your option) any later version")],
    "AGPL-3.0-only": [_GNU.format(what="program", name="Affero General Public License", version="version 3 of the License")],
    "AGPL-3.0-or-later": [_GNU.format(what="program", name="Affero General Public License", version="either version 3 of the License, or (at your option) any later version")],
}
#: Words that may stand between two license names under one opening ("MIT or the Apache License 2.0").
JOINTS = frozenset(["or", "and", "the", "either", "both", "at", "your", "option"])
#: Words that may differ: one in so many of a wording's words.
TOLERANCE = 10
#: Words without a three-word sequence of any wording that end a block. A confirmed wording never has so many in a row.
GAP = 40
#: A run of words which only one of two rival wordings holds is a mark of it if it is shorter than this; longer ones, such as
#: a clause, are beyond the tolerance as they are.
CLAUSE = 8
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def wordings() -> dict[tuple[str, str], list[str]]:
    """The templates, by license and kind: each a list of wordings."""
    out: dict[tuple[str, str], list[str]] = {}
    for name, forms in NAMES.items():
        out[name, "name"] = [f"{o} {f}" for f in _forms(forms) for o in OPENINGS]
    return out | {(name, "text"): texts for name, texts in TEXTS.items()}


def _forms(forms: list[str]) -> list[str]:
    return list(dict.fromkeys(f for form in forms for f in ([form, form.removeprefix("the ")] if form.startswith("the ") else [form])))


def distances(wording: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The fewest word differences between the wording and any run of the block that ends at each place (0: before all)."""
    cols = np.arange(len(block) + 1)
    row = np.zeros(len(block) + 1, np.int64)
    for n, w in enumerate(wording.tolist(), 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (block != w))
        new[0] = n
        row = np.minimum.accumulate(new - cols) + cols
    return row


def align(wording: list[int], run: list[int]) -> list[tuple[int, int]]:
    """The least alignment of a wording with a run of which it may leave out a beginning: (place in the wording, place in the
    run) in order, -1 for none. Equal words are preferred to replaced ones, those to words left out."""
    m, n = len(wording), len(run)
    table = np.zeros((m + 1, n + 1), np.int64)
    cols, own = np.arange(n + 1), np.array(run)
    for i, w in enumerate(wording, 1):
        new = table[i - 1] + 1
        new[1:] = np.minimum(new[1:], table[i - 1, :-1] + (own != w))
        new[0] = i
        table[i] = np.minimum.accumulate(new - cols) + cols
    out, i, j = [], m, n
    while i:
        if j and table[i, j] == table[i - 1, j - 1] + (wording[i - 1] != run[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif table[i, j] == table[i - 1, j] + 1:
            i -= 1
            out.append((i, -1))
        else:
            j -= 1
            out.append((-1, j))
    return out[::-1]


@dataclass
class Finding:
    license: str
    start: int
    end: int
    size_alone: int
    size_with: int
    wording: str
    differences: list[str] = field(default_factory=list)
    rival: str | None = None
    rival_differences: int | None = None


@dataclass
class Wording:
    text: str
    ids: np.ndarray
    grams: np.ndarray
    tolerance: int
    marks: frozenset[int] = frozenset()


@dataclass
class Template:
    license: str
    compressor: zstandard.ZstdCompressor
    wordings: list[Wording]


class Scanner:
    def __init__(self) -> None:
        self.alone = zstandard.ZstdCompressor(level=6, write_content_size=False)
        self.vocabulary: dict[str, int] = {}
        self.templates: list[Template] = []
        number = lambda t: np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(t)], np.int64)
        made = {key: {tuple(n): (t, n) for t in texts for n in [number(t)]} for key, texts in wordings().items()}
        self.size = len(self.vocabulary) + 1
        for (name, kind), texts in made.items():
            own = [Wording(t, n, np.unique(self.grams(n)), len(n) // TOLERANCE if kind == "text" else 0) for t, n in texts.values()]
            d = zstandard.ZstdCompressionDict("\n".join(" ".join(tokens(w.text)) for w in own).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=6)
            self.templates.append(Template(name, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False), sorted(own, key=lambda w: -len(w.ids))))
        self.longest = [max(len(w.ids) for w in t.wordings) for t in self.templates]
        self.seeds = np.unique(np.concatenate([w.grams for t in self.templates for w in t.wordings]))
        every = [(t, w) for t in self.templates for w in t.wordings if w.tolerance]
        for t, w in every:
            marks = {i for i, word in enumerate(tokens(w.text)) if any(c.isdigit() for c in word)}
            for t2, rival in every:
                if t2.license != t.license:
                    marks |= self._marks(w, rival)
            w.marks = frozenset(marks)
        #: Bare names, by first word, the longest first: only right after a notice.
        self.bare: dict[str, list[tuple[list[str], str]]] = {}
        for name, forms in NAMES.items():
            for form in _forms(forms):
                words = tokens(form)
                self.bare.setdefault(words[0], []).append((words, name))
        for own_names in self.bare.values():
            own_names.sort(key=lambda x: -len(x[0]))

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Three-word sequences as numbers; wordings of two words have that pair. Words of no wording (0) are in none."""
        size = self.size
        pairs = (ids[:-1] * size + ids[1:]) * size
        if len(ids) <= 2:
            return pairs
        return pairs[:-1] + ids[2:]

    def _marks(self, own: Wording, rival: Wording) -> set[int]:
        """The places of a wording that tell it from a rival one."""
        n = max(len(own.ids), len(rival.ids))
        pairs = align(own.ids.tolist(), rival.ids.tolist())
        odd = [i for i, j in pairs if i >= 0 and (j < 0 or own.ids[i] != rival.ids[j])]
        if not odd or len(own.ids) - len(odd) < n // 2:
            return set()
        runs = np.split(np.array(odd), np.flatnonzero(np.diff(odd) != 1) + 1)
        return {int(i) for r in runs if len(r) < CLAUSE for i in r}

    def confirm(self, w: Wording, ids: np.ndarray) -> tuple[int, int, list[tuple[int, int]]] | None:
        """(differences, first word, alignment) of the best place of a wording in a block, the leftmost if equal."""
        row = distances(w.ids, ids)
        end = int(row.argmin())
        if row[end] > w.tolerance:
            return None
        begin = max(0, end - len(w.ids) - int(row[end]))
        pairs = align(w.ids.tolist(), ids[begin:end].tolist())
        right = {i for i, j in pairs if i >= 0 and j >= 0 and w.ids[i] == ids[begin + j]}
        if not w.marks <= right:
            return None
        return int(row[end]), begin, pairs

    def block(self, words: list[str], ids: np.ndarray) -> tuple[int, int, Finding] | None:
        """The finding in one block, from which word to which."""
        here = set(np.concatenate([self.grams(ids), (ids[:-1] * self.size + ids[1:]) * self.size]).tolist())
        raw = " ".join(words).encode("utf-8", "surrogatepass")
        alone = len(self.alone.compress(raw))
        ranked = sorted((len(t.compressor.compress(raw)), n) for n, t in enumerate(self.templates))
        longest = np.maximum.accumulate([self.longest[n] for _, n in ranked][::-1])[::-1]
        best: tuple[int, int, Finding, Wording, int, list[tuple[int, int]]] | None = None
        for (size, n), most in zip(ranked, longest.tolist(), strict=True):
            if best is not None and best[0] >= most:
                break
            t = self.templates[n]
            for w in t.wordings:
                if best is not None and best[0] >= len(w.ids):
                    break
                # every difference breaks at most three sequences
                if sum(map(here.__contains__, w.grams.tolist())) < max(1, len(w.grams) - 3 * w.tolerance) or (got := self.confirm(w, ids)) is None:
                    continue
                off, begin, pairs = got
                if best is None or len(w.ids) - off > best[0]:
                    best = len(w.ids) - off, off, Finding(t.license, 0, 0, alone, size, w.text), w, begin, pairs
        if best is None:
            return None
        _, _, f, w, begin, pairs = best
        said = tokens(w.text)
        places = [j for _, j in pairs if j >= 0]
        first, last = begin + min(places), begin + max(places)
        for i, j in pairs:
            if i < 0 or j < 0 or w.ids[i] != ids[begin + j]:
                f.differences.append(f"-{said[i]}" if j < 0 else f"+{words[begin + j]}" if i < 0 else f"{said[i]}>{words[begin + j]}")
        other = next((self.templates[n] for _, n in ranked if self.templates[n].license != f.license), None)
        if other is not None:  # how far the next best license is from the same words
            f.rival = other.license
            f.rival_differences = min(int(self._apart(x, ids[first : last + 1])) for x in other.wordings)
        return first, last + 1, f

    def _apart(self, w: Wording, run: np.ndarray) -> int:
        """The words in which a wording differs from the whole of a run."""
        pairs = align(w.ids.tolist(), run.tolist())
        return sum(i < 0 or j < 0 or w.ids[i] != run[j] for i, j in pairs) + min((j for _, j in pairs if j >= 0), default=len(run))

    def seeded(self, codes: np.ndarray) -> np.ndarray:
        return self.seeds[np.minimum(np.searchsorted(self.seeds, codes), len(self.seeds) - 1)] == codes

    def _within(self, words: list[str], ids: np.ndarray, at: int) -> list[tuple[int, int, Finding]]:
        """All findings of a block: what stands before and after one is a block of its own."""
        out, todo = [], [(0, len(ids))]
        while todo:
            a, b = todo.pop()
            if b - a < 2 or not self.candidates(ids[a:b]) or (got := self.block(words[a:b], ids[a:b])) is None:
                continue
            x, y, f = got
            out.append((at + a + x, at + a + y, f))
            todo += [(a, a + x), (a + y, b)]
        return sorted(out, key=lambda f: f[0])

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs of words that may hold a notice."""
        known = ids > 0
        pair = np.flatnonzero(known[:-1] & known[1:])
        if not len(pair):
            return []
        codes = (ids[pair] * self.size + ids[pair + 1]) * self.size
        third = np.r_[ids, 0][pair + 2]
        at = pair[self.seeded(codes) | self.seeded(codes + third) & (third > 0)]
        if not len(at):
            return []
        cuts = np.flatnonzero(np.diff(at) > GAP)
        return [(int(a), min(int(b) + 3, len(ids))) for a, b in zip(at[np.r_[0, cuts + 1]], at[np.r_[cuts, len(at) - 1]], strict=True)]

    def scan(self, text: str | None) -> list[Finding]:
        """All findings of a whole text, in order; they do not overlap."""
        words = tokens(text or "")
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        blocks = self.candidates(ids) if len(ids) > 1 else []
        if not blocks:
            return []
        found = [x for a, b in blocks for x in self._within(words[a:b], ids[a:b], a)]
        spans = [m.span() for m in _WORD.finditer(text)] if found else []
        out, done = [], 0
        for a, b, f in found:
            if a < done:
                continue
            f.start, f.end = spans[a][0], spans[b - 1][1]
            out.append(f)
            done = b
            while (also := self._also(words, done, text, spans)) is not None:
                x, y, name = also
                said = text[spans[x][0] : spans[y - 1][1]]
                out.append(Finding(name, spans[x][0], spans[y - 1][1], f.size_alone, f.size_with, said, [], f.license, None))
                done = y
        return out

    def _also(self, words: list[str], at: int, text: str, spans: list[tuple[int, int]]) -> tuple[int, int, str] | None:
        """A bare name that a joint, or a slash, ties to the notice before it."""
        x = at
        while x < len(words) and x - at < 5 and words[x] in JOINTS:
            x += 1
        tied = x > at and words[at] in ("or", "and") or x < len(words) and text[spans[at - 1][1] : spans[x][0]].strip() == "/"
        for y in (x, x - 1) if tied else ():  # a name may begin with "the"
            for form, name in self.bare.get(words[y] if at <= y < len(words) else "", ()):
                if words[y : y + len(form)] == form:
                    return y, y + len(form), name
        return None


_SCANNER: Scanner | None = None


def scanner() -> Scanner:
    """One for each worker process."""
    global _SCANNER
    if _SCANNER is None:
        _SCANNER = Scanner()
    return _SCANNER


_KINDS = {"license": pa.string(), "start": pa.int64(), "end": pa.int64(), "size_alone": pa.int64(), "size_with": pa.int64(), "wording": pa.string(), "differences": pa.list_(pa.string()), "rival": pa.string(), "rival_differences": pa.int64()}


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, start, end, size_alone, size_with, wording, differences, rival, rival_differences): one row for each
    license notice in each whole text.

    start and end are character positions; the sizes are those of the candidate block; differences are ``-word`` (left
    out), ``+word`` (put in) and ``word>word`` (replaced); the rival is the next license of the ranking, with the words in
    which it differs. Null and empty texts and texts without a notice have no rows, a null key is kept; texts of any length
    are scanned whole; equal wordings go to the license that ranks first, equal sizes to the order of the templates;
    repeated rows repeat theirs; an empty table gives none; other columns, whatever their names, are ignored.
    """
    src = pick(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for b in batches:
            keys, found = [], []
            for n, t in enumerate(b.column(1).to_pylist()):
                for f in s.scan(t):
                    keys.append(n)
                    found.append(f)
            own = b.column(0).take(pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, *(pa.array([getattr(f, c) for f in found], t) for c, t in _KINDS.items())], [key, *_KINDS])

    return map_batches(src, run, f"`{key}` {src.schema[0].dataType.simpleString()}, license string, `start` bigint, `end` bigint, size_alone bigint, size_with bigint, wording string, differences array<string>, rival string, rival_differences bigint")
