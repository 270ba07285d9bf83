"""License scan: winnowed template fingerprints pick candidates, banded alignment gives coverage and spans.

Templates and texts are compared as lower-case runs of letters and digits of any script. The k-word grams of a template
are winnowed (the least hash of every window is kept) into an inverted index from hash to (template,
position). A text's grams are looked up in it; hits that lie near one diagonal form a candidate region, regions that
go on one after the other a chain, and in the strip of either a
banded alignment counts the template's words that occur in order, allowing extra and changed words.

Null, empty and word-free texts match nothing, and so does an empty table. Repeated rows repeat their matches; columns other
than the id and the text are not read. Texts are read whole, in bounded pieces of work.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .tables import bounded_batches

# License notices as their public texts state them, by name; texts that licenses share come first.
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "AGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-2-Clause": f"{_BSD_TWO} {_BSD_DISCLAIMER}",
    "BSD-2-Clause-conditions": _BSD_TWO,
    "BSD-3-Clause": f"{_BSD_TWO} {_BSD_THIRD} {_BSD_DISCLAIMER}",
    "BSD-3-Clause-conditions": f"{_BSD_TWO} {_BSD_THIRD}",
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
        'this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, '
        "and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire "
        "statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in "
        "part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by "
        "a source language processor."
    ),
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": f"{_ISC} {_ISC_DISCLAIMER}",
    "ISC-notice": _ISC,
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": f"{_MIT} {_MIT_DISCLAIMER}",
    "MIT-notice": _MIT,
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
GRAM, WINDOW, BAND, COVERAGE = 3, 2, 8, 0.8
#: Code points of one piece of work; a longer text is one by itself.
CHUNK = 1 << 18
_gap: list[np.ndarray] = []


def _gaps() -> np.ndarray:
    """For each code point whether it is neither a letter nor a digit (nor a mark on one); made once in a worker."""
    if not _gap:
        table = np.ones(0x110000, dtype=bool)
        points = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype(np.uint32)
        for m in regex.finditer(r"[\p{L}\p{N}\p{M}]+", points.tobytes().decode("utf-32-le")):
            table[points[m.start() : m.end()]] = False
        _gap.append(table)
    return _gap[0]


def _words(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts joined by spaces, word hashes, starts and ends in it, and the offset of each text among the words."""
    lower = [t.lower() for t in texts]
    whole = " ".join(lower) + " "
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    gap = _gaps()[points]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in lower])))
    return whole, tk.hash_spans(points, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def _pieces(texts: Sequence[str]) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > CHUNK:
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    value = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for j in range(k):
        value = tk.mix(value + words[j : j + len(value)])
    return value


def winnow(grams: np.ndarray, window: int) -> list[int]:
    """Positions of the least hash of every window, the rightmost of equals; all of fewer grams than a window give one."""
    chosen: list[int] = []
    for first in range(max(1, len(grams) - window + 1)):
        part = grams[first : first + window]
        if len(part):
            at = first + len(part) - 1 - int(np.argmin(part[::-1]))
            if not chosen or chosen[-1] != at:
                chosen.append(at)
    return chosen


@dataclass
class TemplateIndex:
    """The templates' words and the inverted index of their winnowed grams."""

    names: list[str]
    words: list[np.ndarray]
    keys: np.ndarray
    postings: dict[int, list[tuple[int, int]]]
    gram: int
    band: int


def index_templates(templates: Mapping[str, str], gram: int = GRAM, window: int = WINDOW, band: int = BAND) -> TemplateIndex:
    names = sorted(templates)
    words = [_words([templates[n]])[1] for n in names]
    postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for t, w in enumerate(words):
        grams = _grams(w, gram)
        for at in winnow(grams, window):
            postings[int(grams[at])].append((t, at))
    return TemplateIndex(names, words, np.array(sorted(postings), dtype=np.uint64), dict(postings), gram, band)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, first, last + 1 matched position in text) of the best alignment within a band of shifts.

    Template word i may meet the text words low + i to high + i; the score is the longest
    common subsequence on that strip, ties going to the alignment that starts later and ends earlier.
    """
    width = high - low + 1
    best = [(0, 0, 0)] * width  # (matches, start of the match, -end): larger is better
    for i in range(len(template)):
        word = template[i]
        row = [(0, 0, 0)] * width
        for j in range(width):
            at = low + i + j
            skip_text = row[j - 1] if j else (0, 0, 0)
            skip_word = best[j + 1] if j + 1 < width else (0, 0, 0)
            here = max(skip_text, skip_word)
            if 0 <= at < len(text) and text[at] == word:
                m, start, _ = best[j]
                here = max(here, (m + 1, start if m else at, -(at + 1)))
            row[j] = here
        best = row
    m, start, end = max(best)
    return m, start, -end


#: Strips whose bounds are worked out at a time, as cells of template words by shifts.
BOUND_CELLS = 1 << 20


def reachable(template: np.ndarray, text: np.ndarray, lows: np.ndarray, width: int) -> np.ndarray:
    """For strips of `width` shifts from each of lows on: of how many template words the strip's part of the text holds an equal.

    No alignment within a strip matches more words.
    """
    size = len(template)
    # places before and behind the text equal no word
    inside = np.concatenate((np.zeros(size + width, dtype=bool), np.ones(len(text), dtype=bool), np.zeros(size + width, dtype=bool)))
    padded = np.concatenate((np.zeros(size + width, dtype=np.uint64), text, np.zeros(size + width, dtype=np.uint64)))
    held = np.lib.stride_tricks.sliding_window_view(padded, width)
    there = np.lib.stride_tricks.sliding_window_view(inside, width)
    out = np.zeros(len(lows), dtype=np.int64)
    some = max(1, BOUND_CELLS // (size * width))
    for first in range(0, len(lows), some):
        at = np.clip(lows[first : first + some, None] + (size + width) + np.arange(size)[None, :], 0, len(held) - 1)
        out[first : first + some] = ((held[at] == template[None, :, None]) & there[at]).any(axis=2).sum(axis=1)
    return out


@dataclass
class Region:
    """Hits near one diagonal: its shift, the first and last hit's places in the text and in the template, and how many they are."""

    shift: int
    first: int
    last: int
    begin: int
    end: int
    hits: int = 1


def regions(seen: list[tuple[int, int]], near: int, size: int) -> list[Region]:
    """Regions of hits (shift, place in the text): a hit joins the last region if it lies near and goes on in the template."""
    out: list[Region] = []
    for shift, at in sorted(seen, key=lambda s: (s[1], s[0])):
        r = out[-1] if out else None
        if r and at - r.last <= size and abs(shift - r.shift) <= near:
            r.last, r.end, r.hits = at, max(r.end, at - shift), r.hits + 1
        else:
            out.append(Region(shift, at, at, at - shift, at - shift))
    return out


def chains(found: list[Region], size: int) -> list[tuple[int, int]]:
    """(least, greatest shift) of the chains of two regions or more that go on both in the text and in the template.

    A region follows that of most hits among those before it that end at most a template's length earlier.
    """
    score, before = [r.hits for r in found], [-1] * len(found)
    first = 0
    for i, r in enumerate(found):
        while found[first].last < r.first - size:
            first += 1
        for j in range(first, i):
            p = found[j]
            if p.last < r.first and p.end < r.begin and score[j] + r.hits > score[i]:
                score[i], before[i] = score[j] + r.hits, j
    inner, out = set(before), []
    for i in range(len(found)):
        if before[i] >= 0 and i not in inner:
            shifts, at = [], i
            while at >= 0:
                shifts.append(found[at].shift)
                at = before[at]
            out.append((min(shifts), max(shifts)))
    return out


def scan_words(words: np.ndarray, index: TemplateIndex, coverage: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last word + 1) of every match in one text, in order.

    Where matches overlap, the one stays that has the most matched words less missing ones, as a license may hold another's words.
    """
    grams = _grams(words, index.gram)
    if not len(grams) or not len(index.keys):
        return []
    place = np.minimum(np.searchsorted(index.keys, grams), len(index.keys) - 1)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for at in np.flatnonzero(index.keys[place] == grams):
        for t, pos in index.postings[int(grams[at])]:
            hits[t].append((int(at) - pos, int(at)))
    found = []
    for t, seen in hits.items():
        size = len(index.words[t])
        near = min(index.band, size // 2)
        mine = regions(seen, near, size)
        shifts = np.array(sorted({r.shift for r in mine}), dtype=np.int64)
        enough = reachable(index.words[t], words, shifts - index.band, 2 * index.band + 1) >= coverage * size
        hopeful = set(shifts[enough].tolist())
        # the whole band may reach the next copy of a short template, the narrow one only the region's own
        strips = [(r.shift - band, r.shift + band) for r in mine if r.shift in hopeful for band in (near, index.band)]
        linked: dict[int, set[int]] = defaultdict(set)
        for low, high in chains(mine, size):
            linked[high - low + 2 * near + 1].add(low - near)
        for width, lows in linked.items():
            at = np.array(sorted(lows), dtype=np.int64)
            strips += [(low, low + width - 1) for low in at[reachable(index.words[t], words, at, width) >= coverage * size].tolist()]
        for low, high in dict.fromkeys(strips):
            m, first, last = align(index.words[t], words, low, high)
            if m >= coverage * size:
                found.append((t, m, first, last))
    found.sort(key=lambda f: (len(index.words[f[0]]) - 2 * f[1], -f[1], f[2], f[0]))
    kept: list[tuple[int, int, int, int]] = []
    for f in found:
        if all(f[3] <= k[2] or f[2] >= k[3] for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda k: (k[2], k[0]))


def scan(
    documents: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    id_col: str = "doc_id",
    text_col: str = "text",
    coverage: float = COVERAGE,
    gram: int = GRAM,
    window: int = WINDOW,
    band: int = BAND,
) -> DataFrame:
    """One row per match: (id_col, license, n_matched, n_template, coverage, start_word, end_word, span).

    Word positions count the text's runs of letters and digits from 0, the end is exclusive; span is the
    matched part of the lower-cased text. Repeated rows repeat their matches; null ids are kept.
    """
    index = index_templates(templates, gram, window, band)
    kind = documents.select(F.col(id_col).alias(id_col)).schema[0].dataType.simpleString()
    columns = [id_col, "license", "n_matched", "n_template", "coverage", "start_word", "end_word", "span"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["text"].notna()]
            ids, out = pdf["id"].tolist(), []
            for first, texts in _pieces(pdf["text"].tolist()):
                whole, words, starts, ends, offsets = _words(texts)
                grams = _grams(words, index.gram)
                if not len(grams) or not len(index.keys):
                    continue
                place = np.minimum(np.searchsorted(index.keys, grams), len(index.keys) - 1)
                hit = np.flatnonzero(index.keys[place] == grams)
                for doc in np.unique(np.searchsorted(offsets, hit, side="right") - 1):
                    base = offsets[doc]
                    for t, m, a, b in scan_words(words[base : offsets[doc + 1]], index, coverage):
                        size = len(index.words[t])
                        out.append((ids[first + doc], index.names[t], m, size, m / size, a, b, whole[starts[base + a] : ends[base + b - 1]]))
            yield pd.DataFrame(out, columns=columns)

    schema = f"`{id_col}` {kind}, license string, n_matched long, n_template long, coverage double, start_word long, end_word long, span string"
    return bounded_batches(documents).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
