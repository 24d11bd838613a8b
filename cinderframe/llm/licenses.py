"""Licence scans: Dice coefficient of word bigrams between normalised text and templates.

A document is compared as a whole, by paragraph, by line and by every window of a
template's own number of words. A template and a unit of a and b distinct bigrams cannot
reach a coefficient t unless a / b lies between t / (2 - t) and its inverse, so sizes prune
most templates; and a unit needs a number of bigrams that occur in any template, which
prunes most units before that. A window needs t / (2 - t) of its template's bigrams, so
windows are compared only around places where that many lie close enough.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderframe.llm.shared import batch_bytes, by_value, text_chunks
from cinderframe.llm.words import U, WordHasher, alphanumeric, mix

by_value(__name__)

# Public licence notices and texts.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "BSD disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0-or-later header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "MIT disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT notice": "Released under the MIT License.",
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
UNITS = ("text", "paragraph", "line", "window")
#: Windows that are compared at once; bounds the memory of a text with very many.
WINDOWS = 4096


def bigram_hashes(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * U(3) + hashes[1:] * U(0x9E3779B97F4A7C15)) if len(hashes) > 1 else np.zeros(0, U)


def matching(found: np.ndarray, belongs: np.ndarray, vocabulary: np.ndarray, sizes: np.ndarray, least: float) -> list[tuple[float, int]]:
    """(coefficient, template) of every template that a unit with distinct bigrams ``found`` reaches."""
    n = len(found)
    fits = (sizes * least <= (2 - least) * n) & (n * least <= (2 - least) * sizes)
    if not fits.any():
        return []
    at = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
    common = belongs[at[vocabulary[at] == found]].sum(axis=0)
    dice = np.where(fits, 2.0 * common / (n + sizes), 0.0)
    return [(float(dice[k]), int(k)) for k in np.flatnonzero(dice >= least)]


def best_window(grams: np.ndarray, own: np.ndarray, width: int, first: int, last: int, size: int, least: float):
    """(coefficient, start) of the best window of ``width`` words among words ``first`` to ``last``, or None; earlier windows win ties.

    ``own`` are the places of bigrams of the template, which has ``size`` distinct ones. A window
    can reach ``least`` only if it holds ``least / (2 - least)`` of that many places.
    """
    need = int(np.ceil(least / (2 - least) * size - 1e-9))
    if len(own) < need or last - first < width:
        return None
    lows, highs = np.maximum(own[need - 1 :] - width + 2, first), np.minimum(own[: len(own) - need + 1], last - width)
    change = np.zeros(last - first + 2, np.int64)
    some = lows <= highs
    np.add.at(change, lows[some] - first, 1)
    np.add.at(change, highs[some] - first + 1, -1)
    starts = np.flatnonzero(np.cumsum(change) > 0) + first
    mine = np.zeros(last - first, bool)
    mine[own - first] = True
    best = None
    for k in range(0, len(starts), WINDOWS):
        places = starts[k : k + WINDOWS, None] + np.arange(width - 1)
        order = np.argsort(grams[places], axis=1, kind="stable")
        values = np.take_along_axis(grams[places], order, 1)
        new = np.ones(values.shape, bool)
        new[:, 1:] = values[:, 1:] != values[:, :-1]
        common = (new & np.take_along_axis(mine[places - first], order, 1)).sum(axis=1)
        dice = 2.0 * common / (new.sum(axis=1) + size)
        top = int(dice.argmax())
        if dice[top] >= least and (best is None or dice[top] > best[0]):
            best = (float(dice[top]), int(starts[k + top]))
    return best


def _scan(names: list[str], texts: list[str], least: float):
    def run(batches):
        import pyarrow as pa

        hasher = WordHasher(alphanumeric())
        sets, widths = [], []
        for text in texts:
            raw = np.frombuffer(text.encode(), np.uint8)
            words = hasher.words(raw, np.array([0, len(raw)]))[2]
            widths.append(len(words))
            sets.append(np.unique(bigram_hashes(words)))
        sizes = np.array([len(s) for s in sets])
        vocabulary = np.unique(np.concatenate(sets))
        belongs = np.array([np.isin(vocabulary, s) for s in sets]).T.astype(np.int64)
        needed = int(np.ceil(least / 2 * sizes.min() * (1 + least / (2 - least)) - 1e-9))
        for batch in batches:
            ids, out = [], []
            for first, last, data, bounds in text_chunks(batch.column(1)):
                matches: list[dict[int, tuple]] = [{} for _ in range(last - first)]
                starts, _, hashes, at = hasher.words(data, bounds)

                def offer(row: int, template: int, dice: float, rank: int, start: int, words: int) -> None:
                    """Keep a template's best place: larger coefficient, then larger unit, then earlier."""
                    new = (-dice, rank, start - int(at[row]), words)
                    matches[row][template] = min(new, matches[row].get(template, new))

                text_of = np.repeat(np.arange(last - first), np.diff(at))
                grams = bigram_hashes(hashes)
                near = np.minimum(np.searchsorted(vocabulary, grams), len(vocabulary) - 1)
                known = vocabulary[near] == grams
                breaks = np.flatnonzero(data == 10)
                line_of = np.searchsorted(breaks, starts) + text_of
                # A paragraph begins at a text's first word and where only white space with two line breaks or more lies before.
                gap = data != 10
                gap &= ~np.isin(data, np.frombuffer(b" \t\r\x0b\x0c", np.uint8))
                solid = np.concatenate([[0], np.cumsum(gap)])
                blank = np.flatnonzero(solid[breaks[1:]] == solid[breaks[:-1] + 1]) if len(breaks) > 1 else np.zeros(0, np.int64)
                paragraph_of = np.searchsorted(breaks[blank + 1] if len(blank) else breaks[:0], starts) + text_of
                inside = text_of[:-1] == text_of[1:]
                for rank, unit_of in enumerate((text_of, paragraph_of, line_of)):
                    if not len(grams):
                        break
                    whole = (unit_of[:-1] == unit_of[1:]) & inside
                    hits = np.bincount(unit_of[:-1][whole & known], minlength=unit_of[-1] + 1)
                    for unit in np.flatnonzero(hits >= needed).tolist():
                        a, b = np.searchsorted(unit_of, [unit, unit + 1]).tolist()
                        for dice, template in matching(np.unique(grams[a : b - 1][whole[a : b - 1]]), belongs, vocabulary, sizes, least):
                            offer(int(text_of[a]), template, dice, rank, a, b - a)
                places = np.flatnonzero(known & inside) if len(grams) else np.zeros(0, np.int64)
                member = belongs[near[places]] > 0
                for template, (width, size) in enumerate(zip(widths, sizes.tolist())):
                    own = places[member[:, template]]
                    counts = np.bincount(text_of[own], minlength=last - first)
                    for row in np.flatnonzero(counts >= least / (2 - least) * size - 1e-9).tolist():
                        a, b = np.searchsorted(own, at[row : row + 2]).tolist()
                        best = best_window(grams, own[a:b], width, int(at[row]), int(at[row + 1]), size, least)
                        if best:
                            offer(row, template, best[0], UNITS.index("window"), best[1], width)
                for row, mine in enumerate(matches, first):
                    rows = [(names[t], -d, UNITS[rank], start, words) for t, (d, rank, start, words) in sorted(mine.items())]
                    out += rows or [(None,) * 5]
                    ids += [row] * max(len(rows), 1)
            kinds = [pa.string(), pa.float64(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), *columns], ["id", "license", "dice", "unit", "start", "n_words"])

    return run


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, dice, unit, start, n_words): every template of at least ``least`` in a document, at its best place.

    Words are runs of ASCII letters and digits and of other scripts' characters, A-Z
    lower-cased; a unit is the text, a paragraph between blank lines, a line, or any window of as
    many words as the template has, and its set the distinct bigrams. The best place has the largest
    coefficient, then the larger unit, then the smaller ``start`` (the number of its first word in the text).
    A row without a match gives one row of nulls, as null, empty and one-word texts do. Templates need two
    words or more. Repeated rows and null ids are scanned row by row; other columns are ignored.
    """
    batch_bytes(docs.sparkSession)
    names = sorted(n for n in templates if len(re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", templates[n])) > 1)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    run = _scan(names, [templates[n] for n in names], least)
    out = "id long, license string, dice double, unit string, start long, n_words long"
    return source.mapInArrow(run, out).withColumnRenamed("id", id_col)
