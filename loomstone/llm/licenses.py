"""License scans by conditional compression.

In texts that may state a license, every run of words that is as similar to a template
as LEAST asks is found by an exact alignment; stretches without enough of the template's words
are skipped, as they cannot hold one. Each run found is a candidate block: it is compressed
alone and with each template as a raw zstandard dictionary. Of candidates that overlap, the one whose
template takes the most bytes off stands, and its exact wording differences are given. What a template
saves is measured on the run, so it does not depend on the text around, and drops nothing.
"""

from __future__ import annotations

import bisect
import difflib
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed wordings of public licenses and notices. A name may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.""",
    ),
    (
        "BSD-3-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to
endorse or promote products derived from this software without specific prior written permission.""",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    (
        "GPL-2.0",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ),
    (
        "LGPL-3.0",
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/.""",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Least share of equal words for a confirmed match.
LEAST = 0.85
#: The same in whole points: a run that shares `own` words with a template of n has 2 * own / (n + run) >= LEAST just if SAME * own - EACH * run >= EACH * n.
SAME, EACH = 40, 17
#: Bits of a run's start below its points.
PLACE = 32

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def gate(templates=TEMPLATES) -> str:
    """A pattern that each match holds, as alternative words.

    A match has at least n * EACH / (SAME - EACH) of the template's n words, so it has one of any
    words that are together more of them than it can lack: the longest ones are taken.
    """
    found: set[str] = set()
    for _, text in templates:
        own = words(text)
        lack = len(own) - -(-len(own) * EACH // (SAME - EACH))
        count = 0
        for w in sorted(set(own), key=lambda w: (w not in found, -len(w), w)):
            if count > lack:
                break
            found.add(w)
            count += own.count(w)
    # a word that holds another one is found with it
    return "|".join(re.escape(w) for w in sorted(found) if not any(x != w and x in w for x in found))


class Scanner:
    """Compressors and word tables for all templates, made once for each task."""

    def __init__(self, templates=TEMPLATES):
        self.templates = [(name, words(text)) for name, text in templates]
        self.alone = zstandard.ZstdCompressor(level=3)
        self.given = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, w in self.templates]
        self.number: dict[str, int] = {}
        for _, template in self.templates:
            for w in template:
                self.number.setdefault(w, len(self.number))
        # For each template, a row for each word and last one for all others: the gain where the word stands.
        self.gain = []
        for _, template in self.templates:
            equal = np.arange(len(self.number) + 1)[:, None] == np.array([self.number[w] for w in template])
            self.gain.append(np.where(equal, SAME - EACH << PLACE, -(1 << 60)))
        self.inside = [(g > 0).any(1) for g in self.gain]

    def saved(self, run: str, i: int) -> tuple[int, float]:
        """How many bytes template i takes off a run's compressed size, and what share of it."""
        data = run.encode()
        alone = len(self.alone.compress(data))
        off = alone - len(self.given[i].compress(data))
        return off, off / alone

    def stretches(self, block: np.ndarray, i: int) -> list[tuple[int, int]]:
        """(low, high) of the words that can be in a match with template i.

        A match has at least n * EACH / (SAME - EACH) of the template's n words in
        at most n * (SAME - EACH) / EACH words: all windows of that length with so many are covered.
        """
        n = len(self.templates[i][1])
        wide, need = min(n * (SAME - EACH) // EACH, len(block)), -(-n * EACH // (SAME - EACH))
        sums = np.concatenate(([0], np.cumsum(self.inside[i][block])))
        starts = np.flatnonzero(sums[wide:] - sums[:-wide] >= need)
        if not len(starts):
            return []
        breaks = np.flatnonzero(np.diff(starts) > wide) + 1
        return [(int(x[0]), int(x[-1]) + wide) for x in np.split(starts, breaks)]

    def align(self, block: np.ndarray, low: int, high: int, i: int) -> list[tuple[int, int, int]]:
        """(points, first, last) of the best run that ends at each word of a stretch, of those that reach LEAST.

        Best is by points for the longest common subsequence with the template, in one
        pass for all runs: best[j] has the points, and below them the start, of the best
        run up to here against the template's first j words.
        """
        gain, n = self.gain[i], len(self.templates[i][1])
        best, found = np.full(n + 1, low, np.int64), []
        for at in range(low, high):
            new = best - (EACH << PLACE)
            np.maximum(new[1:], best[:-1] + gain[block[at]], out=new[1:])
            new[0] = at + 1
            best = np.maximum.accumulate(new)
            points = int(best[n]) >> PLACE
            if points >= EACH * n:
                found.append((points, int(best[n]) & ((1 << PLACE) - 1), at + 1))
        return found

    def runs(self, block: np.ndarray, i: int) -> list[tuple[int, int, int]]:
        """(points, first, last) of all matches of a block with template i that do not overlap: the best of each stretch first, then those in the gaps between."""
        least = -(-len(self.templates[i][1]) * EACH // (SAME - EACH))
        found, open_ = [], self.stretches(block, i)
        while open_:
            low, high = open_.pop()
            taken: list[tuple[int, int, int]] = []  # by place
            for points, first, last in sorted(self.align(block, low, high, i), key=lambda x: (-x[0], x[1])):
                at = bisect.bisect(taken, first, key=lambda x: x[0])
                if (not at or taken[at - 1][1] <= first) and (at == len(taken) or last <= taken[at][0]):
                    taken.insert(at, (first, last, points))
            found += [(points, first, last) for first, last, points in taken]
            if taken:
                edges = zip([low, *(x[1] for x in taken)], [*(x[0] for x in taken), high], strict=True)
                open_ += [(a, b) for a, b in edges if b - a >= least]
        return found

    def differences(self, run: list[str], template: list[str]) -> list[str]:
        codes = difflib.SequenceMatcher(None, template, run, autojunk=False).get_opcodes()
        return [f"-{' '.join(template[i1:i2])} +{' '.join(run[j1:j2])}" for tag, i1, i2, j1, j2 in codes if tag != "equal"]

    def numbers(self, text: str) -> tuple[array, array, np.ndarray]:
        """Where each word of a text starts and stops, and its number."""
        starts, stops, found, other = array("q"), array("q"), array("i"), len(self.number)
        for m in WORD.finditer(text):
            starts.append(m.start())
            stops.append(m.end())
            found.append(self.number.get(m[0].lower(), other))
        return starts, stops, np.frombuffer(found, np.int32)

    def scan(self, text: str) -> list[tuple]:
        """(license, start, end, saved, similarity, differences) of the licenses stated, one for each name and place, in order; those inside another's place are left out."""
        starts, stops, block = self.numbers(text)
        found = []
        for i, (_, template) in enumerate(self.templates):
            for points, first, last in self.runs(block, i) if len(block) else ():
                run = words(text[starts[first] : stops[last - 1]])
                off, share = self.saved(" ".join(run), i)
                found.append((off, share, 2 * (points + EACH * len(run)) / SAME / (len(template) + len(run)), first, last, i))
        # Of runs that overlap, the one that its template takes the most off wins, then the more similar one.
        found.sort(key=lambda x: (-x[0], -x[2], x[3], x[5]))
        kept: list[tuple] = []  # by place
        for x in found:
            at = bisect.bisect(kept, x[3], key=lambda y: y[3])
            if (not at or kept[at - 1][4] <= x[3]) and (at == len(kept) or x[4] <= kept[at][3]):
                kept.insert(at, x)
        out = []
        for _, share, similarity, first, last, i in kept:
            name, template = self.templates[i]
            start, stop = starts[first], stops[last - 1]
            out.append((name, start, stop, round(share, 6), round(similarity, 6), self.differences(words(text[start:stop]), template)))
        return out


FOUND = "doc_id long, license string, start long, stop long, saved double, similarity double, n_differences int, differences array<string>"


def _scan(batches):
    scanner, holds = Scanner(), gate()
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.string())]
    for batch in batches:
        may = pc.match_substring_regex(batch.column("text"), pattern=holds, ignore_case=True)
        rows = []
        some = batch.filter(may)
        for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text"), strict=True):
            rows += [(doc_id, *x[:5], len(x[5]), x[5]) for x in scanner.scan(text.as_py())]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def scan(docs: DataFrame) -> DataFrame:
    """A row for each license that a text of `docs` (doc_id, text; other columns are ignored) states.

    start and stop count characters. Null and empty texts, and such as hold no word of
    gate(), give no rows; rows that repeat give their rows each time;
    an empty table gives none. Texts are scanned whole, each by itself, across lines and paragraphs.
    Of licenses that tie in the bytes saved and in similarity, the one that TEMPLATES has first is given.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, FOUND)
