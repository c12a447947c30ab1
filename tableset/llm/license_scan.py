"""Licences in texts, by the Dice coefficient of word bigrams with licence templates.

Templates are short notices, grants of several sentences and whole licence texts. A text is
compared in passages: every line, every paragraph (lines between blank ones) of more than one
line, the whole text if it has several paragraphs, and, for licences that start or end within
these, windows of words wherever they begin. With 2 * common / (passage + template) of at
least the threshold t, sizes can differ by the factor t / (2 - t) at most, and that share of
the template's bigrams must be in the text. So a text that has too few bigrams of a template
isn't compared with it, nor is a window that has too few; what is left is counted in full.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, repeat
from pkgutil import get_data

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Short notices of public licences and the openings of their texts, by SPDX identifier.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# Grants and notices of more than one sentence.
GRANTS = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    *(
        (name, f"This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} License as published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details.")
        for name, what, mark, kind, number in (
            ("GPL-2.0", "program", ";", "General Public", "2"),
            ("GPL-3.0", "program", ":", "General Public", "3"),
            ("LGPL-2.1", "library", ";", "Lesser General Public", "2.1"),
            ("LGPL-3.0", "library", ":", "Lesser General Public", "3"),
            ("AGPL-3.0", "program", ":", "Affero General Public", "3"),
        )
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: Licences with their whole text in the folder ``licenses``.
WHOLE = ("Apache-2.0", "MIT", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "MPL-2.0", "CC0-1.0", "BSL-1.0", "Unlicense")
TEMPLATES = (*NOTICES, *GRANTS, *((name, get_data(__name__, f"licenses/{name}.txt").decode()) for name in WHOLE))
#: Least Dice coefficient, in percent.
PERCENT = 80
_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> Counter:
    """Pairs of neighbouring words, as often as they occur; of one word, that word."""
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter(words)


class Kept:
    """Spans by group; those of a group don't overlap, so that neighbours are found by bisection."""

    def __init__(self):
        self.groups: dict[tuple, list[tuple[int, int, float]]] = {}

    def add(self, group: tuple, start: int, end: int, dice: float) -> None:
        insort(self.groups.setdefault(group, []), (start, end, dice))

    def told(self, license: str, start: int, end: int, dice: float) -> bool:
        """Whether a span tells this one already: a window or a longer passage of its licence that
        overlaps it, or a span of another licence, as alike, that lies in the same place."""
        for (name, kind), spans in self.groups.items():
            at = max(0, bisect_left(spans, (start,)) - 1)
            while at < len(spans) and spans[at][0] < end:
                a, b, d = spans[at]
                at += 1
                if b <= start:
                    continue
                if name == license:
                    if kind == "window" or b - a >= end - start:
                        return True
                elif (kind == "window" or d >= dice) and 2 * (min(b, end) - max(a, start)) > max(b - a, end - start):
                    return True
        return False


class Index:
    def __init__(self, templates: tuple[tuple[str, str], ...], percent: int):
        self.names, self.percent = [n for n, _ in templates], percent
        self.grams = [bigrams(t) for _, t in templates]
        self.sizes = np.array([g.total() for g in self.grams])
        #: Least bigrams in common, and most bigrams of a passage, at which the threshold can be reached.
        self.need = -(-self.sizes * percent // (200 - percent))
        self.most = self.sizes * (200 - percent) // percent
        #: Templates of one word match that word alone.
        self.single: dict[str, int] = {}
        pairs: dict[tuple[str, str], int] = {}
        for i, grams in enumerate(self.grams):
            for g in grams:
                if isinstance(g, str):
                    self.single.setdefault(g, i)
                else:
                    pairs.setdefault(g, len(pairs))
        self.words: dict[str, int] = {}
        for w in (w for pair in pairs for w in pair):
            self.words.setdefault(w, len(self.words))
        codes = np.array([self.words[a] * len(self.words) + self.words[b] for a, b in pairs], np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        #: How often each template has each bigram.
        self.counts = np.zeros((len(pairs), len(templates)), np.int32)
        for i, grams in enumerate(self.grams):
            for g, n in grams.items():
                if not isinstance(g, str):
                    self.counts[pairs[g], i] = n
        self.counts = self.counts[order]

    def numbers(self, words: list[str]) -> np.ndarray:
        """Bigrams of the words as rows of ``counts``; -1 for those of no template."""
        at = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        out = np.full(max(0, len(words) - 1), -1, np.int64)
        known = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        if len(known):
            codes = at[known] * len(self.words) + at[known + 1]
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit = self.codes[place] == codes
            out[known[hit]] = place[hit]
        return out

    def common(self, grams: np.ndarray, of: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Bigrams in common with each of the templates ``of``."""
        found, n = np.unique(grams[grams >= 0], return_counts=True)
        return np.minimum(self.counts[found][:, of], n[:, None]).sum(0)

    def best(self, passage: str) -> tuple[int, float] | None:
        """Template of the largest coefficient that reaches the threshold (the first of equals), and the coefficient."""
        words = _WORD.findall(passage.lower())
        return self._best(words, self.numbers(words), np.arange(len(self.names)))

    def _best(self, words: list[str], grams: np.ndarray, rivals: np.ndarray) -> tuple[int, float] | None:
        if len(words) < 2:
            return (self.single[words[0]], 1.0) if words and words[0] in self.single else None
        n, t = len(grams), self.percent
        sizes = self.sizes[rivals]
        rivals = rivals[(sizes * t <= n * (200 - t)) & (n * t <= sizes * (200 - t)) & (self.need[rivals] <= np.count_nonzero(grams >= 0))]
        if not len(rivals):
            return None
        twice, both = 2 * self.common(grams, rivals), n + self.sizes[rivals]
        dice = np.where(100 * twice >= t * both, twice / both, 0)
        i = int(dice.argmax())
        return (int(rivals[i]), float(dice[i])) if dice[i] else None

    def windows(self, grams: np.ndarray, i: int) -> Iterator[tuple[int, int, int, float]]:
        """From every bigram of template ``i`` the window of the largest coefficient, if that
        reaches the threshold: first and last bigram, bigrams in common, coefficient."""
        count, size, need, t = self.counts[:, i], int(self.sizes[i]), int(self.need[i]), self.percent
        at = np.flatnonzero((grams >= 0) & (count[grams] > 0))
        reach = np.searchsorted(at, at + self.most[i]) - np.arange(len(at))
        starts = np.flatnonzero(reach >= need)
        if not len(starts):
            return
        # A bigram counts where the one that lies as many occurrences back as the template has is outside.
        own = grams[at]
        order = np.argsort(own, kind="stable")
        back = np.arange(len(at)) - count[own[order]]
        inside = (back >= 0) & (own[order[np.maximum(back, 0)]] == own[order])
        before = np.full(len(at), -1, np.int64)
        before[order[inside]] = order[back[inside]]
        for s in starts.tolist():
            part = slice(s, s + int(reach[s]))
            common = np.cumsum(before[part] < s)
            if common[-1] < need:
                continue
            both = at[part] - at[s] + 1 + size
            fits = np.flatnonzero(200 * common >= t * both)
            if len(fits):
                dice = 2 * common[fits] / both[fits]
                j = int(dice.argmax())
                yield int(at[s]), int(at[s + fits[j]]), int(common[fits[j]]), float(dice[j])

    def passages(self, text: str) -> Iterator[tuple[str, int, int]]:
        """Kind, start and end of all lines, paragraphs of several lines, and the text if it has several paragraphs."""
        start = first = last = None
        lines = paragraphs = at = 0
        for line in text.split("\n"):
            if line.strip():
                yield "line", at, at + len(line)
                first, start = (at if x is None else x for x in (first, start))
                last, lines = at + len(line), lines + 1
            elif start is not None:
                paragraphs += 1
                if lines > 1:
                    yield "paragraph", start, last
                start, lines = None, 0
            at += len(line) + 1
        if start is not None:
            paragraphs += 1
            if lines > 1:
                yield "paragraph", start, last
        if paragraphs > 1:
            yield "text", first, last

    def scan(self, text: str | None) -> list[dict]:
        lower = (text or "").lower()
        words = _WORD.findall(lower)
        grams = self.numbers(words)
        able = np.flatnonzero((self.common(grams) >= self.need) & (self.need > 0)) if np.count_nonzero(grams >= 0) >= self.need.min(initial=1) else np.empty(0, np.int64)
        if not len(able) and not (self.single and not self.single.keys().isdisjoint(words)):
            return []
        places = [m.span() for m in _WORD.finditer(lower)]
        if len(lower) != len(text):
            # A few letters have two code points in lower case.
            origin = [i for i, n in enumerate(accumulate(map(len, map(str.lower, text)))) for _ in range(len(text[i].lower()))]
            places = [(origin[a], origin[b - 1] + 1) for a, b in places]
        firsts = [a for a, _ in places]
        found, kept = [], Kept()
        for kind, a, b in self.passages(text):
            i, j = bisect_left(firsts, a), bisect_left(firsts, b)
            if hit := self._best(words[i:j], grams[i : max(i, j - 1)], able):
                found.append({"start": a, "end": b, "license": self.names[hit[0]], "dice": hit[1]})
                kept.add((self.names[hit[0]], kind), a, b, hit[1])
        rivals = [(-common, -dice, a, b, i) for i in able.tolist() for a, b, common, dice in self.windows(grams, i)]
        fresh = []
        for _, dice, a, b, i in sorted(rivals):
            start, end, name = places[a][0], places[b + 1][1], self.names[i]
            if not kept.told(name, start, end, -dice):
                kept.add((name, "window"), start, end, -dice)
                fresh.append({"start": start, "end": end, "license": name, "dice": -dice})
        return found + sorted(fresh, key=lambda x: x["start"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """Licence passages of every document.

    Returns ``id`` and ``spans`` (array of start, end, license, dice: code points, end
    exclusive), a row for each row of ``docs``. Words are runs of letters and digits in lower
    case. NULL, empty and wordless texts have no span. Of several templates that reach
    ``percent`` the one of the largest coefficient names the passage, the first of equals.

    Lines, paragraphs and the whole text come first, then windows by their start. Windows that
    overlap are settled by the most bigrams in common, then by the coefficient: one is left out
    beside a window or a longer passage of its licence, and in the place of another licence that
    fits as well; a notice within a longer licence of another name stays. Templates of one word
    are compared with passages only.
    """

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(templates, percent)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))
        for texts in batches:
            yield pa.array([index.scan(t.as_py()) for t in texts], kind)

    scan.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    spans = F.arrow_udf(scan, "array<struct<start:int,end:int,license:string,dice:double>>")
    return docs.select(F.col(id_col).alias("id"), spans(F.col(text_col)).alias("spans"))
