"""License scan by patience alignment.

Plan
----
1. Texts and templates become words (ASCII case folded; only letters, digits
   and dots inside numbers count).
2. A text is searched for a template only where enough of the template's words
   lie close together: windows of ``SPREAD`` times the template's length.
3. In a window, words that are unique in both the text and the template are the
   anchors; the longest increasing subsequence of their places is kept, and the
   gaps between anchors are aligned in the same way.  A gap without anchors is
   aligned by its longest common subsequence, in linear space.
4. Coverage is the share of the template's words that are matched.  A match
   needs ``COVERAGE`` of the template and ``DENSITY`` of the text it spans, and
   the phrases that tell its license from others (``TELLING``) must be matched
   in one piece each; of matches that overlap the one with more matched words
   stays.

One pass over whole texts, without shuffles; the templates are a fixed list.

Defined results: null and empty texts have no licenses.  A license that occurs
several times is reported each time.  A BSD notice of which only the words that
all variants share is there is reported as ``BSD``.  Of the long license texts
(GNU, Apache, Mozilla) the title lines are templates, not the bodies.  Every
row gives one row, so repeated rows and null ids stay as they are, and matches
that tie go to the earlier place, then the name.  Only id and text are read, so
other columns, whatever their names, play no part; an empty table gives an
empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ruleframe.llm.common import mapped

COVERAGE = 0.8
DENSITY = 0.6
SPREAD = 1.5

# Public license notices.
_GNU = "is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = (
    f"{_BSD}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_CC = "This work is licensed under the Creative Commons Attribution{0} 4.0 International License."

TEMPLATES: dict[str, tuple[str, ...]] = {
    "0BSD": (f'{_ISC}. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE',),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        f"This program {_GNU.format('Affero General Public License', '3')}",
        "GNU Affero General Public License Version 3, 19 November 2007",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "Apache License Version 2.0, January 2004",
    ),
    "BSD": (_BSD,),
    "BSD-2-Clause": (_BSD_2, "Released under the BSD 2-Clause License."),
    "BSD-3-Clause": (
        f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Released under the BSD 3-Clause License.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", _CC.format("")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", _CC.format("-NonCommercial")),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.", _CC.format("-NonCommercial-NoDerivatives")),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.", _CC.format("-NonCommercial-ShareAlike")),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", _CC.format("-NoDerivatives")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", _CC.format("-ShareAlike")),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        f"This program {_GNU.format('General Public License', '2')}",
        "GNU General Public License Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        f"This program {_GNU.format('General Public License', '3')}",
        "GNU General Public License Version 3, 29 June 2007",
    ),
    "ISC": (_ISC, f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies"),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        f"This library {_GNU.format('Lesser General Public License', '2.1')}",
        "GNU Lesser General Public License Version 2.1, February 1999",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        f"This library {_GNU.format('Lesser General Public License', '3')}",
        "GNU Lesser General Public License Version 3, 29 June 2007",
    ),
    "MIT": ("Released under the MIT License.", _MIT),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0"),
}

# What tells a license from those that share its words; a template needs those phrases that it holds.
TELLING: dict[str, tuple[str, ...]] = {
    "0BSD": ("disclaims all warranties",),
    "AGPL-3.0": ("gnu affero general public", "version 3"),
    "Apache-2.0": ("apache", "2.0"),
    "BSD-2-Clause": ("bsd 2 clause", "redistributions in binary form"),
    "BSD-3-Clause": ("bsd 3 clause", "neither the name", "endorse or promote"),
    "CC-BY-4.0": ("by 4.0", "attribution 4.0"),
    "CC-BY-NC-4.0": ("by nc 4.0", "attribution noncommercial 4.0"),
    "CC-BY-NC-ND-4.0": ("by nc nd 4.0", "attribution noncommercial noderivatives 4.0"),
    "CC-BY-NC-SA-4.0": ("by nc sa 4.0", "attribution noncommercial sharealike 4.0"),
    "CC-BY-ND-4.0": ("by nd 4.0", "attribution noderivatives 4.0"),
    "CC-BY-SA-4.0": ("by sa 4.0", "attribution sharealike 4.0"),
    "GPL-2.0": ("gnu general public", "version 2"),
    "GPL-3.0": ("gnu general public", "version 3"),
    "LGPL-2.1": ("gnu lesser general public", "version 2.1"),
    "LGPL-3.0": ("gnu lesser general public", "version 3"),
    "MIT": ("mit",),
    "MPL-2.0": ("mozilla public", "2.0"),
}

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 or c == 46 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return [s for w in (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split() if (s := w.strip(b"."))]


def increasing(places: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, p in enumerate(places):
        at = bisect_left(tails, p)
        back.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(p)
            ends.append(i)
        else:
            tails[at], ends[at] = p, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each prefix of ``b``."""
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence, by halving ``a``: memory grows with the lengths, not their product."""
    shared = set(a) & set(b)
    if not shared:
        return []
    if len(a) == 1 or len(b) == 1:
        word = next(w for w in a if w in shared)
        return [(a.index(word), b.index(word))]
    number = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    xs, ys = (np.array([number[w] for w in side], dtype=np.int64) for side in (a, b))
    out: list[tuple[int, int]] = []
    parts = [(0, len(xs), 0, len(ys))]
    while parts:
        a0, a1, b0, b1 = parts.pop()
        if a1 - a0 == 1:
            out += [(a0, b0 + int(j)) for j in np.flatnonzero(ys[b0:b1] == xs[a0])[:1]]
        elif a1 > a0 and b1 > b0:
            mid = (a0 + a1) // 2
            both = _row(xs[a0:mid], ys[b0:b1]) + _row(xs[mid:a1][::-1], ys[b0:b1][::-1])[::-1]
            # Of equally long ones the one whose words come first in ``a``.
            cut = b1 - int(np.argmax(both[::-1]))
            parts += [(a0, mid, b0, cut), (mid, a1, cut, b1)]
    return sorted(out)


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of ``a`` and ``b`` by recursive patience alignment."""
    out: list[tuple[int, int]] = []
    open_gaps = [(0, len(a), 0, len(b))]
    while open_gaps:
        a0, a1, b0, b1 = open_gaps.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        both = [(i, place[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in place]
        if not both:
            out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        anchors = [both[i] for i in increasing([j for _, j in both])]
        out += anchors
        marks = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        open_gaps += [(i + 1, k, j + 1, n) for (i, j), (k, n) in zip(marks, marks[1:], strict=False)]
    return sorted(out)


def telling(name: str, template: list[bytes]) -> list[tuple[int, int]]:
    """Places (first, end) in the template of the phrases that its license needs."""
    out = []
    for phrase in map(words_of, TELLING.get(name, ())):
        out += [(i, i + len(phrase)) for i in range(len(template)) if template[i : i + len(phrase)] == phrase][:1]
    return out


class Scanner:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.templates = [(name, number, words_of(t)) for name, texts in sorted(templates.items()) for number, t in enumerate(texts)]
        self.telling = [telling(name, t) for name, _, t in self.templates]
        self.words = {w: i for i, w in enumerate(sorted({w for *_, t in self.templates for w in t}))}
        self.sets = []
        for *_, t in self.templates:
            mask = np.zeros(len(self.words) + 1, dtype=bool)
            mask[[self.words[w] for w in t]] = True
            self.sets.append(mask)

    @staticmethod
    def _match(words: list[bytes], start: int, width: int, template: list[bytes], need: int, needed: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        """First and end word and matched words of an alignment that begins at ``start``."""
        pairs = align(words[start : start + width], template)
        if len(pairs) < need or pairs[0][0] > 0 or len(pairs) < DENSITY * (pairs[-1][0] + 1):
            return None
        place = {j: i for i, j in pairs}
        for first, end in needed:
            if any(j not in place for j in range(first, end)) or place[end - 1] - place[first] != end - 1 - first:
                return None
        return start, start + pairs[-1][0] + 1, len(pairs)

    def scan(self, text: str | None) -> list[tuple[int, int, str, int, int]]:
        """(first word, end word, license, matched words, template words)."""
        words = words_of(text)
        none = len(self.words)
        get = self.words.get
        ids = np.fromiter((get(w, none) for w in words), dtype=np.int32, count=len(words))
        there = np.zeros(none + 1, dtype=bool)
        there[ids] = True
        found: list[tuple[int, int, str, int, int]] = []
        for (name, _, template), mask, needed in zip(self.templates, self.sets, self.telling, strict=True):
            need = int(np.ceil(COVERAGE * len(template) - 1e-9))
            # Enough of the template's words must occur at all, repeats counted as often as the template has them.
            if sum(1 for w in template if there[self.words[w]]) < need or not all(there[self.words[w]] for a, b in needed for w in template[a:b]):
                continue
            hits = np.flatnonzero(mask[ids])
            width = int(len(template) * SPREAD) + 2
            close = np.searchsorted(hits, hits + width) - np.arange(len(hits)) >= need
            starts = hits[close].tolist()
            i = 0
            while i < len(starts):
                match = self._match(words, starts[i], width, template, need, needed)
                if not match:
                    i += 1
                    continue
                # A stray word may stand before the notice: later starts can match as much in less text.
                j = i + 1
                while j < len(starts) and starts[j] < match[1] - need + 1:
                    other = self._match(words, starts[j], width, template, need, needed)
                    if other and (-other[2], other[1] - other[0]) < (-match[2], match[1] - match[0]):
                        match = other
                    j += 1
                found.append((match[0], match[1], name, match[2], len(template)))
                i = bisect_left(starts, match[1], i + 1)
        kept: list[tuple[int, int, str, int, int]] = []
        for f in sorted(found, key=lambda f: (-f[3], -f[3] / f[4], f[0], f[2])):
            if all(f[1] <= k[0] or f[0] >= k[1] for k in kept):
                kept.append(f)
        return sorted(kept)


def scan(docs: DataFrame, text: str = "text", row_id: str = "doc_id", templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """``<row_id>, n_licenses, licenses, matches`` for every row of ``docs``.

    ``licenses`` are the distinct names; ``matches`` holds
    name:first_word:end_word:coverage in thousandths, comma-joined.
    """
    kind = docs.schema[row_id].dataType.simpleString()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in source:
            found = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([",".join(sorted({m[2] for m in f})) for f in found], pa.string()),
                    pa.array([",".join(f"{m[2]}:{m[0]}:{m[1]}:{1000 * m[3] // m[4]}" for m in f) for f in found], pa.string()),
                ],
                names=[row_id, "n_licenses", "licenses", "matches"],
            )

    return docs.select(F.col(row_id), F.col(text)).transform(mapped, run, f"`{row_id}` {kind}, n_licenses bigint, licenses string, matches string")
