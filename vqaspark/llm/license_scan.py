"""Operator 4: licenses by conditional compression.

Sentences with a licensing word, and their neighbours with one, form candidate blocks; a sentence runs on over a single line
break.  The words of a block are compressed on their own and again with every template as raw zstandard dictionary; the part
of its size that a template saves ranks the templates.  In that order, the first template that an alignment confirms is the
license: its names and version numbers stand in the block in order, no other license's name stands between, and at most one
in five of its other telling words differ.  Confirmed templates that save as much, to within ``TIE``, are told apart by the
words aligned.  The aligned stretch is cut out and what stands before and behind it is judged again, so a block may hold
several licenses; the words that differ are reported.  A notice after "not" is none.  Long blocks are judged in overlapping
windows, so time is linear in them.  No saving is too small for a candidate: within a long sentence a short notice such as
"MIT licensed" saves no more than a dictionary of licensing words in general, which was tried as a threshold and lost notices.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: The notice of the Free Software Foundation, and the parts of the BSD licenses.
GNU = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_CLAUSES = (
    BSD + ": Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = ' This software is provided by the copyright holders and contributors "as is" and any express or implied warranties'
#: Licence templates: SPDX identifier, then wordings that public licence notices use (fixed values).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "MIT": [
        "MIT License.",
        "Licensed under the MIT License.",
        "Licensed under MIT.",
        "License: MIT.",
        "MIT licensed.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
    ],
    "GPL-2.0": ["licensed under the GNU General Public License, version 2.", "licensed under the GPL version 2.", GNU.format("program", "General Public", "2"), "SPDX-License-Identifier: GPL-2.0-only"],
    "GPL-3.0": ["licensed under the GNU General Public License, version 3.", "licensed under the GPL version 3.", "licensed under the GNU GPL, either version 3 of the License, or (at your option) any later version.", GNU.format("program", "General Public", "3"), "SPDX-License-Identifier: GPL-3.0-only"],
    "LGPL-2.0": ["licensed under the GNU Library General Public License, version 2.", GNU.format("library", "Library General Public", "2"), "SPDX-License-Identifier: LGPL-2.0-only"],
    "LGPL-2.1": ["licensed under the GNU Lesser General Public License, version 2.1.", "licensed under the LGPL version 2.1.", GNU.format("library", "Lesser General Public", "2.1"), "SPDX-License-Identifier: LGPL-2.1-only"],
    "LGPL-3.0": ["licensed under the GNU Lesser General Public License, version 3.", "licensed under the LGPL version 3.", GNU.format("library", "Lesser General Public", "3"), "SPDX-License-Identifier: LGPL-3.0-only"],
    "AGPL-3.0": ["licensed under the GNU Affero General Public License, version 3.", "licensed under the AGPL version 3.", GNU.format("program", "Affero General Public", "3"), "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Licensed under the 2-Clause BSD License.", BSD_CLAUSES + BSD_END, "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Licensed under the 3-Clause BSD License.", BSD, BSD_CLAUSES + BSD_THIRD + BSD_END, "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "ISC License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "Artistic-2.0": ["Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Creative Commons Zero v1.0 Universal"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
#: Words that say nothing about which license it is; they may differ or be missing.
NEUTRAL = frozenset("a an and any are as at file for in international is it licensed license of or public released software terms the this to under v version work you".split())
#: Words that name a license; one that is not the template's own must not stand within its wording.
NAMES = frozenset("affero agpl apache artistic attribution boost bsd bsl cc eclipse endorse epl gnu gpl isc lesser lgpl mit mozilla nc nd noderivatives noncommercial sa sharealike spdx unencumbered zero zlib".split())
SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "gplv": "gpl", "lgplv": "lgpl", "agplv": "agpl"}
TRIGGER = re.compile(
    r"licen[cs]|SPDX-|\bCC[ -](?:BY|0)|\bCC0\b|\b[AL]?GPL|creative\W+commons|permission\W+(?:is\W+hereby|to\W+use)|redistributions?\W+(?:and\W+use|of|in)\b|neither\W+the\W+name|provided\b[^.\n]*\n?[^.\n]*\bas\W+is\b|public\W+domain|general\W+public",
    re.I,
)
#: A sentence ends at ., ! or ? before white space (not in "v. 2.0"), at a line without a word, or at the end.
BREAK = re.compile(r"(?<!\bv)(?<!\bver)[.!?]+(?=\s|\Z)|\n(?:[^\w\n]*\n)+", re.I)
LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)*")
#: Shares of saved size that differ by less count as the same.
TIE = 0.02
#: Words of a block that are judged at once; a match begins in the first half, and no wording is as long as a half.
WINDOW = 600
#: Words that turn a notice into its contrary, within so many words before it.
DENIED, REACH = frozenset({"not", "never", "isn", "aren", "cannot"}), 4
#: Costs of a word that differs: neutral, telling, and never.
SLIGHT, TELLING, NEVER = 1, 10_000, 10**12


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end): runs of letters, and numbers without a final .0, as 2.0 and 2 name the same version."""
    out = []
    for m in WORD.finditer(text):
        w = m.group().lower()
        out.append((SAME.get(w, w.removesuffix(".0")), m.start(), m.end()))
    return out


def words(text: str) -> list[str]:
    return [w for w, _, _ in word_spans(text)]


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of neighbouring sentences with a licensing word; a text without one costs one search."""
    out: list[tuple[int, int]] = []
    breaks = None
    for m in TRIGGER.finditer(text):
        if out and m.end() <= out[-1][1]:
            continue
        breaks = breaks or [0, *(x.end() for x in BREAK.finditer(text)), len(text)]
        start = breaks[bisect_right(breaks, m.start()) - 1]
        end = next(x for x in breaks[bisect_right(breaks, m.start()) :] if x >= m.end())
        if out and (start < out[-1][1] or not LETTER.search(text, out[-1][1], start)):
            out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


class Wording:
    """A wording of a template, to be aligned with the words of a block."""

    def __init__(self, text: str, own: frozenset[str]):
        self.words, self.own = words(text), own
        telling = [w for w in self.words if w not in NEUTRAL]
        self.telling, self.most = len(telling), len(telling) // 5
        if self.most:
            must = {w for w in telling if w in NAMES or w[0].isdigit()}
        else:  # a name alone, such as mit, may be a common word
            must = {*telling} | ({"license", "licensed"} & {*self.words} if len(telling) == 1 else set())
        self.must = frozenset(must)
        self.lost = [NEVER if w in must else SLIGHT if w in NEUTRAL else TELLING for w in self.words]

    def align(self, block: list[str]) -> tuple[int, int, int, int] | None:
        """(telling words aligned, words that differ, first, end) of the best stretch of the block's words, or None.

        Least cost over all stretches; of several, the one in the middle.
        """
        n = len(block)
        more = np.array([0, *(SLIGHT if w in NEUTRAL or w in self.own else NEVER if w in NAMES else TELLING for w in block)], np.int64)
        run, place = np.cumsum(more), np.arange(n + 1)
        at: dict[str, list[int]] = {}
        for j, w in enumerate(block):
            at.setdefault(w, []).append(j)
        cost, first = np.zeros(n + 1, np.int64), place
        for w, lost in zip(self.words, self.lost, strict=True):
            step = np.maximum(more[1:], lost)
            step[at.get(w, [])] = 0
            slide = cost[:-1] + step
            new, start = cost + lost, first.copy()
            better = slide <= new[1:]
            new[1:][better], start[1:][better] = slide[better], first[:-1][better]
            left = new - run  # the cheapest way from the left, by words of the block that the wording lacks
            low = np.minimum.accumulate(left)
            came = np.maximum.accumulate(np.where(left == low, place, 0))
            cost, first = np.minimum(low + run, NEVER), start[came]
        ends = np.flatnonzero(cost == (least := int(cost.min())))
        if least // TELLING > self.most:
            return None
        end = int(ends[len(ends) // 2])
        return self.telling - least // TELLING, least // TELLING + least % TELLING, int(first[end]), end


class Scanner:
    def __init__(self):
        import zstandard as z

        def with_dictionary(wordings: list[str]) -> z.ZstdCompressor:
            kit = "\n".join(" ".join(words(w)) for w in wordings)
            return z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(kit.encode() * 2, dict_type=z.DICT_TYPE_RAWCONTENT))

        self.plain = z.ZstdCompressor(level=3)
        self.templates = []
        for name, wordings in TEMPLATES.items():
            sized = with_dictionary(wordings)
            own = NAMES & {*words(" ".join([name, *wordings]))}
            self.templates.append((name, sized, [Wording(w, own) for w in wordings]))
        self.judge = cache(self._judge)

    def ranked(self, block: list[str]) -> list[tuple[float, int]]:
        """(share of its size saved, template), the most saved first."""
        raw = " ".join(block).encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        return sorted(((1 - len(sized.compress(raw)) / alone, i) for i, (_, sized, _) in enumerate(self.templates)), key=lambda x: (-x[0], x[1]))

    def winner(self, block: list[str]) -> tuple[str, float, int, int, int] | None:
        """(identifier, share saved, words that differ, first, end) of a stretch of words, or None."""
        have = {*block}
        best, key, top = None, (), 0.0
        for saved, i in self.ranked(block):
            if best and saved < top - TIE:
                break
            name, _, wordings = self.templates[i]
            found = [x for w in wordings if w.must <= have and (x := w.align(block))]  # without all of them no stretch aligns
            if found:
                told, differ, first, end = max(found, key=lambda x: (x[0], -x[1]))
                top = top if best else saved
                if best is None or (told, -differ) > key:
                    best, key = (name, saved, differ, first, end), (told, -differ)
        return best

    def stretches(self, block: list[str]) -> list[tuple[str, float, int, int, int]]:
        """winner() of the block and of what each leaves before and behind it."""
        out, left = [], [(0, len(block))]
        while left:
            a, b = left.pop()
            if b > a and (found := self.winner(block[a:b])):
                name, saved, differ, first, end = found
                out.append((name, saved, differ, a + first, a + end))
                left += [(a, a + first), (a + end, b)]
        return sorted(out, key=lambda x: x[3])

    def _judge(self, block: str) -> list[tuple[str, int, int, float, int]]:
        spans = word_spans(block)
        plain, out, at = [w for w, _, _ in spans], [], 0
        while at < len(plain):
            last = at + WINDOW >= len(plain)
            to = at + WINDOW // 2
            for name, saved, differ, first, end in self.stretches(plain[at : at + WINDOW]):
                first, end = at + first, at + end
                if last or first < at + WINDOW // 2:
                    to = max(to, end)
                    if not DENIED & {*plain[max(0, first - REACH) : first]}:
                        out.append((name, spans[first][1], spans[end - 1][2], saved, differ))
            at = len(plain) if last else to
        joined: list[tuple[str, int, int, float, int]] = []
        for x in sorted(out, key=lambda x: x[1]):
            if joined and joined[-1][0] == x[0]:
                y = joined[-1]
                joined[-1] = (x[0], y[1], x[2], max(x[3], y[3]), x[4] + y[4])
            else:
                joined.append(x)
        return joined

    def scan(self, text: str) -> list[tuple[str, int, int, float, int]]:
        out = []
        for start, end in candidate_blocks(text):
            block = text[start:end]
            out += [(n, start + s, start + e, saved, differ) for n, s, e, saved, differ in (self.judge(block) if end - start <= 4000 else self._judge(block))]
        return out


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_blocks, licenses, spans) for every row.

    n_blocks: the licenses found, neighbours of the same identifier in a candidate block as one; licenses: the distinct
    identifiers in order, comma-joined; spans: identifier:start:end in code points of the words aligned, with the share of
    its block's size that the template saves and the number of words that differ.  A null or empty text, or one without a licensing
    word, has no block; a null id stays null; repeated rows give repeated results; further columns are not read; bytes that are no
    UTF-8 count as U+FFFD; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in common.slices(batches):
            rows = [scanner.scan(t) for t in b.column(1).to_pylist()]
            if scanner.judge.cache_info().currsize > 50_000:
                scanner.judge.cache_clear()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([",".join(sorted({x[0] for x in r})) for r in rows], pa.string()),
                    pa.array([",".join(f"{n}:{s}:{e}:{saved:.3f}:{differ}" for n, s, e, saved, differ in r) for r in rows], pa.string()),
                ],
                names=["doc_id", "n_blocks", "licenses", "spans"],
            )

    return common.texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_blocks long, licenses string, spans string")
