"""License scans by conditional compression.

A candidate block is as many words as a template has, laid so that the block and
the template have a word that begins grants in the same place.  Each block is
compressed alone and with its template as a zstandard raw dictionary, and what
shrinks by MIN_REDUCTION is ranked by the bytes saved.  In that order, winners
are confirmed by their exact differences in wording: nearly all words of the
template have to be there, and those that tell licenses apart all of them.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import small_batches

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
_BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_MIT_BODY = (
    ", including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
_APACHE_BODY = (
    " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
    '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_BODY = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
)
_BSD_ENDORSE = "to endorse or promote products derived from this software without specific prior written permission."
_BSD_NAMES = f"Neither the name of the copyright holder nor the names of its contributors may be used {_BSD_ENDORSE}"

#: Identifiers whose line of the form SPDX-License-Identifier: ... is a grant.
SPDX = (
    "Apache-2.0", "MIT", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "BSL-1.0", "Zlib", "EPL-2.0", "Unlicense",
)

#: Wordings of grants by SPDX identifier.  Fixed values: the notices that the licenses themselves ask for.
#: The BSD licenses begin alike, so their conditions tell them apart; the beginning alone is LicenseRef-BSD.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + _APACHE_BODY),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_BODY),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; " + _GNU.format("General Public", "2")),
    ("GPL-3.0", "This program is free software: " + _GNU.format("General Public", "3")),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("LGPL-2.1", "This library is free software; " + _GNU.format("Lesser General Public", "2.1")),
    ("LGPL-3.0", "This library is free software: " + _GNU.format("Lesser General Public", "3")),
    ("AGPL-3.0", "This program is free software: " + _GNU.format("Affero General Public", "3")),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("LicenseRef-BSD", _BSD),
    ("BSD-2-Clause", f"{_BSD}: {_BSD_CONDITIONS}"),
    ("BSD-3-Clause", f"{_BSD}: {_BSD_CONDITIONS} {_BSD_NAMES}"),
    ("BSD-3-Clause", f"{_BSD}: {_BSD_CONDITIONS} The name of the author may not be used {_BSD_ENDORSE}"),
    ("BSD-4-Clause", f"{_BSD}: {_BSD_CONDITIONS} {_BSD_ADVERTISING} {_BSD_NAMES}"),
    ("BSD-4-Clause", f"{_BSD}: {_BSD_CONDITIONS} {_BSD_ADVERTISING} The name of the author may not be used {_BSD_ENDORSE}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_BODY),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "All rights reserved."),
    *((n, f"SPDX-License-Identifier: {n}") for n in SPDX),
]
#: Words that begin a search: only text around one of them can be a grant.  A space stands for whatever is between words.
CUES = ("licens", "permission", "redistribut", "free software", "public domain", "rights reserved", "source code form")
#: Least share by which a template has to shrink a block.
MIN_REDUCTION = 0.2
#: Least share of the template's words that the text must have in their order.
MIN_WORDING = 0.9
#: One word in so many of the template's may come in between.
EXTRA = 4

#: A word of denial refutes a grant that begins within so many words after it.
DENIAL = 3
_DENYING = frozenset("not never isn aren wasn weren".split())
_SENTENCE_END = re.compile(r"[.;:!?](?:\s|$)")

#: Words that tell licenses apart: a difference in one of them refutes a template.
_TELLING = frozenset(
    "apache mit gnu gpl lesser affero general bsd 2 3 2.0 2.1 3.0 4.0 1.0 2-clause 3-clause clause mozilla cc cc0 by by-sa by-nc by-nd sharealike noncommercial "
    "attribution attribution-sharealike attribution-noncommercial unencumbered not".split()
)
#: Numbers of the conditions in a list, which tell nothing apart there.
_NUMBERS = frozenset("1 2 3 4".split())
_CUE = re.compile("|".join(f"({c})" for c in CUES).replace(" ", r"[\W_]+"))
#: A word may be broken after a hyphen, before the comment sign of the next line.
_BROKEN = re.compile(r"-\r?\n[^\w\n]*")
_WORD = re.compile(rf"[^\W_]+(?:(?:[.-]|{_BROKEN.pattern})[^\W_]+)*")


def _places(text: str) -> tuple[array, array]:
    """Starts and ends of the words."""
    starts, ends = array("q"), array("q")
    for m in _WORD.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    return starts, ends


def _word(text: str, start: int, end: int) -> str:
    return _BROKEN.sub("-", text[start:end].lower())


def _lower(text: str) -> str:
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would move the offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def denied(text: str, words: list[str], starts: array, first: int) -> bool:
    """Whether one of the DENIAL words before a grant, in its sentence, says that it is none."""
    for k in range(max(0, first - DENIAL), first):
        if words[k] in _DENYING and not _SENTENCE_END.search(text, starts[k], starts[first]):
            return True
    return False


class Scanner:
    """Templates with their dictionaries; opened once in a worker."""

    def __init__(self) -> None:
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.with_: list[zstandard.ZstdCompressor] = []
        self.words: list[list[str]] = []
        #: Templates and the places of a cue in them, by cue.
        self.having: dict[int, dict[int, list[int]]] = {}
        for i, (_, t) in enumerate(TEMPLATES):
            low = t.lower()
            starts, ends = _places(low)
            self.words.append([_word(low, a, b) for a, b in zip(starts, ends, strict=True)])
            d = zstandard.ZstdCompressionDict(" ".join(self.words[i]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=3)
            self.with_.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
            for m in _CUE.finditer(low):
                self.having.setdefault(m.lastindex, {}).setdefault(i, []).append(bisect_right(starts, m.start()) - 1)
        self.reach = max(len(w) + len(w) // EXTRA for w in self.words)

    def ranked(self, words: list[str], cues: list[tuple[int, int]]) -> list[tuple[int, int, int, float, list[int]]]:
        """(bytes saved, template, word of the cue, reduction, its places in the template) of the blocks that a template shrinks, the most bytes first.

        A template that has the cue in several places has a block for each; they are in the order of their reduction.
        """
        alone: dict[tuple[int, int], tuple[bytes, int]] = {}
        out = []
        for j, cue in cues:
            for i, at in self.having.get(cue, {}).items():
                blocks = []
                for k in at:
                    block = max(0, j - k), j - k + len(self.words[i])
                    if block not in alone:
                        raw = " ".join(words[slice(*block)]).encode("utf-8", "surrogatepass")
                        alone[block] = raw, len(self.alone.compress(raw))
                    raw, size = alone[block]
                    saved = size - len(self.with_[i].compress(raw))
                    if saved >= MIN_REDUCTION * size:
                        blocks.append((-saved / size, k, saved))
                if blocks:
                    blocks.sort()
                    out.append((blocks[0][2], i, j, -blocks[0][0], [k for _, k, _ in blocks]))
        return sorted(out, key=lambda c: (-c[0], c[1], c[2]))

    def confirm(self, words: list[str], taken: bytearray, i: int, j: int, k: int) -> tuple[int, int] | None:
        """First word and end of the template's wording around its word k in word j, among words not taken."""
        template = self.words[i]
        more = len(template) // EXTRA
        low, high = max(0, j - k - more), min(len(words), j - k + len(template) + more)
        low = taken.rfind(1, low, j) + 1 or low
        high = end if (end := taken.find(1, j, high)) >= 0 else high
        first, last = j - k, j - k + len(template)
        if low <= first and last <= high and words[first:last] == template:  # no difference at all
            return first, last
        span = _confirmed(template, words[low:high])
        return span and (low + span[1], low + span[2])

    def scan(self, text: str) -> list[tuple[int, int, str, float]]:
        """Grants in a text as (start, end, license, reduction)."""
        cues = [(m.start(), m.lastindex) for m in _CUE.finditer(_lower(text))]
        if not cues:
            return []
        starts, ends = _places(text)
        words = [_word(text, a, b) for a, b in zip(starts, ends, strict=True)]
        left = self.ranked(words, [(bisect_right(starts, at) - 1, cue) for at, cue in cues])
        taken = bytearray(len(words))
        out: list[tuple[int, int, str, float]] = []
        while left:
            before, open_ = len(out), []
            for c in left:
                _, i, j, cut, places = c
                if taken[j]:
                    continue
                if span := next((x for k in places if (x := self.confirm(words, taken, i, j, k))), None):
                    first, last = span
                    if denied(text, words, starts, first):
                        continue
                    taken[first:last] = b"\1" * (last - first)
                    out.append((starts[first], ends[last - 1], TEMPLATES[i][0], cut))
                else:
                    open_.append(c)
            if len(out) == before:
                break
            # What the grants leave over is confirmed again: words beside a grant may have hidden another.
            left = [c for c in open_ if not taken[c[2]] and 1 in taken[max(0, c[2] - self.reach) : c[2] + self.reach]]
        return sorted(out)


def _confirmed(template: list[str], own: list[str]) -> tuple[int, int, int] | None:
    """How many of the template's words there are, from where to where, or None if too many differ or one that tells licenses apart does."""
    same = [m for m in SequenceMatcher(None, template, own, autojunk=False).get_matching_blocks() if m.size]
    if not same or sum(m.size for m in same) < MIN_WORDING * len(template):
        return None
    have = {i for m in same for i in range(m.a, m.a + m.size)}
    if any(w in _TELLING for i, w in enumerate(template) if i not in have):
        return None
    first, last = same[0].b, same[-1].b + same[-1].size
    taken = {j for m in same for j in range(m.b, m.b + m.size)}
    extra = [own[j] for j in range(first, last) if j not in taken]
    telling = _TELLING - _NUMBERS if "redistributions" in template else _TELLING
    if any(w in telling for w in extra) or len(extra) > len(template) // EXTRA:
        return None
    return len(taken), first, last


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses granted in each text: doc_id, n_grants, licenses, spans, best_reduction.

    licenses: identifiers in alphabetical order, each once, joined with commas.  spans:
    license:start:end by start (code points, end exclusive).  best_reduction: largest share by which
    a template shrinks the block of a confirmed grant, 0 without one, to six digits.

    A grant that a word such as "not" precedes in its sentence, within DENIAL words, is none.
    A null or empty text grants nothing.  Rows are scanned by themselves, so repeated rows and
    identifiers are kept; of confirmed templates that overlap, the one that saves most bytes leads, then the
    first in the list.  A grant may stand within a line or run over several.
    Other columns are ignored.  An empty table gives an empty result.  Texts of any length are
    scanned whole, and every block around every cue is compressed with every template that has the cue.
    """
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for x in batches:
            found = [scanner.scan(t or "") for t in x["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": x["doc_id"],
                    "n_grants": [len(f) for f in found],
                    "licenses": [",".join(sorted({n for _, _, n, _ in f})) for f in found],
                    "spans": [",".join(f"{n}:{a}:{b}" for a, b, n, _ in f) for f in found],
                    "best_reduction": [round(max((c for *_, c in f), default=0.0), 6) for f in found],
                }
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(scan, "doc_id long, n_grants long, licenses string, spans string, best_reduction double")
