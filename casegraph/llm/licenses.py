"""License scans by patience alignment.

A template is aligned to a window of the text: words that occur once in both are anchors, the longest increasing
subsequence of their positions is kept, and the gaps between anchors are aligned the same way; equal words at the ends of
a gap match too. Coverage is the share of the template's words that match. A window is as long as the template and SLACK of it
(texts of LONG words or more: as long again), so a place is a run of so many words at most; windows are aligned wherever the
multiset of the template's words is covered well enough, ending at one of them.

Notices of different licenses differ in few words, so coverage alone does not tell them apart: what names a license (its
name, version and terms) are marks. All marks of a template have to match, and no other mark of the same kind may stand
between the first and the last of them, or right beside them where names go on (CC BY-NC, "GPL" after "Lesser").
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._words import sliced

SLACK = 0.25
LONG = 40

TERMS = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
#: Names by which a notice may call a license.
NAMES = {
    "MIT": ("MIT License", "MIT"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"),
    "BSD": ("BSD License",),
    "ISC": ("ISC License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL version 2", "GPL-2.0", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL version 3", "GPL-3.0", "GPLv3"),
    "GPL": ("GNU General Public License", "GPL License"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License, Version 2.0", "EPL-2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
} | {
    f"CC-{'-'.join(t)}-{v}": (f"Creative Commons {'-'.join(TERMS[x] for x in t)} {v} International License", f"Creative Commons {'-'.join(TERMS[x] for x in t)} {v}", f"CC {'-'.join(t)} {v}")
    for t in (("BY",), ("BY", "SA"), ("BY", "NC"), ("BY", "ND"), ("BY", "NC", "SA"), ("BY", "NC", "ND"))
    for v in ("3.0", "4.0")
}
#: How a notice goes; {} is a name. Other ways ("This work is licensed under a", "Available under the") differ in a word or two.
FORMS = ("Licensed under the {}", "Licensed under {}", "Released under {}")
#: Words that name a license, its version or its terms.
MARKS = frozenset(
    """mit bsd isc apache gnu gpl lgpl agpl gplv2 gplv3 lesser library affero general public mozilla mpl eclipse epl boost software creative commons cc cc0 universal
    by nc nd sa attribution noncommercial noderivatives noderivs sharealike simplified new modified original clause zlib artistic eupl 0 1 2 3 4 5""".split()
)
#: Marks that change a name when they stand right before it, right after it, or after one that has no version.
BEFORE, AFTER, VERSIONS = frozenset("lesser library affero modified simplified original".split()), frozenset("nc nd sa noncommercial noderivatives noderivs sharealike".split()), frozenset("1 2 3 4 5 clause".split())
VERSIONED = frozenset("bsd gpl gnu".split())

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This {w} is free software: you can redistribute it and/or modify it under the terms of the GNU {n} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version. This {w} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {n} for more details."
#: Public license texts and headers: (text, words it must hold, words that must not stand in it or up to LONG words after it).
TEXTS = {
    "MIT": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS, "sublicense", ""),
    "ISC": ('Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.', "fee", ""),
    "BSD-2-Clause": (_BSD, "redistributions binary", "endorse acknowledgement"),
    "BSD-3-Clause": (_BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "redistributions endorse", "acknowledgement"),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.", "misrepresented", ""),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered", ""),
    "BSL-1.0": ('Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:', "organization", ""),
    "Apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache 2", ""),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla 2", ""),
    "GPL-2.0": (_GNU.format(w="program", n="General Public License", v=2), "general 2", "lesser library affero"),
    "GPL-3.0": (_GNU.format(w="program", n="General Public License", v=3), "general 3", "lesser library affero"),
    "LGPL-2.1": (_GNU.format(w="library", n="Lesser General Public License", v=2.1), "lesser 2", "affero"),
    "LGPL-3.0": (_GNU.format(w="library", n="Lesser General Public License", v=3), "lesser 3", "affero"),
    "AGPL-3.0": (_GNU.format(w="program", n="Affero General Public License", v=3), "affero 3", "lesser"),
}


@dataclass(frozen=True)
class Rule:
    """A template: its text, words that must match, and words that must not stand between the first of them and the end of the place,
    right before the first of them, or up to `reach` words after the place."""

    license: str
    text: str
    must: frozenset[str] = frozenset()
    never: frozenset[str] = frozenset()
    before: frozenset[str] = frozenset()
    after: frozenset[str] = frozenset()
    reach: int = 2


def rules() -> list[Rule]:
    """All known notices and texts."""
    out = [Rule(name, text, frozenset(must.split()), frozenset(never.split()), frozenset(), frozenset(never.split()), LONG) for name, (text, must, never) in TEXTS.items()]
    for name, ways in NAMES.items():
        for way in ways:
            must = MARKS.intersection(_words(way))
            after = AFTER | (VERSIONS if must & VERSIONED and not must & VERSIONS else frozenset())
            out += [Rule(name, form.format(way), must, MARKS - must, BEFORE - must, after - must) for form in FORMS]
    return out


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions of equal items, increasing in both: patience alignment."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(b[b0:b1], b0) if cb[x] == 1}
        anchors = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if ca[x] == 1 and x in where]
        last = (a0, b0)
        for i, j in _increasing(anchors):
            out.append((i, j))
            todo.append((last[0], i, last[1], j))
            last = (i + 1, j + 1)
        if last != (a0, b0):
            todo.append((last[0], a1, last[1], b1))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that increases in the second place, by piles."""
    tops, tails, back = [], [], []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(tails[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            tails.append(k)
        else:
            tops[p], tails[p] = j, k
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


@dataclass
class Template:
    name: str
    words: list[int]
    counts: dict[int, int]
    span: int
    must: frozenset[int]
    never: frozenset[int]
    before: frozenset[int]
    after: frozenset[int]
    reach: int


def _hashes(text: str) -> list[int]:
    return next(iter(sliced(pa.array([text], pa.large_string()), most=1 << 62)))[2].word_hash().tolist()


def prepared(known: list[Rule]) -> list[Template]:
    of = lambda words: frozenset(h for w in words for h in _hashes(w))
    out = []
    for r in sorted(known, key=lambda r: (r.license, r.text)):
        if h := _hashes(r.text):
            out.append(Template(r.license, h, dict(Counter(h)), len(h) + max(2, int(len(h) * SLACK)) if len(h) < LONG else 2 * len(h), of(r.must), of(r.never), of(r.before), of(r.after), r.reach))
    return out


#: license, coverage, first matched word, word after the last, number of matched words
Place = tuple[str, float, int, int, int]


def scan(column: pa.Array, templates: list[Template], least: float) -> dict[int, list[Place]]:
    """By row: the places that reach `least`, in the order of the text. Places of one template are apart from each other; of places that
    overlap, the one of the most matched words stays (then of the highest coverage, then the first by position and license)."""
    vocabulary = np.unique(np.array([x for t in templates for x in t.words], np.uint64))
    bitmap = np.zeros(1 << 20, bool)
    bitmap[vocabulary >> np.uint64(44)] = True
    member = np.zeros((len(templates), len(vocabulary)), np.int32)
    for k, t in enumerate(templates):
        for x, n in t.counts.items():
            member[k, np.searchsorted(vocabulary, np.uint64(x))] = n
    need = least * np.array([len(t.words) for t in templates]) - 1e-9
    out: dict[int, list[Place]] = {}
    for base, last, w in sliced(column):
        h, ends = w.word_hash(), w.rows_from()
        at = np.flatnonzero(bitmap[h >> np.uint64(44)])
        place = np.minimum(np.searchsorted(vocabulary, h[at]), len(vocabulary) - 1)
        ok = vocabulary[place] == h[at]
        at, place = at[ok], place[ok]
        row = w.row[at]
        pair, n = np.unique(row * len(vocabulary) + place, return_counts=True)
        bound = np.zeros((last - base, len(templates)), np.int32)
        for k in range(len(templates)):
            bound[:, k] = np.bincount(pair // len(vocabulary), weights=np.minimum(member[k, pair % len(vocabulary)], n), minlength=last - base)
        for r, k in np.argwhere(bound >= need[None, :]).tolist():
            a, b = np.searchsorted(row, [r, r + 1])
            mine = a + np.flatnonzero(member[k, place[a:b]] > 0)
            found = _places(at[mine] - ends[r], h[at[mine]].tolist(), h[ends[r] : ends[r + 1]], templates[k], least)
            out.setdefault(r + base, []).extend(found)
    return {r: apart for r, places in out.items() if (apart := _apart(places))}


def _apart(places: list[Place]) -> list[Place]:
    kept: list[Place] = []
    for p in sorted(places, key=lambda p: (-p[4], -p[1], p[2], p[0])):
        if all(p[3] <= q[2] or q[3] <= p[2] for q in kept):
            kept.append(p)
    return sorted(kept, key=lambda p: p[2])


def _is(t: Template, words: np.ndarray, pairs: list[tuple[int, int]]) -> bool:
    """Whether the aligned words name the template's license."""
    named = [i for i, j in pairs if t.words[j] in t.must]
    if len({t.words[j] for _, j in pairs} & t.must) < len(t.must):
        return False
    matched, end = {i for i, _ in pairs}, pairs[-1][0] + 1
    begin = named[0] if named else pairs[0][0]
    if any(x in t.never and i not in matched for i, x in enumerate(words[begin:end].tolist(), begin)):
        return False
    return not (begin and int(words[begin - 1]) in t.before) and not t.after.intersection(words[end : end + t.reach].tolist())


def _places(pos: np.ndarray, hashes: list[int], words: np.ndarray, t: Template, least: float) -> Iterator[Place]:
    """Slides a window of the template's span over the template's words in the text; aligns it where the words suffice. A place that
    reaches the threshold grows for a quarter of the span, then the next may begin after it."""
    need, have, covered, left, done = least * len(t.words) - 1e-9, Counter(), 0, 0, -1
    best: tuple | None = None
    pos = pos.tolist()
    for right, (p, x) in enumerate(zip(pos, hashes, strict=True)):
        have[x] += 1
        covered += have[x] <= t.counts[x]
        while pos[left] <= p - t.span or pos[left] <= done:
            y = hashes[left]
            covered -= have[y] <= t.counts[y]
            have[y] -= 1
            left += 1
            if left > right:
                break
        if best and p > best[0] + max(3, t.span // 4):  # what is left of the template would have come
            yield best[1]
            done, best = best[1][3] - 1, None
        if covered >= need and left <= right:
            first = max(done + 1, p + 1 - t.span)
            pairs = aligned(words[first : p + 1].tolist(), t.words)
            share = len(pairs) / len(t.words)
            if share < least - 1e-9 or best is not None and share <= best[1][1]:
                continue
            pairs = [(i + first, j) for i, j in pairs]
            if not _is(t, words, pairs):
                continue
            best = (best[0] if best else p, (t.name, share, pairs[0][0], pairs[-1][0] + 1, len(pairs)))
            if share == 1:
                yield best[1]
                done, best = best[1][3] - 1, None
    if best:
        yield best[1]


def scanned(docs: DataFrame, known: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """(doc_id, license, coverage, n_licenses, licenses) of every row. license: that of the place with the highest coverage (of the
    most matched words, then the first in the text, on a tie); licenses: license:coverage:first word:end word of every place found,
    as scan() finds them. Words are runs of letters and digits, A-Z lower-cased. Null, empty and wordless texts and texts without a place: license
    null, coverage 0, no licenses. Texts of any length are read as wholes; repeated rows fare alike; an empty table gives an empty
    one; other columns are not read. known: default rules()."""
    templates = prepared(rules() if known is None else known)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_licenses", T.LongType()), T.StructField("licenses", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan(b.column(1), templates, least) if templates else {}
            rows = [found.get(r, []) for r in range(b.num_rows)]
            best = [min(x, key=lambda f: (-f[1], -f[4], f[2])) if x else None for x in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x and x[0] for x in best], pa.string()), pa.array([x[1] if x else 0.0 for x in best], pa.float64()), pa.array([len(x) for x in rows], pa.int64()), pa.array([";".join(f"{n}:{c:.4f}:{s}:{e}" for n, c, s, e, _ in x) for x in rows], pa.string())],
                names=schema.names,
            )

    return own.mapInArrow(run, schema)
