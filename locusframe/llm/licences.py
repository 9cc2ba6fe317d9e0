"""Licence scan: texts, their lines and runs of words against templates, by the Dice coefficient of word bigrams.

Text is normalised to lower-case ASCII letters and digits, anything else being
a gap.  A document's segments are its lines, the document as a whole, and for
each template all runs of as many words as it has, wherever lines end.  With
A and B the sets of bigrams of a segment and a template, Dice is
2 |A and B| / (|A| + |B|).  It reaches a threshold t only if the sizes differ
by a factor of at most (2 - t) / t: templates outside these bounds are never
compared, nor are segments too few of whose bigrams occur in any template.  A
run of words is looked at only where so many of the template's bigrams lie
within its length that it can reach t.

Runs that match overlap, so the best is taken first (ties: first template,
first place), and a run goes if half of its bigrams lie in runs taken before.
Of those taken, a run goes if it lies within a matching line or text of the
same template, or of at least its coefficient.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LOWER, groups, prepare, texts, trimmed, windows, word_hashes

THRESHOLD = 0.8
GAP = np.array([not (b < 128 and chr(b).isalnum()) for b in range(256)])
#: Public licence notices and short licence texts, by identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-notice": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Whole licences, which are looked for as runs of words and as whole texts, in addition to the templates.
_MIT = TEMPLATES["MIT-permission"] + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GNU = "{kind} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {version} of the License, or (at your option) any later version. {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
_BSL = 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.'
_UNLICENSE = TEMPLATES["Unlicense"] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."
_0BSD = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + TEMPLATES["ISC"].partition("appear in all copies.")[2]
LICENCES = {
    "0BSD": _0BSD,
    "AGPL-3.0-header": _GNU.format(kind="This program", mark=":", name="Affero General Public License", comma=",", version="3"),
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + _BSD_THIRD + _BSD_END,
    "BSL-1.0": _BSL,
    "GPL-2.0-header": _GNU.format(kind="This program", mark=";", name="General Public License", comma=";", version="2"),
    "LGPL-2.1-header": _GNU.format(kind="This library", mark=";", name="Lesser General Public License", comma=";", version="2.1"),
    "LGPL-3.0-header": _GNU.format(kind="This program", mark=":", name="Lesser General Public License", comma=",", version="3"),
    "MIT": _MIT,
    "Unlicense-text": _UNLICENSE,
    "Zlib": _ZLIB,
}
#: Runs of words that are compared at once.
RUNS = 2048


def _bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of bigrams, their bounds by text, and where each bigram's words start and its last one ends."""
    begin, size, hashes, bounds = word_hashes(data, offsets, GAP, LOWER)
    g, to = windows(hashes, bounds, 2)
    counts = np.diff(to)
    first = np.repeat(bounds[:-1], counts) + np.arange(to[-1]) - np.repeat(to[:-1], counts)
    return g, to, np.stack([begin[first], begin[first + 1], begin[first + 1] + size[first + 1]]) if len(first) else np.zeros((3, 0), np.int64)


def compiled(templates: dict[str, str]) -> list[tuple[str, np.ndarray]]:
    out = []
    for name in sorted(templates):
        raw = np.frombuffer(templates[name].encode(), np.uint8)
        out.append((name, np.unique(_bigrams(raw, np.array([0, len(raw)]))[0])))
    return out


def candidates(owner: np.ndarray, g: np.ndarray, vocabulary: np.ndarray, share: float) -> Iterator[tuple[int, np.ndarray]]:
    """Segments with their distinct bigrams, enough of which occur in some template. owner: each bigram's segment, ascending."""
    if not len(g):
        return
    hit = vocabulary[np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)] == g
    near = np.zeros(owner[-1] + 1, bool)
    near[owner[hit]] = True
    keep = near[owner]
    owner, g = owner[keep], g[keep]
    order = np.lexsort((g, owner))
    owner, g = owner[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (g[1:] != g[:-1])
    owner, g = owner[new], g[new]
    hit = vocabulary[np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)] == g
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    ends = np.append(starts[1:], len(owner))
    if len(starts):
        hits = np.add.reduceat(hit.astype(np.int64), starts)
        for i in np.flatnonzero(hits >= share * (ends - starts)).tolist():
            yield int(owner[starts[i]]), g[starts[i] : ends[i]]


def best(a: np.ndarray, templates: list[tuple[str, np.ndarray]], threshold: float) -> tuple[float, str] | None:
    """The template with the greatest Dice coefficient of at least the threshold, ties to the first name."""
    share, top = threshold / (2 - threshold), None
    for name, b in templates:
        if not (share * len(b) <= len(a) <= len(b) / share):
            continue
        dice = 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))
        if dice >= threshold and (top is None or dice > top[0]):
            top = dice, name
    return top


def lengths(templates: dict[str, str]) -> list[int]:
    """Bigrams of each template, repeated ones too, in the order of ``compiled``."""
    raw = [np.frombuffer(templates[name].encode(), np.uint8) for name in sorted(templates)]
    return [len(_bigrams(x, np.array([0, len(x)]))[0]) for x in raw]


def _isin(g: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g


def runs(g: np.ndarray, doc: np.ndarray, templates: list[tuple[str, np.ndarray]], sizes: list[int], threshold: float) -> list[tuple[int, float, str, int, int]]:
    """Runs of bigrams that match a template of their length: text, coefficient, template, first bigram, bigrams. doc: each bigram's text."""
    share, out = threshold / (2 - threshold), []
    if not len(g):
        return out
    hits = np.flatnonzero(_isin(g, np.unique(np.concatenate([b for _, b in templates]))))
    for (name, b), size in zip(templates, sizes, strict=True):
        if not len(b):
            continue
        # a set of bigrams that reaches the threshold shares this many of them
        need = max(1, int(np.ceil(share * len(b) - 1e-9)))
        own = hits[_isin(g[hits], b)]
        first, last = own[: len(own) - need + 1], own[need - 1 :]
        close = (last - first < size) & (doc[first] == doc[last]) if len(own) >= need else np.zeros(0, bool)
        if not close.any():
            continue
        low, high = np.maximum(last[: len(close)][close] - size + 1, 0), first[: len(close)][close]
        start = np.unique(np.concatenate([np.arange(x, y + 1) for x, y in zip(low.tolist(), high.tolist(), strict=True)]))
        start = start[start + size <= len(g)]
        start = start[doc[start] == doc[start + size - 1]]
        for at in range(0, len(start), RUNS):
            some = start[at : at + RUNS]
            held = np.sort(g[some[:, None] + np.arange(size)], 1)
            new = np.ones(held.shape, bool)
            new[:, 1:] = held[:, 1:] != held[:, :-1]
            dice = 2 * (new & _isin(held, b)).sum(1) / (new.sum(1) + len(b))
            for i in np.flatnonzero(dice >= threshold).tolist():
                out.append((int(doc[some[i]]), float(dice[i]), name, int(some[i]), size))
    return out


def taken(found: list[tuple[int, float, str, int, int]], n: int) -> list[tuple[int, float, str, int, int]]:
    """Of overlapping runs the best. n: bigrams in all."""
    covered, out = np.zeros(n, bool), []
    for x in sorted(found, key=lambda x: (-x[1], x[2], x[3])):
        own = covered[x[3] : x[3] + x[4]]
        if 2 * int(own.sum()) < x[4]:
            own[:] = True
            out.append(x)
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, licence, dice, n_found, found for every row of docs.

    docs: doc_id and text; more columns are ignored.  found: for each matching
    line, text or run of words its first byte and length (-1: the whole text),
    the template and the coefficient.  licence and dice: the best of them (ties: first name),
    null if there is none, as for null and empty texts and those of fewer than
    two words.  A null doc_id stays null; repeated rows each give a row.
    """
    prepare(docs.sparkSession)
    known = compiled(templates or TEMPLATES)
    entire = [] if templates else compiled(LICENCES)
    all_ = templates or TEMPLATES | LICENCES
    windowed, sizes = compiled(all_), lengths(all_)
    vocabulary = np.unique(np.concatenate([b for _, b in windowed]))
    share = threshold / (2 - threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, 2 << 20):
            whole = pa.Table.from_batches(block).combine_chunks().to_batches()[0]
            data, offsets = texts(whole)
            g, to, starts = _bigrams(data, offsets)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(to))
            found: dict[int, list[dict]] = {}
            for i, a in candidates(doc, g, vocabulary, share):
                if top := best(a, known, threshold) or best(a, entire, threshold):
                    found.setdefault(i, []).append({"start": 0, "length": -1, "licence": top[1], "dice": top[0]})
            breaks = np.flatnonzero(data[offsets[0] : offsets[-1]] == 10) + offsets[0]
            line, other = np.searchsorted(breaks, starts[0]), np.searchsorted(breaks, starts[1])
            inner = line == other
            segment = (doc + line)[inner]  # ascending, and new for each line and each document
            place = np.flatnonzero(inner)
            for s, a in candidates(segment, g[inner], vocabulary, share):
                if top := best(a, known, threshold):
                    i = int(place[np.searchsorted(segment, s)])
                    d, n = int(doc[i]), int(line[i])
                    low = max(int(offsets[d]), int(breaks[n - 1]) + 1 if n else 0)
                    high = min(int(offsets[d + 1]), int(breaks[n]) if n < len(breaks) else int(offsets[-1]))
                    found.setdefault(d, []).append({"start": low - int(offsets[d]), "length": high - low, "licence": top[1], "dice": top[0]})
            for d, dice, name, s, size in sorted(taken(runs(g, doc, windowed, sizes, threshold), len(g)), key=lambda x: x[3]):
                low, high = int(starts[0][s] - offsets[d]), int(starts[2][s + size - 1] - offsets[d])
                others = [(x["start"], x["start"] + x["length"] if x["length"] >= 0 else int(offsets[d + 1] - offsets[d])) for x in found.get(d, []) if "run" not in x and (x["licence"] == name or x["dice"] >= dice)]
                if not any(a <= low and high <= b for a, b in others):
                    found.setdefault(d, []).append({"start": low, "length": high - low, "licence": name, "dice": dice, "run": True})
            rows = [found.get(i, []) for i in range(len(offsets) - 1)]
            for x in (x for r in rows for x in r):
                x.pop("run", None)
            tops = [min(((-x["dice"], x["licence"]) for x in r), default=(None, None)) for r in rows]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("licence", pa.string()), ("dice", pa.float64())]))
            yield pa.RecordBatch.from_arrays([whole.column(0), pa.array([x[1] for x in tops], pa.string()), pa.array([None if x[0] is None else -x[0] for x in tops], pa.float64()), pa.array([len(r) for r in rows], pa.int64()), pa.array(rows, kind)], names=["doc_id", "licence", "dice", "n_found", "found"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, licence string, dice double, n_found long, found array<struct<start:long,length:long,licence:string,dice:double>>")


_VALUES = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in TEMPLATES.items())
_GRAMS = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: x <> '')"
SQL = f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') body from documents),
s as (select rid, unnest(string_split(body, chr(10))) seg from d union all select rid, body from d),
sw as (select rid, {_WORDS.format("seg")} ws from s),
sg as (select rid, row_number() over () sid, {_GRAMS.format("ws")} g from sw where len(ws) >= 2),
t(name, body) as (values {_VALUES}),
tg as (select name, {_GRAMS.format("ws")} g from (select name, {_WORDS.format("body")} ws from t)),
m as (select rid, sid, name, 2 * len(list_intersect(sg.g, tg.g)) / (len(sg.g) + len(tg.g)) dice from sg join tg on len(sg.g) between len(tg.g) * {THRESHOLD / (2 - THRESHOLD)} and len(tg.g) / {THRESHOLD / (2 - THRESHOLD)}),
b as (select rid, sid, arg_min(name, (-dice, name)) licence, max(dice) dice from m where dice >= {THRESHOLD} group by all),
r as (select rid, arg_min(licence, (-dice, licence)) licence, max(dice) dice, count(*) n from b group by rid)
select d.doc_id, r.licence, round(r.dice, 9) dice, coalesce(r.n, 0)::bigint n_found from d left join r using (rid)
"""
