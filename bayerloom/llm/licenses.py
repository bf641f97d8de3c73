"""License scans by patience alignment.

A text that shares SEED_WORDS consecutive words with a template is aligned with
it around each place where the template could lie. Words that are unique in
both the place and the template are anchors; the longest increasing subsequence
of anchors holds, and the gaps between them are aligned in the same way, after
their equal ends are matched. A template's coverage is its share of aligned
words. Of templates that cover overlapping places the one with most aligned
words counts, so that a notice isn't reported as another that it contains.
Words between asterisks identify a template (its name, its version): if they
aren't aligned, one behind the other, the notice is reported as `unknown`.

Notices in parts, with any amount of text between, are chains of stretches of
seeds, increasing in text and template; the gaps between stretches are aligned.
A chain counts where it shares no words with the notices found so far, contains
them, or makes a single one of the same template fuller; text between its parts
may hold other notices. Parts need SEED_WORDS consecutive words to be seen.

Templates are a fixed list of some KB. Null and wordless texts match nothing;
each row (repeated ones and null ids too) gives its own rows; ties go to the
earlier place, then to the template that is listed first. An empty table gives
an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, window_hashes, word_hashes, words_of

SEED_WORDS = 3
COVERAGE = 0.8

UNKNOWN = "unknown"

#: Wordings of common notices. A name may have several; words between asterisks tell it from others.
_NOTICES = (
    ("Apache-2.0", "Licensed under the *Apache* License, Version *2.0*."),
    ("Apache-2.0", "Licensed under the *Apache* License, Version *2.0* (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the *MIT* License."),
    ("MIT", "Licensed under the *MIT* License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD", "Released under the *BSD* License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("GPL-2.0", "This work is licensed under the *GNU General Public* License, *version 2*."),
    ("GPL-3.0", "This work is licensed under the *GNU General Public* License, *version 3*."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the *GNU General Public* License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the *GNU Lesser General Public* License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the *Mozilla Public* License, v. *2.0*. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("All-rights-reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. *Neither the name of* the copyright holder nor the names of its contributors may be used to *endorse or promote* products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. *Neither the name of* the copyright holder nor the names of its contributors may be used to *endorse or promote* products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Distributed under the *Boost Software* License, Version *1.0*."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the *GNU Affero General Public* License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the *Eclipse Public* License *2.0* which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the *Eclipse Public* License *v1.0* which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("Artistic-2.0", "This is free software; you can redistribute it and/or modify it under the terms of the *Artistic* License *2.0*."),
    ("Perl", "This library is free software; you can redistribute it and/or modify it under the same terms as *Perl itself*."),
)
#: Licences that short notices name, by what they are called in them.
_CALLED = {
    "MIT": "MIT", "BSD": "BSD", "ISC": "ISC", "Zlib": "Zlib", "Apache": "Apache", "BSL-1.0": "Boost Software", "EPL": "Eclipse Public", "MPL": "Mozilla Public", "Artistic": "Artistic",
    "GPL": "GNU General Public", "LGPL": "GNU Lesser General Public", "AGPL": "GNU Affero General Public",
}
#: The conditions of Creative Commons licences, and their versions with what they call themselves.
_CONDITIONS = {"": "", "-SA": "-ShareAlike", "-ND": "-NoDerivatives", "-NC": "-NonCommercial", "-NC-SA": "-NonCommercial-ShareAlike", "-NC-ND": "-NonCommercial-NoDerivatives"}
_VERSIONS = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic", "1.0": "Generic"}


def _templates():
    yield from _NOTICES
    for name, called in _CALLED.items():
        for verb in ("Released", "Licensed"):
            yield name, f"{verb} under the *{called}* License."
    for version, region in _VERSIONS.items():
        for short, long in _CONDITIONS.items():
            yield f"CC-BY{short}-{version}", f"Licensed under *CC BY{short} {version}*."
            yield f"CC-BY{short}-{version}", f"This work is licensed under a *Creative Commons Attribution{long} {version}* {region} License."


TEMPLATES = tuple({text: (name, text) for name, text in _templates()}.values())


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops, top_at, back = [], [], []
    for k, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(top_at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            top_at.append(k)
        else:
            tops[pile], top_at[pile] = v, k
    chain, k = [], top_at[-1] if top_at else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    return chain[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words in increasing order: patience alignment of a and b."""
    pairs, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(k, where[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        held = [anchors[k] for k in increasing([q for _, q in anchors])]
        if not held:
            continue
        pairs += held
        for (p, q), (p2, q2) in zip([(a0 - 1, b0 - 1), *held], [*held, (a1, b1)], strict=True):
            gaps.append((p + 1, p2, q + 1, q2))
    return sorted(pairs)


def chains(seeds: list[tuple[int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of two or more stretches (place in the text, in the template, seeds), both places increasing, heaviest first.

    A stretch weighs its seeds; passing over other stretches of 4 or more seeds,
    such as another copy, costs theirs.
    """
    stretches: list[list[int]] = []
    for p, q in sorted(set(seeds), key=lambda s: (s[0] - s[1], s[0])):
        if stretches and (last := stretches[-1])[0] + last[2] == p and last[1] + last[2] == q:
            last[2] += 1
        else:
            stretches.append([p, q, 1])
    stretches.sort()
    at, of, n = np.array(stretches, dtype=np.int64).T
    passed = np.concatenate([[0], np.cumsum(np.where(n >= 4, n, 0))])
    after, before = passed[np.searchsorted(at, at + n)], passed[np.searchsorted(at, at)]
    weight, back = n.copy(), np.full(len(n), -1)
    # stretches that end before a place are told apart by their words of the template alone: the best of each such class counts
    classes: dict[tuple[int, int], int] = {}
    first, last, value, holder = (np.zeros(16, np.int64) for _ in range(4))
    ended, by_end, begins = 0, np.argsort(at + n, kind="stable"), np.searchsorted(at, at - n.max())
    for j in range(1, len(n)):
        while (i := int(by_end[ended])) < j and at[i] + n[i] <= at[j]:
            k = classes.setdefault((int(of[i]), int(n[i])), len(classes))
            if k == len(value):
                first, last, value, holder = (np.concatenate([x, np.zeros_like(x)]) for x in (first, last, value, holder))
            worth = weight[i] + after[i]
            if worth >= value[k]:
                first[k], last[k], value[k], holder[k] = of[i], of[i] + n[i], worth, i
            ended += 1
        best, chosen = 0, -1
        if classes:
            m = len(classes)
            over = np.maximum(0, last[:m] - of[j])
            gain = np.where((first[:m] < of[j]) & (over < n[j]), value[:m] - over - before[j], 0)
            k = int(gain.argmax())
            best, chosen = gain[k], int(holder[k])
        near = slice(int(begins[j]), j)  # the few that reach into this one
        if near.start < j:
            over = np.maximum(0, np.maximum(at[near] + n[near] - at[j], of[near] + n[near] - of[j]))
            gain = weight[near] - over - np.maximum(0, before[j] - after[near])
            gain = np.where((at[near] < at[j]) & (of[near] < of[j]) & (over < n[j]), gain, 0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, chosen = gain[k], near.start + k
        if best > 0:
            weight[j] += best
            back[j] = chosen
    out, used = [], np.zeros(len(n), bool)
    for j in np.argsort(-weight, kind="stable").tolist():
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(tuple(stretches[j]))
            j = int(back[j])
        if len(chain) > 1:
            out.append(chain[::-1])
    return out


def align_chain(doc: list[int], words: list[int], chain: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Pairs of a chain's words and of what aligns before, between and after its stretches."""
    pairs, p0, q0 = [], max(0, chain[0][0] - chain[0][1] - 2), 0
    for p, q, n in [*chain, (None, len(words), 0)]:
        if p is None:
            p = min(len(doc), p0 + len(words) - q0 + 2)
        else:
            n += SEED_WORDS - 1
            cut = max(0, p0 - p, q0 - q)
            p, q, n = p + cut, q + cut, n - cut
            if n <= 0:
                continue
        if q0 < q:
            pairs += [(p0 + x, q0 + y) for x, y in align(doc[p0:p], words[q0:q])]
        pairs += [(p + x, q + x) for x in range(n)]
        p0, q0 = p + n, q + n
    return pairs


def _marked(text: str) -> list[tuple[int, int]]:
    """First and one past the last word of each part between asterisks."""
    spans, at = [], 0
    for k, part in enumerate(text.split("*")):
        n = len(words_of(part))
        if k % 2:
            spans.append((at, at + n))
        at += n
    return spans


class Scanner:
    def __init__(self, templates=TEMPLATES):
        hashes, offsets = word_hashes(pa.array([t for _, t in templates], pa.string()))
        self.names = [n for n, _ in templates]
        self.marked = [_marked(t) for _, t in templates]
        self.words = [hashes[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        self.seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            for q, code in enumerate(window_hashes(np.array(words, dtype=np.uint64), SEED_WORDS).tolist()):
                self.seeds[code].append((k, q))
        self.codes = np.sort(np.array(list(self.seeds), dtype=np.uint64))
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(self.codes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def _known(self, k: int, pairs: list[tuple[int, int]]) -> bool:
        """Whether the words that identify a template are aligned, those of a part one behind the other."""
        at = {q: p for p, q in pairs}
        return all(a in at and all(at.get(q) == at[a] + q - a for q in range(a, b)) for a, b in self.marked[k])

    def scan_words(self, doc: list[int], starts: list[tuple[int, int]], least: float) -> list[tuple[int, float, int, int, int, bool]]:
        """(template, coverage, aligned words, first and one past the last word, known) of each notice; starts: (seed code, place)."""
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for code, p in starts:
            for k, q in self.seeds[code]:
                seeds[k].append((p, q))
        found, parted = [], []
        for k, own in seeds.items():
            words, places = self.words[k], {p - q for p, q in own}
            slack = len(words) // 4 + 2
            runs: list[list[int]] = []
            for place in sorted(places):
                if runs and place - runs[-1][0] <= slack:
                    runs[-1].append(place)
                else:
                    runs.append([place])
            for run in runs:
                a, b = max(0, run[0] - 2), min(len(doc), run[-1] + len(words) + 2)
                pairs = align(doc[a:b], words)
                if pairs and len(pairs) >= least * len(words):
                    found.append((len(pairs), self._known(k, pairs), -(a + pairs[0][0]), -k, a + pairs[-1][0] + 1, frozenset(a + p for p, _ in pairs)))
        taken: dict[int, int] = {}  # first words of notices and one past their last; none overlap
        begins: list[int] = []
        kept: dict[int, tuple] = {}
        for number, hit in enumerate(sorted(found, key=lambda h: h[:5], reverse=True)):
            start, end = -hit[2], hit[4]
            place = bisect_left(begins, start)
            if (place == 0 or taken[begins[place - 1]] <= start) and (place == len(begins) or begins[place] >= end):
                begins.insert(place, start)
                taken[start] = end
                kept[number] = hit
        holder = {p: number for number, hit in kept.items() for p in hit[5]}
        for k, own in seeds.items():
            # no chain may share words with a notice of at least as many words as the template has
            words = self.words[k]
            free = [(p, q) for p, q in own if p not in holder or kept[holder[p]][0] < len(words)]
            if len({p - q for p, q in free}) > 1:
                for chain in chains(free):
                    pairs = align_chain(doc, words, chain)
                    if len(pairs) >= least * len(words):
                        parted.append((len(pairs), self._known(k, pairs), -pairs[0][0], -k, pairs[-1][0] + 1, frozenset(p for p, _ in pairs)))
        for number, hit in enumerate(sorted(parted, key=lambda h: h[:5], reverse=True), len(found)):
            met = {holder[p] for p in hit[5] if p in holder}
            fuller = all(kept[other][0] < hit[0] for other in met)
            if fuller and (all(kept[other][5] <= hit[5] for other in met) or len(met) == 1 and kept[next(iter(met))][3] == hit[3]):
                for other in met:
                    for p in kept.pop(other)[5]:
                        del holder[p]
                kept[number] = hit
                holder.update(dict.fromkeys(hit[5], number))
        return sorted(((-k, n / len(self.words[-k]), n, -start, end, known) for n, known, start, k, end, _ in kept.values()), key=lambda x: x[3])

    def scan(self, texts: pa.Array, least: float) -> list[list[tuple[str, float, int, int, int]]]:
        hashes, offsets = word_hashes(texts)
        windows = window_hashes(hashes, SEED_WORDS)
        at = np.flatnonzero(self.sieve[(windows & np.uint64((1 << 18) - 1)).astype(np.int64)])
        at = at[np.isin(windows[at], self.codes)]
        owner = np.searchsorted(offsets, at, side="right") - 1
        at, owner = at[at + SEED_WORDS <= offsets[owner + 1]], owner[at + SEED_WORDS <= offsets[owner + 1]]
        out: list[list[tuple[str, float, int, int, int]]] = [[] for _ in range(len(texts))]
        for k in np.unique(owner).tolist():
            start, stop = int(offsets[k]), int(offsets[k + 1])
            starts = [(int(windows[p]), p - start) for p in at[owner == k].tolist()]
            out[k] = [(self.names[t] if known else UNKNOWN, *rest) for t, *rest, known in self.scan_words(hashes[start:stop].tolist(), starts, least)]
        return out


def scan_licenses(docs: DataFrame, templates=TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, n_words, first_word, end_word of each notice found in each row of docs."""

    def work():
        scanner = Scanner(templates)

        def step(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(d, *hit) for d, hits in zip(part.column("doc_id").to_pylist(), scanner.scan(part.column("text"), coverage), strict=True) for hit in hits]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32())
            names = ["doc_id", "license", "coverage", "n_words", "first_word", "end_word"]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)

        return step

    return map_slices(docs.select("doc_id", "text"), "text", work, "doc_id long, license string, coverage double, n_words int, first_word int, end_word int")
