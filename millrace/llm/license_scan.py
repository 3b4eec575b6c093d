"""License scans by patience alignment (operator 3).

A text is aligned with each template that it could cover: words that occur once in both are
anchors, the longest increasing subsequence of them is kept, and the gaps between anchors are
aligned in the same way; a gap without such words is split at its longest common run. Coverage
is the share of a template's words that the text aligns within a stretch of at most
``1.5`` times the template's length, so that words scattered over a text don't count.

Words are lower-cased runs of letters and digits. A stretch can reach ``least`` only if so many of
its words are the template's. Where that holds, the text is cut into overlapping windows, so that each
stretch lies in one, and each window is aligned on its own: what stands around a license, however
long, doesn't take part. The best stretch is aligned once more without its surroundings.
Texts are scanned whole, without shuffle; templates are a short list of the caller.

Null and empty texts match nothing. Repeated rows give a row each. Of equal coverage the first
name in alphabetical order is named, of equal stretches the first. Extra columns are ignored. A
template without words is refused. Empty table: empty result.
"""

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)

#: Texts of short public licenses, and usual openings and notices of them and of longer ones.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": _BSD + _BSD_END,
    "BSD-3-Clause": _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END,
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
    "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MIT": "Released under the MIT License",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

_words = regex.compile(r"[\p{L}\p{N}]+").findall
SCANS = "doc_id long, n_words long, license string, coverage double, first_word long, last_word long, licenses array<string>"


def words(text: str) -> list[str]:
    return _words(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence whose second members increase, of pairs in order of the first."""
    tops: list[int] = []
    at: list[int] = []
    back = []
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        back.append(at[pile - 1] if pile else -1)
        tops[pile : pile + 1], at[pile : pile + 1] = [b], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _diagonal_run(a: np.ndarray, b: np.ndarray, most: int = 1 << 16) -> tuple[int, int, int] | None:
    """The longest common run of arrays with up to ``most`` pairs of equal words."""
    order = np.argsort(b)
    ordered = b[order]
    low = np.searchsorted(ordered, a)
    n = np.searchsorted(ordered, a, "right") - low
    ends = np.cumsum(n)
    if not 0 < ends[-1] <= most:
        return None
    i = np.repeat(np.arange(len(a)), n)
    j = order[np.arange(ends[-1]) + np.repeat(low - ends + n, n)]
    place = np.sort((j - i + len(a)) * (len(a) + 1) + i)  # one more is the next place on a diagonal
    first = np.flatnonzero(np.concatenate(([True], np.diff(place) != 1)))
    size = np.diff(np.append(first, len(place)))
    diagonal, i = np.divmod(place[first[size == size.max()]], len(a) + 1)
    i, j = min(zip(i.tolist(), (i + diagonal - len(a)).tolist(), strict=True))
    return i, j, int(size.max())


def longest_run(a: list, b: list) -> tuple[int, int, int]:
    """Start in a, start in b and length of the longest common run, the first of equals; by search over its length.

    Of arrays with few equal words the places of these are sorted by diagonal instead.
    """
    if isinstance(a, np.ndarray) and (found := _diagonal_run(a, b)):
        return found
    if len(a) * len(b) <= 4096:
        run = SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        return run.a, run.b, run.size
    ids: dict = {}
    if isinstance(a, np.ndarray):  # numbers of 32 bits
        both = np.concatenate((a, b)).astype(np.uint64)
    else:
        both = np.fromiter((ids.setdefault(w, len(ids)) for part in (a, b) for w in part), np.uint64, len(a) + len(b))
    ranks, size = [both], 1  # dense ranks of runs of 1, 2, 4, ... words
    while 2 * size <= min(len(a), len(b)):
        last = ranks[-1]
        ranks.append(np.unique(last[:-size] << np.uint64(32) | last[size:], return_inverse=True)[1].astype(np.uint64))
        size *= 2

    def common(n: int) -> tuple[int, int] | None:
        p = n.bit_length() - 1
        r = ranks[p]
        key = r[: len(both) - n + 1] << np.uint64(32) | r[n - (1 << p) : n - (1 << p) + len(both) - n + 1]
        x, y = key[: len(a) - n + 1], key[len(a) :]
        hit = np.flatnonzero(np.isin(x, y))
        return (int(hit[0]), int(np.flatnonzero(y == x[hit[0]])[0])) if len(hit) else None

    low, high, best = 0, min(len(a), len(b)) + 1, (0, 0)
    while high - low > 1:
        n = (low + high) // 2
        if found := common(n):
            low, best = n, found
        else:
            high = n
    return *best, low


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places of equal words, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
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
        in_b = Counter(b[b0:b1])
        in_a = Counter(w for w in a[a0:a1] if w in in_b)
        if not in_a:
            continue
        place = {b[k]: k for k in range(b0, b1) if in_b[b[k]] == 1}
        anchors = _increasing([(k, place[a[k]]) for k in range(a0, a1) if a[k] in place and in_a[a[k]] == 1])
        if not anchors:
            x, y, n = longest_run(a[a0:a1], b[b0:b1])
            anchors = [(a0 + x + k, b0 + y + k) for k in range(n)]
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(p + 1, x, q + 1, y) for (p, q), (x, y) in zip(edges, edges[1:], strict=False) if p + 1 < x and q + 1 < y]
    return sorted(out)


def _once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of the words that both have once, in order of a's; whether any word is in both."""
    both, n = np.concatenate((a, b)), len(a)
    both = np.sort(both.astype(np.uint64) << np.uint64(32) | np.arange(len(both), dtype=np.uint64))
    order, words_ = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), both >> np.uint64(32)
    ends = np.append(np.flatnonzero(words_[1:] != words_[:-1]), len(both) - 1)
    first, last = order[np.append(0, ends[:-1] + 1)], order[ends]
    common = (first < n) & (last >= n)
    once = common & (np.diff(ends, prepend=-1) == 2)
    x, y = first[once], last[once] - n
    by = np.argsort(x)
    return x[by], y[by], bool(common.any())


def _same(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words that both begin with."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


def align_hashes(a: np.ndarray, b: np.ndarray, few: int = 128) -> np.ndarray:
    """What ``align`` gives for words that are numbers of 32 bits, in rows; parts of more than ``few`` words stay arrays."""
    in_a, in_b = a.tolist(), b.tolist()
    rows, pairs, todo = [], [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a1 - a0 + b1 - b0 <= few:
            while a0 < a1 and b0 < b1 and in_a[a0] == in_b[b0]:
                pairs.append((a0, b0))
                a0, b0 = a0 + 1, b0 + 1
            part, other = in_a[a0:a1], in_b[b0:b1]
            if not set(part).isdisjoint(other):
                pairs += [(a0 + x, b0 + y) for x, y in align(part, other)]
            continue
        n = _same(a[a0:a1], b[b0:b1])
        rows.append(np.arange(n)[:, None] + (a0, b0))
        a0, b0 = a0 + n, b0 + n
        n = _same(a[a0:a1][::-1], b[b0:b1][::-1])
        rows.append(np.arange(-n, 0)[:, None] + (a1, b1))
        a1, b1 = a1 - n, b1 - n
        if a0 == a1 or b0 == b1:
            continue
        x, y, some = _once(a[a0:a1], b[b0:b1])
        if not some:
            continue
        if (np.diff(y) < 0).any():
            x, y = np.array(_increasing(list(zip(x.tolist(), y.tolist(), strict=True)))).T
        if not len(x):
            big = (a1 - a0) * (b1 - b0) > 4096
            i, j, n = longest_run(*((a[a0:a1], b[b0:b1]) if big else (in_a[a0:a1], in_b[b0:b1])))
            x, y = i + np.arange(n), j + np.arange(n)
        x, y = x + a0, y + b0
        rows.append(np.stack((x, y), axis=1))
        low_x, low_y, high_x, high_y = np.append(a0, x + 1), np.append(b0, y + 1), np.append(x, a1), np.append(y, b1)
        gap = (low_x < high_x) & (low_y < high_y)
        one = np.flatnonzero(gap & (high_x - low_x == 1) & (high_y - low_y == 1))  # most gaps are a changed word
        gap[one] = False
        one = one[a[low_x[one]] == b[low_y[one]]]
        rows.append(np.stack((low_x[one], low_y[one]), axis=1))
        todo += zip(low_x[gap].tolist(), high_x[gap].tolist(), low_y[gap].tolist(), high_y[gap].tolist(), strict=True)
    out = np.array(pairs, np.int64).reshape(-1, 2)
    if not rows:  # one part, whose pairs are in order
        return out
    out = np.concatenate([*rows, out])
    return out[np.argsort(out[:, 0])]


class Scanner:
    def __init__(self, templates: dict[str, str], least: float, stretch: float = 1.5):
        self.least, self.stretch = least, stretch
        self.templates = [(name, words(text), Counter(words(text))) for name, text in sorted(templates.items())]
        if not all(t for _, t, _ in self.templates):
            raise ValueError("a template has no words")
        self.known = frozenset(w for _, t, _ in self.templates for w in t)

    def _best(self, found: list[str], t: list[str]) -> tuple[int, int, int]:
        """Aligned words of the best stretch, its first and its last word."""
        places = [p for p, _ in align(found, t)]
        best, low = (0, 0, 0), 0
        for high in range(len(places)):
            while places[high] - places[low] + 1 > self.stretch * len(t):
                low += 1
            best = max(best, (high - low + 1, -places[low], -places[high]))
        return best[0], -best[1], -best[2]

    def windows(self, all_words: list[str], at: np.ndarray, t: list[str], count: Counter) -> Iterator[tuple[int, int]]:
        """Windows of the text in which a stretch could reach ``least``; ``at``: places of words that some template has.

        Two windows in succession share a whole stretch.
        """
        own = at[np.fromiter((all_words[k] in count for k in at.tolist()), bool, len(at))]
        most, need = int(self.stretch * len(t)), self.least * len(t)
        step = max(1, len(t) // 4)
        # places from which a stretch holds enough of the template's words
        enough = own[np.searchsorted(own, own + most) - np.arange(len(own)) >= need]
        done = -1
        for k in enough.tolist():
            if k >= done:  # the next stretches start within ``step`` words
                done = k + step
                yield k, min(len(all_words), k + step + most)

    def __call__(self, text: str) -> tuple[int, list[tuple[float, str, int, int]]]:
        """Number of words, and coverage, name, first and last word of each template found, the best first."""
        found, all_words = [], words(text)
        own = self.known.intersection(all_words)
        at = np.fromiter((k for k, w in enumerate(all_words) if w in own), np.int64)
        for name, t, count in self.templates:
            if sum(count[w] for w in own if w in count) < self.least * len(t):
                continue
            best = (0, 0, 0)
            for a, b in self.windows(all_words, at, t, count):
                n, first, last = self._best(all_words[a:b], t)
                if n > best[0]:
                    best = (n, a + first, a + last)
                if n == len(t):
                    break
            if best[0] and best[0] < len(t):  # without its surroundings, which may have held back anchors
                near = len(t) // 4
                for x, y in ((max(0, best[1] - near), best[2] + 1 + near), (best[1], best[2] + 1)):
                    n, first, last = self._best(all_words[x:y], t)
                    if n > best[0]:
                        best = (n, x + first, x + last)
            if best[0] >= self.least * len(t):
                found.append((best[0] / len(t), name, best[1], best[2]))
        return len(all_words), sorted(found, key=lambda x: (-x[0], x[1]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its best license with coverage and place in words, and all that it covers."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            got = [scanner(t.as_py()) for t in batch.column(1)]
            best = [f[0] if f else (None,) * 4 for _, f in got]
            cols = [batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([b[1] for b in best], pa.string()), pa.array([b[0] for b in best], pa.float64())]
            cols += [pa.array([b[k] for b in best], pa.int64()) for k in (2, 3)] + [pa.array([[x[1] for x in f] for _, f in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "license", "coverage", "first_word", "last_word", "licenses"])

    return rows.mapInArrow(task, SCANS)
