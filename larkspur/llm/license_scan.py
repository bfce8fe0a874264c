"""License scans by conditional compression.

Candidate blocks are neighbouring lines that speak of licences; notices of several
paragraphs have blank or comment-only lines between them, which do not end a block.
A block is compressed by zstandard alone, and with each template as a raw-content
dictionary; a template that the block repeats makes it much smaller.  Templates
are ranked by that reduction, and confirmed by an exact comparison of words: the
template is aligned with the words of the block that are nearest to it, and what
these have more, less or otherwise than the template counts as a difference.
The confirmed template that repeats most words wins.  Its words are cut out, and
what is left before and after them is searched in the same way, so a block may hold
several notices, on one line or on many, and other prose beside them.

Every template is compared unless it cannot be there: where no stretch of the block
has enough of its words in common, in whatever order, no alignment has few enough
differences.

Scale: one pass over the documents without a shuffle.  Templates are a fixed
list that goes with the function.  Licence lines repeat very much, so a worker
keeps what it found for the latest blocks; this changes time, not results.

Defined cases: null and empty texts have no blocks; repeated rows are scanned
each; of templates that repeat as many words, the one of fewer differences wins, then
the one that is ranked first, then the first by name, and its first place; a block
of any length is compared as a whole; columns other than id and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import quoted, worker_cache

#: Wordings of public licence notices and texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
        "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
        "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-2-Clause-short": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "ISC-short": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT-text-short": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
_TRIGGER = re.compile(r"licen[cs]|copyright|permission|redistribut|warrant|public domain|spdx|free software", re.I)
_WORD = re.compile(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*")

SCHEMA = "doc_id long, block_line long, n_lines long, license string, reduction double, n_missing long, n_extra long, n_changed long, exact boolean"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def regions_of(text: str | None, vocabulary: set[str]) -> list[tuple[list[str], list[int]]]:
    """(words, the line of each) of the candidate blocks: neighbouring lines with a licence
    term or with words at least half of which are in `vocabulary`, one at least with a term."""
    if not text or not _TRIGGER.search(text):
        return []
    out, held, at, told = [], [], [], False
    for i, line in enumerate([*text.split("\n"), None]):
        words = words_of(line) if line is not None else []
        term = bool(words) and bool(_TRIGGER.search(line))
        if words and (term or 2 * sum(w in vocabulary for w in words) >= len(words)):
            held += words
            at += [i] * len(words)
            told = told or term
        elif words or line is None:
            if told:
                out.append((held, at))
            held, at, told = [], [], False
    return out


def differences(block: list[str], template: list[str]) -> tuple[int, int, int]:
    """(words of the template that are missing, words of the block more, words changed) by an exact edit alignment."""
    n = len(template)
    # Rows of (cost, missing, extra, changed); equal costs prefer a change over a gap.
    above = [(j, j, 0, 0) for j in range(n + 1)]
    for i, w in enumerate(block, 1):
        row = [(i, 0, i, 0)]
        for j, t in enumerate(template, 1):
            c, m, e, x = above[j - 1]
            best = (c, m, e, x) if w == t else (c + 1, m, e, x + 1)
            c, m, e, x = above[j]
            if c + 1 < best[0]:
                best = (c + 1, m, e + 1, x)
            c, m, e, x = row[j - 1]
            if c + 1 < best[0]:
                best = (c + 1, m + 1, e, x)
            row.append(best)
        above = row
    return above[n][1:]


def located(words: list[str], template: list[str]) -> tuple[int, int, int, int, int]:
    """(first, end, missing, extra, changed) of the stretch of `words` nearest to the whole
    template; of stretches equally near the first that ends, and its longest."""
    # Columns of (cost, first, missing, extra, changed), one for each end in `words`; a stretch begins anywhere at no cost.
    n = len(template)
    above = [(j, 0, j, 0, 0) for j in range(n + 1)]
    best, end = above[n], 0
    for i, w in enumerate(words, 1):
        row = [(0, i, 0, 0, 0)]
        for j, t in enumerate(template, 1):
            c, f, m, e, x = above[j - 1]
            now = (c, f, m, e, x) if w == t else (c + 1, f, m, e, x + 1)
            c, f, m, e, x = above[j]
            if c + 1 < now[0]:
                now = (c + 1, f, m, e + 1, x)
            c, f, m, e, x = row[j - 1]
            if c + 1 < now[0]:
                now = (c + 1, f, m + 1, e, x)
            row.append(now)
        above = row
        if above[n][0] < best[0]:
            best, end = above[n], i
    return (best[1], end, *best[2:])


class Scanner:
    """Templates with their compressors.  Words of a block are an instance of a template
    if their differences are at most `most_different` of the template's words."""

    def __init__(self, templates: dict[str, str], most_different: float):
        import zstandard as z

        self.words = {k: words_of(v) for k, v in sorted(templates.items())}
        self.vocabulary = {w for x in self.words.values() for w in x}
        self.bags = {k: Counter(x) for k, x in self.words.items()}
        self.most = {k: int(most_different * len(x)) for k, x in self.words.items()}
        bare = z.ZstdCompressionParameters.from_level(19, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.alone = z.ZstdCompressor(compression_params=bare)
        given = lambda w: z.ZstdCompressionDict(" ".join(w).encode(), dict_type=z.DICT_TYPE_RAWCONTENT)
        self.with_template = {k: z.ZstdCompressor(compression_params=bare, dict_data=given(w)) for k, w in self.words.items()}
        self.known: dict[str, list[tuple]] = {}

    def stretches(self, words: list[str], name: str) -> list[tuple[int, int]]:
        """(first, end) of all that an instance of the template can lie in: each
        difference costs one of the words in common, and adds one word at most."""
        bag, most = self.bags[name], self.most[name]
        size, need = len(self.words[name]) + most, len(self.words[name]) - most
        have: Counter = Counter()
        common, out = 0, []
        for i, w in enumerate(words):
            if w in bag:
                have[w] += 1
                common += have[w] <= bag[w]
            if i >= size and (v := words[i - size]) in bag:
                common -= have[v] <= bag[v]
                have[v] -= 1
            if common >= need:
                first = max(0, i + 1 - size)
                if out and first <= out[-1][1]:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((first, i + 1))
        return out

    def gain(self, words: list[str], name: str) -> float:
        """The share by which the template reduces the words' compressed size."""
        plain = " ".join(words).encode()
        return 1 - len(self.with_template[name].compress(plain)) / len(self.alone.compress(plain))

    def instances(self, words: list[str]) -> list[tuple]:
        """(first, end, license, reduction, missing, extra, changed) of all instances in a block, in order."""
        key = " ".join(words)
        if (found := self.known.get(key)) is not None:
            return found
        out: list[tuple] = []
        left = [(0, len(words))]
        while left:
            lo, hi = left.pop()
            some = words[lo:hi]
            if not some or not _TRIGGER.search(" ".join(some)):
                continue
            may = {k: places for k in self.words if (places := self.stretches(some, k))}
            ranked = sorted((-self.gain(some, k), k) for k in may)
            best = None
            for rank, (gain, name) in enumerate(ranked):
                if gain >= 0:
                    continue
                for a, b in may[name]:
                    s, e, *d = located(some[a:b], self.words[name])
                    if sum(d) <= self.most[name]:
                        order = (d[0] + d[2] - len(self.words[name]), sum(d), rank, a + s)
                        if best is None or order < best[0]:
                            best = (order, lo + a + s, lo + a + e, name, d)
            if best:
                _, s, e, name, d = best
                out.append((s, e, name, self.gain(words[s:e], name), *d))
                left += [(lo, s), (e, hi)]
        if len(self.known) > 50_000:
            self.known.clear()
        self.known[key] = sorted(out)
        return self.known[key]

    def scan(self, text: str | None) -> list[tuple]:
        """(first line, number of lines, license, reduction, missing, extra, changed) of all instances."""
        return [(at[s], at[e - 1] - at[s] + 1, *rest) for words, at in regions_of(text, self.vocabulary) for s, e, *rest in self.instances(words)]


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, most_different: float = 0.25
) -> DataFrame:
    """One row per instance of a template: doc_id, block_line (from 0), n_lines, license,
    reduction (share of the compressed size saved), n_missing, n_extra, n_changed (words) and exact."""
    given = dict(templates or TEMPLATES)

    def run(batches):
        scanners = worker_cache("license_scanners", dict)
        key = (tuple(sorted(given.items())), most_different)
        if key not in scanners:
            scanners[key] = Scanner(given, most_different)
        scan = scanners[key]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found in scan.scan(text):
                    out.append((doc_id, *found, not any(found[4:])))
            cols = list(zip(*out)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=[x.split(" ")[0] for x in SCHEMA.split(", ")])

    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
