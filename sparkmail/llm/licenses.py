"""License scans by template matching.

A template is wording with `[[optional regions]]` and `{{n}}`, a region that any n words at most may replace. Each is
compiled into an automaton over words and accepts text whose mandatory words are all there, in order and unchanged.
Base phrases are plain runs of words. Words are runs of digits, letters and non-ASCII characters, A-Z in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_BSD_OPENING = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
[[1]] Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
[[2]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
[[3]] Neither the name of {{12}} nor the names of [[its]] {{6}} may be used to endorse or promote products derived from this
software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY {{10}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{10}} BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ISC_DISCLAIMER = """
THE SOFTWARE IS PROVIDED "AS IS" AND {{10}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {{10}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""

#: Wording of public licences, whole with their conditions and disclaimers, and of sentences that name a licence. Fixed values.
TEMPLATES = {
    "0bsd": ["""
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
""" + _ISC_DISCLAIMER],
    "apache-2.0": [
        "[[released]] [[licensed]] under the [[terms of the]] Apache License, Version 2.0 [[(the License)]]",
        "Apache License Version 2.0 [[January 2004]]",
    ],
    "apache-2.0-notice": ["""
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this {{3}} except in compliance with the
License. You may obtain a copy of the License at {{10}} Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express
or implied. See the License for the specific language governing permissions and limitations under the License.
"""],
    "bsd": ["[[released]] [[licensed]] under the [[{{1}} clause]] BSD license"],
    "bsd-2-clause": [_BSD_OPENING + _BSD_DISCLAIMER],
    "bsd-3-clause": [_BSD_OPENING + _BSD_NAMES + _BSD_DISCLAIMER],
    "cc-by-nc": ["CC BY-NC [[{{1}} 0]]", "Creative Commons Attribution-NonCommercial {{1}}.0 [[International]] License"],
    "cc-by-sa": ["CC BY-SA [[{{1}} 0]]", "Creative Commons Attribution-ShareAlike {{1}}.0 [[International]] License"],
    "copyright-notice": ["Copyright {{8}} all rights reserved"],
    "gpl-notice": ["""
This {{2}} is free software: you can redistribute it and/or modify it under the terms of the GNU [[Lesser]] [[Affero]]
General Public License as published by the Free Software Foundation, either version {{2}} of the License, or (at your option)
any later version. This {{2}} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU [[Lesser]] [[Affero]] General Public License for
more details.
"""],
    "gpl-versioned": [
        "[[GNU]] General Public License [[as published by the Free Software Foundation]] [[either]] version {{1}} "
        "[[of the License]] [[or [[at your option]] any later version]]",
        "[[GNU]] General Public License v3",
    ],
    "isc": ["""
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.
""" + _ISC_DISCLAIMER, """
Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.
""" + _ISC_DISCLAIMER],
    "mit": [
        "[[released]] [[licensed]] under the MIT license", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the {{2}}), to deal in the {{2}} without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the {{2}}, and to permit persons to whom the {{2}} is furnished to do so,
subject to the following conditions:
The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or
substantial portions of the {{2}}.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{6}} BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""],
    "zlib": ["""
This software is provided 'as-is', without any express or implied warranty. In no event will {{6}} be held liable for any
damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
[[1]] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
[[2]] Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
[[3]] This notice may not be removed or altered from any source distribution.
"""],
}

_OTHER = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_SPACED = bytes.maketrans(_OTHER, b" " * len(_OTHER))


@dataclass
class Automaton:
    """States are numbered; 0 starts, `end` accepts. Arcs on a word, on any word, and without a word."""

    label: str
    text: str
    words: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any: list[int | None] = field(default_factory=lambda: [None])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    must: list[list[bytes]] = field(default_factory=list)  # runs of mandatory words
    end: int = 0

    def _state(self) -> int:
        self.words.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.words) - 1

    def compile(self) -> "Automaton":
        at, starts, run = 0, [], []
        self.must.append(run)
        for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+", self.text):
            if token == "[[":
                starts.append(at)
            elif token == "]]":
                after = self._state()
                self.free[at].append(after)
                self.free[starts.pop()].append(after)
                at = after
            elif token.startswith("{{"):
                gap = [at] + [self._state() for _ in range(int(token[2:-2]))]
                after = self._state()
                for here, there in zip(gap, gap[1:]):
                    self.any[here] = there
                for here in gap:
                    self.free[here].append(after)
                at = after
            else:
                for word in words_of(token):
                    after = self._state()
                    self.words[at][word] = after
                    at = after
                    if not starts:
                        run.append(word)
                if not starts:
                    continue
            run = []
            self.must.append(run)
        self.must = [r for r in self.must if r]
        self.end = at
        return self

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for there in self.free[todo.pop()]:
                if there not in states:
                    states.add(there)
                    todo.append(there)
        return states

    def first_words(self) -> set[bytes]:
        return {w for s in self._closed({0}) for w in self.words[s]}

    def longest(self, words: list[bytes], start: int) -> int | None:
        """Where the longest accepted run of words from `start` ends, or None."""
        states, found = self._closed({0}), None
        for at in range(start, len(words) + 1):
            if self.end in states:
                found = at
            if at == len(words):
                break
            word = words[at]
            after = {self.words[s][word] for s in states if word in self.words[s]}
            after |= {self.any[s] for s in states if self.any[s] is not None}
            if not after:
                break
            states = self._closed(after)
        return found

    def matches(self, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        """Accepted runs that do not overlap, from left to right, the longest from each start."""
        if any(b" " + b" ".join(run) + b" " not in joined for run in self.must):
            return []
        found, free, firsts = [], 0, self.first_words()
        for at, word in enumerate(words):
            if at >= free and word in firsts and (end := self.longest(words, at)) is not None:
                found.append((at, end))
                free = end
        return found


def compiled() -> list[Automaton]:
    return [Automaton(label, text).compile() for label, texts in TEMPLATES.items() for text in texts]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACED).split()


def base_places(joined: bytes, phrase: str) -> list[int]:
    """Starts of a phrase in words joined and framed by spaces, overlaps included."""
    wanted, found, at = b" " + phrase.encode() + b" ", [], -1
    place, seen = 0, 0
    while (at := joined.find(wanted, at + 1)) >= 0:
        place += joined.count(b" ", seen, at)
        seen = at
        found.append(place)
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id_col, n_words, base and found (arrays of label, start, end; places in words, end exclusive).

    base holds every place of a base phrase, found the accepted texts of templates. Null text counts as empty: no words,
    empty arrays. Repeated rows and null ids give a row each. Other columns are not read.
    """
    place = T.StructType.fromDDL("label string, start long, `end` long")
    picked = docs.select(id_col, text_col)
    schema = T.StructType([picked.schema[id_col], T.StructField("n_words", T.LongType()),
                           T.StructField("base", T.ArrayType(place)), T.StructField("found", T.ArrayType(place))])
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled()
        for batch in batches:
            n, base, found = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                joined = b" " + b" ".join(words) + b" "
                n.append(len(words))
                base.append([{"label": label, "start": at, "end": at + len(phrase.split())}
                             for phrase, label in BASE.items() for at in base_places(joined, phrase)])
                found.append([{"label": a.label, "start": start, "end": end}
                              for a in automata for start, end in a.matches(words, joined)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(base, kind),
                                              pa.array(found, kind)], names=schema.names)

    return picked.mapInArrow(matched, schema)


def summarise(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, first and last base place, labels, and a score.

    The score grows with the longest wording that was matched, 1 - 1 / (1 + words); 0 where nothing was.
    """
    def labels(*columns: str):
        every = F.array_union(*[F.transform(c, lambda x: x["label"]) for c in columns])
        return F.array_join(F.sort_array(F.array_distinct(every)), ",")

    starts = F.transform("base", lambda x: x["start"])
    longest = F.coalesce(F.array_max(F.transform(F.concat("base", "found"), lambda x: x["end"] - x["start"])), F.lit(0))
    return scanned.select(
        id_col, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels("base", "base").alias("base_labels"),
        labels("base", "found").alias("labels"), (1 - 1 / (1 + longest)).cast("double").alias("score"), "found")
