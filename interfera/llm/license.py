"""License scans by template-markup matching.

A template is a license text with marks: ``<<opt>>`` ... ``<</opt>>`` around wording that may be left out, and
``<<var:n>>`` or ``<<var:a-b>>`` for wording that may be replaced by n, or a to b, words. It is compiled to an automaton
over tokens: mandatory words must stand exactly, in order and without a gap. Words are compared in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from interfera.llm.store import small_batches, table, tidy

#: Words that must stand together, and the labels of the contract.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: Notices of a line, in templates of ours.
NOTICES = [
    ("apache", "Licensed under the Apache License <<opt>>Version <<var:2>><</opt>>"),
    ("mit", "Released under the <<opt>>terms of the<</opt>> MIT License"),
    ("gpl-notice", "This <<var:1-3>> is licensed under the <<opt>>terms of the<</opt>> GNU <<opt>>Lesser<</opt>> <<opt>>Affero<</opt>> General Public License <<opt>>version <<var:1>><</opt>>"),
    ("cc", "Licensed under <<opt>>a Creative Commons<</opt>> CC BY <<opt>>NC<</opt>> <<opt>>SA<</opt>> <<opt>>ND<</opt>> <<opt>><<var:2>><</opt>>"),
    ("copyright", "Copyright <<opt>>c<</opt>> <<var:1-8>> All rights reserved"),
]
#: Whole license texts, with marks.
LICENSES = [
    ("mit-full", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice <<opt>>(including the next paragraph)<</opt>> shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL <<var:1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""),
    ("bsd-full", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: <<opt>>1<</opt>> Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. <<opt>>2<</opt>> Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution. <<opt>><<opt>>3<</opt>> Neither the name of <<var:1-12>> nor the names
of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission.<</opt>> THIS SOFTWARE IS PROVIDED BY <<var:1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL <<var:1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE"""),
    ("isc-full", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted<<opt>>, provided that the above copyright notice and this permission notice appear in all copies<</opt>>. THE
SOFTWARE IS PROVIDED "AS IS" AND <<var:1-8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:1-8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE"""),
    ("zlib-full", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: <<opt>>1<</opt>> The origin of this software must not be misrepresented; you must not claim that you wrote
the original software. If you use this software in a product, an acknowledgment in the product documentation would be
appreciated but is not required. <<opt>>2<</opt>> Altered source versions must be plainly marked as such, and must not
be misrepresented as being the original software. <<opt>>3<</opt>> This notice may not be removed or altered from any
source distribution"""),
    ("apache-full", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at <<var:4-8>> Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License"""),
    ("gpl-full", """This <<var:1-3>> is free software; you can redistribute it and/or modify it under the terms of the
GNU <<opt>>Lesser<</opt>> <<opt>>Affero<</opt>> General Public License as published by the Free Software
Foundation; either version <<var:1-2>> of the License, or (at your option) any later version. This
<<var:1-3>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<opt>>Lesser<</opt>> <<opt>>Affero<</opt>> General
Public License for more details. You should have received a copy of the GNU <<opt>>Lesser<</opt>> <<opt>>Affero<</opt>>
General Public License along with this <<var:1-3>> <<opt>>If not, see <<var:2-8>><</opt>>"""),
]
TEMPLATES = NOTICES + LICENSES
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_MARK = re.compile(r"<<(/?)(opt|var)(?::(\d+)(?:-(\d+))?)?>>")


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


class Automaton:
    """States and the moves between them: on a word, on any word, or on nothing. ``first``: the words it begins with."""

    def __init__(self, template: str):
        self.word: dict[int, tuple[str, int]] = {}
        self.any: dict[int, int] = {}
        self.free: dict[int, set[int]] = {}
        state, opened, at = 0, [], 0
        self.size = 1

        def new() -> int:
            self.size += 1
            return self.size - 1

        for mark in [*_MARK.finditer(template), None]:
            for w in words(template[at : mark.start() if mark else len(template)]):
                self.word[state] = (w, to := new())
                state = to
            if not mark:
                break
            at = mark.end()
            if mark[2] == "opt" and not mark[1]:
                to = new()  # a state of its own, so that a way round doesn't share its moves
                self.free.setdefault(state, set()).add(to)
                opened.append(state)
                state = to
            elif mark[2] == "opt":
                to = new()
                self.free.setdefault(state, set()).add(to)
                self.free.setdefault(opened.pop(), set()).add(to)
                state = to
            else:
                low = int(mark[3] or 0)
                high = int(mark[4] or mark[3] or 0)
                ends = []
                for k in range(high):
                    ends += [state] * (k >= low)
                    self.any[state] = (to := new())
                    state = to
                out = new()
                for s in [*ends, state]:
                    self.free.setdefault(s, set()).add(out)
                state = out
        self.last = state
        start = self.closed({0})
        if start & self.any.keys() or self.last in start:
            raise ValueError(f"a template must begin with a mandatory word: {template}")
        self.first = {self.word[s][0] for s in start if s in self.word}
        self.mandatory = self._mandatory(template)

    @staticmethod
    def _mandatory(template: str) -> list[str]:
        """The distinct words outside all optional regions."""
        out, depth, at = [], 0, 0
        for mark in [*_MARK.finditer(template), None]:
            if not depth:
                out += words(template[at : mark.start() if mark else len(template)])
            if mark:
                depth += (-1 if mark[1] else 1) * (mark[2] == "opt")
                at = mark.end()
        return list(dict.fromkeys(out))

    def closed(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free.get(todo.pop(), ()):
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def longest(self, ws: list[str], i: int) -> int:
        """Where the longest match from word i ends, or -1."""
        now, end = self.closed({0}), -1
        while True:
            if self.last in now:
                end = i
            if i >= len(ws) or not now:
                return end
            w = ws[i]
            step = {self.word[s][1] for s in now if s in self.word and self.word[s][0] == w} | {self.any[s] for s in now if s in self.any}
            now, i = self.closed(step), i + 1


@cache
def _compiled() -> list[tuple[str, Automaton]]:
    return [(name, Automaton(t)) for name, t in TEMPLATES]


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    low = (text or "").translate(_LOWER)
    found = [(label, p) for label, phrase in BASE if (p := phrase.split()) and all(x in low for x in p)]
    tried = [(label, a) for label, a in _compiled() if all(x in low for x in a.mandatory)]
    ws = _WORD.findall(low)
    if not found and not tried:
        return len(ws), 0, None, None, [], [], 0.0
    base, covered, labels = [], [], set()
    wanted = {p[0] for _, p in found}.union(*[a.first for _, a in tried])
    for i in [i for i, w in enumerate(ws) if w in wanted]:
        for label, p in found:
            if ws[i : i + len(p)] == p:
                base.append((i, label))
                covered.append((i, i + len(p)))
        for label, a in tried:
            if ws[i] in a.first and (end := a.longest(ws, i)) > i:
                labels.add(label)
                covered.append((i, end))
    base_labels = {label for _, label in base}
    total = at = 0
    for s, e in sorted(covered):
        total += max(0, e - max(s, at))
        at = max(at, e)
    return len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None, sorted(base_labels), sorted(base_labels | labels), total / len(ws) if ws else 0.0


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, n_words, n_base, first_word, last_word, base_labels, labels and score for each row.

    score: the share of the text's words inside a base phrase or a template's match. A null text is empty: no words,
    no labels (empty strings), score 0. Keys may repeat or be null; other columns are ignored, whatever their names;
    an empty table gives none. Whole texts are read; memory follows the longest.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = [scan_text(t) for t in part.column(1).to_pylist()]
                rows = [(*r[:4], ",".join(r[4]), ",".join(r[5]), r[6]) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], names=[key, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(key, docs[text].cast("string").alias("text_"))
    return rows.mapInArrow(tidy(run), f"`{key}` {rows.dtypes[0][1]}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def op10_template_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
