"""Licence scan by matching statistics against a generalised suffix automaton of licence words.

The templates are few and fixed, so the automaton is small and each task builds its own.
A text streams through it word by word: after each word, the state stands for the longest
suffix of what was read that occurs in a template.  A state knows all places in all templates
where its words end, and those where only shorter suffixes end, so that a match is found in
each template that has it.  Matches that are long enough, chained when they follow each other
in one template with small gaps, make covered spans of that template; of two labels, one whose
words the other explains better is left out.  Phrases are templates of their own: a phrase
stands wherever the current suffix, or a shorter one, is the whole phrase.

A null text is empty; so is one without words, which has no spans and the score 0.  Repeated rows, and rows with a null id, are
rows of their own.  Long texts are scanned whole, word by word.  An empty table gives no rows.  Columns of docs keep their names
(`n_words`, `phrases` and `covered` are replaced).
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.frames import documents, hidden, restored

#: Fixed phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Openings and short forms of well-known notices, by label.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software
        Released under the MIT License""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version
        This work is licensed under the GNU General Public License, version 3""",
    "lgpl": """under the terms of the GNU Lesser General Public License as published by the Free Software Foundation""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0""",
    "cc0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights
        dedicated to the public domain under CC0 1.0 Universal""",
    "proprietary": """All rights reserved. No part of this publication may be reproduced without prior written permission""",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
    notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
    WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
    PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
    OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
    SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
    with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
    applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
    WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
    permissions and limitations under the License."""
_GNU_OPENING = """This {it} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by
    the Free Software Foundation, either version {version} of the License, or (at your option) any later version."""
_GNU = (
    _GNU_OPENING
    + """ This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
    warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a
    copy of the {name} along with this {it}. If not, see https://www.gnu.org/licenses/."""
)
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
    conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
    list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
    products derived from this software without specific prior written permission."""
_BSD_END = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
    IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
    CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
    PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
    TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
    POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
    granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
    "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
    MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
    DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
    OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""

_CC = """This work is licensed under the Creative Commons {name} 4.0 International License. To view a copy of this license, visit
    http://creativecommons.org/licenses/{code}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""
_CC0 = """To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or
    neighboring rights to this work. You should have received a copy of the CC0 legalcode along with this work. If not, see
    http://creativecommons.org/publicdomain/zero/1.0/."""

_AGPL = _GNU.format(it="program", name="GNU Affero General Public License", version="3")
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
    available at https://www.eclipse.org/legal/epl-2.0"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
    compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
    non-commercial, and by any means."""

#: Creative Commons licences: code and name.
CREATIVE_COMMONS = {
    "by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
_CC_FORMS = ("This work is licensed under a Creative Commons {name} 4.0 International License", "Creative Commons {name} 4.0 International License", "Licensed under CC {code} 4.0", "SPDX-License-Identifier: CC-{code}-4.0")

#: Identifiers of licences in one line, by label.
IDENTIFIERS = {
    "mit": ["MIT"], "apache": ["Apache-2.0"], "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"], "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "isc": ["ISC"], "mpl": ["MPL-2.0"], "epl": ["EPL-2.0"], "cc0": ["CC0-1.0"], "unlicense": ["Unlicense"],
}

#: Clauses by which a notice is told where the rest is missing.
CLAUSES = {
    "mit": [_MIT[_MIT.index("The above copyright") : _MIT.index(" THE SOFTWARE IS")], _MIT[_MIT.index("THE SOFTWARE IS") : _MIT.index(" IN NO EVENT")], _MIT[_MIT.index("IN NO EVENT") :]],
    "apache": [_APACHE[_APACHE.index("Unless required") : _APACHE.index(" See the License")], _APACHE[_APACHE.index("See the License") :]],
    "bsd": [
        _BSD_START[_BSD_START.index("Redistributions of source") : _BSD_START.index(" 2.")], _BSD_START[_BSD_START.index("Redistributions in binary") :], _BSD_NAMES[_BSD_NAMES.index("Neither") :],
        _BSD_END[: _BSD_END.index("IN NO EVENT")], _BSD_END[_BSD_END.index("IN NO EVENT") :],
    ],
    "isc": [_ISC[_ISC.index("THE SOFTWARE IS") : _ISC.index(" IN NO EVENT")], _ISC[_ISC.index("IN NO EVENT") :]],
    "epl": ["made available under the terms of the Eclipse Public License"],
}

#: Whole notices, and their clauses and one-line forms, by label.
NOTICES = {
    "mit": [_MIT],
    "apache": [_APACHE],
    "gpl": [_GNU.format(it="program", name="GNU General Public License", version="3")],
    "lgpl": [
        _GNU.format(it="library", name="GNU Lesser General Public License", version="2.1"),
        _GNU_OPENING.format(it="library", name="GNU Lesser General Public License", version="2.1"),
        _GNU.format(it="program", name="GNU Lesser General Public License", version="3"),
        _GNU_OPENING.format(it="program", name="GNU Lesser General Public License", version="3"),
    ],
    "agpl": [_AGPL],
    "bsd": [_BSD_START + _BSD_END, _BSD_START + _BSD_NAMES + _BSD_END],
    "isc": [_ISC],
    "mpl": [_MPL],
    "epl": [_EPL],
    "unlicense": [_UNLICENSE],
    "cc0": [_CC0],
}
for _code, _name in CREATIVE_COMMONS.items():
    NOTICES[f"cc-{_code}"] = [_CC.format(name=_name, code=_code), *(f.format(name=_name, code=_code.upper()) for f in _CC_FORMS)]
for _label, _ids in IDENTIFIERS.items():
    NOTICES[_label] = [*NOTICES[_label], *CLAUSES.get(_label, []), *(f"SPDX-License-Identifier: {x}" for x in _ids)]

#: Shortest match, in words, that can be part of a covered span; longest gap between chained
#: matches; least share of the template's line that a span covers.
SEED, GAP, COVER = 3, 3, 0.8

_MAP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of letters a-z (A-Z in lower case), digits and all other than ASCII characters."""
    return text.translate(_MAP).split()


class Automaton:
    """Generalised suffix automaton over numbered words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.at: list[list[tuple[int, int]]] = [[]]  # templates and the ends of the prefixes whose state this is

    def add(self, words: list[int], template: int) -> None:
        last = 0
        for end, w in enumerate(words, 1):
            last = self._extend(last, w)
            self.at[last].append((template, end))

    def occurrences(self, least: int) -> list[list[tuple[int, int, int | None]]]:
        """For each state (template, end, words) of all places that end with `least` of its words or more; None: with all of them.

        A place counts with the longest suffix that ends there.
        """
        below: list[set[tuple[int, int]]] = [set(x) for x in self.at]
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            below[self.link[s]] |= below[s]
        out = []
        for s in range(len(self.next)):
            seen, found, up = set(), [], s
            while up > 0 and self.length[up] >= least:
                found += [(t, end, None if up == s else self.length[up]) for t, end in sorted(below[up] - seen)]
                seen |= below[up]
                up = self.link[up]
            out.append(found)
        return out

    def _clone(self, of: int, length: int) -> int:
        self.next.append(dict(self.next[of]))
        self.link.append(self.link[of])
        self.length.append(length)
        self.at.append([])
        return len(self.next) - 1

    def _redirect(self, state: int, w: int, old: int, new: int) -> None:
        while state >= 0 and self.next[state].get(w) == old:
            self.next[state][w] = new
            state = self.link[state]

    def _split(self, state: int, w: int) -> int:
        """The state of the suffix that ends with w after `state`, split off from longer ones if need be."""
        to = self.next[state][w]
        if self.length[to] == self.length[state] + 1:
            return to
        own = self._clone(to, self.length[state] + 1)
        self._redirect(state, w, to, own)
        self.link[to] = own
        return own

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.at.append([])
        state = last
        while state >= 0 and w not in self.next[state]:
            self.next[state][w] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, w)
        return new


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str], notices: dict[str, list[str]]):
        lines = [(label, words_of(line.encode())) for label, text in templates.items() for line in re.split(r"\n\s*(?=Released|This work|Licensed|dedicated)", text)]
        lines += [(label, words_of(text.encode())) for label, texts in notices.items() for text in texts]
        self.ids: dict[bytes, int] = {}
        number = lambda words: [self.ids.setdefault(w, len(self.ids)) for w in words]
        self.labels = [label for label, _ in lines] + list(phrases.values())
        self.lines = [number(w) for _, w in lines]
        self.automaton = Automaton()
        for t, line in enumerate(self.lines):
            self.automaton.add(line, t)
        self.phrase_at: dict[int, tuple[int, str]] = {}
        for phrase, label in phrases.items():
            words = number(words_of(phrase.encode()))
            self.automaton.add(words, len(self.lines))
        for phrase, label in phrases.items():  # states are final now
            state = 0
            words = number(words_of(phrase.encode()))
            for w in words:
                state = self.automaton.next[state][w]
            self.phrase_at[state] = (len(words), label)
        self.places = [[x for x in found if x[0] < len(self.lines)] for found in self.automaton.occurrences(SEED)]
        # The phrases that end where a state stands: its own and those of its suffixes.
        self.ending: list[list[tuple[int, int, str]]] = []
        for s in range(len(self.automaton.next)):
            found, up = [], s
            while up > 0:
                if up in self.phrase_at:
                    n, label = self.phrase_at[up]
                    found.append((n, up, label))
                up = self.automaton.link[up]
            self.ending.append(found)

    def scan(self, words: list[int | None]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """((start, label) of phrases, (start, end, label, share of the line) of covered spans); words: None if in no template."""
        a = self.automaton
        next_, link, length = a.next, a.link, a.length
        base: list[tuple[int, str]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}  # by template: start, end, end in the template
        going: dict[tuple[int, int], int] = {}  # words of the match that ends here, by template and end in it less the end here
        state = run = 0
        previous = -2

        def over(end: int, now: dict[tuple[int, int], int]) -> None:
            for key, n in going.items():
                if key not in now:
                    matches.setdefault(key[0], []).append((end - n, end, end + key[1]))

        for i in (i for i, w in enumerate(words) if w is not None):
            if i != previous + 1:
                over(previous + 1, {})
                going = {}
                state = run = 0
            previous = i
            w = words[i]
            while state and w not in next_[state]:
                state = link[state]
                run = length[state]
            if w in next_[state]:
                state = next_[state][w]
                run += 1
            for n, _, label in self.ending[state]:
                if n <= run:
                    base.append((i + 1 - n, label))
            if going or run >= SEED:
                now = {(t, end - i - 1): run if n is None else n for t, end, n in self.places[state]} if run >= SEED else {}
                over(i, now)
                going = now
        over(previous + 1, {})
        return sorted(base), self._best([(t, *span) for t, found in matches.items() for span in self._chain(found, len(self.lines[t]))])

    @staticmethod
    def _chain(matches: list[tuple[int, int, int]], size: int) -> list[tuple[list[tuple[int, int]], float]]:
        """The words of spans, as pieces, with their shares of a template of `size` words.

        A span is made of matches that follow each other in the template and in the text, with gaps of at most GAP words there.
        Spans don't overlap; those that cover more come first.
        """
        out = []
        todo = [sorted(matches, key=lambda m: (m[1], m[0], m[2]))]
        while todo:
            some = todo.pop()
            if sum(end - start for start, end, _ in some) < COVER * size:
                continue
            best: list[tuple[int, int, int, int]] = []  # words covered, start, match before, words that the match adds
            for k, (start, end, at) in enumerate(some):
                own = (end - start, start, -1, end - start)
                j = k - 1
                while j >= 0 and some[j][1] >= start - GAP:
                    add = min(end - some[j][1], at - some[j][2], end - start)
                    if add > 0 and (best[j][0] + add, best[j][1]) > own[:2]:
                        own = (best[j][0] + add, best[j][1], j, add)
                    j -= 1
                best.append(own)
            taken: list[tuple[int, int]] = []
            for k in sorted(range(len(some)), key=lambda k: (-best[k][0], best[k][1])):
                if best[k][0] < COVER * size:
                    break
                low, high = best[k][1], some[k][1]
                if not _meets(taken, low, high):
                    insort(taken, (low, high))
                    pieces = []
                    while k >= 0:
                        pieces.append((some[k][1] - best[k][3], some[k][1]))
                        k = best[k][2]
                    out.append((pieces[::-1], min(1.0, sum(b - a for a, b in pieces) / size)))
            if taken:
                todo.append([m for m in some if not _meets(taken, m[0], m[1])])
        return out

    def _best(self, spans: list[tuple[int, list[tuple[int, int]], float]]) -> list[tuple[int, int, str, float]]:
        """Spans without those of which a span of another label that meets them explains more words, or as many with a greater share."""
        spans = sorted(spans, key=lambda s: s[1][0][0])
        beaten = set()
        for i, (t, pieces, share) in enumerate(spans):
            low, high = pieces[0][0], pieces[-1][1]
            for j in range(i + 1, len(spans)):
                other, more, much = spans[j]
                if more[0][0] >= high:
                    break
                if self.labels[other] != self.labels[t]:
                    if (_inside(more, low, high), much) > (_inside(pieces, low, high), share):
                        beaten.add(i)
                    if (_inside(pieces, more[0][0], more[-1][1]), share) > (_inside(more, more[0][0], more[-1][1]), much):
                        beaten.add(j)
        return sorted((p[0][0], p[-1][1], self.labels[t], share) for i, (t, p, share) in enumerate(spans) if i not in beaten)


def _meets(spans: list[tuple[int, int]], low: int, high: int) -> bool:
    """Whether one of the sorted spans, which don't overlap, overlaps low to high."""
    i = bisect_left(spans, (high, high))
    return i > 0 and spans[i - 1][1] > low


def _inside(pieces: list[tuple[int, int]], low: int, high: int) -> int:
    return sum(max(0, min(b, high) - max(a, low)) for a, b in pieces)


def _scan_batches(phrases: dict[str, str], templates: dict[str, str], notices: dict[str, list[str]], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, notices)
        get = scanner.ids.get
        struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            n_words, base, spans = [], [], []
            for t in batch[text].cast(pa.binary()).to_pylist():
                words = words_of(t or b"")
                n_words.append(len(words))
                b, s = scanner.scan([get(w) for w in words])
                base.append([{"start": i, "label": x} for i, x in b])
                spans.append([{"start": i, "end": j, "label": x, "share": y} for i, j, x, y in s])
            kinds = (pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())])), struct)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip((n_words, base, spans), kinds))], names=[*batch.schema.names, "n_words", "phrases", "covered"])

    return run


def scan(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """docs with n_words, phrases (start, label) and covered (start, end, label, share), in words from 0."""
    rows, names = hidden(docs)
    text = next(c for c, n in names.items() if n == text_col)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    out = rows.mapInArrow(_scan_batches(phrases, templates, notices, text), f"{schema}, n_words long, phrases array<struct<start:long,label:string>>, covered array<struct<start:long,end:long,label:string,share:double>>")
    return restored(out, names, n_words="n_words", phrases="phrases", covered="covered")


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    starts = F.col("phrases.start")
    labels = lambda *c: F.array_join(F.array_sort(F.array_distinct(F.concat(*c))), ",")
    covered = F.coalesce(F.array_max("covered.share"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("phrases.label").alias("base_labels"), labels("phrases.label", "covered.label").alias("labels"), F.when(F.size("phrases") > 0, 1.0).otherwise(covered).alias("score"),
    )
