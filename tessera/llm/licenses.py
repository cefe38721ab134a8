"""License scans by template-markup matching.

A template is a notice's wording, read as texts are, with two kinds of regions: <<optional>> ... <<end>>, which may be absent, and
<<any N M /pattern/>>, which N to M words replace, each matching the pattern. It compiles to an automaton over
words: literal words must match exactly, optional regions are bypass edges, replaceable ones counted loops. Base
phrases are templates without regions, run by the same machine. A text is accepted at every place where a path from
start to end exists.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. Defined cases: null and empty texts
have no words, no places and score 0; repeated rows and null ids are returned as they come. Only doc_id and text
are read. Texts are matched whole, however long.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and labels of the base (fixed values).
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_WHO = "<<any 1 8 /.*/>>"
_GRANT = "<<optional>>this <<any 1 3 /.*/>> is<<end>> licensed under the"
_LATER = "<<optional>>or <<any 0 4 /at|your|option|any|\\(|\\)/>> later <<optional>>version<<end>><<end>>"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<any 0 1 /1|a/>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<any 0 1 /2|b/>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = f"<<any 0 1 /3|c/>> Neither the name of {_WHO} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = f"This software is provided by {_WHO} as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall {_WHO} be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."


def _gnu(name: str, version: str) -> list[str]:
    """The FSF's notice for source files, and a plain grant."""
    return [
        f"{_GRANT} gnu {name} version {version} {_LATER}",
        f"is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation either version {version} of the license or at your option any later version",
        f"is free software you can redistribute it and or modify it under the terms of the gnu {name} as published by the free software foundation version {version} <<optional>>of the license<<end>> <<optional>>only<<end>>",
        f"under the terms of the gnu {name} as published by the free software foundation either version {version} of the license",
    ]


def _creative(parts: str, words: str, version: str) -> list[str]:
    major, minor = version.split(".")
    short = f"licensed under <<optional>>a <<optional>>creative commons<<end>><<end>> cc {parts.replace('-', ' ')} {major} {minor}"
    return [short, f"licensed under <<any 0 1 /a|the/>> creative commons {words} {major} {minor} <<any 0 1 /international|unported|generic/>> <<optional>>public<<end>> license"]


#: Templates and the labels they add: whole notices with their regions. The wording is fixed. A notice begins at its first mandatory or literal
#: word: one that began with any word would start everywhere.
TEMPLATES = {
    "apache-2.0": [
        f"{_GRANT} apache license version 2 <<optional>>0<<end>>",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<any 0 8 /.*/>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    **{f"{label}-{version}": _gnu(name, number) for label, name, some in (("gpl", "general public license", "2.0 3.0"), ("lgpl", "<<any 1 1 /lesser|library/>> general public license", "2.0 2.1 3.0"), ("agpl", "affero general public license", "3.0")) for version in some.split() for number in [version.replace(".0", "").replace(".", " ") + (" <<optional>>0<<end>>" if version.endswith(".0") else "")]},
    "mit-notice": ["released under the mit license", "licensed under the mit license"],
    "mit-text": [f"Permission is hereby granted, free of charge, to any person obtaining a copy of this <<any 1 6 /.*/>> to deal in the <<any 1 2 /.*/>> without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the <<any 1 2 /.*/>>, and to permit persons to whom the <<any 1 2 /.*/>> is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the <<any 1 2 /.*/>>. {_AS_IS}"],
    "isc-text": [f"Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and {_WHO} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall {_WHO} be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."],
    "bsd-2-clause": [f"{_BSD_HEAD} {_BSD_TAIL}"],
    "bsd-3-clause": [f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"],
    "bsd-text": [_BSD_HEAD],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at <<any 1 8 /.*/>>", f"{_GRANT} mozilla public license <<any 0 1 /v|version/>> 2 0"],
    "epl-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License <<any 0 1 /v|version/>> 2.0", f"{_GRANT} eclipse public license <<any 0 1 /v|version/>> 2 0"],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0. <<any 0 4 /see|accompanying|file|the/>> <<optional>>license 1 0 txt<<end>>"],
    "zlib-text": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<any 0 1 /1/>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<any 0 1 /2/>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<any 0 1 /3/>> This notice may not be removed or altered from any source distribution."],
    "unlicense": [f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. <<any 0 200 /.*/>> {_AS_IS}"],
    "cc0-1.0": ["creative commons zero v1 0 universal", "licensed under <<any 0 1 /the/>> <<optional>>creative commons<<end>> cc0 1 0 <<any 0 2 /universal|license/>>", "to the extent possible under law <<any 1 12 /.*/>> waived all copyright and related or neighboring rights to"],
    **{f"cc-{parts}-{version}": _creative(parts, words, version) for parts, words in (("by", "attribution"), ("by-sa", "attribution sharealike"), ("by-nc", "attribution noncommercial"), ("by-nd", "attribution noderivatives"), ("by-nc-sa", "attribution noncommercial sharealike"), ("by-nc-nd", "attribution noncommercial noderivatives")) for version in ("3.0", "4.0")},
}

#: Bytes of words, the rest becomes a space; A-Z are lowered first.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Automaton:
    """States with word edges, pattern edges and free edges. add() returns nothing; find() yields (template, start, end)."""

    def __init__(self):
        self.word: list[dict[bytes, list[int]]] = []
        self.pattern: list[list[tuple[re.Pattern, int]]] = []
        self.free: list[list[int]] = []
        self.ends: dict[int, object] = {}
        self.starts: list[int] = []
        self.mandatory: list[bytes] = []

    def _state(self) -> int:
        self.word.append({})
        self.pattern.append([])
        self.free.append([])
        return len(self.word) - 1

    def add(self, name, template: str) -> None:
        at = self._state()
        self.starts.append(at)
        opened: list[int] = []
        runs: list[list[bytes]] = [[]]
        for mark, low, high, pattern, text in re.findall(r"<<(optional|end|any) ?(?:(\d+) (\d+) /(.*?)/)?>>|([^<]+)", template):
            if mark:
                runs.append([])
            if mark == "optional":
                opened.append(at)
            elif mark == "end":
                new = self._state()
                self.free[at].append(new)
                self.free[opened.pop()].append(new)
                at = new
            elif mark == "any":
                compiled, out = re.compile(pattern.encode()), self._state()
                for i in range(int(high)):
                    if i >= int(low):
                        self.free[at].append(out)
                    new = self._state()
                    self.pattern[at].append((compiled, new))
                    at = new
                self.free[at].append(out)
                at = out
            for word in text.encode().translate(_TABLE).split():
                new = self._state()
                self.word[at].setdefault(word, []).append(new)
                at = new
                if not opened:
                    runs[-1].append(word)
        self.ends[at] = name
        #: A run of words that no accepted text is without.
        self.mandatory.append(b" " + b" ".join(max(runs, key=lambda r: sum(map(len, r)))) + b" ")

    def _closure(self, states) -> set[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def freeze(self) -> Automaton:
        self.first: dict[bytes, list[int]] = {}
        self.open: list[tuple[re.Pattern, int]] = []
        for s in self.starts:
            for q in self._closure([s]):
                for w in self.word[q]:
                    self.first.setdefault(w, []).append(s)
                self.open += [(p, s) for p, _ in self.pattern[q]]
        return self

    def find(self, words: list[bytes]):
        first = self.first
        for i, w in enumerate(words):
            begin = set(first.get(w, ())) if not self.open else set(first.get(w, ())) | {s for p, s in self.open if p.fullmatch(w)}
            if not begin:
                continue
            live, j = self._closure(begin), i
            found: dict[object, int] = {}
            while live:
                for s in live:
                    if s in self.ends:
                        found[self.ends[s]] = j
                if j == len(words):
                    break
                step = [t for s in live for t in self.word[s].get(words[j], ())] + [t for s in live for p, t in self.pattern[s] if p.fullmatch(words[j])]
                live, j = self._closure(step), j + 1
            for name, end in found.items():
                yield name, i, end


def compiled(templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None) -> Automaton:
    machine = Automaton()
    for phrase, label in (BASE if base is None else base).items():
        machine.add(("base", label), phrase)
    for label, some in (TEMPLATES if templates is None else templates).items():
        for t in some:
            machine.add(("template", label), t)
    return machine.freeze()


def _scan(templates, base):
    def run(batches):
        machine = compiled(templates, base)
        needed = set(machine.mandatory)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                flat = text.encode().translate(_TABLE) if text else b""
                words = flat.split()
                places: list[int] = []
                base_labels, labels, spans = set(), set(), []
                line = b" ".join([b"", *words, b""])
                if any(m in line for m in needed):
                    for (kind, label), start, end in machine.find(words):
                        labels.add(label)
                        if kind == "base":
                            places.append(start)
                            base_labels.add(label)
                        else:
                            spans.append((label, start, end))
                score = 1.0 if spans else 0.5 if places else 0.0
                rows.append((key, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, spans))
            span = pa.list_(pa.struct([("label", pa.string()), ("start_word", pa.int64()), ("end_word", pa.int64())]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[:-1])]
            columns.append(pa.array([[dict(label=a, start_word=b, end_word=c) for a, b, c in r[8]] for r in rows], span))
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, base: dict[str, str] | None = None) -> DataFrame:
    """One row per document: word and place counts, labels of the base and of the templates, score (1 a template's whole
    wording, 0.5 only a base phrase, 0 neither) and the accepted notices as (label, start_word, end_word)."""
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<label:string,start_word:long,end_word:long>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(templates, base), schema)
