"""Licence scans by sentence-rule recognition.

A text is cut into lines and sentences; each is normalised without the comment leader of
its line (lower case, runs of anything but letters and digits as one space), and the
longest run of lines from each place that joins to a known licence sentence is one.
The identifiers found, in text order, are matched against ordered rules: a rule is a
sequence of identifiers that must follow one another with at most ``gap`` unknown
sentences between neighbours.  Rules are tried by falling length at every place, so a
full licence is reported once and not also as its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of published licences and of the usual notices that refer to them.
SENTENCES: dict[str, str] = {
    "mit-notice": "Released under the MIT License",
    "mit-notice-2": "This project is licensed under the MIT License",
    "mit-notice-3": "Licensed under the MIT License",
    "mit-title": "The MIT License (MIT)",
    "mit-title-2": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "no-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-details": "See the GNU General Public License for more details",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
    "gpl-free-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-no-liability": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "isc-no-liability": "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    "mpl-copy-2": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "unlicense-grant": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
}
#: (licence, identifiers in order); the more specific rule is the longer one.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("mit-grant", "mit-condition", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-condition", "as-is")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-notice",)), ("MIT", ("mit-notice-2",)), ("MIT", ("mit-notice-3",)), ("MIT", ("mit-title",)), ("MIT", ("mit-title-2",)),
    ("Apache-2.0", ("apache-header", "apache-copy", "apache-basis", "apache-limits")),
    ("Apache-2.0", ("apache-header",)), ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")), ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-or-later", ("gpl-free-2", "gpl-hope", "gpl-details")), ("GPL-3.0-or-later", ("gpl-free-2",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")), ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)), ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)), ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-4.0", ("cc-by-notice",)), ("CC-BY-4.0", ("cc-by-work",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-no-liability")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-no-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant", "isc-as-is", "isc-no-liability")), ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-notice", "mpl-copy")), ("MPL-2.0", ("mpl-notice", "mpl-copy-2")), ("MPL-2.0", ("mpl-notice",)),
    ("Unlicense", ("unlicense", "unlicense-grant")), ("Unlicense", ("unlicense",)),
    ("proprietary", ("reserved",)),
]

_OTHER = re.compile(r"[^A-Za-z0-9]+")
#: A sentence ends at . ; : ! ? before white space or the end, or at an empty line.
_END = re.compile(r"[.;:!?]+(?=\s|$)|\n\s*\n")
#: Texts are cut at lines too; lines may be joined again.
_CUT = re.compile(r"[.;:!?]+(?=\s|$)|\n")
#: What may stand before and after the words of a line: marks of comments, lists, headings and quotes.
_LEAD = re.compile(r"(?:[^\S\n]|<!--+|[-*#/;%>|!'\"]|\.\\\"|(?:dnl|rem|c)(?=[ \t])|\(?(?:\d{1,2}|[a-z])\)(?=[ \t]))*", re.I)
_SPACE = re.compile(r"[^\S\n]*")
_TAIL = " \t\r\n\f\v*#|"


def normalise(sentence: str) -> str:
    """Lower case (A-Z), every run of anything but a-z and 0-9 as one space, trimmed."""
    return _OTHER.sub(" ", sentence).strip().lower()


class Recogniser:
    """Finds rules in the sentences of a text."""

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, tuple[str, ...]]], gap: int):
        # A known sentence may hold several of the marks that end one; each part is a step of it.
        self.known: dict[str, list[str]] = {}
        self.parts: dict[str, tuple[str, ...]] = {}
        for name, text in sentences.items():
            keys = tuple(k for k in map(normalise, _END.split(text)) if k)
            self.parts[name] = tuple(f"{name}/{i}" for i in range(len(keys)))
            for i, key in enumerate(keys):
                self.known.setdefault(key, []).append(f"{name}/{i}")
        words = [k.split() for k in self.known]
        self.prefixes = {" ".join(w[: i + 1]) for w in words for i in range(len(w))}
        steps = [(licence, "+".join(names), tuple(p for n in names for p in self.parts[n])) for licence, names in rules]
        self.rules: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {}
        for licence, rule, chain in sorted(steps, key=lambda s: (-len(s[2]), s[1])):
            self.rules.setdefault(chain[0], []).append((licence, rule, chain))
        self.gap = gap
        # Words of the rarest kind: a text without any of them holds no known sentence.
        firsts = sorted({max(k.split(), key=len) for k in self.known if len(k) > 8})
        firsts += [k for k in self.known if len(k) <= 8]
        self.hint = re.compile("|".join(map(re.escape, firsts)))

    def _sentences(self, text: str, block: list[tuple[int, int, str]], n: int, found: list[tuple[int, int, int, list[str]]]) -> int:
        """Add the known sentences among the joined lines of ``block``; the number of the next sentence."""
        i = 0
        while i < len(block):
            key, last = "", -1
            for j in range(i, len(block)):
                key = f"{key} {block[j][2]}" if key else block[j][2]
                if key not in self.prefixes:
                    break
                if key in self.known:
                    last, names = j, self.known[key]
            if last >= 0:
                start, end = block[i][0], block[last][1]
                passage = text[start:end].rstrip(_TAIL).removesuffix("*/").removesuffix("-->").rstrip(_TAIL)
                found.append((n, start, start + len(passage), names))
                i = last
            n += 1
            i += 1
        return n

    def __call__(self, text: str) -> list[tuple[str, str, int, int]]:
        """(licence, rule, start, end) in characters, in text order, without overlaps."""
        if not self.hint.search(text.lower()):
            return []
        found: list[tuple[int, int, int, list[str]]] = []  # sentence number, span, identifiers
        at = n = 0
        opens = True  # at the start of a line
        block: list[tuple[int, int, str]] = []  # span and key of lines that no sentence end or empty line parts
        while at < len(text):
            start = (_LEAD if opens else _SPACE).match(text, at).end()
            mark = _CUT.search(text, start)
            end = mark.end() if mark else len(text)
            key = normalise(text[start:end])
            if key:
                block.append((start, end, key))
            opens = mark is not None and mark[0] == "\n"
            if not key or not opens:
                n = self._sentences(text, block, n, found)
                block = []
            at = end
        out, i = [], 0
        while i < len(found):
            for licence, rule, chain in (r for name in found[i][3] for r in self.rules.get(name, ())):
                j = i + len(chain) - 1
                if j < len(found) and all(
                    chain[k] in found[i + k][3] and (not k or found[i + k][0] - found[i + k - 1][0] - 1 <= self.gap) for k in range(len(chain))
                ):
                    out.append((licence, rule, found[i][1], found[j][2]))
                    i = j
                    break
            i += 1
        return out


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: dict[str, str] = SENTENCES,
    rules: list[tuple[str, tuple[str, ...]]] = RULES,
    gap: int = 2,
) -> DataFrame:
    """(id_col, n_matches, licenses, matches) for every row of ``docs``.

    ``licenses`` are the distinct licences in order; ``matches`` hold licence, rule, and the
    start and end of the passage in characters of the whole text.  Null and empty texts
    match nothing; repeated rows and null ids are scanned like others; other columns are
    ignored.  One pass without a shuffle; the rule tables travel with the task.
    """
    find = Recogniser(sentences, rules, gap)
    id_type = docs.schema[id_col].dataType.simpleString()
    match = pa.list_(pa.struct([("license", pa.string()), ("rule", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [find(t) if t else [] for t in batch.column(1).to_pylist()]
            names = [sorted({h[0] for h in row}) for row in hits]
            rows = [[dict(zip(("license", "rule", "start_char", "end_char"), h)) for h in row] for row in hits]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(h) for h in hits], pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(rows, match)],
                names=["id", "n_matches", "licenses", "matches"],
            )

    schema = f"id {id_type}, n_matches long, licenses array<string>, matches array<struct<license: string, rule: string, start_char: long, end_char: long>>"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
    return out.withColumnRenamed("id", id_col)
