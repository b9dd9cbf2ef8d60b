"""Operator 6: licence recognition from sentences and rules.

A text's words are matched, from each place where a sentence or line may begin, with the
known licence sentences (longest first, over line ends and comment marks), each of which
has an identifier.  The identifiers of a text form a sequence, and ordered rules say
which sequences make a licence: a rule matches where its identifiers follow one another,
with at most ``GAP`` other known sentences between two of them.  Rules are tried in
order; a match uses up its identifiers, so the three sentences of a full licence text
are one finding and not three.  After ``SPDX-License-Identifier:`` the licences of the
expression are taken, with GNU licences as -only or -or-later.

Defined results: a null or empty text has no findings; findings are in order of their
place; case, punctuation and white space don't matter; repeated rows have the same findings;
a very long text takes steps linear in its length.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from trellis.llm.scratch import tuned

GAP = 2

#: Sentences with identifiers; wording of the public licence texts (fixed values).
SENTENCES: dict[str, list[str]] = {
    "mit.grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ],
    "mit0.grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ],
    "mit.notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit.warranty": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
    ],
    "mit.liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
    ],
    "apache2.compliance": ["you may not use this file except in compliance with the License"],
    "apache2.copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache2.basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache2.see": ["See the License for the specific language governing permissions and limitations under the License"],
    "apache2.terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache2.copyright": [
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"
    ],
    "gpl.preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works", "The licenses for most software are designed to take away your freedom to share and change it"],
    "gpl.hope": ["is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl2.linux": ["it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "mpl1.form": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")"],
    "mpl2.form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "mpl2.copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "epl1.made": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "epl2.made": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    ],
    "bsd.grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd.source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd.binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd.advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd.endorse": [
        f"Neither the name of {a} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
        for a in ("the copyright holder", "the University", "the organization", "the author")
    ],
    "bsd.warranty": [
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
    ],
    "isc.grant": [f"Permission to use, copy, modify, {a} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies" for a in ("and/or", "and")],
    "0bsd.grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc.warranty": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"],
    "zlib.warranty": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib.grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "zlib.origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software"],
    "zlib.altered": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"],
    "boost.grant": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"
    ],
    "unlicense.free": ["This is free and unencumbered software released into the public domain"],
    "unlicense.anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "wtfpl.do": ["You just DO WHAT THE FUCK YOU WANT TO"],
    "cc0.waive": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"],
    "postgresql.grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "reserved": ["All rights reserved"],
}

#: Licences by the names that a sentence may give them; "+" marks those whose later versions are named as well.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT license (MIT)", "Expat License"],
    "MIT-0": ["MIT No Attribution License", "MIT No Attribution"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License, Version 2.0 (the \"License\")", "Apache License 2.0", "Apache 2.0 License", "Apache Software License, Version 2.0"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "EPL-1.0": ["Eclipse Public License, version 1.0", "Eclipse Public License - v 1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License - v 2.0", "Eclipse Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License", "BSD 2-Clause \"Simplified\" License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD 3-Clause \"New\" or \"Revised\" License"],
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License - Version 1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "PSF-2.0": ["Python Software Foundation License Version 2"],
    "CC0-1.0": ["Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal", "CC0 1.0", "Creative Commons CC0 1.0 Universal License"],
    "WTFPL": ["Do What The Fuck You Want To Public License"],
    "Unlicense": ["Unlicense"],
}
_GNU = {"GPL": ("GNU General Public License", "GNU GPL", ("1.0", "2.0", "3.0")), "LGPL": ("GNU Lesser General Public License", "GNU LGPL", ("2.0", "2.1", "3.0")), "AGPL": ("GNU Affero General Public License", "GNU AGPL", ("3.0",))}
_CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
#: What may lead to a licence's name, besides nothing or "the".
_LEADS = [*(f"{subject}{verb} under " for subject in ("", "This project is ", "This work is ", "This software is ", "This program is ", "This file is ", "This library is ", "This document is ", "The code is ") for verb in ("Licensed", "Released", "Distributed", "Made available", "Available"))]
_ARTICLES = ("", "the ", "a ", "an ", "the terms of the ")

#: (licence, identifiers that follow one another), in order of precedence.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("name.MIT", "mit.grant", "mit.notice", "mit.warranty")),
    ("MIT", ("mit.grant", "mit.notice", "mit.warranty")),
    ("MIT-0", ("name.MIT-0", "mit0.grant", "mit.warranty")),
    ("MIT-0", ("mit0.grant", "mit.warranty")),
    ("Apache-2.0", ("name.Apache-2.0", "apache2.compliance", "apache2.copy", "apache2.basis", "apache2.see")),
    ("Apache-2.0", ("name.Apache-2.0", "apache2.compliance", "apache2.copy")),
    ("Apache-2.0", ("apache2.terms", "apache2.copyright")),
    ("BSD-4-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.advertising", "bsd.endorse")),
    *((k, (*head, "bsd.grant", "bsd.source", "bsd.binary", *tail)) for k, tail in (("BSD-3-Clause", ("bsd.endorse",)), ("BSD-2-Clause", ())) for head in ((f"name.{k}",), ())),
    ("ISC", ("name.ISC", "isc.grant")),
    ("ISC", ("isc.grant",)),
    ("0BSD", ("name.0BSD", "0bsd.grant")),
    ("0BSD", ("0bsd.grant",)),
    ("Zlib", ("name.Zlib", "zlib.warranty", "zlib.grant", "zlib.origin", "zlib.altered")),
    ("Zlib", ("zlib.warranty", "zlib.grant", "zlib.origin")),
    ("BSL-1.0", ("name.BSL-1.0", "boost.grant")),
    ("BSL-1.0", ("boost.grant",)),
    ("Unlicense", ("unlicense.free", "unlicense.anyone")),
    ("Unlicense", ("unlicense.free",)),
    ("MPL-1.1", ("mpl1.form",)),
    ("MPL-2.0", ("mpl2.form", "mpl2.copy")),
    ("MPL-2.0", ("mpl2.form",)),
    ("EPL-1.0", ("epl1.made",)),
    ("EPL-2.0", ("epl2.made",)),
    ("CC0-1.0", ("cc0.waive",)),
    ("WTFPL", ("name.WTFPL", "wtfpl.do")),
    ("PostgreSQL", ("postgresql.grant",)),
    ("GPL-2.0-only", ("gpl2.linux",)),
]


def _complete() -> None:
    """Sentences and rules that follow from names."""
    for kind, (name, short, versions) in _GNU.items():
        for version in versions:
            v = version.removesuffix(".0")
            full = [f"{n}{a}{x}" for n in (name, short) for a in (", version ", " version ", " v", " ") for x in {v, version}]
            NAMES[f"{kind}-{version}-only"] = full
            later = ["or later", "or any later version", "or (at your option) any later version"]
            NAMES[f"{kind}-{version}-or-later"] = [f"{n} {x}" for n in full for x in later]
            SENTENCES[f"version.{version}"] = [f"either version {x} of the License, or (at your option) any later version" for x in {v, version}]
            RULES.append((f"{kind}-{version}-or-later", (f"{kind.lower()}.free", f"version.{version}")))
        others = [name] + ["GNU Library General Public License"] * (kind == "LGPL")
        SENTENCES[f"{kind.lower()}.free"] = [
            f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the {n} as published by the Free Software Foundation"
            for thing in ("program", "library", "file", "software") for n in others
        ]
        SENTENCES[f"{kind.lower()}.see"] = [f"See the {n} for more details" for n in others]
    for kind, name in _CC.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            full = [f"Creative Commons {name} {version}{place}{x}" for place in ("", " International", " Unported", " Generic") for x in (" License", " Public License", "")]
            NAMES[f"CC-{kind}-{version}"] = [f"CC {kind} {version}", f"CC-{kind}-{version}", *full]
    for licence, names in NAMES.items():
        SENTENCES[f"name.{licence}"] = names
        RULES.append((licence, (f"name.{licence}",)))
    RULES.extend([("MIT-fragment", ("mit.grant",)), ("MIT-fragment", ("mit.warranty",)), ("all-rights-reserved", ("reserved",))])


_complete()
#: Identifiers of SPDX expressions that are known, by lower case.
SPDX = {x.lower(): x for x in [*NAMES, "BSD-4-Clause", "PostgreSQL", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CDDL-1.0", "CDDL-1.1", "EUPL-1.2", "NCSA", "OFL-1.1", "Python-2.0", "Ruby", "Vim", "W3C", "X11", "curl", "OpenSSL"]}
_EXPRESSION = re.compile(r"SPDX-License-Identifier:[ \t]*((?:[A-Za-z0-9.+:-]{1,100}|[()]|[ \t]{1,8}(?=[A-Za-z0-9(.)]))+)")


def spdx(expression: str) -> list[str]:
    """Licences of an SPDX expression, in order, each with its exception; what is no expression has none."""
    tokens = re.findall(r"[()]|[^()\s]+", expression)
    out, depth, want = [], 0, True
    for k, t in enumerate(tokens):
        if want and t == "(":
            depth += 1
        elif not want and t == ")" and depth:
            depth -= 1
        elif not want and t.upper() in ("AND", "OR") and k + 1 < len(tokens):
            want = True
        elif not want and t.upper() == "WITH" and k + 1 < len(tokens):
            want = None
        elif want is None and re.fullmatch(r"[A-Za-z0-9.-]+", t):
            out[-1], want = f"{out[-1]} WITH {t}", False
        elif want and (known := _known(t)) is not None:
            out.append(known)
            want = False
        else:  # the text goes on: what was complete before stands
            break
    return out


def _known(token: str) -> str | None:
    token = token.rstrip(".") if token.lower() not in SPDX else token
    if token.startswith("LicenseRef-") or ":LicenseRef-" in token:
        return token
    plain = SPDX.get(token.lower().removesuffix("+"))
    if plain is None:
        return None
    if re.match(r"A?L?GPL-\d", plain):  # GNU licences name their versions apart
        base = plain.removesuffix("-only").removesuffix("-or-later")
        return f"{base}-or-later" if token.endswith("+") or plain.endswith("-or-later") else f"{base}-only"
    return plain


_WORD = re.compile(r"\w+")
#: What may follow a whole sentence.
_END = re.compile(r"[\"')\]]*(?:[.!?;:,]+(?:\s|\Z)|\s*\n|\s*\Z|\s*[-–—(|*])")
#: What may stand before a sentence within a line.
_BEFORE = (".", "!", "?", ";", ":", ",", "(", "|", '"')


def _begins(text: str, start: int) -> bool:
    """Whether a sentence may begin at the word: after a mark, or as the first word of a line, however far indented."""
    at = start
    while at and text[at - 1] not in "\n_" and not text[at - 1].isalnum():
        at -= 1
    return not at or text[at - 1] == "\n" or text[at:start].rstrip().endswith(_BEFORE)


class Sentences:
    """A trie of normalised words; licences' names are one part of it, which all their leads share."""

    def __init__(self, sentences: dict[str, list[str]] = SENTENCES):
        self.trie, names = {}, {}
        for identifier, wordings in sentences.items():
            for wording in wordings:
                self._node(names if identifier.startswith("name.") else self.trie, wording)[""] = identifier
                if identifier.startswith("name."):
                    self._node(self.trie, wording)[""] = self._node(self.trie, f"the {wording}")[""] = identifier
        for lead in _LEADS:
            for article in _ARTICLES:
                node = self._node(self.trie, lead + article)
                if node.keys() & names.keys():
                    raise ValueError(f"{lead + article!r} begins a sentence that goes on like a name")
                node.update(names)
        firsts = sorted(self.trie)
        self._first = re.compile(rf"(?<!\w)(?:{'|'.join(''.join(f'[{c}{c.upper()}]' if c.isalpha() else c for c in w) for w in firsts)})(?!\w)")

    @staticmethod
    def _node(node: dict, wording: str) -> dict:
        for word in _WORD.findall(wording.lower()):
            node = node.setdefault(word, {})
        return node

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """(identifier, start, end) of known sentences and SPDX licences (``spdx:``), left to right without overlaps."""
        out, free = [], 0
        named = [(m.start(), m.end(1), spdx(m[1])) for m in _EXPRESSION.finditer(text)] if "SPDX-License-Identifier" in text else []
        for first in self._first.finditer(text):
            start = first.start()
            if start < free or not _begins(text, start):
                continue
            node, best = self.trie, None
            for word in _WORD.finditer(text, start):
                node = node.get(word.group().lower())
                if node is None:
                    break
                if "" in node and _END.match(text, word.end()):
                    best = (node[""], start, word.end())
            if best is not None:
                out.append(best)
                free = best[2]
        if named:
            out = [f for f in out if not any(a <= f[1] < b for a, b, _ in _near(named, f[1]))]
            out = sorted([*out, *((f"spdx:{x}", a, b) for a, b, found in named for x in found)], key=lambda f: f[1])
        return out


@functools.cache
def known_sentences() -> Sentences:
    """One trie in a Python worker."""
    return Sentences()


def _near(named: list[tuple], place: int) -> list[tuple]:
    """The expression that begins last before the place."""
    k = bisect_right(named, place, key=lambda n: n[0])
    return named[k - 1 : k]


def match_rules(found: list[tuple[str, int, int]], rules: list[tuple[str, tuple[str, ...]]] = RULES, gap: int = GAP) -> list[tuple[str, int, int]]:
    """(licence, start, end): rules in order over the sequence of identifiers, each used once; SPDX licences last.

    Unused identifiers are a linked list, and each rule is tried only where its first one stands: linear in their number.
    """
    n, places, out = len(found), defaultdict(list), []
    after, before, used = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    for k, (identifier, _, _) in enumerate(found):
        places[identifier].append(k)
    for licence, wanted in rules:
        if any(identifier not in places for identifier in wanted):
            continue
        for first in places[wanted[0]]:
            if used[first]:
                continue
            hits = [first]
            for identifier in wanted[1:]:
                k = after[hits[-1]]
                for _ in range(gap):
                    if k >= n or found[k][0] == identifier:
                        break
                    k = after[k]
                if k >= n or found[k][0] != identifier:
                    break
                hits.append(k)
            if len(hits) == len(wanted):
                out.append((licence, found[first][1], found[hits[-1]][2]))
                for k in hits:
                    used[k] = True
                    if after[k] < n:
                        before[after[k]] = before[k]
                    if before[k] >= 0:
                        after[before[k]] = after[k]
    out += [(f[0][5:], f[1], f[2]) for f in found if f[0].startswith("spdx:")]
    return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, licences array<string>, spans array<struct<licence, start, end>>, sentences array<string>) of each row."""
    tuned(docs.sparkSession)
    span = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        known = known_sentences()
        for batch in batches:
            found = [known.find(t.as_py() or "") for t in batch.column(1)]
            matched = [match_rules(f) if f else [] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([sorted({m[0] for m in ms}) for ms in matched], pa.list_(pa.string())),
                    pa.array([[dict(zip(("licence", "start", "end"), m, strict=True)) for m in ms] for ms in matched], span),
                    pa.array([[f[0] for f in fs] for fs in found], pa.list_(pa.string())),
                ],
                [id_col, "licences", "spans", "sentences"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, licences array<string>, spans array<struct<licence:string,start:int,end:int>>, sentences array<string>"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
