"""License scans by sentence rules.

Each text is cut into sentences, which are normalised (lower case, letters and digits only, single
spaces). Known sentences have identifiers; pieces that a sentence is wrapped over are joined again for
as long as what is joined begins some known sentence, so a sentence may be wrapped over any number of
lines. Numbers and letters that mark list items don't count. A tag of an SPDX expression gives an
identifier for each licence and exception that it names. The identifiers of a text, in order, are
matched against ordered rules: at each place the first rule whose sequence stands there names a
licence and its identifiers are used up; copyright sentences between them don't count. A licence that
several rules show is named once, where it first stands.

Defined results: null and empty texts have no sentence; unknown sentences are left out, and end a
sequence only where they stand between its parts; equal rows have equal results; long texts are read
whole; an empty table gives an empty table. Only the key and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import text_chunks

# Sentences of the licences' own texts and notices, and SPDX identifiers.
#: Known sentences, by identifier.
SENTENCES = {
    "apache-name": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")', 'Licensed under the Apache License, Version 2.0 (the "License");', "Released under the Apache License, Version 2.0", "Apache License, Version 2.0"],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-named-use": ['Licensed under the Apache License, Version 2.0 (the "License") you may not use this file except in compliance with the License'],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-basis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License"],
    "mit-name": ["Released under the MIT License", "Licensed under the MIT License", "The MIT License", "The MIT License (MIT)", "MIT License", "This project is licensed under the MIT License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "mit-as-is": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT', 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND'],
    "mit-liable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "isc-name": ["ISC License", "The ISC License", "Licensed under the ISC License", "Released under the ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-as-is": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "bsd-name": ["Released under the BSD License", "Licensed under the BSD License", "BSD License"],
    "bsd2-name": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License", "Licensed under the 2-Clause BSD License"],
    "bsd3-name": ["BSD 3-Clause License", "Licensed under the BSD 3-Clause License", "Licensed under the 3-Clause BSD License"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-advertise": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "gpl1-name": ["This work is licensed under the GNU General Public License, version 1", "Licensed under the GNU General Public License, version 1"],
    "gpl2-name": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"],
    "gpl3-name": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "mpl1-name": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")"],
    "mpl2-name": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "epl1-name": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "epl2-name": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "boost-name": ["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "wtfpl": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "cc-zero": ["Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "reserved": ["All rights reserved", "All rights reserved worldwide"],
}

#: Licences and the sequences of identifiers that show them; the first that fits counts.
RULES = [
    ("Apache-2.0", ("apache-named-use", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-named-use",)),
    ("Apache-2.0", ("apache-name", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-name", "apache-use", "apache-copy", "apache-basis")),
    ("Apache-2.0", ("apache-name",)),
    ("MIT", ("mit-name", "mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liable")),
    ("MIT", ("mit-name", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-name",)),
    ("ISC", ("isc-name", "isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-name",)),
    ("0BSD", ("0bsd-grant",)),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-4-Clause", ("reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-3-Clause", ("reserved", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("reserved", "bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd3-name",)),
    ("BSD-2-Clause", ("bsd2-name",)),
    ("BSD", ("reserved", "bsd-grant")),
    ("BSD", ("bsd-grant",)),
    ("BSD", ("bsd-name",)),
    ("GPL-1.0", ("gpl1-name",)),
    ("GPL-2.0", ("gpl2-name",)),
    ("GPL-3.0", ("gpl3-name",)),
    ("MPL-1.1", ("mpl1-name",)),
    ("MPL-2.0", ("mpl2-name", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-name",)),
    ("EPL-1.0", ("epl1-name",)),
    ("EPL-2.0", ("epl2-name",)),
    ("Unlicense", ("unlicense",)),
    ("BSL-1.0", ("boost-name",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("WTFPL", ("wtfpl",)),
    ("CC0-1.0", ("cc-zero",)),
]

#: SPDX identifiers without families: tags name them as they are.
SPDX = (
    "0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0 BSD-2-Clause BSD-2-Clause-Patent "
    "BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CPL-1.0 ECL-2.0 EPL-1.0 "
    "EPL-2.0 EUPL-1.1 EUPL-1.2 IPL-1.0 ISC MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 "
    "OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 QPL-1.0 Ruby SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C "
    "WTFPL X11 Zlib ZPL-2.1 "
    "Autoconf-exception-3.0 Bison-exception-2.2 Classpath-exception-2.0 GCC-exception-3.1 "
    "Linux-syscall-note LLVM-exception OpenSSL-exception"
).split()
#: Creative Commons licences, their full names, and versions with what follows them in full names.
CC = {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}
#: The GNU licences: names, and versions.
GNU = {
    "GPL": ("GNU General Public License", ("1", "2", "3")),
    "LGPL": ("GNU Lesser General Public License", ("2.1", "3")),
    "AGPL": ("GNU Affero General Public License", ("3",)),
}
# End of the fixed values.


def _families() -> None:
    """Adds the sentences and rules of licences that come in versions, and of SPDX tags."""

    def add(licence: str, name: str, sentences: list[str]) -> None:
        SENTENCES[name] = sentences
        RULES.append((licence, (name,)))

    for kind, full in CC.items():
        for version, area in CC_VERSIONS.items():
            short, licence = f"CC {kind} {version}", f"CC-{kind}-{version}"
            long = f"Creative Commons {full} {version} {area} License"
            heads = ("Licensed under", "This work is licensed under", "Released under")
            add(licence, licence.lower(), [f"{h} {n}" for h in heads for n in (short, f"a {long}", f"the {long}")])
            SPDX.append(licence)
    for family, (full, versions) in GNU.items():
        for version in versions:
            number = version if "." in version else f"{version}.0"
            thing = "program" if family != "LGPL" else "library"
            may = "you can redistribute it and/or modify it under the terms of the"
            by = "as published by the Free Software Foundation"
            starts = [f"{w} is free software {may} {full}" for w in ("It", f"This {thing}", "This program", "This file", "This software")]
            late, only = f"{family}-{number}-or-later", f"{family}-{number}-only"
            later = "of the License, or (at your option) any later version"
            add(late, late.lower(), [f"{s} {by}, either version {version} {later}" for s in starts])
            exactly = [f"{s}{v} {by}{e}" for s in starts for v, e in ((f" version {version}", ""), ("", f", version {version}"), ("", f", version {version} of the License"))]
            add(only, only.lower(), exactly)
            SPDX.extend([late, only, f"{family}-{number}", f"{family}-{number}+"])
    for licence in SPDX:
        add(licence, f"spdx-{licence.lower()}", [])
    RULES.append(("proprietary", ("reserved",)))


_families()
COPYRIGHT = "copyright"
PIECE = re.compile(r"(?<=[.!?;:])\s+|\n")
OTHER = re.compile(r"[^a-z0-9]+")
#: Marks of list items.
MARK = re.compile(r"(?:[0-9]{1,2}|[a-z]|i{2,3}|iv)")
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)", re.IGNORECASE)
NAME = re.compile(r"[A-Za-z0-9.+-]+")


def normalised(sentence: str) -> str:
    return OTHER.sub(" ", sentence.lower()).strip()


KNOWN = {normalised(text): name for name, texts in SENTENCES.items() for text in texts}
#: What known sentences begin with, by whole words.
BEGUN = {" ".join(words[:n]) for words in map(str.split, KNOWN) for n in range(1, len(words) + 1)}
FIRST_WORDS = {text.split()[0] for text in KNOWN} | {COPYRIGHT}
ANY_FIRST = re.compile("|".join(sorted({*FIRST_WORDS, "spdx"})), re.IGNORECASE)
TAGGED = {licence.lower(): f"spdx-{licence.lower()}" for licence in SPDX}
BY_FIRST: dict[str, list[tuple[str, tuple[str, ...]]]] = {}
for _licence, _sequence in RULES:
    BY_FIRST.setdefault(_sequence[0], []).append((_licence, _sequence))


def sentence_ids(text: str) -> list[str | None]:
    """Identifiers of the known sentences in order; None once for unknown ones between them."""
    if not ANY_FIRST.search(text):
        return []
    found: list[str | None] = []
    done = 0
    for tag in TAG.finditer(text):
        _read(text[done : tag.start()], found)
        found += [TAGGED[n] for n in (w.rstrip(".").lower() for w in NAME.findall(tag[1])) if n in TAGGED]
        done = tag.end()
    _read(text[done:], found)
    return found[:-1] if found and found[-1] is None else found


def _read(text: str, found: list[str | None]) -> None:
    pieces = [p for p in map(normalised, PIECE.split(text)) if p]
    at = 0
    while at < len(pieces):
        name, used = _sentence(pieces, at)
        if name or (found and found[-1] and not MARK.fullmatch(pieces[at])):
            found.append(name)
        at += used


def _sentence(pieces: list[str], at: int) -> tuple[str | None, int]:
    """The longest known sentence that begins here, and the pieces that it takes."""
    first, _, rest = pieces[at].partition(" ")
    joined = rest if MARK.fullmatch(first) and rest.partition(" ")[0] in FIRST_WORDS else pieces[at]
    first = joined.partition(" ")[0]
    if first not in FIRST_WORDS:
        return None, 1
    best: tuple[str | None, int] = (COPYRIGHT if first == COPYRIGHT else None, 1)
    used = 1
    while joined in BEGUN:
        if joined in KNOWN:
            best = (KNOWN[joined], used)
        if at + used == len(pieces):
            break
        joined = f"{joined} {pieces[at + used]}"
        used += 1
    return best


def licenses(ids: list[str | None]) -> list[str]:
    """Names of the licences whose rules fit, each once, in order."""
    rest, names, at = [i for i in ids if i != COPYRIGHT], {}, 0
    while at < len(rest):
        rules = BY_FIRST.get(rest[at], []) if rest[at] else []
        name, used = next(((n, len(seq)) for n, seq in rules if tuple(rest[at : at + len(seq)]) == seq), (None, 1))
        if name:
            names[name] = None
        at += used
    return list(names)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``sentences`` (identifiers in order) and ``licenses`` (names in order) of every row."""
    picked = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    strings = pa.list_(pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches, "text"):
            ids = [sentence_ids(t or "") for t in chunk.column("text").to_pylist()]
            known = [[i for i in own if i] for own in ids]
            names = [licenses(own) for own in ids]
            columns = [chunk.column("key"), pa.array(known, strings), pa.array(names, strings)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "sentences", "licenses"])

    found = picked.mapInArrow(work, f"key {kind}, sentences array<string>, licenses array<string>")
    return found.withColumnRenamed("key", key)
