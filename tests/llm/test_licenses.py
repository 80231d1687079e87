"""Licence sentences and rules: cases by hand, and the query against a plain search."""

from __future__ import annotations

from llm_cases import DATA, EDGE, edge, texts  # noqa: F401

from kpiloom.llm import licenses, queries


def names(text):
    return licenses.licenses(licenses.sentence_ids(text))


MIT = """MIT License

Copyright (c) 2020 A

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, A
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """ * This program is free software; you can redistribute it and/or
 * modify it under the terms of the GNU General Public License
 * as published by the Free Software Foundation; either version 2
 * of the License, or (at your option) any later version.
"""
LGPL = """This library is free software; you can redistribute it and/or modify it
under the terms of the GNU Lesser General Public License as published by the
Free Software Foundation; either version 2.1 of the License, or (at your
option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


def test_notices():
    assert names(MIT) == ["MIT"]
    assert licenses.sentence_ids(MIT)[-4:] == ["mit-grant", "mit-notice", "mit-as-is", "mit-liable"]
    assert names(BSD) == ["BSD-2-Clause"]
    assert names(BSD + "\n" + ENDORSE) == ["BSD-3-Clause"]
    assert names(BSD.replace("1. ", "a) ").replace("2. ", "* ") + ENDORSE.replace("3. ", "(3) ")) == ["BSD-3-Clause"]
    assert names(GPL) == ["GPL-2.0-or-later"]
    assert names(GPL.replace("2\n", "3\n").replace("GNU General", "GNU Affero General")) == ["AGPL-3.0-or-later"]
    assert names(LGPL) == ["LGPL-2.1-or-later"]
    assert names(ISC) == ["ISC"]
    assert names("Licensed under CC BY 3.0.") == ["CC-BY-3.0"]
    long = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    assert names(long) == ["CC-BY-SA-4.0"]


def test_wrapped_over_any_number_of_lines():
    for text, name in ((MIT, "MIT"), (ISC, "ISC"), (LGPL, "LGPL-2.1-or-later")):
        assert names("\n// ".join(text.split())) == [name]  # a line for each word
    assert names("lorem\n" * 5000 + GPL + "ipsum\n" * 5000) == ["GPL-2.0-or-later"]


def test_tags():
    tag = "SPDX-License-Identifier:"
    assert names(f"# {tag} MIT\nx") == ["MIT"]
    assert names(f"// {tag} GPL-2.0-only\nint x;") == ["GPL-2.0-only"]
    assert names(f"/* {tag} BSD-3-Clause */") == ["BSD-3-Clause"]
    expression = "(GPL-2.0-only WITH Linux-syscall-note) OR MIT"
    assert names(f"{tag} {expression}") == ["GPL-2.0-only", "Linux-syscall-note", "MIT"]
    assert names(f"{tag} MIT.\nLicensed under the Apache License, Version 2.0") == ["MIT", "Apache-2.0"]
    assert names(f"{tag} Unheard-of-1.0") == []


def test_cases():
    grant, notice = (licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-notice"))
    assert names(f"{grant}\n{notice}.") == ["MIT"]
    assert names(f"{grant}\nSomething else.\n{notice}.") == []
    assert names("Bla bla.\nLicensed under the Apache License, Version 2.0.\nMore.") == ["Apache-2.0"]
    assert names("Released under the MIT License.\nMore.\nReleased under the MIT License.") == ["MIT"]
    assert names("junk***\nLicensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert names("They were licensed under CC BY-NC 4.0.") == []
    assert names("All rights reserved.") == ["proprietary"]
    assert names("") == []


#: The licence lines of the test tables.
LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "All rights reserved.": "proprietary",
    "Released under the MIT License.": "MIT",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_query_against_a_plain_search(spark, texts):  # noqa: F811
    got = {r.doc_id: r for r in queries.op5_license_scan(spark, DATA).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = {LINES[x] for x in (text or "").split("\n") if x in LINES}
        assert got[i].licenses == ",".join(sorted(want))
    assert sum(r.licenses != "" for r in got.values()) >= 3


def test_edge_rows(spark, edge):  # noqa: F811
    got = licenses.scan(edge).collect()
    assert len(got) == len(EDGE) and all(r.sentences == [] and r.licenses == [] for r in got)
    assert licenses.scan(edge.limit(0)).collect() == []
