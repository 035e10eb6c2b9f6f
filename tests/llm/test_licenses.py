"""Licence recognition on texts with known answers in all layouts, and against a search without short cuts."""

import random
import re
import textwrap

import pytest

from tessera.llm import licenses

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{comma} either version {v} of the License, or (at your option) any later version.

This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
TEXTS = {
    "MIT": MIT,
    "BSD-3-Clause": BSD.format(ENDORSE),
    "BSD-2-Clause": BSD.format(""),
    "Apache-2.0": APACHE,
    "GPL-3.0-or-later": GPL.format(what="program", mark=":", name="General Public License", comma=",", v="3"),
    "GPL-2.0-or-later": GPL.format(what="program", mark=";", name="General Public License", comma=";", v="2"),
    "LGPL-2.1-or-later": GPL.format(what="library", mark=";", name="Lesser General Public License", comma=";", v="2.1"),
    "AGPL-3.0-or-later": GPL.format(what="program", mark=":", name="Affero General Public License", comma=",", v="3"),
    "ISC": ISC,
    "0BSD": ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC0-1.0": "To the extent possible under law, Some One has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
}


def names(text):
    return [m["licence"] for m in licenses.recognise(text)]


def layouts(text):
    """The same text in one line for each paragraph, wrapped at several widths, and behind comment marks."""
    yield text
    for width in (40, 60, 78):
        lines = [line for p in text.split("\n\n") for line in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]]
        yield "\n".join(lines)
        for first, mark, last in (("", "# ", ""), ("/*\n", " * ", "\n */"), ("", "// ", ""), ("<!--\n", "  ", "\n-->"), ("", ";; ", "")):
            yield first + "\n".join((mark + line).rstrip() for line in lines) + last
    yield text.upper()
    yield " ".join(text.split())


@pytest.mark.parametrize("licence", sorted(TEXTS))
def test_all_layouts_give_one_result(licence):
    for text in layouts(TEXTS[licence]):
        assert names(text) == [licence], text
        assert names("Copyright (c) 2020-2024 Some One\n\n" + text) in ([licence], ["notice", licence])
        assert names(f"Some words before it.\n\n{text}\n\nint main() {{}}") == [licence]


def test_references_and_tags():
    assert names("Some text.\nReleased under the MIT License.") == ["MIT"]
    assert names("x\nLicensed under the Apache License, Version 2.0.\nAll rights reserved.") == ["Apache-2.0", "proprietary"]
    assert names("This work is licensed under the GNU General Public License, version 3.") == ["GPL-3.0-only"]
    assert names("a line without a mark\nLicensed under CC BY-NC 4.0.") == ["CC-BY-NC-4.0"]
    assert names("This library is distributed under the LGPL v2.1 or later.") == ["LGPL-2.1-or-later"]
    assert names("This project is licensed under the BSD 3-Clause License, see LICENSE for details.") == ["BSD-3-Clause"]
    for tag in ("Apache-2.0", "GPL-2.0-only", "MIT OR Apache-2.0", "GPL-2.0-only WITH Classpath-exception-2.0", "CC0-1.0", "LicenseRef-own"):
        for line in ("# SPDX-License-Identifier: {}\ncode", "/* SPDX-License-Identifier: {} */", "<!-- SPDX-License-Identifier: {} -->"):
            assert names(line.format(tag)) == [tag]
    assert names("The MIT License (MIT)\n\nCopyright (c) 2020 Some One\n\n" + MIT) == ["MIT"]
    assert names("Copyright 2019 A Company. All rights reserved.") == ["proprietary"]
    assert names("© 2019 A Company") == ["notice"]


def test_order_matters():
    bsd = ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]
    assert licenses.match_rules(bsd) == [("BSD-3-Clause", 0, 5)]
    assert licenses.match_rules([x for x in bsd if x != "bsd-endorse"]) == [("BSD-2-Clause", 0, 4)]
    assert [x[0] for x in licenses.match_rules(["bsd-source", "bsd-grant"])] == ["unmatched", "unmatched"]
    assert licenses.match_rules(["copyright", "copyright", "mit-grant", "mit-notice", "mit-warranty", "mit-liability", "ref ISC"]) == [("MIT", 0, 6), ("ISC", 6, 7)]


def test_parts_and_changed_sentences_are_not_taken_for_the_whole():
    assert names("Permission is hereby granted, free of charge, to any person to read this.") == []
    assert names(MIT.replace("free of charge", "for a fee")) == ["unmatched"] * 3
    assert names("It was released under the MIT License of nobody knows which year.") == []


def test_clean_prose_has_none():
    assert names("The permission slip was late. We licensed nothing. Rights and duties.\nCopying is fun.") == []
    assert names("") == []


def plain_sentences(text):
    """Every known sentence is tried at every place where one may begin; no markers, no first words."""
    words, out, i = licenses.words_of(text), [], 0
    tags = {m.start(): m for m in licenses._SPDX.finditer(text)}
    while i < len(words):
        if words[i][1] in tags:
            m = tags[words[i][1]]
            out.append((f"spdx {m[1]}", m.start(), m.end(1)))
            i = next((j for j in range(i, len(words)) if words[j][1] >= m.end(1)), len(words))
            continue
        said = "".join(w + ("|" if b else " ") for w, _, _, b in words[i:])
        ends = [(m.end(), -k, name) for k, (name, p, _, _) in enumerate(licenses.KNOWN) if (m := p.match(said))] if not i or words[i - 1][3] else []
        if not ends:
            i += 1
            continue
        end, _, name = max(ends)
        n = sum(said.count(c, 0, end) for c in " |")
        out.append((name, words[i][1], words[i + n - 1][2]))
        i += n
    return out


def test_against_search_without_short_cuts():
    rnd = random.Random(9)
    pieces = [*TEXTS.values(), "# SPDX-License-Identifier: MIT", "Released under the MIT License.", "Copyright (c) 2001, 2003 X Y Z", "All rights reserved.", "Some other words; and more. It is so", "1) The end", "LICENSE", "MIT"]
    for _ in range(60):
        parts = [rnd.choice(list(layouts(rnd.choice(pieces)))) for _ in range(rnd.randrange(1, 6))]
        text = rnd.choice(["\n", "\n\n", " "]).join(parts)
        found = licenses.sentences(text)
        assert found == plain_sentences(text)
        assert licenses.marked(text) >= bool(found)


def test_each_sentence_has_a_marker():
    for name, template in (*licenses.SENTENCES, *licenses._references()):
        # without what may be left out, and with each choice taken away in turn, a marker is left
        least = template
        while "[" in least:
            least = re.sub(r"\[[^\[\]]*\]", "", least)
        choices = re.findall(r"\{([^{}]*)\}", least)
        for word in choices[0].split("|") if choices else [""]:
            assert licenses.marked(least.replace("{" + choices[0] + "}", word) if choices else least), (name, word)


def test_rows(spark):
    rows = [(1, "Text. Released under the MIT License.", "a"), (1, "Text. Released under the MIT License.", "a"), (2, None, "b"), (3, "", "c"), (None, "é\nAll rights reserved.", "d"), (4, "word " * 40_000 + "\n" + MIT, "e"), (5, "İ\nAll rights reserved", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    got = sorted((str(r.doc_id), [m.licence for m in r.matches]) for r in licenses.scan(docs).collect())
    assert got == sorted([("1", ["MIT"]), ("1", ["MIT"]), ("2", []), ("3", []), ("None", ["proprietary"]), ("4", ["MIT"]), ("5", ["proprietary"])])
    span = {r.doc_id: (r.matches[0].start, r.matches[0].end) for r in licenses.scan(docs).collect() if r.matches}
    assert span[None] == (2, 21) and span[5] == (2, 21)
    assert licenses.scan(docs.limit(0)).count() == 0


def test_gnu_notices_by_version():
    def notice(name, before="", behind="", later=""):
        return f"This program is free software; you can redistribute it and/or modify it under the terms of {before}the GNU {name} as published by the Free Software Foundation{behind}{later}."

    general, lesser, affero = "General Public License", "Lesser General Public License", "Affero General Public License"
    option = ", or (at your option) any later version"
    assert names(notice(general)) == ["GPL-1.0-or-later"] and names(notice(lesser)) == ["LGPL-2.0-or-later"] and names(notice(affero)) == ["AGPL-3.0-or-later"]
    assert names(notice(general, behind="; version 2 of the License")) == ["GPL-2.0-only"] and names(notice(general, behind=", version 3 of the License")) == ["GPL-3.0-only"]
    assert names(notice(general, before="version 2 of ")) == ["GPL-2.0-only"] and names(notice(general + " version 3")) == ["GPL-3.0-only"]
    assert names(notice(lesser, behind=", version 3 of the License")) == ["LGPL-3.0-only"] and names(notice(lesser, before="version 2.1 of ")) == ["LGPL-2.1-only"]
    assert names(notice(general, behind="; either version 2 of the License", later=option)) == ["GPL-2.0-or-later"] and names(notice(lesser, behind="; either version 3 of the License", later=option)) == ["LGPL-3.0-or-later"]
