"""Licence recognition by sentences and ordered rules.

A text is a sequence of words: case, punctuation, quotes and comment marks do not count, so neither do line breaks, and a
sentence is the same in a wrapped file, behind comment marks or in one line. A sentence may begin at the start of a line or
after a final mark, and ends at the end of a line or before a final mark; the longest known one that does is taken. Known
sentences are whole ones, with slots for what differs (years, holders, addresses), and each becomes its identifier.

The sequence of identifiers of a text, with other sentences left out, is then matched against rules: each rule is a
sequence of identifiers that stands for a licence. Rules are tried in order at each place, longer and stricter ones first,
and a matched sequence is used up; what matches no rule is reported as unmatched.

Covered are the texts or standard headers of MIT, the BSD family, ISC, Zlib, Apache-2.0, GPL, LGPL, AGPL, MPL-2.0, EPL-2.0,
BSL-1.0, Unlicense and CC0, short references to those and to the Creative Commons licences, all SPDX tags, and proprietary
notices.

Each known sentence has a marker word, so texts without any are done after one search; of the others, only places where the
first word of a known sentence begins one are looked at. The work is a map over documents; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import texts, with_row_id

# Wording of the public licence texts and of their usual notices. [x|y]: may be there; {x|y}: one of them; <n>:
# up to n words.
SENTENCES = (
    ("all-rights", "all rights reserved"),
    ("mit-title", "[the] mit license [mit]"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-title", "[the] {bsd 2 clause|bsd 3 clause|new bsd|modified bsd|simplified bsd} license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-endorse", "neither the {name|names} of <10> nor the names of [its|the] contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-warranty", "this software is provided by <12> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-liability", "in no event shall <12> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc-title", "[the] isc license"),
    ("isc-grant", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-warranty", "the software is provided as is and {the author disclaims|isc disclaims|the authors disclaim} all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc-liability", "in no event shall {the author|the authors|isc} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib-warranty", "this software is provided as is without any express or implied warranty"),
    ("zlib-liability", "in no event will the {author|authors} be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("apache2-grant", "licensed under the apache license version 2.0 the license"),
    ("apache2-use", "you may not use this {file|software|work|project} except in compliance with the license"),
    ("apache2-copy", "you may obtain a copy of the license at [<8>]"),
    ("apache2-warranty", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-warranty", "{this program|this library|this software|this file|it} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu [lesser|affero|library] general public license for more details"),
    ("gpl-copy", "you should have received a copy of the gnu [lesser|affero|library] general public license along with this {program|library|software|file} [if not {see|write to} <25>]"),
    ("mpl2-header", "this source code form is subject to the terms of the mozilla public license {v|version} 2.0"),
    ("mpl2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at <8>"),
    ("epl2-header", "this program and the accompanying materials are made available under the terms of the eclipse public license [v|version] 2.0 which [accompanies this distribution and] is available at <10>"),
    ("bsl1-header", "distributed under the boost software license version 1.0 [see accompanying file <12>]"),
    ("unlicense-domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense-grant", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0-waiver", "to the extent possible under law <15> {has|have} waived all copyright and related or neighboring rights to this {work|software|<4>}"),
)

# Families of the public licences that share one notice, with their names and versions.
GNU = (("gpl", "gnu general public license", "GPL", ("2.0", "3.0")), ("lgpl", "gnu {lesser|library} general public license", "LGPL", ("2.1", "3.0")), ("agpl", "gnu affero general public license", "AGPL", ("3.0",)))
# What licences are called in short references.
NAMES = (
    ("MIT", "{mit license|mit}"), ("Apache-2.0", "{apache license [version|v] {2|2.0}|apache {2|2.0} license|apache {2|2.0}}"), ("MPL-2.0", "mozilla public license [version|v] 2.0"), ("EPL-2.0", "eclipse public license [version|v] 2.0"),
    ("BSL-1.0", "boost software license [version|v] 1.0"), ("BSD-3-Clause", "{bsd 3 clause license|3 clause bsd license|new bsd license|modified bsd license}"), ("BSD-2-Clause", "{bsd 2 clause license|2 clause bsd license|simplified bsd license}"),
    ("ISC", "isc license"), ("Zlib", "zlib license"), ("Unlicense", "unlicense"), ("CC0-1.0", "{cc0|cc0 1.0|creative commons zero|creative commons cc0} [1.0] [universal] [license]"),
    ("CC-BY-NC-4.0", "{cc by nc|creative commons attribution {noncommercial|non commercial}} [license] [4.0] [international] [license]"),
    ("CC-BY-SA-4.0", "{cc by sa|creative commons attribution {sharealike|share alike}} [license] [4.0] [international] [license]"),
    ("CC-BY-ND-4.0", "{cc by nd|creative commons attribution {noderivatives|no derivatives}} [license] [4.0] [international] [license]"),
    ("CC-BY-4.0", "{cc by|creative commons attribution} [license] [4.0] [international] [license]"),
)
REFERENCE = "[{this|the} {work|software|program|project|code|source code|file|library|package|module|document} is] {released|licensed|distributed|available|made available|published} under [the terms of] [the|a|an] %s [the license] [see <12>]"


FREE = "{this program|this library|this software|this file|it} is free software you can redistribute it and or modify it under the terms of"
PUBLISHED = "as published by the free software foundation"
# What a GNU notice without a version stands for, which is any version.
ANY_VERSION = {"gpl": "GPL-1.0-or-later", "lgpl": "LGPL-2.0-or-later", "agpl": "AGPL-3.0-or-later"}


def _references() -> Iterator[tuple[str, str]]:
    for licence, name in NAMES:
        yield f"ref {licence}", REFERENCE % name
    for key, name, short, versions in GNU:
        for v in versions:
            said = f"[version|v] {{{v}|{v.removesuffix('.0')}|v{v.removesuffix('.0')}}}"
            for suffix, more in (("only", "[only]"), ("or-later", "or {later|any later version|at your option any later version}")):
                yield f"ref {short}-{v}-{suffix}", REFERENCE % f"{{{name}|{key}}} {said} {more}"
                number = f"{{{v}|{v.removesuffix('.0')}}}"
                if suffix == "or-later":
                    yield f"{key}-{v}-{suffix}", f"{FREE} [version {number} of] the {name} [version {number}] {PUBLISHED} {{either version|version}} {number} of the license or at your option any later version"
                else:  # the version has to be said, before or behind the publisher
                    yield f"{key}-{v}-{suffix}", f"{FREE} {{{{version {number} of the {name}|the {name} version {number}}} {PUBLISHED} [version {number} of the license]|the {name} {PUBLISHED} version {number} of the license}}"
        yield f"{key}-any", f"{FREE} the {name} {PUBLISHED}"



#: (licence, identifiers in order), tried from the top; ? may be left out, * may repeat or be left out. An identifier that
#: begins with "ref" or "spdx" names its licence itself.
RULES = (
    ("MIT", ("mit-title?", "copyright*", "all-rights?", "mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("BSD-3-Clause", ("bsd-title?", "copyright*", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty", "bsd-liability?")),
    ("BSD-2-Clause", ("bsd-title?", "copyright*", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability?")),
    ("BSD-1-Clause", ("copyright*", "all-rights?", "bsd-grant", "bsd-source", "bsd-warranty", "bsd-liability?")),
    ("ISC", ("isc-title?", "copyright*", "isc-grant", "isc-warranty", "isc-liability")),
    ("0BSD", ("copyright*", "0bsd-grant", "isc-warranty", "isc-liability")),
    ("Zlib", ("copyright*", "zlib-warranty", "zlib-liability", "zlib-grant")),
    ("Apache-2.0", ("copyright*", "all-rights?", "apache2-grant", "apache2-use?", "apache2-copy?", "apache2-warranty?", "apache2-see?")),
    *((f"{short}-{v}-{suffix}", ("copyright*", f"{key}-{v}-{suffix}", "gpl-warranty?", "gpl-see?", "gpl-copy?")) for key, _, short, versions in GNU for v in versions for suffix in ("or-later", "only")),
    *((licence, ("copyright*", f"{key}-any", "gpl-warranty?", "gpl-see?", "gpl-copy?")) for key, licence in ANY_VERSION.items()),
    ("MPL-2.0", ("copyright*", "mpl2-header", "mpl2-copy?")),
    ("EPL-2.0", ("copyright*", "epl2-header")),
    ("BSL-1.0", ("copyright*", "bsl1-header")),
    ("Unlicense", ("unlicense-domain", "unlicense-grant?")),
    ("CC0-1.0", ("cc0-waiver",)),
    ("MIT", ("mit-title",)),
    ("ISC", ("isc-title",)),
    ("proprietary", ("copyright", "all-rights")),
    ("proprietary", ("all-rights",)),
    ("notice", ("copyright",)),
)

#: Each known sentence has one of these, in lower case.
MARKERS = (
    "licens", "licenc", "copyright", "©", "(c)", "reserved", "permission", "warrant", "redistribut", "liable", "endorse", "unencumbered", "anyone", "obtain",
    "released", "distributed", "available", "published",
)
_WORD = re.compile(r"\(c\)|[a-z0-9]+(?:[.'’][a-z0-9]+)*|©")
_BREAK = re.compile(r"[\r\n]|[.!?;:][\"'”’)\]]*(?:\s|$)")
_SPDX = re.compile(r"SPDX-License-Identifier:[\x20\t]*([A-Za-z0-9.+-]+(?:[\x20\t]+(?:AND|OR|WITH)[\x20\t]+[A-Za-z0-9.+-]+)*)")
_YEARS = r"(?:[0-9]{4}[ |])"
#: A notice goes to the first break: a year, a mark or both, and a holder.
_COPYRIGHT = re.compile(rf"(?:copyright[ |](?:(?:\(c\)|©)[ |])?|(?:\(c\)|©)[ |](?=[0-9]{{4}}[ |])){_YEARS}*(?:[^ |]+ ){{0,20}}(?:[^ |]+)?(?:(?<=\|)|\|)")


def pattern_of(template: str) -> str:
    """A regular expression over words that a blank or a break (|) follows."""
    out = []
    for t in re.findall(r"[\[\]{}|]|<\d+>|[^\s\[\]{}|<>]+", template.lower()):
        if t in "[{":
            out.append("(?:")
        elif t in "]}|":
            out.append({"]": ")?", "}": ")", "|": "|"}[t])
        elif t[0] == "<":
            out.append(r"(?:[^ |]+[ |]){0,%s}?" % t[1:-1])
        else:
            out.append(re.escape(t) + "[ |]")
    return "".join(out) + r"(?<=\|)"


def first_words(template: str) -> set[str]:
    """Words that a template may begin with."""
    found, depth, optional, fresh = set(), 0, False, True
    for t in re.findall(r"[\[\]{}|]|<\d+>|[^\s\[\]{}|<>]+", template.lower()):
        if t in "[{":
            depth += 1
            optional, fresh = (t == "[" if depth == 1 else optional), fresh
        elif t == "|":
            fresh = True
        elif t in "]}":
            depth -= 1
            if not depth and not optional:
                return found
            fresh = True
        elif fresh:
            found.add(t)
            fresh = False
            if not depth:
                return found
    return found


KNOWN = tuple((name, re.compile(pattern_of(t)), len(t.split()) + 12 * t.count("<"), frozenset(first_words(t))) for name, t in (*SENTENCES, *_references())) + (("copyright", _COPYRIGHT, 30, frozenset(("copyright", "(c)", "©"))),)
_BY_FIRST: dict[str, list] = defaultdict(list)
for _known in KNOWN:
    for _first in _known[3]:
        _BY_FIRST[_first].append(_known)


def marked(text: str) -> bool:
    low = text.lower()
    return any(m in low for m in MARKERS)


def words_of(text: str) -> list[tuple[str, int, int, bool]]:
    """(word, start, end, whether a break follows) of each word; a list mark is followed by one, too."""
    found = list(_WORD.finditer(text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)))
    out = []
    for i, m in enumerate(found):
        gap = text[m.end() : found[i + 1].start()] if i + 1 < len(found) else "\n"
        out.append((m[0], m.start(), m.end(), bool(_BREAK.search(gap)) or (len(m[0]) <= 2 and gap[:1] in ").")))
    return out


def sentences(text: str, known=_BY_FIRST) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the known sentences in order, without overlaps. known: by first word."""
    words = words_of(text)
    tags = {m.start(): m for m in _SPDX.finditer(text)}
    out, i = [], 0
    while i < len(words):
        word, start, _, _ = words[i]
        if start in tags:
            m = tags[start]
            out.append((f"spdx {' '.join(m[1].split())}", start, m.end(1)))
            while i < len(words) and words[i][1] < m.end(1):
                i += 1
            continue
        best = None
        if word in known and (not i or words[i - 1][3]):
            most = max(k[2] for k in known[word])
            said = "".join(w + ("|" if b else " ") for w, _, _, b in words[i : i + most])
            for name, pattern, _, _ in known[word]:
                m = pattern.match(said)
                if m and (best is None or m.end() > best[1]):
                    best = (name, m.end())
        if best is None:
            i += 1
            continue
        n = said.count(" ", 0, best[1]) + said.count("|", 0, best[1])
        out.append((best[0], start, words[i + n - 1][2]))
        i += n
    return out


def _rule_end(names: list[str], i: int, rule: tuple[str, ...]) -> int | None:
    for element in rule:
        name = element.rstrip("?*")
        if i < len(names) and names[i] == name:
            i += 1
            while element[-1] == "*" and i < len(names) and names[i] == name:
                i += 1
        elif element[-1] not in "?*":
            return None
    return i


def match_rules(names: list[str]) -> list[tuple[str, int, int]]:
    """(licence, first, end) of sequences in order; at each place the first rule that matches uses its sentences up."""
    out, i = [], 0
    while i < len(names):
        kind, _, licence = names[i].partition(" ")
        end = i + 1
        if kind not in ("ref", "spdx"):
            licence = "unmatched"
            for name, rule in RULES:
                at = _rule_end(names, i, rule)
                if at is not None:
                    licence, end = name, at
                    break
        out.append((licence, i, end))
        i = end
    return out


def recognise(text: str) -> list[dict]:
    """licence, start, end (code points) and sentences (identifiers) of each match in order."""
    if not marked(text):
        return []
    found = sentences(text)
    return [{"licence": x, "start": found[i][1], "end": found[j - 1][2], "sentences": [f[0] for f in found[i:j]]} for x, i, j in match_rules([f[0] for f in found])]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: rid, doc_id, matches (array of licence, start, end, sentences).

    Null and empty texts have no matches; repeated rows each have their own; further columns are not looked at."""
    match = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("sentences", pa.list_(pa.string()))]))

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [recognise(t.decode("utf-8", "replace")) for t in texts(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, match)], names=["rid", "doc_id", "matches"])

    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).select("rid", "doc_id", "text")
    return rows.mapInArrow(out, f"rid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, matches array<struct<licence:string,start:long,end:long,sentences:array<string>>>")
