"""Declarations of one Java file. A scanner, not a parser: comments and literals are blanked, then braces lead the way.

One pass each finds line starts, comments and pairs of braces, so the time is in proportion to the file. Where braces do not
pair up, indentation decides: a closing brace that stands deeper than the line of the open one is taken for a stray, and a
line that begins a declaration ends all blocks whose lines are indented as much or more. So what follows a broken
declaration is found, and each type says how many braces its file had to be helped with.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_SKIP = re.compile(r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)')
_PACKAGE = re.compile(r"\bpackage\s+([\w.]+)\s*;")
_IMPORT = re.compile(r"\bimport\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;")
_ANNOTATION = re.compile(r"@(?!interface\b)([\w.]+)\s*(?:\((?:[^()]|\([^()]*\))*\))?")
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_TYPE = re.compile(r"\b(class|interface|enum)\s+([A-Za-z_$][\w$]*)")
_METHOD = re.compile(r"^(?:(?P<type>[\w$.]+(?:\s*<[^()]*>)?(?:\s*\[\s*\])*)\s+)?(?P<name>[A-Za-z_$][\w$]*)\s*\((?P<parameters>[^()]*)\)")
_FIELD = re.compile(r"^(?P<type>[\w$.]+(?:\s*<[^=;]*?>)?(?:\s*\[\s*\])*)\s+(?P<names>[A-Za-z_$][\w$]*\s*(?:\[\s*\])*\s*(?:[=,].*)?)$", re.DOTALL)
_BEGINS = re.compile(r"[ \t]*(?:@\w|(?:public|protected|private|static|abstract|final|class|interface|enum)\b)")
_BRACE = re.compile(r"[{}]")
_END = re.compile(r"[;{]")
_STRAYS = re.compile(r"[\s}]*")
_WORD = re.compile(r"([a-z-]+)\s+")
_FINAL = re.compile(r"\bfinal\s+")
_BRACKETS = re.compile(r"[<>()\[\]{}]")
#: In a broken file the package is in the first lines, and no more imports are taken.
PACKAGE_LINES, MOST_IMPORTS = 20, 100


class Source:
    """A file with what is looked up again and again: lines, comments, pairs of braces."""

    def __init__(self, source: str):
        self.source, self.comments, pieces, last = source, [], [], 0
        for m in _SKIP.finditer(source):
            if m[0][0] == "/":
                self.comments.append((m.start(), m.end()))
            pieces += [source[last : m.start()], re.sub(r"[^\n]", " ", m[0]) if "\n" in m[0] else " " * len(m[0])]
            last = m.end()
        #: Same length, with comments and literals as spaces; line ends stay.
        self.text = "".join([*pieces, source[last:]])
        self.comment_ends = [e for _, e in self.comments]
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.closes, self.problems = self._pairs()
        if self.problems:
            self.closes, self.problems = self._pairs_by_indent()

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def close(self, at: int) -> int:
        """Place behind the block whose brace is at ``at``."""
        return self.closes.get(at, len(self.text))

    def _pairs(self) -> tuple[dict[int, int], int]:
        closes, open_, problems = {}, [], 0
        for m in _BRACE.finditer(self.text):
            if m[0] == "{":
                open_.append(m.start())
            elif open_:
                closes[open_.pop()] = m.end()
            else:
                problems += 1
        return closes, problems + len(open_)

    def _pairs_by_indent(self) -> tuple[dict[int, int], int]:
        closes, open_, problems = {}, [], 0  # open: place and indent of its line
        for start, end in zip(self.lines, [*self.lines[1:], len(self.text)], strict=True):
            words = self.text[start:end].expandtabs(4)
            indent = len(words) - len(words.lstrip())
            if _BEGINS.match(self.text, start, end):
                while open_ and open_[-1][1] >= indent:
                    closes[open_.pop()[0]] = start
                    problems += 1
            for m in _BRACE.finditer(self.text, start, end):
                if m[0] == "{":
                    open_.append((m.start(), indent))
                    continue
                if not self.text[start : m.start()].strip():  # it leads its line
                    while open_ and open_[-1][1] > indent:
                        closes[open_.pop()[0]] = start
                        problems += 1
                    if not open_ or open_[-1][1] < indent:
                        problems += 1
                        continue
                if open_:
                    closes[open_.pop()[0]] = m.end()
                else:
                    problems += 1
        return closes, problems + len(open_)

    def javadoc(self, start: int, since: int) -> str | None:
        """The documentation comment before a declaration, with nothing but comments of a line in between. since: where the
        declaration before it ends."""
        i = bisect_right(self.comment_ends, start) - 1
        while i >= 0 and self.comments[i][0] >= since and self.source.startswith("//", self.comments[i][0]):
            i -= 1
        if i < 0 or self.comments[i][0] < since or not self.source.startswith("/**", self.comments[i][0]):
            return None
        return self.source[slice(*self.comments[i])]

    def members(self, start: int, end: int):
        """(end of the one before, start, end of the head, end) of the declarations in a stretch; a head ends before ";" or "{"."""
        at = start
        while (m := _END.search(self.text, at, end)) is not None:
            stop, head = m.end(), m.start()
            while m is not None and m[0] == "{":
                stop = min(self.close(m.start()), end)
                eq = self.text.find("=", at, head)
                if eq < 0 or "(" in _ANNOTATION.sub("", self.text[at:eq]):
                    break
                m = _END.search(self.text, stop, end)  # an initialiser: the declaration goes on
                stop = end if m is None else m.end()
            # strays before a declaration belong to none
            begin = _STRAYS.match(self.text, at, head).end()
            if self.text.count("(", begin, head) != self.text.count(")", begin, head):
                # a head that was cut off: the last line that begins a declaration is one of its own
                starts = self.lines[bisect_right(self.lines, begin) : bisect_right(self.lines, head)]
                begin = next((x + len(self.text[x:head]) - len(self.text[x:head].lstrip()) for x in reversed(starts) if _BEGINS.match(self.text, x, head)), begin)
            yield at, begin, head, stop
            at = stop


def _split(text: str, mark: str = ",") -> list[str]:
    """At marks outside of brackets."""
    if not _BRACKETS.search(text):
        return [x for x in map(str.strip, text.split(mark)) if x]
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += c in "<([{"
        depth -= c in ">)]}"
        if c == mark and not depth:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def _bare(text: str, instead: str = "") -> str:
    """Without annotations."""
    return _ANNOTATION.sub(instead, text) if "@" in text else text


def _plain(name: str) -> str:
    """Without type arguments."""
    return re.sub(r"<.*", "", name).strip() if "<" in name else name.strip()


def _imports(text: str) -> list[str]:
    found, at = [], text.find("import")
    while at >= 0:
        m = _IMPORT.match(text, at)
        if m:
            found.append(m[1])
        at = text.find("import", m.end() if m else at + 1)
    return found


def _head(text: str) -> tuple[list[str], list[str], str]:
    """(annotations, modifiers, the rest in single spaces) of a declaration."""
    annotations = ["@" + m[1] for m in _ANNOTATION.finditer(text)] if "@" in text else []
    words = " ".join(_bare(text, " ").split())
    modifiers = []
    while (m := _WORD.match(words)) and m[1] in _MODIFIERS:
        modifiers.append(m[1])
        words = words[m.end() :]
    return annotations, modifiers, words


def _without_parameters(words: str) -> str:
    """A declaration without the type parameters that it begins with."""
    depth = 0
    for i, c in enumerate(words if words.startswith("<") else ""):
        depth += (c == "<") - (c == ">")
        if not depth:
            return words[i + 1 :].lstrip()
    return words


def outer_names(source: str) -> list[str]:
    """The names of the outer types, in order; what is inside of them is not looked at."""
    file, found = Source(source), []
    for _, begin, head, _ in file.members(0, len(file.text)):
        words = _head(file.text[begin:head])[2]
        m = _TYPE.search(words)
        if m and not words[: m.start()].strip():
            found.append(m[2])
    return found


def types_of(source: str, texts: bool = True) -> list[dict]:
    """All classes, interfaces and enums with their place, parent (index or -1), fields and methods, outer ones first. Without
    texts there is no code and no documentation of types and methods."""
    file = Source(source)
    text = file.text
    package = m[1] if (m := _PACKAGE.search(text)) and (not file.problems or file.line(m.start()) <= PACKAGE_LINES) else ""
    imports = _imports(text)[: MOST_IMPORTS if file.problems else None]
    out: list[dict] = []

    def declare(since: int, start: int, head: int, stop: int, parent: int, depth: int) -> None:
        annotations, modifiers, words = _head(text[start:head])
        m = _TYPE.search(words)
        if not m or words[: m.start()].strip():
            return
        kind, name, rest = m[1], m[2], words[m.end() :]
        clause = lambda word: (re.search(rf"\b{word}\s+(.*?)(?=\b(?:extends|implements|permits)\b|$)", rest) or [None, ""])[1]
        bases = [_plain(x) for x in _split(clause("extends"))]
        own = {
            "parent": parent, "depth": depth, "name": name, "class_type": kind, "package": package, "imports": imports, "modifiers": modifiers, "annotations": annotations,
            "extends": bases[0] if bases else None, "implements": [_plain(x) for x in _split(clause("implements"))], "documentation": file.javadoc(start, since) if texts else None,
            "source_code": None if not texts else source if parent < 0 else source[start:stop], "start_line": file.line(start), "end_line": file.line(max(stop - 1, start)), "problems": file.problems, "fields": [], "methods": [],
        }
        out.append(own)
        number, body = len(out) - 1, head + 1
        inside = stop - text[:stop].endswith("}") if stop > head else stop
        if kind == "enum":  # constants end with the first ";" outside of braces and brackets
            level, body = 0, inside
            for i in range(head + 1, inside):
                level += text[i] in "{("
                level -= text[i] in "})"
                if text[i] == ";" and not level:
                    body = i + 1
                    break
        for before, begin, end, close in file.members(body, inside):
            notes, mods, declaration = _head(text[begin:end])
            if (t := _TYPE.search(declaration)) and not declaration[: t.start()].strip():
                declare(before, begin, end, close, number, depth + 1)
            elif "(" in declaration.split("=")[0]:
                method = _METHOD.match(_without_parameters(declaration))
                if method and method["type"] != "record" and (method["type"] or method["name"] == name):
                    parameters = [(_FINAL.sub("", _bare(p)) if "final" in p else _bare(p)).strip() for p in _split(method["parameters"])]
                    pairs = [p.rsplit(None, 1) for p in parameters if len(p.split()) > 1]
                    own["methods"].append({
                        "name": method["name"], "return_type": _plain(method["type"] or "void"), "parameters": [{"type": _plain(a), "name": b} for a, b in pairs], "modifiers": mods,
                        "annotations": notes, "documentation": file.javadoc(begin, before) if texts else None, "body": source[source.rfind("\n", 0, begin) + 1 : close] if texts else None, "start_line": file.line(begin), "end_line": file.line(max(close - 1, begin)),
                    })
            elif field := _FIELD.match(declaration):
                kind_of = _plain(field["type"])
                own["fields"] += [{"name": re.match(r"[\w$]+", x)[0], "type": kind_of, "modifiers": mods} for x in _split(field["names"]) if re.match(r"[A-Za-z_$]", x)]

    for before, begin, head, close in file.members(0, len(text)):
        declare(before, begin, head, close, -1, 0)
    return out
