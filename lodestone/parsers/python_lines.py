"""Python sources by lines: imports, classes with their methods, functions and constants.

A line scanner, not a grammar: a definition is what one line shows. Blocks are told by indentation (a tab counts
four). A function whose parameters do not close on its line has the name Anonymous and no parameters.
"""

from __future__ import annotations

import re

from ..operators.globs import name_matches
from ..schemas import DistillOptions
from . import Export, Import, Member, Parsed

CLASS = re.compile(r"class\s+(\w+)\s*(?:\(([^)]*)\))?\s*:")
DEF = re.compile(r"(async\s+)?def\s+(\w+)\s*\(([^)]*)\)\s*(?:->\s*([^:]+))?\s*:")
DEF_START = re.compile(r"(?:async\s+)?def\s")
FROM = re.compile(r"from\s+(\S+)\s+import\s+(.+)")
CONSTANT = re.compile(r"([A-Z][A-Z0-9_]*)\s*(?::[^=]+)?=(?!=)|([a-z_]\w*)\s*:\s*[^=]+=(?!=)")
#: Kinds in the order of the result; classes come last.
ORDER = {"function": 0, "const": 1, "class": 2}


def indent_of(line: str) -> int:
    return sum(4 if c == "\t" else 1 for c in line[: len(line) - len(line.lstrip(" \t"))])


def imports_of(line: str, number: int) -> Import | None:
    if m := FROM.match(line):
        names = [n.strip().strip("()") for n in m[2].split(",")]
        return Import(m[1], [n.split(" as ")[-1].strip() for n in names if n], number)
    if line.startswith("import "):
        source, _, alias = line[7:].strip().partition(" as ")
        return Import(source.strip(), [alias.strip() or source.strip()], number)
    return None


def function_signature(line: str) -> tuple[str, str]:
    m = DEF.match(line)
    if m is None:
        return "Anonymous", "def Anonymous()"
    kept = ", ".join(p for p in (x.strip() for x in m[3].split(",")) if p and not p.startswith("self"))
    return m[2], f"{'async ' if m[1] else ''}def {m[2]}({kept}){' -> ' + m[4].strip() if m[4] else ''}"


class _Reader:
    def __init__(self, options: DistillOptions):
        self.o, self.out = options, Parsed()
        self.owner: Export | None = None
        self.owner_indent = -1
        self.owner_kept = False

    def wanted(self, name: str, line: int) -> bool:
        """Whether a name is kept; why not goes to the skipped items."""
        if name.startswith("_") and not self.o.private:
            self.out.skipped.append((name, "private", line))
            return False
        if self.o.exclude_names and name_matches(name, self.o.exclude_names) or self.o.include_names and not name_matches(name, self.o.include_names):
            self.out.skipped.append((name, "pattern", line))
            return False
        return True

    def add(self, export: Export) -> bool:
        if kept := self.wanted(export.name, export.line):
            self.out.exports.append(export)
        return kept

    def line(self, text: str, indent: int, number: int) -> None:
        body = text.strip()
        if found := imports_of(body, number):
            self.out.imports.append(found)
        elif m := CLASS.match(body):
            bases = [b.strip() for b in (m[2] or "").split(",") if b.strip()]
            signature = f"class {m[1]}({', '.join(bases)})" if bases else f"class {m[1]}"
            self.owner = Export(m[1], "class", signature, "private" if m[1].startswith("_") else "public", number, indent // 4)
            self.owner_indent, self.owner_kept = indent, self.add(self.owner)
        elif DEF_START.match(body):
            name, signature = function_signature(body)
            private = name.startswith("_")
            if self.owner is not None and indent > self.owner_indent:
                if private and not self.o.private:
                    self.out.skipped.append((name, "private", number))
                else:
                    self.owner.members.append(Member(name, "constructor" if name == "__init__" else "method", signature, private))
            elif indent == 0:
                self.owner = None
                self.add(Export(name, "function", signature, "private" if private else "public", number))
        elif indent == 0:
            self.owner = None
            if m := CONSTANT.match(body):
                name = m[1] or m[2]
                self.add(Export(name, "const", body, "private" if name.startswith("_") else "public", number))


def parse(source: str, options: DistillOptions) -> Parsed:
    reader = _Reader(options)
    lines = source.split("\n")
    k = 0
    while k < len(lines):
        text, number = lines[k], k + 1
        body = text.strip()
        k += 1
        quote = body[:3]
        if quote in ('"""', "'''"):
            doc = [body[3:]]
            single = quote in body[3:]
            while not single and k < len(lines):
                doc.append(lines[k])
                k += 1
                if quote in doc[-1]:
                    break
            inside = reader.owner is not None and indent_of(text) > reader.owner_indent
            if not single and not inside and options.docstrings and reader.out.exports:
                words = [x.strip() for x in "\n".join(doc).split(quote)[0].split("\n")]
                reader.out.exports[-1].docstring = "\n".join(words).strip()
        elif body and not body.startswith("#"):
            reader.line(text, indent_of(text), number)
    reader.out.exports.sort(key=lambda e: (ORDER.get(e.kind, 999), e.name))
    return reader.out
