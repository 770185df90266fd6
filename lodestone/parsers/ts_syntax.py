"""TypeScript and JavaScript sources by their syntax: a tokenizer and a reader of top-level declarations.

Types are the declared ones; where none is written, that of a literal initializer or of a plain returned literal,
else any. Non-exported declarations are left out without a word, re-exports and a default export are rows of their
own.
"""

from __future__ import annotations

import re
from itertools import accumulate, chain

from ..operators.globs import name_matches
from ..schemas import DistillOptions
from . import Export, Import, Member, Parsed, ts_lines

GAP = r"((?:\s++|//[^\n]*+|/\*.*?\*/)*+)"
TOKEN = r"`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_$#@][\w$]*|\d[\w.]*|=>|\.\.\.|\?\.|[{}()\[\]<>;,:=?!|&.+\-*/%^~]"
#: White space and comments, then a token, a character that is none, or the end.
SCAN = re.compile(rf"{GAP}({TOKEN}|.|\Z)", re.S)
#: A method on one line with plain parameters, result and body, which holds neither brackets nor texts nor comments.
NAME = r"[A-Za-z_$][\w$]*+"
PARAM = rf"{NAME}\??+(?:: ?{NAME}(?:\.{NAME})*+)?+(?: = (?:{NAME}|\d\w*+))?+"
METHOD = rf"(async +)?({NAME})(\((?:{PARAM}(?:, ?{PARAM})*+)?+\)(?:: ?{NAME}(?:\.{NAME})*+(?:<{NAME}(?:, ?{NAME})*+>)?+)?+) ?\{{[^{{}}()\[\]\"'`/]*+\}}"
NO_METHOD = r"(?!(?:async +)?(?:as|satisfies|extends|is|in|of|instanceof|keyof|infer|if|for|while|switch|catch|with|function|implements)\b)"
METHODS = re.compile(METHOD)
ONE_METHOD = NO_METHOD + METHOD.replace("(async +)", "(?:async +)").replace(f"({NAME})(", f"{NAME}(?:")
#: An enum whose members are names, alone or with a text or a number on the same line, without comments.
MEMBER = rf"{NAME}(?: *+= *+(?:'[^'\\\n]*+'|\"[^\"\\\n]*+\"|-?\d[\w.]*+))?+"
MEMBERS = re.compile(MEMBER)
ENUM = rf"enum ++{NAME} *+\{{\s*+{MEMBER}\s*+(?:,\s*+{MEMBER}\s*+)*+,?+\s*+\}}"
ENUMS = re.compile(rf"enum ++({NAME}) *+\{{(.*)\}}", re.S)
#: Four plain methods or more with nothing but white space between them are one token.
SCAN_METHODS = re.compile(rf"{GAP}({ONE_METHOD}(?:(?:\s++{ONE_METHOD}){{3,}}+)?+|{ENUM}|{TOKEN}|.|\Z)", re.S)
COMMENT = re.compile(r"//[^\n]*|/\*(?P<doc>.*?)\*/", re.S)
OPEN, CLOSE = "{([", "})]"
BRACKETS = frozenset(OPEN + CLOSE)
MARKS = frozenset("{}()[]<>;,:=?!|&.+-*/%^~")
NAME_STARTS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$#@")
MODIFIERS = ("public", "private", "protected", "static", "readonly", "abstract", "async", "override", "declare", "get", "set")
ORDER = ("interface", "type", "class", "function", "const", "enum")


class Token:
    __slots__ = ("end", "kind", "line", "start", "text", "doc")

    def __init__(self, kind: str, text: str, start: int, line: int, doc: str | None):
        self.kind, self.text, self.start, self.end, self.line, self.doc = kind, text, start, start + len(text), line, doc


class Tokens:
    """A source's tokens as lists, and for every opening bracket the place of its closing one. With ``methods`` a plain method
    that stands in a class, or several in a row, are one token, and so is a plain enum outside of classes (its places are in
    ``enums``, and in ``methods`` too)."""

    def __init__(self, source: str, methods: bool = False):
        self.source, self._line, self.methods, self.enums = source, (0, 1), set(), set()
        flat = list(chain.from_iterable((SCAN_METHODS if methods else SCAN).findall(source)))
        self._place(flat)
        apart = self._match()
        if apart:  # what looks like a method in no class
            for k in reversed([self._kept[k] for k in apart] if self._kept else apart):
                inner = list(chain.from_iterable(SCAN.findall(flat[2 * k + 1])))
                flat[2 * k + 1 : 2 * k + 2] = inner[1:-2] if not inner[-1] else inner[1:]
            self._place(flat)
            self._match()

    def _place(self, flat: list[str]) -> None:
        ends = list(accumulate(map(len, flat)))
        self.texts, self.gaps, self.starts, self.ends = flat[1::2], flat[0::2], ends[0::2], ends[1::2]
        while self.texts and not self.texts[-1]:
            for x in (self.texts, self.gaps, self.starts, self.ends):
                x.pop()
        none = {x for x in set(self.texts) if len(x) == 1 and not (x in NAME_STARTS or x in MARKS or x.isdecimal())}
        self._kept = keep = [k for k, x in enumerate(self.texts) if x not in none] if none else []
        if none:  # characters that are no tokens belong to the next gap
            self.texts, self.starts, self.ends = ([x[k] for k in keep] for x in (self.texts, self.starts, self.ends))
            self.gaps = [self.source[a:b] for a, b in zip([0, *self.ends], self.starts, strict=False)]

    def _match(self) -> list[int]:
        """Sets ``closing``, ``methods`` and ``enums``; the places of methods that are in no class, and of enums that are in one or
        in other brackets than braces."""
        texts, opened, apart, classes = self.texts, [], [], {}
        self.closing, self.methods, self.enums = {}, set(), set()
        for k in [k for k, x in enumerate(texts) if x[-1] in BRACKETS]:
            x = texts[k]
            if x in OPEN:
                opened.append(k)
            elif x in CLOSE:
                if opened:
                    self.closing[opened.pop()] = k
            else:
                at = opened[-1] if opened else -1
                if at not in classes:
                    classes[at] = at >= 0 and texts[at] == "{" and self._heads_class(at)
                if x.startswith("enum ") and not classes[at] and (at < 0 or texts[at] == "{"):
                    self.methods.add(k)
                    self.enums.add(k)
                elif classes[at] and not x.startswith("enum "):
                    self.methods.add(k)
                else:
                    apart.append(k)
        return apart

    def _heads_class(self, k: int) -> bool:
        k -= 1
        while k >= 0 and self.texts[k][-1] not in BRACKETS and self.texts[k] not in (";", "class"):
            k -= 1
        return k >= 0 and self.texts[k] == "class"

    def line(self, k: int) -> int:
        """Counted from the place that was asked for before, as places are asked for in their order."""
        start, (at, n) = self.starts[k], self._line
        if start < at:
            at, n = 0, 1
        self._line = start, n + self.source.count("\n", at, start)
        return self._line[1]

    def kind(self, k: int) -> str:
        x = self.texts[k][0]
        return "text" if x in "`\"'" else "name" if x in NAME_STARTS else "number" if x.isdecimal() else "mark"

    def doc(self, k: int) -> str | None:
        """The text of the last documenting comment before a token."""
        docs = [m for m in COMMENT.finditer(self.gaps[k]) if m[0].startswith("/**")] if "/**" in self.gaps[k] else []
        return "\n".join(re.sub(r"^\s*\*? ?", "", x) for x in (docs[-1]["doc"] or "")[1:].split("\n")).strip() if docs else None

    def at(self, k: int) -> Place:
        return Place(self, k)

    def token(self, k: int) -> Token:
        return Token(self.kind(k), self.texts[k], self.starts[k], self.line(k), self.doc(k))

    def all(self) -> list[Token]:
        return [self.token(k) for k in range(len(self.texts))]


class Place:
    """Where a token is; its line and what documents it are looked up when they are asked for."""

    __slots__ = ("k", "of")

    def __init__(self, of: Tokens, k: int):
        self.of, self.k = of, k

    @property
    def line(self) -> int:
        return self.of.line(self.k)

    @property
    def doc(self) -> str | None:
        return self.of.doc(self.k)


def tokenize(source: str) -> list[Token]:
    return Tokens(source).all()


def squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Reader:
    def __init__(self, source: str, options: DistillOptions):
        self.source, self.o, self.t, self.i = source, options, tokenize(source), 0
        self.out = Parsed()

    # -- tokens
    def peek(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.t[k].text if k < len(self.t) else ""

    def take(self) -> Token:
        self.i += 1
        return self.t[self.i - 1]

    def accept(self, *texts: str) -> str:
        if self.peek() in texts and self.peek():
            return self.take().text
        return ""

    def between(self, a: int, b: int) -> str:
        """Source from token a up to token b, not included."""
        return squeeze(self.source[self.t[a].start : self.t[b - 1].end]) if b > a else ""

    def group(self) -> tuple[int, int]:
        """Passes a bracketed group; the places of its inner tokens."""
        depth, start = 0, self.i + 1
        angle = self.peek() == "<"
        while self.i < len(self.t):
            x = self.take().text
            if x in OPEN or angle and x == "<":
                depth += 1
            elif x in CLOSE or angle and x == ">":
                depth -= 1
                if not depth:
                    break
        return start, self.i - 1

    def until(self, *stops: str) -> str:
        """Source up to one of the stops outside all brackets, or to the next line that begins a statement."""
        start, angle = self.i, 0
        while self.i < len(self.t):
            x = self.peek()
            if x in stops and not angle:
                break
            if x in CLOSE and not angle:
                break
            if self.i > start and not angle and ";" in stops and self.t[self.i].line > self.t[self.i - 1].line and self.t[self.i].kind == "name" and self.t[self.i - 1].text not in ("=>", "=", "|", "&", ",", ".", "+", "?", ":"):
                break
            if x in OPEN:
                self.group()
            else:
                angle = max(0, angle + (x == "<") - (x == ">"))
                self.take()
        return self.between(start, self.i)

    # -- names
    def add(self, e: Export, always: bool = False) -> None:
        if not always:
            if self.o.exclude_names and name_matches(e.name, self.o.exclude_names, "typescript") or self.o.include_names and not name_matches(e.name, self.o.include_names, "typescript"):
                self.out.skipped.append((e.name, "pattern", e.line))
                return
        if not self.o.docstrings:
            e.docstring = None
        self.out.exports.append(e)

    # -- statements
    def read(self) -> Parsed:
        default = None
        while self.i < len(self.t):
            begin = self.t[self.i]
            if begin.text == "import" and self.peek(1) not in ("(", "."):
                self.read_import()
            elif begin.text == "export":
                self.take()
                if self.accept("default"):
                    default = Export("default", "const", "export default", "public", begin.line)
                    if self.peek() in ("class", "function", "abstract", "async", "interface") and self.t[min(self.i + 1, len(self.t) - 1)].kind == "name":
                        self.declaration(begin)
                    else:
                        self.until(";")
                elif self.peek() in ("{", "*"):
                    self.read_reexport(begin)
                else:
                    self.declaration(begin)
            elif begin.text in OPEN:
                self.group()
            else:
                self.take()
        if default:
            self.add(default, always=True)
        self.out.exports.sort(key=lambda e: (ORDER.index(e.kind) if e.kind in ORDER else len(ORDER), e.name))
        return self.out

    def read_import(self) -> None:
        line, names = self.take().line, []
        self.accept("type")
        while self.i < len(self.t) and self.t[self.i].kind != "text":
            if self.peek() == "{":
                a, b = self.group()
                parts = self.between(a, b).split(",")
                names += [p.split(" as ")[-1].strip().removeprefix("type ") for p in parts if p.strip()]
            elif self.accept("*"):
                self.accept("as")
                names.append(self.take().text)
            else:
                x = self.take()
                if x.kind == "name" and x.text != "from":
                    names.append(x.text)
        if self.i < len(self.t):
            self.out.imports.append(Import(self.take().text[1:-1], names, line))
        self.accept(";")

    def read_reexport(self, begin: Token) -> None:
        start = self.i
        names = ["*"]
        if self.peek() == "{":
            a, b = self.group()
            names = [p.split(" as ")[-1].strip() for p in self.between(a, b).split(",") if p.strip()]
        else:
            self.take()
            if self.accept("as"):
                names = [self.take().text]
        if self.accept("from"):
            self.take()
        signature = "export " + self.between(start, self.i)
        self.accept(";")
        for name in names:
            self.add(Export(name, "const", signature, "public", begin.line), always=True)

    def declaration(self, begin: Token) -> None:
        words = []
        while self.peek() in ("declare", "abstract", "async"):
            words.append(self.take().text)
        kind = self.peek()
        reader = {"function": self.function, "class": self.klass, "interface": self.interface, "type": self.alias, "enum": self.enum, "const": self.variables, "let": self.variables, "var": self.variables, "namespace": self.namespace, "module": self.namespace}.get(kind)
        if kind == "const" and self.peek(1) == "enum":
            self.take()
            reader = self.enum
        if reader:
            self.take()
            reader(begin, words)

    def function(self, begin: Token, words: list[str]) -> None:
        star = self.accept("*")
        name = self.take().text if self.t[self.i].kind == "name" else "default"
        head, result = self.callable()
        prefix = "async " if "async" in words else ""
        self.add(Export(name, "function", f"{prefix}function{star} {name}{head}: {result}", "public", begin.line, docstring=begin.doc))

    def callable(self) -> tuple[str, str]:
        """Type parameters and parameters as written, and the result's type; passes the body."""
        start = self.i
        if self.peek() == "<":
            self.group()
        a, b = self.group() if self.peek() == "(" else (self.i, self.i)
        head = self.between(start, self.i)
        result = self.until("{", ";", "=>") if self.accept(":") else ""
        if self.peek() == "{":
            x, y = self.group()
            result = result or self.returned(x, y)
        else:
            self.accept(";")
        return head or "()", result or "any"

    def returned(self, a: int, b: int) -> str:
        kinds = {literal_type(self.between(k + 1, self.end_of(k + 1, b)), widen=True) for k in range(a, b) if self.t[k].text == "return"}
        return "void" if not kinds else kinds.pop() if len(kinds) == 1 else "any"

    def end_of(self, k: int, b: int) -> int:
        depth = 0
        while k < b and (depth or self.t[k].text not in (";", "}")):
            depth += (self.t[k].text in OPEN) - (self.t[k].text in CLOSE)
            k += 1
        return k

    def klass(self, begin: Token, words: list[str]) -> None:
        start = self.i
        name = self.take().text
        while self.i < len(self.t) and self.peek() != "{":
            self.take()
        signature = f"{'abstract ' if 'abstract' in words else ''}class {self.between(start, self.i)}"
        a, b = self.group()
        self.add(Export(name, "class", signature, "public", begin.line, members=self.members(a, b), docstring=begin.doc))

    def interface(self, begin: Token, words: list[str]) -> None:
        start = self.i
        name = self.take().text
        while self.i < len(self.t) and self.peek() != "{":
            self.take()
        signature = f"interface {self.between(start, self.i)}"
        a, b = self.group()
        self.add(Export(name, "interface", signature, "public", begin.line, members=self.members(a, b), docstring=begin.doc))

    def alias(self, begin: Token, words: list[str]) -> None:
        start = self.i
        name = self.take().text
        self.until(";")
        self.add(Export(name, "type", f"type {self.between(start, self.i)}", "public", begin.line, docstring=begin.doc))
        self.accept(";")

    def enum(self, begin: Token, words: list[str]) -> None:
        name = self.take().text
        a, b = self.group()
        self.add(Export(name, "enum", f"enum {name} {{ {self.between(a, b)} }}", "public", begin.line, docstring=begin.doc))

    def variables(self, begin: Token, words: list[str]) -> None:
        while self.i < len(self.t):
            if self.t[self.i].kind != "name":
                self.until(";")
                break
            name = self.take().text
            declared = self.until("=", ",", ";") if self.accept(":") else ""
            value = self.until(",", ";") if self.accept("=") else ""
            kind = declared or literal_type(value)
            self.add(Export(name, "const", f"const {name}: {kind}{' = ' + value if value and kind == value else ''}", "public", begin.line, docstring=begin.doc))
            if not self.accept(","):
                break
        self.accept(";")

    def namespace(self, begin: Token, words: list[str]) -> None:
        name = self.until("{")
        self.group()
        self.add(Export(name, "const", f"namespace {name}", "public", begin.line, docstring=begin.doc))

    def members(self, a: int, b: int) -> list[Member]:
        after, self.i, out = self.i, a, []
        while self.i < b:
            if self.accept(";", ","):
                continue
            if self.peek().startswith("@"):
                self.take()
                if self.peek() == "(":
                    self.group()
                continue
            words, start = [], self.i
            while self.peek() in MODIFIERS and self.peek(1) not in ("(", ":", "=", ";", "?", "<", ""):
                words.append(self.take().text)
            star = self.accept("*")
            if self.peek() == "[":
                self.group()
                name = self.between(start + len(words) + bool(star), self.i)
            else:
                name = self.take().text
            optional = self.accept("?") or self.accept("!")
            lead = "".join(w + " " for w in words if w not in ("public", "get", "set", "async"))
            if self.peek() in ("(", "<"):
                head, result = self.callable()
                kind = "constructor" if name == "constructor" else "getter" if "get" in words else "setter" if "set" in words else "method"
                signature = f"constructor{head}" if kind == "constructor" else f"{lead}{'async ' if 'async' in words else ''}{'get ' if kind == 'getter' else 'set ' if kind == 'setter' else ''}{name}{optional}{head}: {result}"
            else:
                declared = self.until("=", ";", ",") if self.accept(":") else ""
                value = self.until(";") if self.accept("=") else ""
                kind, signature = "property", f"{lead}{name}{optional}: {declared or literal_type(value, widen=True)}"
            private = "private" in words or name.startswith("#")
            if (private and not self.o.private) or ("protected" in words and not self.o.protected):
                self.out.skipped.append((name, "private", self.t[start].line))
            else:
                out.append(Member(name, kind, signature, private, "protected" in words))
        self.i = after
        rank = {"constructor": 0, "property": 1, "method": 2, "getter": 3, "setter": 4}
        return sorted(out, key=lambda m: rank[m.kind])


def literal_type(value: str, widen: bool = False) -> str:
    if re.fullmatch(r"-?\d[\d_.eE+-]*", value):
        return "number" if widen else value
    if value in ("true", "false"):
        return "boolean" if widen else value
    if re.match(r"`", value) or re.match(r"[\"'].*[\"']\s*\+", value) or re.search(r"\+\s*[\"'`]", value):
        return "string"
    if re.fullmatch(r"\"[^\"]*\"|'[^']*'", value):
        return "string" if widen else value
    if m := re.fullmatch(r"new\s+([\w.]+(?:<.*>)?)\s*\(.*\)", value, re.S):
        return m[1]
    if m := re.fullmatch(r"(?:async\s*)?(\(.*?\))\s*(?::\s*([^=]+?))?\s*=>.*", value, re.S):
        return f"{squeeze(m[1])} => {squeeze(m[2] or 'any')}"
    return "any"


def parse(source: str, options: DistillOptions) -> Parsed:
    """A source that the reader cannot follow to its end is read by lines."""
    try:
        return _Reader(source, options).read()
    except (IndexError, RecursionError):
        return ts_lines.parse(source)
