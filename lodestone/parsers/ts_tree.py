"""TypeScript sources as a tree of declarations with scopes, and the symbols of that tree as they are written.

Every declaration is a node: nodes of a namespace, a module or a function body hang below it. ``parse`` gives the exported
nodes of all depths in source order, with annotation text only: type parameters of classes and interfaces, members of
enums, constructors, and let and var as such. Members with computed, quoted or # names, accessors and anonymous defaults
are left out; so is all but the first variable of a statement, as the signatures are a statement's.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from ..operators.globs import name_matches
from ..schemas import DistillOptions
from . import Export, Import, Member, Parsed
from .ts_syntax import CLOSE, ENUMS, MEMBERS, METHODS, OPEN, Place, Token, Tokens

#: Words that go on with a type or an expression on the next line.
ONWARD = ("as", "satisfies", "extends", "is", "in", "of", "instanceof", "keyof", "infer")
#: Marks after which a statement goes on.
PENDING = ("=", "=>", "|", "&", ",", ".", "?.", "+", "-", "*", "/", "%", "?", ":", "<", "!", "(", "[", "{", "extends", "keyof", "typeof", "new", "return", "as", "infer", "is", "await", "in", "of", "instanceof", "...")
MODIFIERS = ("public", "private", "protected", "static", "readonly", "abstract", "async", "override", "declare", "get", "set", "accessor")
STOPS = frozenset("{}()[]<;,")
LEADS = ("export", "default", "declare", "abstract", "async")


@dataclass
class Param:
    name: str
    optional: bool
    type: str | None
    text: str
    default: tuple[int, int] | None = None
    rest: bool = False


@dataclass
class Node:
    """A declaration. Token places are half-open; ``body`` is a function's or a namespace's, ``value`` an initializer's."""

    kind: str
    name: str
    token: Place
    words: list[str] = field(default_factory=list)
    type_params: str = ""
    heritage: list[tuple[str, str]] = field(default_factory=list)
    params: list[Param] | None = None
    type: str | None = None
    value: tuple[int, int] | None = None
    body: tuple[int, int] | None = None
    optional: bool = False
    children: list[Node] = field(default_factory=list)
    specifiers: list[tuple[str, str]] = field(default_factory=list)
    """(name elsewhere, name here) of imports and re-exports."""
    module: str = ""
    text: str = ""
    """Of kind ``methods``, plain methods in a row, of which the words are the first one's; an enum's members, if it is one token."""

    @property
    def exported(self) -> bool:
        return "export" in self.words


class _Apart(Exception):
    """A method or an enum that is one token stands where none is expected."""


class Tree:
    """Reads a source once. ``nodes`` are its top-level declarations. With ``heads`` only, plain methods and enums are read as one
    token, without the places of their tokens."""

    def __init__(self, source: str, heads: bool = False):
        self.source = source
        try:
            self._read(heads)
        except _Apart:
            self._read(False)

    def _read(self, heads: bool) -> None:
        self.tokens = Tokens(self.source, heads)
        self.x, self.n, self.i, self.methods, self.enums = self.tokens.texts, len(self.tokens.texts), 0, self.tokens.methods, self.tokens.enums
        self.nodes = self.statements(self.n)

    @cached_property
    def t(self) -> list[Token]:
        return self.tokens.all()

    # -- tokens
    def text(self, k: int | None = None) -> str:
        k = self.i if k is None else k
        return self.x[k] if k < self.n else ""

    def kind(self, k: int | None = None) -> str:
        k = self.whole(self.i if k is None else k)
        return self.tokens.kind(k) if k < self.n else ""

    def whole(self, k: int) -> int:
        if k in self.methods:
            raise _Apart
        return k

    def raw(self, a: int, b: int) -> str:
        return self.source[self.tokens.starts[a] : self.tokens.ends[b - 1]] if a < b <= self.n else ""

    def accept(self, *texts: str) -> bool:
        if self.i < self.n and self.x[self.i] in texts:
            self.i += 1
            return True
        return False

    def inside(self) -> tuple[int, int]:
        """Passes a bracketed group; its inner places."""
        start, depth = self.i + 1, 0
        if self.i in self.tokens.closing:
            self.i = self.tokens.closing[self.i] + 1
            return start, self.i - 1
        while self.i < self.n:
            x = self.x[self.whole(self.i)]
            depth += (x in OPEN) - (x in CLOSE)
            self.i += 1
            if depth == 0:
                return start, self.i - 1
        return start, self.i

    def angles(self) -> str:
        """Passes <...>; its text."""
        start, depth = self.i, 0
        while self.i < self.n:
            x = self.text()
            if x in OPEN:
                self.inside()
                continue
            depth += (x == "<") - (x == ">")
            self.i += 1
            if depth == 0:
                break
        return self.raw(start, self.i)

    def generic_call(self) -> bool:
        """Whether the < here opens type arguments of a call."""
        if self.i == 0 or self.kind(self.i - 1) != "name" or self.tokens.gaps[self.i]:
            return False
        k, depth = self.i, 0
        while k < self.n and self.text(self.whole(k)) not in (";", "&&", "="):
            depth += (self.text(k) == "<") - (self.text(k) == ">")
            k += 1
            if depth == 0:
                return self.text(k) == "("
        return False

    def ends_here(self, start: int) -> bool:
        """Whether a new line begins another statement."""
        if self.i == start or "\n" not in self.tokens.gaps[self.i]:
            return False
        if self.i in self.methods:
            return self.text(self.i - 1) not in PENDING
        return (self.kind() in ("name", "number", "text") or self.text() in ("}", "@")) and self.text() not in ONWARD and self.text(self.i - 1) not in PENDING

    def upto(self, *stops: str, types: bool = False, end: int | None = None) -> tuple[int, int]:
        """Passes a type or an expression, up to a stop outside all brackets or to the end of the statement."""
        start, end, angle, texts = self.i, self.n if end is None else end, 0, self.x
        while self.i < end:
            x = texts[self.i] if self.i < self.n else ""
            if not angle and (x in stops or x == ";" or x in CLOSE or self.ends_here(start)):
                break
            if x in OPEN:
                if types and x == "{" and self.i > start and self.text(self.i - 1) not in (*PENDING, "readonly") and not angle:
                    break  # a body, not a type
                self.inside()
            elif x == "<" and (types or self.generic_call()):
                angle += types
                if types:
                    self.i += 1
                else:
                    self.angles()
            else:
                angle -= types and x == ">" and angle > 0
                if self.methods:
                    self.whole(self.i)
                self.i += 1
        return start, self.i

    # -- statements
    def statements(self, end: int) -> list[Node]:
        out: list[Node] = []
        while self.i < end:
            before = self.i
            out += self.statement(end)
            if self.i == before:
                self.i += 1
        self.i = max(self.i, end)
        return out

    def statement(self, end: int) -> list[Node]:
        if self.accept(";"):
            return []
        begin = self.tokens.at(self.i)
        while self.text().startswith("@"):
            self.i += 1
            if self.text() == "(":
                self.inside()
        words: list[str] = []
        while self.text() in LEADS and self.text(self.i + 1) not in ("(", "=", ".", ":", ";", ""):
            words.append(self.text())
            self.i += 1
        if self.i in self.enums:
            return [self.plain_enum(begin, words)]
        if self.text() == "const" and self.i + 1 in self.enums:
            self.i += 1
            return [self.plain_enum(begin, [*words, "const"])]
        word, after = self.text(), self.kind(self.i + 1)
        if word == "import" and self.text(self.i + 1) not in ("(", "."):
            return [self.read_import(begin)]
        if words == ["export"] and word in ("{", "*"):
            return self.read_reexport(begin)
        if word == "type" and after == "name" and words[:1] == ["export"] and self.text(self.i + 1) == "{":
            self.i += 1
            return self.read_reexport(begin)
        if word == "const" and self.text(self.i + 1) == "enum":
            self.i += 1
            word, words = "enum", [*words, "const"]
        if word in ("const", "let", "var") and (after == "name" or self.text(self.i + 1) in ("{", "[")):
            return self.variables(begin, words, word)
        if word == "function":
            return [self.function(begin, words)]
        if word == "class" or word in ("interface", "enum") and after == "name":
            return [{"class": self.klass, "interface": self.interface, "enum": self.enum}[word](begin, words)]
        if word == "type" and after == "name" and self.text(self.i + 2) in ("=", "<"):
            return [self.alias(begin, words)]
        if word in ("namespace", "module") and after in ("name", "text") or word == "global" and self.text(self.i + 1) == "{":
            return [self.namespace(begin, words)]
        if "default" in words:
            node = Node("default", "default", begin, words)
            node.value = self.upto()
            return [node]
        if word in OPEN:
            self.inside()
        else:
            self.upto("{", end=end)
        return []

    def read_import(self, begin: Place) -> Node:
        node = Node("import", "", begin)
        self.i += 1
        if self.text() == "type" and self.text(self.i + 1) not in ("from", ","):
            self.i += 1
        while self.i < self.n and self.kind() != "text":
            if self.text() == "{":
                a, b = self.inside()
                node.specifiers += self.named(a, b)
            elif self.accept("*"):
                self.accept("as")
                node.specifiers.append(("*", self.text()))
                self.i += 1
            else:
                if self.kind() == "name" and self.text() != "from":
                    node.specifiers.append(("default", self.text()))
                self.i += 1
        node.module = self.text()[1:-1]
        self.i += 1
        self.accept(";")
        return node

    def named(self, a: int, b: int) -> list[tuple[str, str]]:
        """Names in braces, (there, here)."""
        out, part = [], []
        for k in range(a, b + 1):
            if k == b or self.text(k) == ",":
                part = part[1:] if part[:1] == ["type"] and len(part) > 1 and part[1] != "as" else part
                if part:
                    out.append((part[0], part[-1]))
                part = []
            else:
                part.append(self.text(self.whole(k)))
        return out

    def read_reexport(self, begin: Place) -> list[Node]:
        out = []
        if self.text() == "{":
            a, b = self.inside()
            lines = {self.text(k): self.tokens.at(k) for k in range(a, b)}
            out = [Node("reexport", here, lines[there], ["export"], specifiers=[(there, here)]) for there, here in self.named(a, b)]
        else:
            self.i += 1
            if self.accept("as"):
                out = [Node("star", self.text(), begin, ["export"], specifiers=[("*", self.text())])]
                self.i += 1
            else:
                out = [Node("star", "*", begin, ["export"])]
        if self.accept("from"):
            for node in out:
                node.module = self.text()[1:-1]
            self.i += 1
        self.accept(";")
        return out

    def params(self) -> list[Param]:
        a, b = self.inside()
        after, self.i, out = self.i, a, []
        while self.i < b:
            if self.accept(","):
                continue
            start = self.i
            while self.text().startswith("@"):
                self.i += 1
                if self.text() == "(":
                    self.inside()
            while self.text() in MODIFIERS and self.kind(self.i + 1) == "name":
                self.i += 1
            rest, name = self.accept("..."), self.i
            if self.text() in OPEN:
                self.inside()
            else:
                self.i += 1
            label, optional, declared, default = self.raw(name, self.i), self.accept("?"), None, None
            if self.accept(":"):
                declared = self.raw(*self.upto(",", "=", types=True, end=b))
            if self.accept("="):
                default = self.upto(",", end=b)
            out.append(Param(label, optional or default is not None, declared, self.raw(start, self.i), default, rest))
            if self.i == start:
                self.i += 1
        self.i = after
        return out

    def callable(self, node: Node) -> Node:
        """Type parameters, parameters, result and body of what follows."""
        if self.text() == "<":
            node.type_params = self.angles()
        node.params = self.params() if self.text() == "(" else []
        if self.accept(":"):
            node.type = self.raw(*self.upto("{", ",", "=>", types=True)) if self.text() != "{" else self.raw(*self.literal_type())
        if self.text() == "{":
            node.body = self.inside()
        else:
            self.accept(";")
        return node

    def literal_type(self) -> tuple[int, int]:
        start = self.i
        self.inside()
        while self.text() in ("[", "|", "&"):
            self.upto("{", types=True)
        return start, self.i

    def function(self, begin: Place, words: list[str]) -> Node:
        self.i += 1
        if self.accept("*"):
            words = [*words, "*"]
        node = Node("function", "", begin, words)
        if self.kind() == "name":
            node.name = self.text()
            self.i += 1
        return self.callable(node)

    def head(self, node: Node) -> None:
        """Type parameters and heritage, up to the brace."""
        if self.text() == "<":
            node.type_params = self.angles()
        while self.i < self.n and self.text() != "{":
            word = self.text(self.whole(self.i))
            self.i += 1
            if word in ("extends", "implements"):
                a, b = self.i, self.i
                while self.i < self.n and self.text() not in ("{", "implements"):
                    a, b = self.upto("{", "implements", ",", types=True)
                    node.heritage.append((word, self.raw(a, b)))
                    if not self.accept(",") and self.i == a:
                        break

    def klass(self, begin: Place, words: list[str]) -> Node:
        self.i += 1
        node = Node("class", "", begin, words)
        if self.kind() == "name" and self.text() not in ("extends", "implements"):
            node.name = self.text()
            self.i += 1
        self.head(node)
        node.body = self.inside()
        node.children = self.members(*node.body)
        return node

    def interface(self, begin: Place, words: list[str]) -> Node:
        self.i += 2
        node = Node("interface", self.text(self.i - 1), begin, words)
        self.head(node)
        node.body = self.inside()
        node.children = self.members(*node.body)
        return node

    def members(self, a: int, b: int) -> list[Node]:
        after, self.i, out = self.i, a, []
        while self.i < b:
            start = self.i
            if start in self.methods:
                out.append(self.method(start, []))
                continue
            if self.accept(";", ","):
                continue
            while self.text().startswith("@"):
                self.i += 1
                if self.text() == "(":
                    self.inside()
            words = []
            while self.text() in MODIFIERS and self.text(self.i + 1) not in ("(", ":", "=", ";", "?", "<", "!", ",", "}", ""):
                words.append(self.text())
                self.i += 1
            if self.text() == "{":  # a static block
                self.inside()
                continue
            if self.accept("*"):
                words.append("*")
            if self.i in self.methods:
                out.append(self.method(start, words))
                continue
            node = Node("property", self.text(), self.tokens.at(start), words)
            if self.text() in ("(", "<"):
                node.kind, node.name = "call", ""
            elif self.text() == "[":
                x, y = self.inside()
                node.name = f"[{self.raw(x, y)}]"
            else:
                self.i += 1
            node.optional = self.accept("?")
            self.accept("!")
            if self.text() in ("(", "<"):
                node.kind = "getter" if "get" in words else "setter" if "set" in words else "constructor" if node.name == "constructor" else node.kind if node.kind == "call" else "method"
                self.callable(node)
            else:
                if self.accept(":"):
                    node.type = self.raw(*self.upto("=", ",", types=True, end=b))
                if self.accept("="):
                    node.value = self.upto(end=b)
            if self.i == start:
                self.i += 1
            out.append(node)
        self.i = after
        return out

    def method(self, start: int, words: list[str]) -> Node:
        """Plain methods that are one token."""
        if self.i in self.enums:
            raise _Apart
        self.i += 1
        return Node("methods", "", self.tokens.at(start), words, text=self.x[self.i - 1])

    def plain_enum(self, begin: Place, words: list[str]) -> Node:
        """An enum that is one token."""
        name, members = ENUMS.fullmatch(self.x[self.i]).groups()
        self.i += 1
        return Node("enum", name, begin, words, text=", ".join(MEMBERS.findall(members)))

    def alias(self, begin: Place, words: list[str]) -> Node:
        self.i += 2
        node = Node("type", self.text(self.i - 1), begin, words)
        if self.text() == "<":
            node.type_params = self.angles()
        self.accept("=")
        self.accept("|")
        node.type = self.raw(*self.upto(types=True))
        self.accept(";")
        return node

    def enum(self, begin: Place, words: list[str]) -> Node:
        self.i += 2
        node = Node("enum", self.text(self.i - 1), begin, words)
        a, b = node.body = self.inside()
        after, self.i = self.i, a
        while self.i < b:
            x, y = (self.i, self.i + 3) if self.assigns(self.i, b) else self.upto(",", end=b)
            self.i = y
            if x < y:
                node.children.append(Node("member", self.text(x).strip("'\""), self.tokens.at(x), value=(x, y)))
            self.accept(",")
            if self.i == x:
                self.i += 1
        self.i = after
        return node

    def assigns(self, k: int, b: int) -> bool:
        """Whether ``name = token,`` stands here on one line."""
        texts, gaps = self.x, self.tokens.gaps
        return k + 3 < b and texts[k + 1] == "=" and texts[k + 3] == "," and texts[k] not in STOPS and texts[k + 2] not in STOPS and "\n" not in gaps[k + 1] + gaps[k + 2] + gaps[k + 3] and texts[k][-1] != "}" and texts[k + 2][-1] != "}"

    def variables(self, begin: Place, words: list[str], word: str) -> list[Node]:
        self.i += 1
        out: list[Node] = []
        while self.i < self.n:
            node = Node(word, "", begin, words if not out else [*words, "further"])
            start = self.i
            if self.text() in OPEN:
                self.inside()
                node.kind = "pattern"
            else:
                node.name = self.text(self.whole(self.i))
                self.i += 1
            self.accept("!")
            if self.accept(":"):
                node.type = self.raw(*self.upto("=", ",", types=True))
            if self.accept("="):
                node.value = self.upto(",")
            out.append(node)
            if self.i == start or not self.accept(","):
                break
        self.accept(";")
        return out

    def namespace(self, begin: Place, words: list[str]) -> Node:
        if self.text() != "global":
            self.i += 1
        start = self.i
        while self.i < self.n and self.text() not in ("{", ";"):
            self.i = self.whole(self.i) + 1
        node = Node("namespace", self.raw(start, self.i).strip("'\"") or "global", begin, words)
        if self.text() == "{":
            a, b = node.body = self.inside()
            after, self.i = self.i, a
            node.children = self.statements(b)
            self.i = after
        return node


def walk(nodes: list[Node], into: tuple[str, ...] = ("namespace",)):
    """All nodes in source order, children after their parent."""
    for n in nodes:
        yield n
        if n.kind in into:
            yield from walk(n.children, into)


def params_text(node: Node) -> str:
    return ", ".join(p.text for p in node.params or [])


def result_text(node: Node) -> str:
    return f": {node.type}" if node.type else ""


def plain(name: str) -> bool:
    return bool(name) and (name[0].isalpha() or name[0] in "_$")


def hidden(node: Node, options: DistillOptions) -> bool:
    return "private" in node.words and not options.private or "protected" in node.words and not options.protected


def members_of(node: Node, options: DistillOptions) -> list[Member]:
    out = []
    for m in node.children:
        if m.kind == "methods":
            out += plain_methods(m, options)
            continue
        if not plain(m.name) or hidden(m, options):
            continue
        if m.kind in ("method", "constructor"):
            prefix = "async " if "async" in m.words else ""
            out.append(Member(m.name, "method", f"{prefix}{m.name}({params_text(m)}){result_text(m)}", "private" in m.words, "protected" in m.words))
        elif m.kind == "property":
            out.append(Member(m.name, "property", f"{m.name}{'?' if m.optional else ''}{result_text(m)}", "private" in m.words, "protected" in m.words))
    return out


class Tails(dict):
    """Parameters and result of a plain method as they stand in its signature, by how they are written."""

    def __missing__(self, tail: str) -> str:
        params, _, result = tail[1:].partition(")")
        self[tail] = made = f"({params.replace(', ', ',').replace(',', ', ')})" + (f": {result[1:].removeprefix(' ')}" if result else "")
        return made


def plain_methods(node: Node, options: DistillOptions) -> list[Member]:
    """The members of plain methods in a row."""
    found, tails = METHODS.findall(node.text), Tails()
    out = [Member(name, "method", f"{'async ' if lead else ''}{name}{tails[tail]}") for lead, name, tail in found]
    if hidden(node, options) or "get" in node.words or "set" in node.words:
        return out[1:]
    if "async" in node.words and not found[0][0]:
        out[0].signature = "async " + out[0].signature
    out[0].private, out[0].protected = "private" in node.words, "protected" in node.words
    return out


def heritage_text(node: Node) -> str:
    kinds = dict.fromkeys(k for k, _ in node.heritage)
    return "".join(f" {k} {', '.join(x for w, x in node.heritage if w == k)}" for k in kinds)


def written(tree: Tree, node: Node) -> str:
    """A declaration's signature as it is written."""
    if node.kind in ("class", "interface"):
        return f"{node.kind} {node.name}{node.type_params}{heritage_text(node)}"
    if node.kind == "function":
        return f"{'async ' if 'async' in node.words else ''}function {node.name}({params_text(node)}){result_text(node)}"
    if node.kind == "type":
        return f"type {node.name} = {node.type}"
    if node.kind == "enum":
        return f"enum {node.name} {{ {node.text or ', '.join(tree.raw(*m.value) for m in node.children)} }}"
    return f"{node.kind} {node.name}{result_text(node)}{' = ' + tree.raw(*node.value) if node.value else ''}"


DECLARED = ("class", "interface", "function", "type", "enum", "const", "let", "var")


def parse(source: str, options: DistillOptions) -> Parsed:
    tree, out = Tree(source, heads=True), Parsed()
    for n in walk(tree.nodes):
        if n.kind == "import":
            out.imports.append(Import(n.module, [], n.token.line))
        elif n.kind == "reexport":
            found = Export(n.name, "const", f"export {{ {n.name} }}", "public", n.token.line)
        elif not (n.exported and n.kind in DECLARED and n.name and "further" not in n.words):
            continue
        else:
            found = Export(n.name, n.kind, written(tree, n), "public", n.token.line, members=members_of(n, options) if n.kind in ("class", "interface") else [])
        if n.kind == "import":
            continue
        if options.include_names and not name_matches(n.name, options.include_names, "typescript") or options.exclude_names and name_matches(n.name, options.exclude_names, "typescript"):
            if n.kind != "reexport":
                out.skipped.append((n.name, "pattern", n.token.line))
            continue
        out.exports.append(found)
    return out
