"""Types of TypeScript declarations without an annotation, inside one file, with holes for what other files decide.

``facts`` reads one source: the exported symbols with their inferred signatures, what each exported name gives to others
(by access path), and where names come from. A hole stands for a value of another file: the module and the name there,
and the path of accesses from it, such as ``()`` for its call, ``.port`` for a property, ``#run()`` for a method of its
instances and ``!`` for what a promise holds. ``plans.typing`` fills the holes by joins over all files.

What is inferred: literals and templates, operators, arrays, objects, arrow functions, calls, property accesses, awaited
promises, conditionals, new, assertions, locals and parameters with defaults, members through ``this``, and all returns of
a function. What no rule covers is any, as are cycles.
"""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass, field

from ..operators.globs import name_matches
from ..schemas import DistillOptions
from . import Export, Import, Member, Parsed
from .ts_syntax import CLOSE, OPEN, ORDER, squeeze
from .ts_tree import Node, Param, Tree, heritage_text, hidden, walk

ANY = "any"


@dataclass(frozen=True)
class Hole:
    module: str
    name: str
    path: str = ""
    op: str = ""
    """``widen`` a literal to its type; ``plus``: the type of a sum with numbers."""


@dataclass(frozen=True)
class Fn:
    params: str
    result: object


@dataclass(frozen=True)
class Obj:
    fields: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Arr:
    item: object


@dataclass(frozen=True)
class Promised:
    value: object


@dataclass(frozen=True)
class Union:
    parts: tuple


@dataclass(frozen=True)
class Named:
    """A declared type, by its text and the scope that knows its name."""

    text: str
    scope: Scope = field(compare=False, hash=False)


@dataclass(frozen=True)
class ClassOf:
    node: Node = field(compare=False, hash=False)
    scope: Scope = field(compare=False, hash=False)
    name: str


class Scope:
    def __init__(self, parent: Scope | None = None, this: Node | None = None):
        self.parent, self.this, self.names = parent, this or (parent.this if parent else None), {}

    def find(self, name: str) -> tuple[object, Scope] | None:
        s: Scope | None = self
        while s:
            if name in s.names:
                return s.names[name], s
            s = s.parent
        return None


def widened(t: object) -> object:
    if isinstance(t, Hole):
        return Hole(t.module, t.name, t.path, t.op or "widen")
    if isinstance(t, Union):
        return union([widened(p) for p in t.parts])
    if isinstance(t, str):
        if t in ("true", "false"):
            return "boolean"
        if t[:1] in ("'", '"'):
            return "string"
        if re.fullmatch(r"-?\d[\d_.eE+-]*", t):
            return "number"
    return t


def union(parts: list) -> object:
    flat = [q for p in parts for q in (p.parts if isinstance(p, Union) else (p,))]
    if ANY in flat:
        return ANY
    once = list(dict.fromkeys(p for p in flat if p != "never"))
    if "true" in once and "false" in once:
        once = ["boolean" if p == "true" else p for p in once if p != "false"]
    once.sort(key=lambda p: p in ("undefined", "null"))  # last, as the language writes them
    return once[0] if len(once) == 1 else Union(tuple(once)) if once else "never"


def nested(part: str) -> str:
    return f"({part})" if " | " in part or "=>" in part else part


#: Results of the language's own functions, by name.
CALLS = {"parseInt": "number", "parseFloat": "number", "Number": "number", "String": "string", "Boolean": "boolean", "isNaN": "boolean", "encodeURIComponent": "string", "decodeURIComponent": "string"}
STATIC = {"JSON.stringify": "string", "Date.now": "number", "Array.isArray": "boolean", "Object.keys": Arr("string"), "Number.isInteger": "boolean", "Number.parseInt": "number", "Number.parseFloat": "number", "String.fromCharCode": "string"}
TEXT_METHODS = dict.fromkeys(("toUpperCase", "toLowerCase", "trim", "trimStart", "trimEnd", "slice", "substring", "padStart", "padEnd", "repeat", "replace", "replaceAll", "charAt", "concat", "normalize"), "string") | dict.fromkeys(
    ("includes", "startsWith", "endsWith"), "boolean"
) | dict.fromkeys(("indexOf", "lastIndexOf", "charCodeAt", "localeCompare", "search"), "number") | {"split": Arr("string")}
ARITHMETIC = ("-", "*", "/", "%", "**", "^", "<<", ">>", ">>>")
COMPARISON = ("==", "===", "!=", "!==", "<", ">", "<=", ">=", "instanceof", "in")
#: Binary operators, loosest first.
LEVELS = (("??", "||"), ("&&",), ("|",), ("&", "^"), ("==", "===", "!=", "!=="), ("<", ">", "<=", ">=", "instanceof", "in"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",))
MARKS = "=!<>+-*/%&|?^"


class Typer:
    def __init__(self, tree: Tree, file: str):
        self.tree, self.t, self.file = tree, tree.t, file
        self.busy: set[int] = set()
        self.known: dict[int, object] = {}
        self.kept: list[object] = []  # what ``known`` knows by its id stays alive
        self.top = Scope()
        self.declare(self.top, tree.nodes)

    def declare(self, scope: Scope, nodes: list[Node]) -> None:
        for n in nodes:
            if n.kind == "import":
                for there, here in n.specifiers:
                    scope.names[here] = Hole(n.module, there)
            elif n.kind in ("function", "class", "interface", "enum", "const", "let", "var", "namespace", "type") and n.name:
                scope.names.setdefault(n.name, n)

    # -- values of names
    def value_of(self, name: str, scope: Scope) -> object:
        found = scope.find(name)
        if found is None:
            return {"undefined": "undefined", "null": "null", "NaN": "number", "Infinity": "number"}.get(name, ANY)
        entry, where = found
        if isinstance(entry, Node):
            return self.node_value(entry, where)
        if isinstance(entry, Param):
            return self.param_type(entry, where)
        return entry

    def guarded(self, node: object, make) -> object:
        key = id(node)
        if key not in self.known:
            if key in self.busy:
                return ANY
            self.busy.add(key)
            self.kept.append(node)
            self.known[key] = make()
            self.busy.discard(key)
        return self.known[key]

    def node_value(self, n: Node, scope: Scope) -> object:
        if n.kind in ("const", "let", "var"):
            if n.type:
                return self.declared(n.type, scope)
            if not n.value:
                return ANY

            def value() -> object:
                found = self.expression(*n.value, scope)
                return found if n.kind == "const" else widened(found)

            return self.guarded(n, value)
        if n.kind == "function":
            return self.function_type(n, scope)
        if n.kind == "class":
            return ClassOf(n, scope, n.name)
        if n.kind == "enum":
            return Obj(tuple((m.name, n.name) for m in n.children))
        if n.kind == "namespace":
            inner = Scope(scope)
            self.declare(inner, n.children)
            return Obj(tuple((c.name, self.node_value(c, inner)) for c in n.children if c.exported and c.kind in ("const", "let", "var", "function")))
        return ANY

    def declared(self, text: str, scope: Scope) -> object:
        text = squeeze(text)
        if m := re.fullmatch(r"Promise\s*<(.*)>", text):
            return Promised(self.declared(m[1], scope))
        if m := re.fullmatch(r"([\w.$]+(?:<.*>)?)\[\]", text):
            return Arr(self.declared(m[1], scope))
        return Named(text, scope) if re.match(r"[A-Z_$]\w*", text) else text

    def param_type(self, p: Param, scope: Scope) -> object:
        if p.type:
            return self.declared(p.type, scope)
        if p.default:
            return self.guarded(p, lambda: widened(self.expression(*p.default, scope)))
        return Arr(ANY) if p.rest else ANY

    def params_text(self, n: Node, scope: Scope) -> str:
        return ", ".join(f"{squeeze(p.name)}{'?' if p.optional or p.rest else ''}: {self.show(self.param_type(p, scope))}" for p in n.params or [] if p.name != "this")

    def function_type(self, n: Node, scope: Scope) -> Fn:
        return Fn(self.params_text(n, scope), self.result(n, scope))

    def result(self, n: Node, scope: Scope) -> object:
        if n.type:
            return self.declared(n.type, scope)
        if n.kind == "constructor" or n.body is None:
            return ANY
        return self.guarded(n, lambda: self.returned(n.body, n.params or [], n.words, scope))

    def returned(self, body: tuple[int, int], params: list[Param], words: list[str], scope: Scope) -> object:
        """The type of a function by the returns of its own body."""
        if "*" in words:
            return ANY
        inner = self.inner_scope(params, scope)
        self.locals(body, inner)
        found = [("undefined" if a == b else widened(self.expression(a, b, inner))) for a, b in self.returns(*body)]
        out = union(found) if any(x != "undefined" for x in found) else "void"
        if "async" in words:
            return out if isinstance(out, Promised) else Promised(out)
        return out

    def inner_scope(self, params: list[Param], scope: Scope) -> Scope:
        inner = Scope(scope)
        for p in params:
            if re.fullmatch(r"[\w$]+", p.name):
                inner.names[p.name] = p
        return inner

    def locals(self, body: tuple[int, int], scope: Scope) -> None:
        """Declares what a body declares, blocks included, nested functions left out."""
        for k in self.own(*body):
            if self.t[k].text in ("const", "let", "var") and k + 1 < body[1] and self.t[k + 1].kind == "name":
                after, self.tree.i = self.tree.i, k
                self.declare(scope, self.tree.variables(self.t[k], [], self.t[k].text))
                self.tree.i = after
            elif self.t[k].text == "function" and self.t[k + 1].kind == "name":
                after, self.tree.i = self.tree.i, k
                self.declare(scope, [self.tree.function(self.t[k], ["async"] if self.t[k - 1].text == "async" else [])])
                self.tree.i = after

    def own(self, a: int, b: int):
        """Places of a body's tokens without those in nested function bodies."""
        k = a
        while k < b:
            yield k
            x = self.t[k].text
            if x == "{" and k > a and (self.t[k - 1].text == "=>" or self.opens_function(k)):
                k = self.after_group(k) - 1
            k += 1

    def opens_function(self, k: int) -> bool:
        """Whether the brace here is the body of a function or a method, going by what stands before its parentheses."""
        j = k - 1
        if self.t[j].text != ")":  # perhaps a result type
            while j > 0 and self.t[j].text not in (")", ";", "{", "}"):
                j -= 1
            if self.t[j].text != ")" or self.t[j + 1].text != ":":
                return False
        depth = 0
        while j >= 0:
            depth += (self.t[j].text in CLOSE) - (self.t[j].text in OPEN)
            if depth == 0:
                break
            j -= 1
        before = self.t[j - 1].text if j else ""
        return before == "function" or before not in ("if", "for", "while", "switch", "catch", "with", "await") and self.t[j - 1].kind == "name"

    def after_group(self, k: int) -> int:
        depth = 0
        while k < len(self.t):
            depth += (self.t[k].text in OPEN) - (self.t[k].text in CLOSE)
            k += 1
            if depth == 0:
                break
        return k

    def returns(self, a: int, b: int):
        for k in self.own(a, b):
            if self.t[k].text == "return" and (k == a or self.t[k - 1].text not in (".", "?.")):
                if k + 1 >= b or self.t[k + 1].line > self.t[k].line or self.t[k + 1].text == ";":
                    yield k + 1, k + 1
                    continue
                after, self.tree.i = self.tree.i, k + 1
                yield self.tree.upto(end=b)
                self.tree.i = after

    # -- expressions
    def split(self, a: int, b: int, *marks: str) -> list[tuple[int, int, str]]:
        """Parts of a range between operators outside brackets: (from, to, operator before)."""
        out, start, before, k = [], a, "", a
        while k < b:
            if self.t[k].text in OPEN:
                k = self.after_group(k)
                continue
            if self.t[k].text == "<" and (beyond := self.after_arguments(k)) > k:
                k = beyond
                continue
            n = self.operator(k, b)
            text = "".join(x.text for x in self.t[k : k + n])
            if text in marks and k > start:
                out.append((start, k, before))
                start, before = k + n, text
            k += n
        out.append((start, b, before))
        return out

    def after_arguments(self, k: int) -> int:
        """The place after the type arguments of a call that begin here; k if none do."""
        after, self.tree.i = self.tree.i, k
        if self.tree.generic_call():
            self.tree.angles()
        found, self.tree.i = self.tree.i, after
        return found

    def operator(self, k: int, b: int) -> int:
        """How many tokens without space between them are one operator."""
        if self.t[k].text not in MARKS or self.t[k].kind != "mark":
            return 1
        n = 1
        while k + n < b and n < 3 and self.t[k + n].kind == "mark" and self.t[k + n].start == self.t[k + n - 1].end and "".join(x.text for x in self.t[k : k + n + 1]) in (*ARITHMETIC, *COMPARISON, "??", "||", "&&", "+=", "-=", "++", "--"):
            n += 1
        return n

    def expression(self, a: int, b: int, scope: Scope) -> object:
        while a < b and self.t[b - 1].text == ";":
            b -= 1
        if a >= b:
            return ANY
        arrow = self.arrow(a, b, scope)
        if arrow is not None:
            return arrow
        word = self.t[a].text
        if word in ("function", "async") and "function" in (word, self.t[min(a + 1, b - 1)].text):
            after, self.tree.i = self.tree.i, a + (word == "async")
            node = self.tree.function(self.t[a], ["async"] if word == "async" else [])
            self.tree.i = after
            return self.function_type(node, scope)
        parts = self.split(a, b, "as", "satisfies")
        if len(parts) > 1 and parts[-1][2] == "as":
            text = self.tree.raw(*parts[-1][:2])
            return self.expression(a, parts[-1][0] - 1, scope) if text == "const" else self.declared(text, scope)
        if len(parts) > 1:
            return self.expression(a, parts[-1][0] - 1, scope)
        question = self.conditional(a, b)
        if question:
            q, colon = question
            return union([self.expression(q + 1, colon, scope), self.expression(colon + 1, b, scope)])
        for level in LEVELS:
            parts = self.split(a, b, *level)
            if len(parts) > 1 and all(p[0] < p[1] for p in parts):
                return self.binary([self.expression(x, y, scope) for x, y, _ in parts], [p[2] for p in parts[1:]])
        return self.unary(a, b, scope)

    def conditional(self, a: int, b: int) -> tuple[int, int] | None:
        k, q, depth = a, None, 0
        while k < b:
            x = self.t[k].text
            if x in OPEN:
                k = self.after_group(k)
                continue
            if x == "?" and self.t[k + 1 : k + 2] and not (self.t[k + 1].text == "?" or k > a and self.t[k - 1].text == "?"):
                q, depth = k if q is None else q, depth + 1
            elif x == ":" and q is not None:
                depth -= 1
                if not depth:
                    return q, k
            k += 1
        return None

    def binary(self, types: list, marks: list[str]) -> object:
        if marks[0] in COMPARISON:
            return "boolean"
        if marks[0] in ("??", "||"):
            left = [p for t in types[:-1] for p in (t.parts if isinstance(t, Union) else (t,)) if p not in ("undefined", "null")]
            return union([*left, types[-1]])
        if marks[0] == "&&":
            return types[-1] if all(t == "boolean" for t in types[:-1]) and types[-1] == "boolean" else ANY
        if "+" in marks:
            wide = [widened(t) for t in types]
            if "string" in wide:
                return "string"
            others = list(dict.fromkeys(t for t in wide if t != "number"))
            if len(others) == 1 and isinstance(others[0], Hole):
                return Hole(others[0].module, others[0].name, others[0].path, "plus")
            return ANY if others else "number"
        return "number"

    def unary(self, a: int, b: int, scope: Scope) -> object:
        word = self.t[a].text
        if word == "!":
            return "boolean"
        if word in ("typeof", "void", "delete") and b - a > 1:
            return {"typeof": "string", "void": "undefined", "delete": "boolean"}[word]
        if word in ("-", "+", "~") and b - a > 1:
            inner = self.unary(a + 1, b, scope)
            return f"-{inner}" if word == "-" and isinstance(inner, str) and inner[:1].isdigit() else "number"
        if word == "await" and b - a > 1:
            inner = self.unary(a + 1, b, scope)
            return inner.value if isinstance(inner, Promised) else Hole(inner.module, inner.name, inner.path + "!") if isinstance(inner, Hole) else inner
        return self.postfix(a, b, scope)

    def postfix(self, a: int, b: int, scope: Scope) -> object:
        first = self.t[a]
        k = a + 1
        if first.text == "new":
            while k < b and self.t[k].text not in ("(", "<"):
                k += 1
            name = self.tree.raw(a + 1, k)
            if k < b and self.t[k].text == "<":
                after, self.tree.i = self.tree.i, k
                name += self.tree.angles()
                k, self.tree.i = self.tree.i, after
            if k < b and self.t[k].text == "(":
                k = self.after_group(k)
            value: object = Named(name, scope)
        elif first.text == "(":
            k = self.after_group(a)
            value = self.expression(a + 1, k - 1, scope)
        elif first.text == "[":
            k = self.after_group(a)
            items = [self.expression(x, y, scope) for x, y, _ in self.split(a + 1, k - 1, ",") if x < y and self.t[x].text != "..."]
            value = Arr(union([widened(i) for i in items])) if items and not any(self.t[x].text == "..." for x, _, _ in self.split(a + 1, k - 1, ",") if x < k - 1) else Arr(ANY)
        elif first.text == "{":
            k = self.after_group(a)
            value = self.object(a + 1, k - 1, scope)
        elif first.kind == "text":
            value = "string" if first.text.startswith("`") else first.text
        elif first.kind == "number":
            value = first.text
        elif first.text in ("true", "false"):
            value = first.text
        elif first.text == "this":
            value = Named(scope.this.name, scope) if scope.this else ANY
        elif first.kind == "name":
            dotted = self.tree.raw(a, min(a + 3, b))
            if dotted in STATIC and scope.find(first.text) is None:
                return STATIC[dotted]
            if first.text == "Math" and scope.find("Math") is None:
                return "number"
            if first.text in CALLS and scope.find(first.text) is None and k < b and self.t[k].text == "(":
                value, k = CALLS[first.text], self.after_group(k)
            else:
                value = self.value_of(first.text, scope)
        else:
            return ANY
        while k < b:
            x = self.t[k].text
            if x in (".", "?."):
                if k + 1 >= b:
                    return ANY
                value, k = self.member(value, self.t[k + 1].text, k + 2 < b and self.t[k + 2].text == "("), k + 2
            elif x == "(":
                value, k = self.called(value), self.after_group(k)
            elif x == "<" and k + 1 < b:
                after, self.tree.i = self.tree.i, k
                self.tree.angles()
                k, self.tree.i = self.tree.i, after
            elif x == "[":
                value, k = (value.item if isinstance(value, Arr) else ANY), self.after_group(k)
            elif x == "!":
                k += 1
            else:
                return ANY
        return value

    def called(self, value: object) -> object:
        if isinstance(value, Fn):
            return value.result
        if isinstance(value, Hole) and value.op != "plus":
            return Hole(value.module, value.name, value.path + "()")
        return ANY

    def member(self, value: object, name: str, called: bool) -> object:
        wide = widened(value)
        if isinstance(value, Obj):
            return next((t for k, t in value.fields if k == name), ANY)
        if isinstance(value, Hole):
            if value.op == "plus":
                return ANY
            return Hole(value.module, name) if value.name == "*" and not value.path else Hole(value.module, value.name, f"{value.path}.{name}")
        if wide == "string":
            return "number" if name == "length" else Fn("", TEXT_METHODS[name]) if name in TEXT_METHODS else ANY
        if wide == "number":
            return Fn("", "string") if name in ("toString", "toFixed", "toPrecision", "toLocaleString") else ANY
        if isinstance(value, Arr):
            if name == "length":
                return "number"
            fixed = {"join": "string", "includes": "boolean", "some": "boolean", "every": "boolean", "indexOf": "number", "findIndex": "number", "push": "number", "pop": union([value.item, "undefined"]), "shift": union([value.item, "undefined"])}
            return Fn("", fixed[name]) if name in fixed else Fn("", value) if name in ("slice", "filter", "sort", "reverse", "concat") else ANY
        if isinstance(value, ClassOf):
            return self.instance_member(value.node, value.scope, name, static=True)
        if isinstance(value, Named):
            base = re.match(r"[\w$]+", value.text)
            found = value.scope.find(base[0]) if base else None
            if found and isinstance(found[0], Hole):
                return Hole(found[0].module, found[0].name, f"{found[0].path}#{name}")
            if found and isinstance(found[0], Node) and found[0].kind in ("class", "interface"):
                return self.instance_member(found[0], found[1], name)
        return ANY

    def instance_member(self, node: Node, scope: Scope, name: str, static: bool = False) -> object:
        inner = Scope(scope, node)
        for m in node.children:
            if m.name == name and ("static" in m.words) == static and m.kind != "setter":
                return self.member_type(m, inner)
        if not static:
            for m in node.children:
                if m.kind == "constructor":
                    for p in m.params or []:
                        if p.name == name and re.match(r"(public|private|protected|readonly)\b", p.text):
                            return self.param_type(p, inner)
            for kind, base in node.heritage:
                if kind == "extends":
                    return self.member(Named(base, scope), name, False)
        return ANY

    def member_type(self, m: Node, scope: Scope) -> object:
        if m.kind == "method":
            return self.function_type(m, scope)
        if m.kind == "getter":
            return self.result(m, scope)
        if m.type:
            return self.declared(m.type, scope)
        if m.value:
            found = self.guarded(m, lambda: self.expression(*m.value, scope))
            return found if "readonly" in m.words else widened(found)
        return ANY

    def object(self, a: int, b: int, scope: Scope) -> object:
        out = []
        for x, y, _ in self.split(a, b, ","):
            if x >= y:
                continue
            name = self.t[x].text.strip("'\"")
            if self.t[x].text in ("...", "[", "*", "get", "set") and y - x > 1 and self.t[x + 1].text != ":":
                return ANY
            if y - x == 1:
                out.append((name, widened(self.value_of(name, scope))))
            elif self.t[x + 1].text == ":":
                out.append((name, widened(self.expression(x + 2, y, scope))))
            else:
                words = ["async"] if name == "async" else []
                after, self.tree.i = self.tree.i, x + len(words) + 1
                node = self.tree.callable(Node("method", self.t[x + len(words)].text, self.t[x], words))
                self.tree.i = after
                out.append((node.name, self.function_type(node, scope)))
        return Obj(tuple(out))

    def arrow(self, a: int, b: int, scope: Scope) -> object | None:
        k, words = a, []
        if self.t[k].text == "async" and k + 1 < b and self.t[k + 1].text in ("(", "<") or self.t[k].text == "async" and k + 2 < b and self.t[k + 2].text == "=>":
            words, k = ["async"], k + 1
        after, self.tree.i = self.tree.i, k
        try:
            if self.t[k].text == "<":
                self.tree.angles()
            node = Node("arrow", "", self.t[a], words)
            if self.tree.text() == "(":
                if self.t[min(self.after_group(self.tree.i), len(self.t) - 1)].text not in ("=>", ":"):
                    return None
                node.params = self.tree.params()
                if self.tree.accept(":"):
                    node.type = self.tree.raw(*self.tree.upto("=>", types=True, end=b))
            elif self.t[k].kind == "name":
                node.params = [Param(self.t[k].text, False, None, self.t[k].text)]
                self.tree.i += 1
            else:
                return None
            if self.tree.i >= b or not self.tree.accept("=>"):
                return None
            start = self.tree.i
        finally:
            self.tree.i = after
        head = self.params_text(node, scope)
        if node.type:
            return Fn(head, self.declared(node.type, scope))
        if self.t[start].text == "{":
            return Fn(head, self.returned((start + 1, self.after_group(start) - 1), node.params, words, scope))
        value = widened(self.expression(start, b, self.inner_scope(node.params, scope)))
        return Fn(head, (value if isinstance(value, Promised) else Promised(value)) if words else value)

    # -- results
    def show(self, t: object) -> str:
        """The type's text; a hole is a marked number, its place in ``holes``."""
        if isinstance(t, str):
            return t
        if isinstance(t, Named):
            return t.text
        if isinstance(t, ClassOf):
            return f"typeof {t.name}"
        if isinstance(t, Hole):
            if t not in self.holes:
                self.holes.append(t)
            return f"\x01{self.holes.index(t)}\x02"
        if isinstance(t, Fn):
            return f"({t.params}) => {self.show(t.result)}"
        if isinstance(t, Arr):
            return f"{nested(self.show(t.item))}[]"
        if isinstance(t, Promised):
            return f"Promise<{self.show(t.value)}>"
        if isinstance(t, Obj):
            return "{ " + " ".join(f"{k}: {self.show(x)};" for k, x in t.fields) + " }" if t.fields else "{}"
        return " | ".join(nested(self.show(p)) if isinstance(p, Fn) else self.show(p) for p in t.parts)

    @property
    def holes(self) -> list[Hole]:
        return self.__dict__.setdefault("_holes", [])

    def paths(self, t: object, path: str, depth: int = 2):
        """What a value gives by accesses, (path, type)."""
        yield path, t
        if not depth:
            return
        if isinstance(t, Fn):
            yield from self.paths(t.result, path + "()", depth - 1)
        elif isinstance(t, Promised):
            yield from self.paths(t.value, path + "!", depth)
        elif isinstance(t, Obj):
            for k, x in t.fields:
                yield from self.paths(x, f"{path}.{k}", depth - 1)
        elif isinstance(t, ClassOf):
            yield from self.instance_paths(t.node, t.scope, path + ".", depth - 1, static=True)
        elif isinstance(t, Named):
            base = re.match(r"[\w$]+", t.text)
            found = t.scope.find(base[0]) if base else None
            if found and isinstance(found[0], Node) and found[0].kind in ("class", "interface"):
                yield from self.instance_paths(found[0], found[1], path + ".", depth - 1)

    def instance_paths(self, node: Node, scope: Scope, path: str, depth: int, static: bool = False):
        for m in node.children:
            if m.name and m.kind in ("method", "property", "getter") and ("static" in m.words) == static and "private" not in m.words:
                yield from self.paths(self.member_type(m, Scope(scope, node)), path + m.name, max(depth, 1) if m.kind == "method" else depth)

    def export_paths(self, n: Node):
        yield from self.paths(self.node_value(n, self.top), "")
        if n.kind in ("class", "interface"):
            yield from self.instance_paths(n, self.top, "#", 2)


@dataclass
class Facts:
    parsed: Parsed = field(default_factory=Parsed)
    holes: list[dict] = field(default_factory=list)
    values: list[dict] = field(default_factory=list)
    aliases: list[dict] = field(default_factory=list)


def module_key(file: str, module: str) -> str | None:
    """The file that a relative module means, without extension; None for packages."""
    if not module.startswith("."):
        return None
    return re.sub(r"\.(tsx?|jsx?|[mc][jt]s)$", "", posixpath.normpath(posixpath.join(posixpath.dirname(file), module)))


def member_rows(x: Typer, node: Node, options: DistillOptions) -> list[Member]:
    """Properties, methods, getters and setters, each in source order; constructors are none of them."""
    inner, out = Scope(x.top, node), []
    for kind in ("property", "method", "getter", "setter"):
        for m in node.children:
            if m.kind != kind or not m.name or m.name.startswith("[") or hidden(m, options) or m.name.startswith("#") and not options.private:
                continue
            lead = "".join(w + " " for w in ("static", "readonly" if kind == "property" and node.kind == "class" else "", "async" if kind == "method" else "") if w in m.words)
            head = x.params_text(m, inner) if m.params is not None else ""
            optional = "?" if m.optional and node.kind == "interface" and kind == "property" else ""
            shown = x.show(x.member_type(m, inner)) if kind == "property" else x.show(x.result(m, inner)) if kind != "setter" else ""
            text = {"property": f"{lead}{m.name}{optional}: {shown}", "method": f"{lead}{m.name}({head}): {shown}", "getter": f"get {m.name}(): {shown}", "setter": f"set {m.name}({head.replace('?:', ':')})"}[kind]
            out.append(Member(m.name, kind, text, "private" in m.words, "protected" in m.words))
    return out


def signature(x: Typer, n: Node) -> str:
    if n.kind == "function":
        lead = "async " if "async" in n.words else ""
        word = "function* " if "*" in n.words else "" if lead else "function "
        return f"{lead}{word}{n.name or 'anonymous'}({x.params_text(n, x.top)}): {x.show(x.result(n, x.top))}"
    if n.kind == "class":
        return f"{'abstract ' if 'abstract' in n.words else ''}class {n.name or 'anonymous'}{heritage_text(n)}"
    if n.kind == "interface":
        return f"interface {n.name}{heritage_text(n)}"
    if n.kind == "type":
        names = [re.match(r"\s*(?:const |in |out )*([\w$]+)", p) for p in n.type_params[1:-1].split(",")] if n.type_params else []
        listed = ", ".join(m[1] for m in names if m)
        return f"type {n.name}{f'<{listed}>' if listed else ''} = {squeeze(n.type or ANY)}"
    if n.kind == "enum":
        return f"{'const ' if 'const' in n.words else ''}enum {n.name}"
    word = "const" if n.kind == "const" else "let"
    value = f" = {squeeze(x.tree.raw(*n.value))}" if n.value else ""
    return f"{word} {n.name}: {x.show(x.node_value(n, x.top))}{value}"


def facts(file: str, source: str, options: DistillOptions) -> Facts:
    tree, out = Tree(source), Facts()
    x, rows = Typer(tree, file), []
    for n in walk(tree.nodes, ()):
        if n.kind == "import":
            out.parsed.imports.append(Import(n.module, [here for _, here in n.specifiers], n.token.line))
        elif n.kind in ("reexport", "star"):
            text = f"export {{ {n.specifiers[0][0]}{' as ' + n.name if n.specifiers[0][0] != n.name else ''} }}" if n.kind == "reexport" else f"export *{' as ' + n.name if n.name != '*' else ''}"
            rows.append(Export(n.name, "const", text + (f" from '{n.module}'" if n.module else ""), "public", n.token.line))
        elif n.exported and "default" in n.words and n.kind == "default":
            rows.append(Export("default", "const", "export default", "public", n.token.line))
        elif n.exported and n.kind in ("function", "class", "interface", "type", "enum", "const", "let", "var"):
            if "default" in n.words:
                rows.append(Export("default", "const", "export default", "public", n.token.line))
            if options.include_names and not name_matches(n.name, options.include_names, "typescript") or options.exclude_names and name_matches(n.name, options.exclude_names, "typescript"):
                out.parsed.skipped.append((n.name, "pattern", n.token.line))
                continue
            kind = "const" if n.kind in ("let", "var") else n.kind
            rows.append(Export(n.name or "anonymous", kind, signature(x, n), "public", n.token.line, docstring=n.token.doc if options.docstrings else None, members=member_rows(x, n, options) if n.kind in ("class", "interface") else []))
    out.parsed.exports = sorted(rows, key=lambda e: (ORDER.index(e.kind), e.name))
    share(x, tree, file, out)
    out.holes = [{"hole": k, "module": module_key(file, h.module), "name": h.name, "path": h.path, "op": h.op} for k, h in enumerate(x.holes)]
    return out


def share(x: Typer, tree: Tree, file: str, out: Facts) -> None:
    """What a file gives to others: values by path, and names that it passes on."""

    def give(name: str, n: object) -> None:
        if isinstance(n, Hole):
            out.aliases.append({"name": name, "module": module_key(file, n.module), "target": n.name})
        elif isinstance(n, Node):
            done = set()
            for path, t in x.export_paths(n):
                if path not in done:
                    done.add(path)
                    out.values.append({"name": name, "path": path, "type": x.show(t)})

    for n in walk(tree.nodes, ()):
        if n.kind == "star":
            out.aliases.append({"name": n.name, "module": module_key(file, n.module), "target": "*"})
        elif n.kind == "reexport":
            there = n.specifiers[0][0]
            give(n.name, Hole(n.module, there) if n.module else x.top.names.get(there))
        elif n.kind == "default" and n.value:
            value = x.expression(*n.value, x.top)
            if isinstance(value, Hole) and not value.path:
                give("default", value)
            else:
                out.values += [{"name": "default", "path": p, "type": x.show(t)} for p, t in dict(x.paths(value, "")).items()]
        elif n.exported and n.kind in ("function", "class", "interface", "enum", "const", "let", "var"):
            give("default" if "default" in n.words else n.name, n)


def parse(source: str, options: DistillOptions) -> Parsed:
    """One file alone: what other files decide is any."""
    found = facts("", source, options).parsed
    for e in found.exports:
        e.signature = re.sub("\x01\\d+\x02", ANY, e.signature)
        for m in e.members:
            m.signature = re.sub("\x01\\d+\x02", ANY, m.signature)
    return found
