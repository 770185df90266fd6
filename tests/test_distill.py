"""Parsers and documents over sources written here."""

from __future__ import annotations

import json

import pytest

from lodestone import parsers
from lodestone.plans import combine, distill, render, tree
from lodestone.schemas import CombineOptions, DistillOptions, ExtractOptions, TreeOptions

PYTHON = '''"""Module."""
import os, sys
import numpy as np
from ..pkg import (a, b as c)
from x import *

LIMIT = 10
_hidden = 1
lower: int = 2
plain = 3

class Service(Base, Mixin):
    """Swallowed."""
    def __init__(self, x):
        import inner
        self.x = x

    async def load(self, key: str = "k") -> dict:
        def nested(): pass
        return {}

    def _private(self): pass

class _Internal: pass

def build(p, q=1) -> int:
    """
    Builds it.
    In two lines.
    """
    return 1

def odd(
    a,
    b,
): pass
'''

TYPESCRIPT = """import d, { a as b, type C } from './x';
import * as ns from "y";
/** Greets people. */
export class Greeter<T> extends Base implements I, J {
  private secret = 1;
  protected age = 3;
  name?: string;
  static count: number = 0;
  constructor(private readonly who: string) { super(); }
  greet() { return "Hi " + this.who; }
  private hide(): void {}
  get size(): number { return 1; }
}
export const PI = 3.14, NAME: string = "x";
export async function add(a: number, b = 2): Promise<number> { return a + b; }
export interface Shape extends Base { area(): number; side?: string }
export type Union = { a: string } | null;
export enum Color { Red = 1, Green }
export { foo as bar } from './z';
export * from './all';
export default Greeter;
const hidden = () => { export_ };
"""


def parsed(path, source, **options):
    return parsers.parse_source(path, source, DistillOptions(**options))


def test_python():
    p = parsed("a.py", PYTHON)
    assert [(i.source, i.specifiers) for i in p.imports] == [("os, sys", ["os, sys"]), ("numpy", ["np"]), ("..pkg", ["a", "c"]), ("x", ["*"]), ("inner", ["inner"])]
    assert [(e.kind, e.name) for e in p.exports] == [("function", "Anonymous"), ("function", "build"), ("const", "LIMIT"), ("const", "lower"), ("class", "Service")]
    service, build = p.exports[-1], p.exports[1]
    assert service.signature == "class Service(Base, Mixin)" and service.docstring is None
    assert [(m.name, m.signature) for m in service.members] == [("load", 'async def load(key: str = "k") -> dict'), ("nested", "def nested()")]
    assert build.signature == "def build(p, q=1) -> int" and build.docstring == "Builds it.\nIn two lines."
    assert {s[0] for s in p.skipped} == {"_private", "__init__", "_Internal"}
    assert "__init__" in [m.name for m in next(e for e in parsed("a.py", PYTHON, private=True).exports if e.name == "Service").members]


def test_tabs_are_like_spaces():
    spaces = "class A:\n    def b(self, x): pass\n    def c(self): pass\n"
    assert parsed("a.py", spaces) == parsed("a.py", spaces.replace("    ", "\t"))


def test_name_patterns():
    source = "def get_a(): pass\ndef set_a(): pass\nclass Admin: pass\n"
    assert [e.name for e in parsed("a.py", source, include_names=["get_*", "Admin"]).exports] == ["get_a", "Admin"]
    kept = parsed("a.py", source, exclude_names=["*_a"])
    assert [e.name for e in kept.exports] == ["Admin"] and [s[1] for s in kept.skipped] == ["pattern", "pattern"]


def test_typescript():
    p = parsed("a.ts", TYPESCRIPT)
    assert [(i.source, i.specifiers) for i in p.imports] == [("./x", ["d", "b", "C"]), ("y", ["ns"])]
    assert [(e.kind, e.name) for e in p.exports] == [("interface", "Shape"), ("type", "Union"), ("class", "Greeter"), ("function", "add"), ("const", "*"), ("const", "NAME"), ("const", "PI"), ("const", "bar"), ("const", "default"), ("enum", "Color")]
    by = {e.name: e for e in p.exports}
    assert by["Greeter"].signature == "class Greeter<T> extends Base implements I, J" and by["Greeter"].docstring == "Greets people."
    assert [m.signature for m in by["Greeter"].members] == ["constructor(private readonly who: string)", "protected age: number", "name?: string", "static count: number", "greet(): string", "get size(): number"]
    assert by["add"].signature == "async function add(a: number, b = 2): Promise<number>"
    assert by["PI"].signature == "const PI: 3.14 = 3.14" and by["NAME"].signature == "const NAME: string"
    assert [m.signature for m in by["Shape"].members] == ["side?: string", "area(): number"]
    assert "age" not in str([m.name for m in parsed("a.ts", TYPESCRIPT, protected=False).exports[2].members])


def test_registry():
    assert parsed("a.zig", "x").errors[0][0] == "no language for a.zig"
    parsers.register(parsers.Language("toy", (".toy",), lambda s, o: 1 / 0))
    assert "ZeroDivisionError" in parsed("a.toy", "").errors[0][0] and "toy" in parsers.registered()
    parsers.unregister("toy")
    assert parsers.language_for("a.toy") is None


@pytest.fixture(scope="module")
def files(spark):
    rows = [("src/a.py", PYTHON), ("src/lib/b.ts", TYPESCRIPT), ("README.md", "# hi"), ("src/c.test.ts", "export const t = 1;"), ("e.py", "")]
    return spark.createDataFrame(rows, "file string, content string")


def test_documents(files):
    doc = distill.distill(files).first().document
    assert doc.index('<file path="e.py">') < doc.index('<file path="a.py">') < doc.index('<file path="lib/b.ts">')
    assert "c.test.ts" not in doc and "README" not in doc
    greeter = doc[doc.index("/**\n * Greets people.\n */") :]
    assert greeter.startswith("/**\n * Greets people.\n */\nexport class Greeter extends Base implements I, J {\n    constructor(private readonly who: string)\n    protected age: number;\n    name?: string;\n    static count: number;\n    greet(): string\n    get size(): number\n}\n")
    assert "export interface Shape extends Base {\n    side?: string;\n    area(): number;\n}\n" in doc
    assert "export enum Color { Red = 1, Green }\n" in doc and "import '..pkg'\n" in doc
    md = distill.distill(files, DistillOptions(format="md")).first().document
    assert "## src/a.py\n\n```python\nimport 'os, sys'\n" in md and "```typescript\n" in md
    data = json.loads(distill.distill(files, DistillOptions(format="json")).first().document)
    assert data["metadata"]["fileCount"] == 3 and data["metadata"]["languages"] == {"python": 2, "typescript": 1}
    assert [f["path"] for f in data["files"]] == ["e.py", "src/a.py", "src/lib/b.ts"]
    with pytest.raises(ValueError, match="unknown format"):
        DistillOptions(format="xml")


def test_no_files(spark, files):
    assert distill.distill(files.limit(0)).first().document == ""
    row = distill.metrics(files.limit(0), distill.parse(files.limit(0))).first()
    assert (row.file_count, row.original_tokens, row.compression_ratio) == (0, 0, 0)


def test_compat_drops_docstrings(files):
    kept = distill.symbols(distill.parse(files, DistillOptions(compat=True)))
    assert kept.where("docstring IS NOT NULL").count() == 0


def test_trees(files):
    symbols = distill.symbols(distill.parse(distill.pick(files, DistillOptions(include=["src/lib/**"]))))
    lines = tree.tree(symbols, "root", TreeOptions()).first().document.split("\n")
    assert lines[:5] == ["root", "└── src/", "    └── lib/", "        └── b.ts", "            ├── add"]
    assert lines[-2:] == ["            └── Greeter", "                Greets people."]
    by_type = tree.tree(symbols, options=TreeOptions(group_by="type")).first().document.split("\n")
    assert by_type[:4] == ["APIs by Type", "├── CLASS (1)", "│   └── Greeter src/lib/b.ts", "│"] and by_type[-2] == "└── ENUM (1)"
    flat = tree.tree(symbols, options=TreeOptions(group_by="none", show_types=True)).first().document.split("\n")
    assert flat[0] == "All APIs" and flat[1].startswith("├── add async function add(") and flat[-1] == "    Greets people."
    assert tree.outline(symbols).first().document.startswith("## src/lib/b.ts\n\n- add\n")
    assert tree.tree(symbols.limit(0), "root").first().document == "root"


def test_private_symbols(spark):
    rows = [("f", 0, "_p", "function", "def _p()", None, "private", 1, 1, []), ("f", 1, "q", "function", "def q()", "d" * 90, "public", 2, 2, [])]
    from lodestone.schemas import SYMBOLS

    symbols = spark.createDataFrame(rows, SYMBOLS)
    assert "_p" not in tree.tree(symbols).first().document
    shown = tree.tree(symbols, options=TreeOptions(include_private=True)).first().document
    assert "    ├── _p [private]\n    └── q\n        " + "d" * 80 + "..." in shown


def test_combine_formats(files):
    md = combine.combine(files, CombineOptions(format="md", include=["*.md"])).first().document
    assert md == "# Code Context\n\n## README.md\n\n```markdown\n# hi\n```\n\n"
    data = json.loads(combine.combine(files, CombineOptions(format="json", include=["*.md"])).first().document)
    assert data == {"files": [{"path": "README.md", "status": "added", "content": "# hi", "additions": 1, "deletions": 0}], "metadata": {"totalFiles": 1, "totalAdditions": 1, "totalDeletions": 0}}


def test_compressed(files):
    small = distill.compress(files.where("file = 'README.md'")).selectExpr("*", "1 AS ord")
    assert render.compression_txt(small).first().document == '<file path="README.md" language="markdown">\n# hi\n</file>'
    assert "\n\n---\n\n" in render.combined_txt(small, distill.parse(files)).first().document


def test_extract_formats(spark):
    rows = [("a.py", "modified", 5, 2, "@@ -1 +1 @@\n+x\n-y\n z", None, 1), ("b<.txt", "added", 3, 0, "+q", None, 2), ("c.txt", "renamed", 0, 0, "", "old.txt", 3)]
    changes = spark.createDataFrame(rows, "file string, status string, additions int, deletions int, diff string, old_file string, ord int")
    contents = spark.createDataFrame([("b<.txt", "q & r")], "file string, content string")
    txt = combine.extract(changes, contents, ExtractOptions()).first().document
    assert "<path>b&lt;.txt</path>" in txt and '<content language="txt">\n<![CDATA[q & r]]>' in txt and "<old_path>old.txt</old_path>" in txt
    assert "<![CDATA[  @@ -1 +1 @@\n+ x\n- y\n   z]]>" in txt
    meta = render.metadata_md("r", "main", "abc1234", "2024-01-01", "staged", 1234, "lodestone", "src/*", ["py"])
    md = combine.extract(changes, contents, ExtractOptions(format="md"), meta).first().document
    assert md.startswith("## Metadata\n") and "~1,234" in md and "\n\n## Scope\n- **Files Changed:** 3\n- **Lines:** +8 -2\n\n## Changes\n" in md
    assert "### c.txt (renamed from old.txt)" in md
    assert "## Metadata" not in combine.extract(changes, contents, ExtractOptions(format="md", no_metadata=True), meta).first().document
    data = json.loads(combine.extract(changes, contents, ExtractOptions(format="json", types=["py"])).first().document)
    assert data["scope"]["filesChanged"] == 1 and data["changes"][0]["file"] == "a.py"
    empty = combine.extract(changes.limit(0), contents, ExtractOptions()).first().document
    assert empty == "<code_context>\n  <changes>\n  </changes>\n</code_context>"
    with pytest.raises(ValueError, match="exclude each other"):
        ExtractOptions(staged=True, all=True)
