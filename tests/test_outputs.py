"""Documents of folders, written to named files."""

from __future__ import annotations

import pytest

from lodestone.plans import combine, distill, tree
from lodestone.schemas import CombineOptions, DistillOptions, TreeOptions


@pytest.fixture
def code(tmp_path):
    root = tmp_path / "code"
    for path, text in {"a.py": "def f(x): pass\ndef _g(): pass\n", "b/c.ts": "export class K { private x = 1; m() { return 'a' } }\n", "b/Zed.py": "LIMIT = 1\n", "b/é.py": "def acc(): pass\n", "skip/d.py": "def d(): pass\n"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.mark.parametrize("fmt", ["txt", "md", "json"])
def test_distill_output(spark, code, tmp_path, fmt):
    out = tmp_path / f"out.{fmt}"
    document = distill.distill_path(spark, code, DistillOptions(exclude=["skip/**"], format=fmt, output=str(out))).first().document
    assert out.read_text(encoding="utf-8") == document and "acc" in document and "def d()" not in document and not document.endswith("\n")


@pytest.mark.parametrize("options", [{}, {"group_by": "type"}, {"group_by": "none", "show_types": True}, {"outline": True}])
def test_tree_output(spark, code, tmp_path, options):
    out = tmp_path / "tree.txt"
    document = tree.tree_path(spark, code, TreeOptions(exclude=["skip/**"], output=str(out), **options)).first().document
    assert out.read_text(encoding="utf-8") == document and "acc" in document and "skip" not in document
    everything = tree.tree_path(spark, code, TreeOptions(include_private=True)).first().document
    assert "skip" in everything and everything.startswith("code\n") and everything.index("├── b/") < everything.index("└── a.py")


@pytest.mark.parametrize("fmt", ["txt", "md", "json"])
def test_combine_output(spark, code, tmp_path, fmt):
    out = tmp_path / f"all.{fmt}"
    document, errors = combine.combine_paths(spark, [code], CombineOptions(format=fmt, output=str(out), sort_by="size"))
    assert out.read_text(encoding="utf-8") == document.first().document and errors.count() == 0
