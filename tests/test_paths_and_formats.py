"""Listed paths, the distiller's scan, output files, metadata, formats, orders and exact token counts."""

from __future__ import annotations

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import tokens
from lodestone.operators import changes as C
from lodestone.operators import selector as S
from lodestone.plans import combine, distill, render, tree
from lodestone.schemas import CombineOptions, DistillOptions, ExtractOptions, Metadata
from lodestone.sources import paths
from lodestone.sources.corpus import TEXT_EXTENSIONS, is_text


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    deep = root / "/".join(f"d{k}" for k in range(13))
    for path, text in {
        root / "a.py": "def a(): pass\n", root / "b.txt": "b", root / ".hidden.py": "X = 1\n", root / "ignored" / "c.py": "Y = 2\n", root / ".gitignore": "ignored/\n",
        deep / "deep.py": "Z = 3\n", root / "sub" / "d.test.ts": "export const t = 1;", root / "sub" / "e.ts": "export const e = 2;", root / "dist" / "f.ts": "export const f = 3;",
    }.items():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (root / "g.py").write_bytes(b"\xff\x00\x01")
    os.symlink(root, root / "sub" / "loop")
    return str(root)


def names(df):
    return sorted(r.file for r in df.select("file").collect())


def test_paths(spark, folder, tmp_path):
    a, sub, gone = f"{folder}/a.py", f"{folder}/sub", f"{folder}/none"
    pipe = str(tmp_path / "pipe")
    os.mkfifo(pipe)
    files, errors = paths.collect(spark, [a, gone, sub, pipe, a], base=folder)
    rows = files.orderBy("ord").collect()
    assert [r.file for r in rows] == ["a.py", "sub/d.test.ts", "sub/e.ts", "a.py"] and rows[0].content == "def a(): pass\n" and rows[0].size == 14 and rows[0].path == a
    assert sorted(r.error for r in errors.collect()) == sorted([f"Path not found: {gone}", f"Not a file or directory: {pipe}"])
    some = lambda **o: names(paths.collect(spark, [a, sub, folder], base=folder, **o)[0])
    assert some(max_files="2") == ["a.py", "sub/d.test.ts"] and some(max_files="1") == ["a.py"]
    assert some(include="*.ts") == ["a.py", "dist/f.ts", "sub/d.test.ts", "sub/d.test.ts", "sub/e.ts", "sub/e.ts"]
    assert not any("deep" in x or "ignored" in x for x in some()) and any("deep" in x for x in some(max_depth="20")) and any("ignored/" in x for x in some(gitignore="false"))
    none, _ = paths.collect(spark, [])
    assert none.count() == 0


def test_combine_paths(spark, folder, tmp_path):
    out = str(tmp_path / "out.txt")
    document, errors = combine.combine_paths(spark, [f"{folder}/sub", f"{folder}/b.txt", "nowhere"], CombineOptions(output=out, exclude=["*.test.ts"]))
    text = document.first().document
    assert re.findall(r'<file path="([^"]*)"', text) == [os.path.relpath(f"{folder}/{x}") for x in ("sub/e.ts", "b.txt")] and open(out).read() == text
    assert errors.first().error == "Path not found: nowhere"
    sized, _ = combine.combine_paths(spark, [f"{folder}/sub", f"{folder}/b.txt"], CombineOptions(format="json", sort_by="size", sort_order="asc"))
    got = json.loads(sized.first().document)
    assert [f["content"] for f in got["files"]] == ["b", "export const t = 1;", "export const e = 2;"] and got["metadata"]["totalFiles"] == 3
    with pytest.raises(ValueError, match="unknown order"):
        CombineOptions(sort_by="colour")


def test_distill_scan(spark, folder):
    assert names(distill.scan(spark, folder)) == [".gitignore", ".hidden.py", "a.py", "b.txt", "/".join(f"d{k}" for k in range(13)) + "/deep.py", "g.py", "ignored/c.py", "sub/e.ts"]
    assert names(distill.scan(spark, folder, DistillOptions(include=["**/*.test.ts"]))) == ["sub/d.test.ts"]
    assert names(distill.scan(spark, folder, DistillOptions(include=["**/*.py"], exclude=["ignored/**", "d0/**"]))) == [".hidden.py", "a.py", "g.py"]
    assert names(distill.scan(spark, f"{folder}/a.py")) == ["a.py"]
    doc = distill.distill(distill.scan(spark, folder).select("file", "content")).first().document
    assert "ignored/c.py" in doc and "deep.py" in doc and "b.txt" not in doc


def test_listed_changes(spark):
    rows = spark.createDataFrame([("a", None, False, 1), ("b", None, True, 2)], "file string, last_modified timestamp, is_directory boolean, ord int")
    (r,) = C.listed_changes(rows).collect()
    assert (r.file, r.status, r.additions, r.deletions, r.diff) == ("a", "added", 0, 0, "")
    assert C.listed_changes(rows.drop("is_directory")).count() == 2


@pytest.fixture(scope="module")
def changed(spark):
    rows = [("a.py", "modified", 5, 2, "@@\n+x", None, 1, True), ("b.txt", "added", 3, 0, "+q", None, 2, False), ("c.py", "deleted", 0, 9, "-z", None, 3, True)]
    return spark.createDataFrame(rows, "file string, status string, additions int, deletions int, diff string, old_file string, ord int, is_staged boolean"), spark.createDataFrame([("b.txt", "q & r")], "file string, content string")


def test_metadata_in_extracts(changed):
    about = Metadata("2024-01-01T00:00:00Z", "code", "main", "abc1234", "staged")
    data = json.loads(combine.extract(*changed, ExtractOptions(format="json"), about).first().document)
    assert data["metadata"] == {"generated": "2024-01-01T00:00:00Z", "repository": {"name": "code", "branch": "main", "commit": "abc1234"}, "extraction": {"method": "staged"}, "tokens": {"estimated": 4}, "tool": {"name": "lodestone", "version": "0.2.0"}}
    assert list(data) == ["scope", "changes", "metadata"] and data["changes"][1]["fullContent"] == "q & r"
    assert "metadata" not in json.loads(combine.extract(*changed, ExtractOptions(format="json", no_metadata=True), about).first().document)
    md = combine.extract(*changed, ExtractOptions(format="md"), about).first().document
    assert "- **Extraction Method:** staged\n- **Estimated Tokens:** ~4\n- **lodestone Version:** 0.2.0\n\n## Scope" in md and "Filters" not in md


def test_selection_and_order(changed):
    files = lambda **o: [c["file"] for c in json.loads(combine.extract(*changed, ExtractOptions(format="json", **o)).first().document)["changes"]]
    assert files() == ["a.py", "b.txt", "c.py"] and files(filter_by="staged") == ["a.py", "c.py"] and files(filter_by="added") == ["b.txt"]
    assert files(sort_by="name", sort_order="desc") == ["c.py", "b.txt", "a.py"] and files(sort_by="status") == ["b.txt", "c.py", "a.py"]
    assert files(selected_files=["c.py", "x"]) == ["c.py"] and files(selected_files=["c.py", "a.py"], sort_by="status") == ["c.py", "a.py"]
    for wrong in ({"sort_by": "age"}, {"sort_order": "up"}, {"filter_by": "new"}):
        with pytest.raises(ValueError, match="unknown"):
            ExtractOptions(**wrong)


def test_places(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), F.col("id").alias("ord")).repartition(7)
    rows = S.places(df, [F.col("k").desc(), F.col("ord")]).collect()
    assert [r.ord for r in sorted(rows, key=lambda r: r.place)] == [r.ord for r in sorted(rows, key=lambda r: (-r.k, r.ord))] and sorted(r.place for r in rows) == list(range(1, 1001))
    assert S.places(df.limit(0), [F.col("k")]).count() == 0
    same = S.places(df.withColumn("k", F.lit(1)), [F.col("k")]).collect()
    assert sorted(r.place for r in same) == list(range(1, 1001))


def test_formats(spark):
    formats = render.Formats("txt")
    with pytest.raises(ValueError, match="not registered"):
        formats.default()
    formats.register("txt", len)
    formats.register("csv", max)
    formats.set_default("csv")
    assert formats.names() == ["txt", "csv"] and formats.get("xml") is None and formats.default() is max and formats.get("txt") is len
    with pytest.raises(ValueError, match="'xml' is not"):
        formats.set_default("xml")
    assert distill.FORMATS.names() == ["txt", "md", "json"]
    files = spark.createDataFrame([("src/a.py", "def a(): pass\n")], "file string, content string")
    distill.FORMATS.register("json", lambda f, p, o: p.agg(F.count("*").cast("string").alias("document")))
    try:
        assert distill.distill(files, DistillOptions(format="json")).first().document == "1"
    finally:
        distill.FORMATS.register("json", lambda f, p, o: render.distill_json(p, distill.metrics(f, p), o.private, o.docstrings))


def test_compressed_and_combined(spark):
    files = spark.createDataFrame([("src/a.py", "def a(): pass\n", 1), ("b.bin", "x" * 1200, 2)], "file string, content string, ord int")
    small = distill.compress(files).join(files.select("file", "ord"), "file")
    md = render.compression_md(small).first().document
    assert md.startswith("# Compressed Files\n\n**Total Files:** 2\n**Total Size:** 1,214 bytes\n\n## src/a.py\n\n```python\ndef a(): pass\n\n```\n\n## b.bin\n\n```txt\n") and md.endswith("x\n```")
    assert "Total" not in render.compression_md(small, metadata=False).first().document
    data = json.loads(render.compression_json(small).first().document)
    assert [f["path"] for f in data["files"]] == ["src/a.py", "b.bin"] and data["metadata"] == {"totalFiles": 2, "totalSize": 1214} and len(data["files"][0]["hash"]) == 8
    assert list(json.loads(render.compression_json(small, metadata=False).first().document)) == ["files"]
    parsed = distill.parse(files)
    both = json.loads(render.combined_json(small, parsed, distill.metrics(files, parsed)).first().document)
    assert list(both) == ["compression", "distillation"] and both["distillation"]["metadata"]["fileCount"] == 1
    assert "\n\n---\n\n## src/a.py" in render.combined_md(small, parsed).first().document
    nothing = small.limit(0)
    assert render.compression_md(nothing).first().document == "# Compressed Files\n\n**Total Files:** 0\n**Total Size:** 0 bytes"


def test_metrics_parse_once(spark):
    files = spark.createDataFrame([("src/a.py", "def a(): pass\n"), ("b.py", ""), ("c.ts", "export const x = 1;")], "file string, content string")
    m = distill.metrics(files, distill.parse(files))
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    r = m.first()
    assert r.file_count == 3 and r.directories == ["src"] and r.languages == {"python": 2, "typescript": 1} and r.original_tokens == 4 + 0 + 5


def test_trees_by_group(spark):
    files = spark.createDataFrame([(f"p{k % 2}/a{k}.py", f"def f{k}(): pass\nclass C{k}: pass\n") for k in range(4)], "file string, content string")
    symbols = distill.symbols(distill.parse(files)).withColumn("p", F.substring_index("file", "/", 1))
    flat = {r.p: r.document for r in tree.tree_flat(symbols, by=["p"]).collect()}
    assert flat["p1"] == "All APIs\n├── f1 p1/a1.py\n├── f3 p1/a3.py\n├── C1 p1/a1.py\n└── C3 p1/a3.py"
    typed = {r.p: r.document for r in tree.tree_by_type(symbols, by=["p"]).collect()}
    assert typed["p0"].startswith("APIs by Type\n├── CLASS (2)\n│   ├── C0 p0/a0.py\n│   └── C2 p0/a2.py\n│\n└── FUNCTION (2)\n")
    assert {r.p for r in tree.outline(symbols, by=["p"]).collect()} == {"p0", "p1"}


def test_sniff_is_the_scanner_s(spark):
    samples = [("a.py", b"\0"), ("a", b""), ("a", b"plain"), ("a.bin", b"pl\0in"), ("b", "ä".encode() * 100), ("c", b"abc" + "é".encode()), ("d.TXT", b"\xff"), ("e", b"x" * 2000 + b"\0"), ("f", "aé".encode() * 600), ("g", bytes(range(256)))]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in samples], "name string, data binary")
    got = {(r.name, bytes(r.data)): r.t for r in df.select("*", T.looks_like_text(F.col("name"), F.col("data"), sorted(TEXT_EXTENSIONS)).alias("t")).collect()}
    assert got == {(n, b): is_text(n, b) for n, b in samples}


def test_exact_token_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["", None, "def f(x):\n    return x", "naïve 日本語", "a" * 5000]
    rows = tokens.count_tokens(spark.createDataFrame([(t, 1) for t in texts], "text string, n_tokens int"), "text", path).collect()
    library = Tokenizer.from_file(path)
    assert [r.n_tokens for r in rows] == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert tokens.count("abcde", "/no/such/file") == 2
