"""Documents over many tasks, and the sink that they are written by."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lodestone.plans import distill, parts, render, tree
from lodestone.sources.document import DocumentSource, DocumentWriter


def blocks(spark, n):
    rows = [((k * 7919) % n, f"block {k} é\nof two lines" if k % 5 else "") for k in range(n)] + [(n + 5, None)]
    return spark.createDataFrame(rows, "ord long, block string").repartition(5)


def joined(pieces):
    data, at = b"", 0
    for r in sorted(pieces.collect(), key=lambda r: r.offset):
        assert r.offset == at, "a gap or an overlap"
        data, at = data + r.text.encode(), at + len(r.text.encode())
    return data.decode()


@pytest.mark.parametrize("n", [1, 3, 400])
@pytest.mark.parametrize("size", [1, 200, 1 << 20])
def test_pieces_are_the_document(spark, n, size):
    b = blocks(spark, n)
    assert joined(parts.pieces(b, size=size)) == render.document(b).first().document
    assert joined(parts.pieces(b, "<héad>\n", "</foot>", size=size)) == render.framed("<héad>\n", b, "</foot>").first().document


def test_pieces_of_nothing(spark):
    none = blocks(spark, 1).where("false")
    assert parts.pieces(none).collect() == [] and parts.numbered(none).collect() == []
    assert joined(parts.pieces(none, "a", "b")) == "ab"


def test_numbers(spark):
    got = parts.numbered(blocks(spark, 400)).orderBy("place").collect()
    want = [r.block for r in blocks(spark, 400).where("block IS NOT NULL").orderBy("ord").collect()]
    assert [r.place for r in got] == list(range(400)) and [r.block for r in got] == want


FILES = [("src/a.py", "def f(x): pass\nclass C:\n    \"\"\"Doc.\"\"\"\n"), ("src/b/c.py", "LIMIT = 1\n"), ("top.py", "def g(): pass\n"), ("src/b/d.ts", "export const a = 1"), ("zz/empty.py", "")]


def test_tree_over_many_tasks(spark, tmp_path):
    symbols = distill.symbols(distill.parse(spark.createDataFrame(FILES, "file string, content string")))
    whole = tree.tree_by_file(symbols, "root").first().document
    path = tree.write_tree(symbols, str(tmp_path / "tree.txt"), "root")
    assert open(path, encoding="utf-8").read() == whole
    lines = parts.numbered(tree.tree_lines(symbols)).orderBy("place").collect()
    assert "\n".join(["root", *(r.block for r in lines)]) == whole


def test_no_task_has_the_whole_tree(spark):
    symbols = distill.symbols(distill.parse(spark.createDataFrame(FILES, "file string, content string")))
    plan = tree.tree_lines(symbols)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [collect" not in plan and "Aggregate [array" not in plan


def test_write(spark, tmp_path):
    path = str(tmp_path / "out.txt")
    b = blocks(spark, 300)
    parts.write(parts.pieces(b, "head\n", "foot", size=100), path)
    assert open(path, encoding="utf-8").read() == render.framed("head\n", b, "foot").first().document
    parts.write(parts.pieces(b.where("false")), path)
    assert open(path).read() == "" and os.listdir(tmp_path) == ["out.txt"]


def test_a_task_that_fails_leaves_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out.txt")
    with open(path, "w") as f:
        f.write("before")
    bad = parts.pieces(blocks(spark, 300), size=100).withColumn("text", F.when(F.col("offset") > 2000, F.raise_error(F.lit("killed"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        parts.write(bad, path)
    with pytest.raises(Exception, match="do not fill"):
        parts.write(parts.pieces(blocks(spark, 300), size=100).where("offset <> 0"), path)
    spark.dataSource.register(DocumentSource)
    with pytest.raises(Exception, match="exists"):
        parts.pieces(blocks(spark, 3)).write.format("document").mode("append").save(path)
    assert open(path).read() == "before" and os.listdir(tmp_path) == ["out.txt"]


def test_a_task_that_runs_again_writes_the_same(tmp_path):
    w = DocumentWriter(str(tmp_path / "x"), True)
    first = w.write(iter([(0, "ab"), (2, "é")]))
    with pytest.raises(RuntimeError):
        w.write(x for k in range(2) for x in ([(4, "c")] if k == 0 else [(_ for _ in ()).throw(RuntimeError())]))
    assert not (tmp_path / "x").exists()
    w.commit([first, None, w.write(iter([(4, "cd")]))])
    assert (tmp_path / "x").read_text() == "abécd" and os.listdir(tmp_path) == ["x"]
