"""A folder as a stream: a changed file's symbols replace those it had."""

from __future__ import annotations

import os
from collections import Counter

from lodestone.plans import distill
from lodestone.sources.watch import FolderStreamReader
from lodestone.streaming import folder, symbol_changes


def put(root, name, text, at):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, ns=(at * 10**9, at * 10**9))


def test_changes_of_a_folder(spark, tmp_path):
    root = tmp_path / "code"
    put(root, "a.py", "def f(x): pass\nLIMIT = 1\n", 1000)
    put(root, "b/c.ts", "export class K { m() { return 1 } }\n", 1001)
    put(root, "b/note.txt", "no code", 1002)
    stream = folder(spark, str(root)).where("file NOT LIKE '%.txt'")
    query = symbol_changes(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "state")).start()

    def now() -> list[tuple]:
        query.processAllAvailable()
        return sorted((r.change, r.file, r.signature) for r in spark.sql("SELECT * FROM changes").collect())

    def standing() -> Counter:
        """What the changes add up to."""
        total = Counter()
        for r in spark.sql("SELECT * FROM changes").collect():
            total[r.file, r.ord, r.signature, tuple(r.members)] += 1 if r.change == "+" else -1
        assert min(total.values(), default=0) >= 0
        return +total

    def whole() -> Counter:
        files = distill.corpus(spark, str(root)).select("file", "content")
        return Counter((r.file, r.ord, r.signature, tuple(m.signature for m in r.members)) for r in distill.symbols(distill.parse(files)).collect())

    try:
        first = now()
        assert first == [("+", "a.py", "LIMIT = 1"), ("+", "a.py", "def f(x)"), ("+", "b/c.ts", "class K")] and standing() == whole()
        assert now() == first
        put(root, "a.py", "def f(x, y): pass\nLIMIT = 1\n", 1003)
        put(root, "d.py", "def new(): pass\n", 1004)
        second = now()
        assert [x for x in second if x not in first] == [("+", "a.py", "def f(x, y)"), ("+", "d.py", "def new()"), ("-", "a.py", "def f(x)")] and standing() == whole()
        put(root, "b/c.ts", "", 1005)
        put(root, "d.py", "def new(): pass\n", 1006)  # written again, with nothing new
        assert [x for x in now() if x not in second] == [("-", "b/c.ts", "class K")] and standing() == whole()
    finally:
        query.stop()


def test_offsets(tmp_path):
    put(tmp_path, "a.py", "1", 1000)
    put(tmp_path, "b.py", "22", 2000)
    reader = FolderStreamReader({"path": str(tmp_path), "files_per_partition": "1"})
    assert reader.initialOffset() == {"at": -1}
    end = reader.latestOffset()
    assert end == {"at": 2000 * 10**9} and reader.latestOffset() == end
    parts = reader.partitions({"at": -1}, end)
    assert [[r[1] for r in reader.read(p)] for p in parts] == [["a.py"], ["b.py"]]
    put(tmp_path, "a.py", "1 again", 3000)
    later = reader.latestOffset()
    assert [r[4] for p in reader.partitions(end, later) for r in reader.read(p)] == ["1 again"]
    assert [r[1] for p in reader.partitions({"at": -1}, end) for r in reader.read(p)] == ["b.py"]  # a run again, after the change
    slow = FolderStreamReader({"path": str(tmp_path), "settle_ms": str(10**13)})
    assert slow.latestOffset() == {"at": -1} and slow.partitions({"at": -1}, {"at": -1}) == []
