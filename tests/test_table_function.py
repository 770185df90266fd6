"""The language modules in SQL, and their start in each worker."""

from __future__ import annotations

import pytest

from lodestone import parsers
from lodestone.parsers import table_function
from lodestone.plans import distill
from lodestone.schemas import DistillOptions

FILES = [("a.py", "import os\ndef f(x): pass\n_y: int = 1\nclass C:\n    def run(self): return 1\n"), ("b/c.ts", "import d from './d';\nexport class K { greet() { return 'hi' } }\nexport const n = 1"), ("none.txt", "x"), ("empty.py", None), (None, "def g(): pass")]


@pytest.fixture(scope="module")
def files(spark):
    df = spark.createDataFrame(FILES, "file string, content string")
    df.createOrReplaceTempView("source_files")
    return df


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("options", [DistillOptions(), DistillOptions(types="written", compat=True)])
def test_lateral_joins_equal_parse_files(spark, files, options):
    table_function.register(spark, "parsed", options)
    known = distill.parse(files.where("file IS NOT NULL"), options)
    got = spark.sql("SELECT f.file, s.* FROM source_files f, LATERAL parsed(f.file, f.content) s WHERE f.file NOT LIKE '%.txt'")
    assert rows(got) == rows(distill.symbols(known)) and got.columns == distill.symbols(known).columns
    got = spark.sql("SELECT f.file, i.* FROM source_files f, LATERAL parsed(f.file, f.content, 'imports') i")
    assert rows(got) == rows(distill.imports(known))
    got = spark.sql("SELECT f.file, i.name, i.reason, i.line FROM source_files f, LATERAL parsed(f.file, f.content, 'skipped') i")
    assert rows(got) == rows(distill.skipped(known))
    assert [r.message for r in spark.sql("SELECT * FROM parsed('none.txt', 'x', 'errors')").collect()] == ["no language for none.txt"]


def test_wrong_arguments_fail_when_the_query_is_analyzed(spark, files):
    table_function.register(spark)
    for call, why in (("parsed('a.py', 'x', 'nothing')", "unknown part"), ("parsed(1, 'x')", "must be a string")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM {call}").schema  # noqa: B018


def test_a_language_starts_once_before_its_first_source(spark):
    started = []
    words = parsers.Language("words", (".words",), lambda s, o: parsers.Parsed(exports=[parsers.Export(w, "const", f"{len(started)} {w}", "public", 1) for w in s.split()]), lambda: started.append(1))
    parsers.register(words)
    try:
        assert not parsers.is_initialized("words")
        parsers.parse_source("x.words", "a b", DistillOptions()), parsers.parse_source("x.words", "c", DistillOptions())
        assert started == [1] and parsers.is_initialized("words")
        parsers.initialize_all()
        assert started == [1] and all(map(parsers.is_initialized, parsers.registered()))
        table_function.register(spark, "parsed_words")
        got = spark.sql("SELECT signature FROM parsed_words('y.words', 'p q')").collect()
        assert [r.signature.split()[1] for r in got] == ["p", "q"]
    finally:
        parsers.unregister("words")
