from lodestone.streaming import parse_stream


def test_symbols_of_arriving_files(spark, tmp_path):
    rows = [("a.py", "def f(x): pass\n"), ("b.ts", "export const N = 1;")]
    spark.createDataFrame(rows, "file string, content string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("file string, content string").parquet(f"{tmp_path}/in")
    query = parse_stream(stream).writeStream.format("memory").queryName("symbols").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.signature for r in spark.sql("select signature from symbols").collect()) == ["const N: 1 = 1", "def f(x)"]
