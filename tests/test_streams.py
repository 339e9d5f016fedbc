from corpuslens.operators import extract as X
from corpuslens.operators import lookup as L
from corpuslens.streaming import streams as ST
from tests.conftest import rows

SCHEMA = "root_path string, file_path string, content string, mtime_ns long"


def test_index_follows_arrivals(spark, make, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    extract = lambda files: X.fallback_outline(L.lines(files))

    def arrive(*files):
        make(SCHEMA, [("r", *f, n) for n, f in enumerate(files)]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        ST.start_index(stream, extract, out, check).awaitTermination()
        return rows(ST.current(spark, out), "file_path", "name")

    assert arrive(("a", "def one\n"), ("b", "def two\n")) == [("a", "one"), ("b", "two")]
    assert arrive(("a", "def three\ndef four\n")) == [("a", "four"), ("a", "three"), ("b", "two")]
    # A file that lost all its symbols has no rows left.
    assert arrive(("b", "nothing\n")) == [("a", "four"), ("a", "three")]
    # Of two versions in one batch the newer counts, whichever has the greater hash.
    assert arrive(("b", "def x\n"), ("b", "def y\n")) == [("a", "four"), ("a", "three"), ("b", "y")]
    assert arrive(("b", "def y\n"), ("b", "def x\n")) == [("a", "four"), ("a", "three"), ("b", "x")]


def test_last_activity_updates(spark, make, tmp_path):
    source = str(tmp_path / "in")
    schema = "package_id string, created_at timestamp"
    for values in ([("p", "2024-01-01"), ("q", "2024-01-05")], [("p", "2024-01-03")]):
        make("package_id string, d string", values).selectExpr("package_id", "cast(d as timestamp) created_at").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = ST.drain(ST.last_activity(stream), "update", ["package_id"])
    assert rows(out.selectExpr("package_id", "date_format(last_activity, 'dd') d")) == [("p", "03"), ("q", "05")]


def test_tables_that_are_folders_stream_too(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    part = next(p for p in (tmp_path / "many.parquet").glob("part-*.parquet"))
    (tmp_path / "one.parquet").write_bytes(part.read_bytes())
    n = spark.read.parquet(str(tmp_path / "one.parquet")).count()
    for name, want in (("many", 10), ("one", n)):
        assert ST.drain(ST.parquet_stream(spark, str(tmp_path), name), "append").count() == want
