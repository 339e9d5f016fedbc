import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from corpuslens.session import tune

    work = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("corpuslens-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.local.dir", work)
        .config("spark.checkpoint.dir", work + "/checkpoint")
        .config("spark.sql.warehouse.dir", work + "/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def make(spark):
    """make("a string, b int", [rows]) -> DataFrame"""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def tree(spark):
    """tree({path: text}) -> files DataFrame of one root."""
    from pyspark.sql import functions as F

    from corpuslens.functions.paths import index_language

    def build(contents, root="/r"):
        rows = [(root, path, text) for path, text in contents.items()]
        df = spark.createDataFrame(rows, "root_path string, file_path string, content string")
        return df.select(
            "root_path", "file_path", index_language(F.col("file_path")).alias("language"),
            F.lit(1).cast("long").alias("mtime_ns"),
            F.octet_length("content").cast("long").alias("size_bytes"), "content",
            F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"),
        )

    return build


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
