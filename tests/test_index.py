import os
import time

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import snapshot as S
from corpuslens.plans.index import build_index, table_reader
from corpuslens.sources import corpus as C
from corpuslens.sources import index_store as IS
from corpuslens.sources.index_store import read_relation
from tests.conftest import rows


@pytest.fixture
def repo(tmp_path):
    def put(path, text, mode="w"):
        full = tmp_path / "repo" / path
        full.parent.mkdir(parents=True, exist_ok=True)
        with open(full, mode) as f:
            f.write(text)
        return full

    put.root = str(tmp_path / "repo")
    put.index = str(tmp_path / "index")
    return put


def test_diff_classes(make):
    schema = "root_path string, file_path string, mtime_ns long, size_bytes long, content_hash string"
    disk = make(schema, [("r", "new", 1, 1, "a"), ("r", "same", 1, 1, "other"), ("r", "touched", 2, 1, "a"), ("r", "edited", 2, 1, "b")])
    index = make(schema, [("r", "same", 1, 1, "a"), ("r", "touched", 1, 1, "a"), ("r", "edited", 1, 1, "a"), ("r", "old", 1, 1, "a"), ("q", "new", 1, 1, "a")])
    diff = S.diff_snapshots(disk, index)
    assert rows(diff, "root_path", "file_path", "status") == [
        ("q", "new", "removed"), ("r", "edited", "changed"), ("r", "new", "missing"), ("r", "old", "removed"),
        ("r", "same", "current"), ("r", "touched", "touched"),
    ]
    # The same with hashes of only what moved.
    assert rows(S.moved(disk, index), "file_path") == [("edited",), ("new",), ("touched",)]
    hashes = S.moved(disk, index).select("root_path", "file_path", "content_hash")
    assert rows(S.diff_snapshots(disk.drop("content_hash"), index, hashes)) == rows(diff)


def test_scan_rules(spark, repo):
    repo("src/a.rs", "fn a() {}\n")
    repo("src/.secret/b.rs", "fn b() {}\n")
    repo("notes.txt", "x")
    repo("big.py", "#" * 200)
    repo("bad.py", b"\xff\xfe\x00", "wb")
    repo("target/out.rs", "fn o() {}\n")
    repo("keep/target.rs", "fn k() {}\n")
    repo("logs/a.py", "x = 1\n")
    repo("logs/keep.py", "x = 1\n")
    repo("pkg/__init__.py", "")
    os.symlink(os.path.join(repo.root, "src/a.rs"), os.path.join(repo.root, "link.rs"))
    files = C.scan_files(spark, repo.root)
    assert rows(files, "file_path") == [(p,) for p in sorted(["src/a.rs", "notes.txt", "big.py", "bad.py", "target/out.rs", "keep/target.rs", "logs/a.py", "logs/keep.py", "pkg/__init__.py"])]
    known = C.indexable(files, max_bytes=100)
    assert ("big.py",) not in rows(known, "file_path") and ("notes.txt",) not in rows(known, "file_path")
    good, skipped = C.decoded(known)
    assert rows(skipped, "file_path") == [("bad.py",)] and ("bad.py",) not in rows(good, "file_path")

    rules = C.ignore_rules(spark.createDataFrame(
        [(repo.root, ".gitignore", "# comment\n/target/\n*.txt\nlogs/*.py\n!logs/keep.py\n"), (repo.root, "src/.gitignore", "a.*\n")],
        "root_path string, file_path string, content string",
    ))
    assert rows(C.apply_ignore(files, rules), "file_path") == [("bad.py",), ("big.py",), ("keep/target.rs",), ("logs/keep.py",), ("pkg/__init__.py",)]
    repo(".gitignore", "/target/\n*.txt\nlogs/\n!logs/keep.py\n")
    repo("src/.ignore", "*.rs\n")
    roots = spark.createDataFrame([(repo.root, repo.root)], "root_path string, location string")
    assert rows(C.list_visible(roots), "file_path") == [("bad.py",), ("big.py",), ("keep/target.rs",), ("pkg/__init__.py",)]
    # What is below an ignored folder cannot be taken back.
    rules = C.ignore_rules(spark.createDataFrame([(repo.root, ".gitignore", "logs/\n!logs/keep.py\n")], "root_path string, file_path string, content string"))
    assert ("logs/keep.py",) not in rows(C.apply_ignore(files, rules), "file_path")


def test_incremental_equals_full(spark, repo, tmp_path):
    repo("Cargo.toml", "")
    repo("src/lib.rs", "use crate::util::helper;\nuse crate::later::thing;\npub fn one() { helper(); }\n")
    repo("src/util.rs", "pub fn helper() {}\n")
    repo("src/old.rs", "fn old() {}\n")
    repo("py/a.py", "from .b import x\ndef f():\n    return x()\n")
    repo("py/b.py", "def x():\n    pass\n")

    def run(index=repo.index):
        roots = spark.createDataFrame([("root", repo.root)], "root_path string, location string")
        return build_index(spark, C.list_trees(roots), index, now=F.lit("2024-01-01").cast("timestamp")).first()

    stats = run()
    assert (stats.files_indexed, stats.files_current, stats.symbols, stats.imports) == (5, 0, 5, 3)
    dep = lambda: rows(read_relation(spark, repo.index, "deps"), "importer_file", "raw_target", "importee_file")
    assert dep() == [
        ("py/a.py", "from .b import x", "py/b.py"), ("src/lib.rs", "crate::later::thing", None),
        ("src/lib.rs", "crate::util::helper", "src/util.rs"),
    ]
    again = run()
    assert (again.files_indexed, again.files_current, again.symbols) == (0, 5, 0)

    os.utime(repo("src/util.rs", "pub fn helper() {}\npub fn two() {}\n"), (time.time() + 5,) * 2)
    os.remove(os.path.join(repo.root, "src/old.rs"))
    repo("src/later.rs", "pub fn thing() {}\n")
    os.remove(os.path.join(repo.root, "py/b.py"))
    stats = run()
    assert (stats.files_indexed, stats.files_removed, stats.files_current) == (2, 2, 2)
    assert ("src/lib.rs", "crate::later::thing", "src/later.rs") in dep()
    assert ("py/a.py", "from .b import x", None) in dep()

    full = str(tmp_path / "full")
    run(full)
    for name in ("files", "symbols", "imports", "identifiers", "deps", "callsites"):
        assert rows(read_relation(spark, repo.index, name)) == rows(read_relation(spark, full, name)), name


def test_many_files(spark, tmp_path):
    files = spark.range(417).select(
        F.lit("r").alias("root_path"), F.concat(F.lit("src/f"), F.col("id"), F.lit(".rs")).alias("file_path"),
        F.lit(1).cast("long").alias("mtime_ns"),
        F.concat(F.lit("fn a"), F.col("id"), F.lit("() {}\nfn b"), F.col("id"), F.lit("() {}\n")).cast("binary").alias("content"),
    ).withColumn("size_bytes", F.octet_length("content").cast("long"))
    index = str(tmp_path / "index")
    run = lambda files, **kw: build_index(spark, files.drop("content"), index, table_reader(files), **kw).first()
    stats = run(files)
    assert (stats.files_indexed, stats.symbols) == (417, 834)
    assert run(files).files_indexed == 0
    only = spark.createDataFrame([("r", "src/f1.rs")], "root_path string, file_path string")
    touched = files.withColumn("mtime_ns", F.lit(2).cast("long")).withColumn("content", F.lit(b"fn z() {}\n"))
    stats = run(touched, only=only)
    assert (stats.files_indexed, stats.files_removed) == (1, 0)
    assert read_relation(spark, index, "symbols").count() == 833


def relations(spark, names, tag=""):
    """Small relations of the files ``names`` of one root, as {relation: rows}."""
    owner = {"deps": "importer_file", "callsites": "caller_file"}
    out = {}
    for name, schema in IS.SCHEMAS.items():
        filled = {owner.get(name, "file_path"): None, "root_path": "r", IS.SORT[name]: f"x{tag}"}
        made = [tuple(n if f == owner.get(name, "file_path") else filled.get(f) for f in schema.names) for n in names]
        out[name] = spark.createDataFrame(made, schema)
    return out


def replace(spark, index, names, gone, tag="", buckets=2):
    keys = spark.createDataFrame([("r", n) for n in gone], "root_path string, file_path string")
    IS.replace_files(spark, index, {n: (df, keys) for n, df in relations(spark, names, tag).items()}, buckets)


def state(spark, index):
    return {name: rows(read_relation(spark, index, name)) for name in IS.SCHEMAS}


def test_a_failed_run_changes_nothing(spark, tmp_path, monkeypatch):
    """Killed before, between and after the relations, leaves the old index; the next one does its work."""
    index, fresh = str(tmp_path / "index"), str(tmp_path / "fresh")
    replace(spark, index, "abcd", "abcd")
    before = state(spark, index)
    assert all(len(v) == 4 for v in before.values())
    real, switch = IS.write_relation, IS._switch
    for step in (1, 4, 7):
        calls = []

        def dying(*args):
            calls.append(args[-1])  # noqa: B023
            if len(calls) == step:  # noqa: B023
                raise RuntimeError("killed")
            real(*args)

        monkeypatch.setattr(IS, "write_relation", dying)
        monkeypatch.setattr(IS, "_switch", (lambda *args, d=dying: d(None)) if step == 7 else switch)
        with pytest.raises(RuntimeError, match="killed"):
            replace(spark, index, "ae", "abe", "2")
        assert len(calls) == step and state(spark, index) == before
        monkeypatch.undo()
    replace(spark, index, "ae", "abe", "2")
    replace(spark, fresh, "cd", "cd")
    replace(spark, fresh, "ae", "ae", "2")
    assert state(spark, index) == state(spark, fresh) != before


def test_readers_keep_their_state_and_compaction_keeps_rows(spark, tmp_path):
    index = str(tmp_path / "index")
    IS.compact(spark, index)
    replace(spark, index, "abcd", "abcd", "1")
    early = read_relation(spark, index, "files")
    replace(spark, index, "ab", "abcd", "2")
    assert rows(early, "file_path") == [(n,) for n in "abcd"]
    assert rows(read_relation(spark, index, "symbols", "r"), "file_path", "name") == [("a", "x2"), ("b", "x2")]
    assert rows(read_relation(spark, index, "symbols", "q")) == []
    was = state(spark, index)
    IS.compact(spark, index)
    assert state(spark, index) == was
    runs = spark.read.parquet(f"{index}/runs").groupBy("root_path", "bucket").agg(F.max("run").alias("run"))
    assert {r.run[:10] for r in runs.collect()} == {"0000000003"}
    # All files gone: the buckets are named again without rows.
    replace(spark, index, "", "ab")
    assert all(not v for v in state(spark, index).values())


def test_bucket_count_is_stored(spark, tmp_path, monkeypatch):
    index = str(tmp_path / "index")
    listing = spark.createDataFrame([("r", "a", 50), ("r", "b", 50), ("q", "a", 9)], "root_path string, file_path string, size_bytes long")
    monkeypatch.setattr(IS, "BUCKET_BYTES", 40)
    assert IS.bucket_count(spark, index, listing) == 3
    replace(spark, index, "abcd", "abcd", buckets=3)
    monkeypatch.undo()
    assert IS.bucket_count(spark, index, listing) == 3 and IS.bucket_count(spark, index + "2", listing) == 1
