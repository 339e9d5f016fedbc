import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import outcome as O
from corpuslens.functions import paths as P
from corpuslens.functions import text as T


@pytest.fixture
def each(spark):
    """each(column function, values) -> results in order"""

    def run(fn, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]

    return run


def test_lines(each):
    assert each(T.split_lines, ["", "a\n", "a\n\n", "a\r\nb", "a\r", "\n", "a\n\nb"]) == [
        [], ["a"], ["a", ""], ["a", "b"], ["a\r"], [""], ["a", "", "b"],
    ]
    assert each(T.line_count, ["", "a", "a\nb\n"]) == [0, 1, 2]


def test_identifiers(each):
    assert each(T.line_tokens, ["a ab é 12 a1 _x ab x-y"]) == [["ab", "é", "a1", "_x"]]
    assert each(T.fold_ascii, ["ÀBc"]) == ["Àbc"]


def test_shorten(each):
    assert each(T.display, ["x" * 80, "𝄞" * 90]) == ["x" * 80, "𝄞" * 77 + "..."]
    assert each(T.signature, ["  " + "y" * 201 + " "]) == ["y" * 197 + "..."]


def test_sanitize(each):
    fence = "```"
    cases = {
        f"\n{fence}md\nHello\n{fence}\n": "Hello",
        f"{fence}\n{fence}": "",
        f"text\n{fence}\ncode\n{fence}\nmore": f"text\n{fence}\ncode\n{fence}\nmore",
        f"{fence}a{fence}": f"{fence}a{fence}",
        "a\n\n\n\nb": "a\n\nb",
        "a\n \n\t\n  b": "a\n\n  b",
        "a\r\n\r\n\r\nb": "a\n\nb",
        " a ": "a",
        "": "",
    }
    assert each(T.sanitize_map, list(cases)) == list(cases.values())


def test_cap(each):
    short, long, wide = "x" * 3000, "x" * 4000, "é" * 2000
    a, b, c = each(T.cap_bytes, [short, long, wide])
    assert a == short
    for out in (b, c):
        assert len(out.encode()) <= 3000 and out.endswith("truncated at 3000 bytes]") and "�" not in out
    assert each(lambda v: T.cap_bytes(v, 4, ""), ["aéé", "��"]) == ["aé", "�"]


def test_languages(each):
    paths = ["a.rs", "a.PY", "a.tsx", "x.h", "x.jsx", "x.pyi", "x.hpp", "Makefile", ".rs", "a/.go", "a.b/c", "x.weird"]
    assert each(P.index_language, paths) == ["rust", "python", "tsx", "c", "javascript", "python", "cpp", None, None, None, None, None]
    assert each(P.tree_language, paths) == ["rust", "python", "tsx", "c-header", "jsx", None, "cpp-header", None, None, None, None, None]


def test_paths(each):
    assert each(P.normalize, ["a/./b", "a/../b", "../x", "a/b/../../..", "a//b", "a/b", "..x/y"]) == ["a/b", "b", "../x", "..", "a/b", "a/b", "..x/y"]
    assert each(P.parent_dir, ["a/b/c", "a", ""]) == ["a/b", "", ""]
    assert each(P.ancestors, ["/a/b", "a/b", "/"]) == [["/a/b", "/a", "/"], ["a/b", "a"], ["/"]]
    assert each(P.parent_dirs, ["a/b/c", "a"]) == [["a", "a/b"], []]
    assert each(lambda v: P.in_scope(v, F.lit("a/b")), ["a/b", "a/b/c", "a/bc", "a"]) == [True, True, False, False]
    assert each(lambda v: P.relative_to(F.lit("/r/"), v), ["/r/a", "/rx/a"]) == ["a", "/rx/a"]


@pytest.mark.parametrize("glob, yes, no", [
    ("*.rs", ["a.rs", "x/a.rs"], ["a.rsx"]),
    ("src/**", ["src/a", "src/a/b"], ["xsrc/a", "src"]),
    ("src/*.rs", ["src/a.rs"], ["src/b/a.rs"]),
    ("**/t?st/[a-c].py", ["t/test/a.py", "test/b.py"], ["test/d.py"]),
    ("{en,de}/*", ["en/a", "de/b"], ["fr/a"]),
    ("[!a].c", ["b.c"], ["a.c"]),
])
def test_globs(glob, yes, no):
    assert all(re.search(P.glob_regex(glob), p) for p in yes)
    assert not any(re.search(P.glob_regex(glob), p) for p in no)


def test_identifier_problem(each):
    fine = ["@tanstack/example", "a/b/c", "v1.2.3", "a_b-c", "a/...", "..a"]
    assert each(P.identifier_problem, fine) == [None] * len(fine)
    bad = {"": "empty", "a b": "invalid characters", "a\\b": "invalid characters", "/a": "leading slash", "a/": "trailing slash",
           "..": "dot segment", "foo/../bar": "dot segment", "a//b": "empty segment", "./a//b": "dot segment", "a//.": "empty segment"}
    assert each(P.identifier_problem, list(bad)) == list(bad.values())


def test_urls(each):
    good = ["https://h/x", "http://h/x", "git://h/x", "ssh://h/x", "file:///x", "/abs/path", "git@h:x/y"]
    bad = ["", "relative/path", "ftp://h/x", "h:x", "a@b"]
    assert each(P.url_valid, good) == [True] * 7
    assert each(P.url_valid, bad) == [False] * 5
    assert each(P.url_insecure, ["http://h", "https://h"]) == [True, False]


def test_storage_name(each):
    assert each(P.storage_name, ["@tanstack/example", "a/b/c", "v1.2_3-x", "é"]) == ["%40tanstack%2Fexample", "a%2Fb%2Fc", "v1.2_3-x", "%C3%A9"]


def test_freshness_and_outcome(each, spark):
    assert each(O.freshness, [0, 1, 10, 11, None], "int") == ["Fresh", "SlightlyStale", "SlightlyStale", "Unknown", "Unknown"]
    assert each(O.outcome, [0, 1, None], "int") == [0, 3, 2]
    df = spark.createDataFrame([(0, " \n"), (0, "x"), (1, ""), (None, "")], "c int, r string")
    out = df.select(O.recorded_exit(F.col("c"), F.col("r")).alias("e"), O.recorded_response(F.col("c"), F.col("r")).alias("t")).collect()
    assert [r.e for r in out] == [3, 0, 1, None] and out[0].t == O.EMPTY_RESPONSE
    df = spark.createDataFrame([("a", None), (None, "b"), ("a", "b"), (None, None)], "p string, q string")
    out = df.select(O.provenance(F.col("p"), F.col("q")).alias("v"), O.provenance_changed(F.col("p"), F.col("q")).alias("c")).collect()
    assert [(r.v, r.c) for r in out] == [("a", True), ("b", True), ("b", True), (None, False)]


def test_hash_vector(spark):
    assert spark.range(1).select(F.sha2(F.lit(""), 256).alias("h")).first().h == hashlib.sha256(b"").hexdigest()
