import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import lookup as L
from corpuslens.operators import search as S
from corpuslens.skew import byte_budget, ranked, salted_join, top_n
from tests.conftest import rows


def test_words(tree, make):
    files = tree({"a": "foo Foo\nbar foo foo\n", "b": "xfoo\nfoo\n"})
    index = L.identifiers(L.lines(files))
    assert rows(L.word_hits(index, "foo"), "file_path", "line") == [("a", 1), ("a", 2), ("b", 2)]
    assert len(rows(L.word_hits(index, "FOO", ignore_case=True))) == 4
    assert ("foo", 3, 2) in rows(L.word_totals(index)) and rows(L.word_totals(index)) == rows(L.corpus_word_totals(files))
    for word, fold in (("foo", False), ("FOO", True), ("bar", False)):
        assert rows(L.corpus_word_hits(files, word, fold)) == rows(L.word_hits(index, word, fold))
    words = make("word string", [("bar",), ("none",), ("xfoo",)])
    assert rows(L.word_hits_many(index, words), "word", "file_path") == [("bar", "a"), ("xfoo", "b")]


def test_symbol_lookup(make):
    s = make("root_path string, file_path string, name string, kind string, line int",
             [("r", "a", "foo", "function", 1), ("r", "b", "foo", "struct", 2), ("r", "a", "Foo_x", "function", 3), ("r", "a", "À", "function", 4), ("r", "a", "fo%", "type", 5)])
    assert rows(L.symbols_named(s, "foo"), "file_path") == [("a",), ("b",)]
    assert rows(L.symbols_named(s, "FOO", prefix=True, kind="function"), "name") == [("Foo_x",), ("foo",)]
    assert rows(L.symbols_named(s, "à", prefix=True)) == []
    assert rows(L.symbols_named(s, "fo%", prefix=True), "name") == [("fo%",)]
    assert len(rows(L.symbols_named_many(s, make("name string", [("foo",), ("foo",), ("À",)])))) == 3
    counts = L.symbol_counts(make("root_path string, file_path string", [("r", "a"), ("r", "none")]), s)
    assert rows(counts, "file_path", "symbols") == [("a", 4), ("none", 0)]


def test_outline_or_fallback(tree, make):
    files = tree({"known.rs": "fn one() {}\n", "notes": "def two\n", "other.rs": "fn three() {}\n"})
    symbols = make("root_path string, file_path string, name string, kind string, line int", [("/r", "known.rs", "one", "function", 1), ("/r", "gone.rs", "x", "function", 1)])
    imports = make("root_path string, file_path string, target string, line int", [("/r", "known.rs", "a::b", 1)])
    out = L.outline_or_fallback(files, files.where("file_path = 'known.rs'"), symbols, imports)
    assert rows(out, "file_path", "entry", "text") == [
        ("known.rs", "import", "a::b"), ("known.rs", "symbol", "one"), ("notes", "symbol", "two"), ("other.rs", "symbol", "three")]


def test_listings(make):
    d = make("root_path string, importer_file string, importee_file string, raw_target string, line int", [("r", "a", None, "z", 2), ("r", "a", "b", "b", 1), ("q", "a", "b", "b", 1)])
    assert [r.line for r in L.forward_edges(d, "r", "a").collect()] == [1, 2]
    assert [r.root_path for r in L.listing(d, "deps").collect()] == ["q", "r", "r"]
    c = make("root_path string, caller_file string, caller_line int, caller_symbol string, callee_name string, callee_kind string", [("r", "b", 1, None, "f", "call"), ("r", "a", 9, "g", "f", "call"), ("r", "a", 1, "g", "h", "call")])
    assert [r.caller_file for r in L.callsites_of(c, "r", "f").collect()] == ["a", "b"]
    assert L.find(c, "callee_name", "h").count() == 1


def test_read_ranges(tree, make):
    files = tree({"f": "1\n2\n3\n4\n", "empty": ""})
    ask = lambda *r: make("root_path string, file_path string, start int, end int", [("/r", *x) for x in r])
    got = lambda *r: rows(L.read_ranges(files, ask(*r)), "line", "text")
    assert got(("f", 2, 3)) == [(2, "2"), (3, "3")]
    assert got(("f", 3, 1)) == [(3, "3")]
    assert got(("f", 0, 99)) == [(1, "1"), (2, "2"), (3, "3"), (4, "4")]
    assert got(("f", None, None))[-1] == (4, "4")
    assert got(("f", 5, 9)) == [] and got(("empty", 1, 1)) == []


def test_search(tree):
    files = tree({"a.rs": "x\nhit\nhit\ny\nz\nw\n", "b.py": "éab ab\nHIT\n", "c": "one line hit"})
    out = {(r.file_path, r.line): r for r in S.search(files, "hit").collect()}
    assert set(out) == {("a.rs", 2), ("a.rs", 3), ("c", 1)}
    near = lambda r: ([c.line for c in r.before], [c.line for c in r.after])
    assert near(out["a.rs", 2]) == ([1], [4]) and near(out["a.rs", 3]) == ([1], [4, 5]) and near(out["c", 1]) == ([], [])
    assert rows(S.search(files, "ab", 0), "file_path", "line", "column") == [("b.py", 1, 3)]
    assert rows(S.search(files, "hit", 0, ignore_case=True, language="python"), "line") == [(2,)]
    assert rows(S.search(files, "hit", 0, globs=("!*.rs",)), "file_path") == [("c",)]
    assert rows(S.search(files, "^hit$", 0), "line") == [(2,), (3,)]


def test_tree(tree, make):
    files = tree({"src/a.rs": "fn a() {}\n", "src/x/b.jsx": "", "top.h": "1\n2\n"})
    counts = make("root_path string, file_path string, symbols long", [("/r", "src/a.rs", 0)])
    got = {r.path: r for r in L.tree(files, counts).collect()}
    assert set(got) == {"src", "src/a.rs", "src/x", "src/x/b.jsx", "top.h"}
    assert (got["src/a.rs"].symbols, got["top.h"].symbols, got["src"].symbols) == (0, None, None)
    assert (got["top.h"].language, got["src/x/b.jsx"].language, got["top.h"].lines) == ("c-header", "jsx", 2)
    assert rows(L.tree(files, max_depth=1), "path", "is_dir") == [("src", True), ("top.h", False)]
    assert rows(L.directory_totals(files), "path", "files", "lines") == [("", 3, 3), ("src", 2, 1), ("src/x", 1, 0)]


def skewed(spark, n=3000, seed=5):
    rnd = random.Random(seed)
    data = [("hot" if i % 3 else f"k{rnd.randrange(40)}", i, rnd.randrange(50)) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, id int, v int")


def test_top_n_equals_brute_force(spark):
    data, df = skewed(spark)
    out = rows(top_n(df, ["k"], [F.desc("v"), F.asc("id")], 7, ["id"]), "k", "id", "rank")
    want = []
    for k in {d[0] for d in data}:
        best = sorted((d for d in data if d[0] == k), key=lambda d: (-d[2], d[1]))[:7]
        want += [(k, d[1], i + 1) for i, d in enumerate(best)]
    assert sorted(out) == sorted(want)


def test_byte_budget_equals_brute_force(spark):
    data, df = skewed(spark)
    out = rows(byte_budget(df, ["k"], [F.asc("id")], ["id"], 100, size=F.col("v")), "k", "id", "used_bytes", "truncated")
    want = []
    for k in {d[0] for d in data}:
        mine, used = sorted((d for d in data if d[0] == k), key=lambda d: d[1]), 0
        total = sum(d[2] for d in mine)
        for d in mine:
            used += d[2]
            if used > 100:
                break
            want.append((k, d[1], used, total > 100))
    assert sorted(out) == sorted(want)


def test_byte_budget_edges(make):
    df = make("q string, n int", [("a", 1), ("a", 2)])
    size = len('{"q":"a","n":1}')
    cut = lambda b: rows(byte_budget(df, ["q"], [F.asc("n")], ["n"], b), "n", "truncated")
    assert cut(size * 2) == [(1, False), (2, False)] and cut(size * 2 - 1) == [(1, True)] and cut(0) == []


def test_salted_join_equals_join(spark):
    data, df = skewed(spark)
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("none", 4)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(salted_join(df, small, ["k"], how, ["id"])) == rows(df.join(small, ["k"], how)), how


def test_copies_of_the_short_side_are_not_broadcast(spark, tmp_path, capsys):
    spark.range(5_000).write.parquet(str(tmp_path / "small"))
    small = spark.read.parquet(str(tmp_path / "small"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    try:
        for list_, how in ((small, "SortMergeJoin"), (small.limit(9), "BroadcastHashJoin")):
            salted_join(spark.range(10**9).selectExpr("id", "id v"), list_, ["id"], "inner", ["v"]).explain()
            assert how in capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_search_sees_each_line_alone(tree):
    files = tree({"a": "foo\nbar\n", "b": "foobar\n"})
    for pattern in (r"foo\z", r"foo(?!\s)", "^foo$"):
        assert ("a", 1) in rows(S.search(files, pattern), "file_path", "line")


def test_large_files_count(tree):
    files = tree({"big.py": "x = 1\n" * (1 << 20), "a.py": "y = 2\n"})
    assert rows(L.directory_totals(files).where("path = ''"), "files", "lines") == [(2, (1 << 20) + 1)]


@pytest.mark.parametrize("n", [0, 1, 997])
def test_rank_over_all_rows(spark, n):
    df = spark.range(n).select((F.col("id") * 7919 % 1000).alias("v"), F.lit("x").alias("rank0")).repartition(7)
    got = ranked(df, [F.desc("v")])
    assert got.columns == ["v", "rank0", "rank"]
    want = sorted((i * 7919 % 1000 for i in range(n)), reverse=True)
    assert [(r.v, r.rank) for r in sorted(got.collect(), key=lambda r: r["rank"])] == [(v, i + 1) for i, v in enumerate(want)]
    again = ranked(df.withColumn("w", F.lit("same")), ["w", "v"]).collect()
    assert sorted(r["rank"] for r in again) == list(range(1, n + 1))


def test_lines_in_budget_equal_running_sums(tree):
    texts = {"a": "one\ntwo\r\nthree", "b": "", "c": "x" * 30 + "\n" + "y\n" * 50, "d": "late\n"}
    files = tree(texts)
    for budget in (1, 4, 13, 14, 45, 60, 1000):
        want, used = [], 0
        for path in sorted(texts):
            for i, line in enumerate(texts[path].replace("\r\n", "\n").removesuffix("\n").split("\n") if texts[path] else []):
                used += len(line) + 1
                if used <= budget:
                    want.append((path, i + 1, used))
        got = L.lines_in_budget(files, budget)
        assert sorted((r.file_path, r.line, r.used_bytes) for r in got.collect()) == want, budget
        assert all(r.truncated == (used > budget) for r in got.collect())
