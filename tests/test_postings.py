"""Lookups by stored postings equal scans, and read only the folders of their keys."""

import random
import re

import pytest

from corpuslens.operators import lookup as L
from corpuslens.operators import postings as P
from corpuslens.operators import search as S
from tests.conftest import rows

TEXTS = {
    "a.rs": "let Alpha = beta;\nfoo(bar)\n", "b.rs": "alpha beta\nx{2}\nfoobar\n", "c.py": "ALPHA\n\n[abc] a.c\n", "d": "", "e.go": "Ärger über\nBÄR bär 日本語テキスト\n",
    "f": "tail without newline abcabc", "g": "a\\b \"q\" 'r' a|b (c)\n",
}


@pytest.fixture(scope="module")
def stored(spark, tree, tmp_path_factory):
    files = tree(TEXTS)
    words, grams = (str(tmp_path_factory.mktemp("postings") / n) for n in ("words", "grams"))
    P.write_postings(P.word_postings(L.identifiers(L.lines(files))), words, 8)
    P.write_postings(P.gram_postings(files), grams, 8)
    return files, words, grams


def test_words_read_one_folder(spark, stored):
    files, words, _ = stored
    index = L.identifiers(L.lines(files))
    for word in ("alpha", "Alpha", "ALPHA", "bär", "BÄR", "none", "foo"):
        for fold in (False, True):
            assert rows(P.word_hits(spark, words, word, fold)) == rows(L.word_hits(index, word, fold)), word
    read = P.read_postings(spark, words, ["alpha"])
    plan = read._jdf.queryExecution().executedPlan().toString()
    every = {f.rsplit("/", 2)[1] for f in spark.read.parquet(words).inputFiles()}
    used = {r[0].rsplit("/", 2)[1] for r in read.selectExpr("input_file_name()").distinct().collect()}
    assert len(every) > 1 and len(used) == 1 and re.search(r"PartitionFilters: \[.*slot", plan)


@pytest.mark.parametrize("pattern, grams", [
    ("License", {"lic", "ice", "cen", "ens", "nse"}), ("[Ll]icen[cs]e", {"ice", "cen"}), ("The +[a-z]+", {"the", "he "}), ("(?i)ABCD", {"abc", "bcd"}),
    ("abc?d", None), ("abcd*ef", {"abc"}), ("abc+def", {"abc", "def"}), ("a|bcd", None), ("abc{2}", None), (r"\p{L}abc", {"abc"}), (r"\pLabc", {"abc"}), (r"a\.bc", {"a.b", ".bc"}),
    (r"x41\x41bcd", None), (r"\Qabc\E", None), ("(?s)abc", None), ("(?:abc)?def", {"def"}), ("(a[)]b)cde", {"cde"}), ("[]abc]def", {"def"}), ("[^]abc]def", {"def"}), ("[a[bcd]e]fgh", {"fgh"}), ("ab", None), ("", None),
    (r"\babc\b", {"abc"}), ("^abc$", {"abc"}), ("abc+?", {"abc"}), ("(?i)(?x)a b c", None), ("(?<=abc)def", None), (r"(\()abc", {"abc"}),
])
def test_required_grams(pattern, grams):
    assert P.required_grams(pattern) == grams


def test_indexed_search_equals_the_scan(stored):
    files, _, grams = stored
    rng = random.Random(8)
    pieces = ["abc", "alpha", "A", "b", "r", "foo", ".", "[a-f]", "(b|c)", "(?:lp)", r"\w", r"\s", r"\(", r"\.", "ä", "本語", "?", "*", "+", "{2}", "{0,2}", "^", "$", " "]
    patterns = ["alpha", "foobar", r"foo\(bar\)", "Alpha", "abcabc", "日本語", r"a\\b", "a\\|b", "x{2}", r"x\{2\}", "nothing here"]
    while len(patterns) < 30:
        p = "".join(rng.choices(pieces, k=rng.randrange(1, 6)))
        try:
            re.compile(p)
        except re.error:
            continue
        if not re.search(r"(^|[(^$?*+}])[?*+{]", p):
            patterns.append(p)
    for p in patterns:
        for fold in (False, True):
            assert rows(P.search_indexed(files, grams, p, 0, fold)) == rows(S.search(files, p, 0, fold)), p


def test_texts_are_worked_through_once(spark, stored, tmp_path):
    """Dealing rows by ranges took a sample of them first, so each text was worked through twice."""
    files, words, _ = stored
    seen = spark.sparkContext.accumulator(0)
    index = L.identifiers(L.lines(files))

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    P.write_postings(P.word_postings(index.mapInPandas(count, index.schema)), str(tmp_path / "once"), 8)
    assert seen.value == index.count()
    assert rows(P.read_postings(spark, str(tmp_path / "once"), ["alpha", "foo"])) == rows(P.read_postings(spark, words, ["alpha", "foo"]))
