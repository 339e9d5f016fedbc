"""Licence scans, fill in the middle and centroid clusters against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import centroids, fim, licences

ODD_TEXTS = [
    None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "\r\n\r\nx", "schön\nein Text\n\n日本語\n😀😀\nend", "has <P> in it\nx\n", "<S>", "tail <M>\n",
    "<\n<P\n<S\n<M\n>", "<P\n>\nS>\n<",
]


# -- licences -------------------------------------------------------------------


def plain_scan(texts, templates, rare=licences.RARE, agree=licences.AGREE, alike=licences.ALIKE):
    lower = str.maketrans(licences._UPPER, licences._UPPER.lower())
    docs = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower)) for t in texts]
    df = {w: sum(w in d for d in docs) for t in templates for w in t.words.split()}
    out = []
    for words in docs:
        found = []
        for t in templates:
            tw = t.words.split()
            posted = sorted(set(tw), key=lambda w: (df[w], w))[: 1 if t.base else rare]
            places = [p for p, w in enumerate(tw) if w in posted]
            for start in range(-len(tw), len(words)):
                at = lambda j: words[start + j] if 0 <= start + j < len(words) else None  # noqa: B023, E731
                if sum(at(p) == tw[p] for p in places) < (1 if t.base else math.ceil(agree * len(places))):
                    continue
                share = sum(at(j) == w for j, w in enumerate(tw)) / len(tw)
                whole = all(at(j) == tw[j] for a, b in licences._spans(t) for j in range(a, b))
                if whole and share >= (1.0 if t.base else alike):
                    found.append((t.label, t.base, start, share))
        base = [f[2] for f in found if f[1]]
        out.append((len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({f[0] for f in found if f[1]})),
                    ",".join(sorted({f[0] for f in found})), max((f[3] for f in found), default=0.0)))
    return out


def test_licences_equal_a_plain_scan(spark):
    rng = random.Random(4)
    notices = [t.words for t in licences.NOTICES]
    filler = "the of a license software cc by public rights all reserved mit granted copy general x1 Ärger".split()
    texts = [None, "", "---", "CC-BY", "cc by", "all rights", "All’ Rights RESERVED", "All Rights-Reserved. all rights reserved", "license", "worK İ cc BY"]
    for n in notices:
        words = n.split()
        texts += [n, n.upper().replace(" ", "\n * "), " ".join(words[2:]), " ".join(words[:-3])]
        for _ in range(3):  # changed words, and words put in
            w = [x if rng.random() > 0.12 else rng.choice(filler) for x in words]
            w.insert(rng.randrange(len(w)), "inserted")
            texts.append(" ".join([*rng.choices(filler, k=rng.randrange(30)), *w, *rng.choices(filler, k=9)]))
    texts += [" ".join(rng.choices(filler, k=200)) for _ in range(40)] + [texts[5]] * 3
    rows = spark.createDataFrame([(k, t, "x", 7) for k, t in enumerate(texts)], "doc_id long, text string, words string, found int").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in licences.summary(licences.scan(rows)).collect()}
    want = dict(enumerate(plain_scan(texts, (*licences.BASE, *licences.NOTICES))))
    assert got == want
    assert {"mit", "gpl-3.0", "bsd", "isc"} <= {x for v in want.values() for x in v[5].split(",")}


def test_licences_of_one_long_text_and_of_none(spark):
    notice = licences.NOTICES[4].words
    text = ("x all rights reserved cc by " * 100_000) + notice
    rows = spark.createDataFrame([(None, text), (None, None)], "doc_id long, text string")
    long, none = sorted(licences.summary(licences.scan(rows)).collect(), key=lambda r: -r.n_words)
    assert (long.n_base, long.first_word, long.last_word, long.labels, long.score) == (200_000, 1, 600_000 - 2, "cc-by,mit,reserved", 1.0)
    assert tuple(none) == (None, 0, 0, None, None, "", "", 0.0)
    assert licences.summary(licences.scan(rows.limit(0))).count() == 0
    with pytest.raises(ValueError, match="key phrase"):
        licences.scan(rows, (licences.Template("a", "b c", ("c b",)),))
    with pytest.raises(ValueError, match="a-z"):
        licences.scan(rows, (licences.Template("a", "B c"),))


def test_licence_phrases_only_whole(spark):
    rows = spark.createDataFrame([(1, "this work is licensed under the gnu general public licence version 3"), (2, "this work is licensed under the gnu general public license version 3")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in licences.summary(licences.scan(rows)).collect()}
    assert got == {1: "", 2: "gpl,gpl-3.0"}


# -- fill in the middle -----------------------------------------------------------


def plain_cut(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k: k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    last = h4 % 100 < spm
    return len(units), "spm" if last else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if last else f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (0, 50)])
def test_fill_in_the_middle(spark, rate, spm):
    rng = random.Random(1)
    some = ["".join(rng.choices(["a", "ö", "日", "😀", "\n", "<", "P", ">", " "], k=rng.randrange(400))) for _ in range(200)]
    texts = ODD_TEXTS + some + ["x" * 3_000_000 + "\n" + "y\n" * 200_000, *some[:3]]
    rows = spark.createDataFrame([(k if k % 9 else None, t, "mine", k) for k, t in enumerate(texts)], "doc_id long, text string, form string, extra long").repartition(3)
    out = fim.fill_in_middle(rows, rate=rate, spm=spm)
    assert out.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars"]
    got = out.withColumn("back", fim.restored(F.col("text"), F.col("form"))).collect()
    assert len(got) == len(texts)
    for r in got:
        n, form, before, between, text = plain_cut(r.doc_id, texts[r.extra], rate, spm)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.text or "") == (n, form, before, between, text)
        assert r.back == texts[r.extra]


def test_fill_in_the_middle_of_nothing(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("bound", [0, 1, 64])
def test_rank_index_is_exact_and_its_lines_are_near(bound):
    rng = np.random.default_rng(3)
    shapes = [np.zeros(1, np.int64), np.zeros(9, np.int64), np.arange(5000) * 7, np.cumsum(rng.integers(0, 300, 5000)), np.cumsum(rng.pareto(1.0, 3000).astype(np.int64)),
              np.concatenate([np.arange(400), 10_000 + 80 * np.arange(400)])]
    for at in shapes:
        index = fim.fit(at.astype(np.int64), bound)
        ranks = np.arange(len(at))
        assert (index.at(ranks) == at).all()
        assert np.abs(index.predict(ranks) - at).max() <= bound + 1
    assert len(fim.fit(np.arange(5000) * 7, bound).first) == 1
    assert len(fim.fit(shapes[-1].astype(np.int64), 1).first) == 2


# -- clusters ---------------------------------------------------------------------


def plain_clusters(rows, size, count, rounds):
    kept = [(k, [math.floor(64 * x) for x in v]) for k, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda k: "~" if k is None else hashlib.sha256(f"1:{k}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:count]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in kept]
    for _ in range(rounds):
        of = assign()
        for c in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    of = assign()
    dist = [far(v, cents[o]) for (_, v), o in zip(kept, of, strict=True)]
    each = [sum(d for d, o in zip(dist, of, strict=True) if o == c) for c in range(len(cents))]
    return sorted(((k if k is not None else -1), o, d, each[o], sum(dist), tuple(cents[o])) for (k, _), o, d in zip(kept, of, dist, strict=True))


@pytest.mark.parametrize(("n", "count", "rounds"), [(300, 16, 3), (300, 4, 0), (300, 5, 30), (3, 16, 3), (0, 16, 3)])
def test_clusters_equal_plain_rounds(spark, n, count, rounds):
    rng = random.Random(n + rounds)
    good = [(k, [rng.choice([-1.0, 0.0, 0.5, 2.0]) + rng.gauss(0, 0.05) for _ in range(8)]) for k in range(n)]
    good += good[:20] + [(None, v) for _, v in good[:2]] + [(k, v) for _, v in good[:1] for k in range(1000, 1020)]
    odd = [(-1, None), (-2, []), (-3, [0.5] * 7), (-4, [float("nan")] * 8), (-5, [0.1] * 7 + [float("inf")]), (-6, [0.1] * 7 + [None])]
    table = spark.createDataFrame([(k, v, 5, "z") for k, v in good + odd], "vec_id long, embedding array<double>, cluster int, x string").repartition(4)
    got = centroids.cluster(table, 8, count=count, rounds=rounds).collect()
    assert sorted(((r.vec_id if r.vec_id is not None else -1), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got) == plain_clusters(good + odd, 8, count, rounds)


def test_cluster_edges(spark):
    far = float((1 << 21) - 1)
    rows = [(1, [far, -far]), (2, [-far, far]), (3, [0.0, 0.0]), (4, [-0.001, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = centroids.cluster(table, 2, count=2).collect()
    assert sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got) == plain_clusters(rows, 2, 2, 3)
    with pytest.raises(Exception, match="too wide"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], table.schema), 2).collect()
    assert centroids.digest([1, -2]) == hashlib.sha256(b"1,-2").hexdigest()
