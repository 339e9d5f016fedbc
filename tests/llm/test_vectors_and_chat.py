"""Vector search and near-duplicates against all pairs; chat formatting as an exact round trip; the pipeline's stages."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import ann, chat, multi_index
from corpuslens.llm.common import ship

VECTORS = "vec_id long, embedding array<float>, label int, v string, rep string, size string"


@pytest.fixture(scope="module")
def shipped(spark):
    return ship(spark)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, "v", "r", "s") for i, v, k in rows], VECTORS)


def some(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims))
    x[n // 2:] = x[: n - n // 2] + rng.normal(size=(n - n // 2, dims)) * 0.12
    x[-5:] = x[0]
    return [(i, [float(np.float32(c)) for c in v], i % 3 if i < n - 5 else 0) for i, v in enumerate(x)]


ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None] + [1.0] * 15, 1), (9005, [1.0] * 16, None), (9006, [1.0, 2.0], 1), (9007, [float("inf")] + [1.0] * 15, 1), (9008, [], 1)]


def test_links_against_all_pairs(shipped):
    rows = [*some(1, 400), *ODD, (None, [1.0] * 16, 0)]
    got = {r["vec_id"]: r for r in multi_index.near_duplicates(vectors(shipped, rows)).collect()}
    assert len(got) == len(rows)
    fine = [(i, np.array(v, float), k) for i, v, k in rows[:400]]
    links = {i: set() for i, _, _ in fine}
    for i, v, k in fine:
        for j, w, m in fine:
            if i != j and k == m and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i].add(j)
    assert {i: got[i]["n_links"] for i in links} == {i: len(s) for i, s in links.items()}
    assert all(got[i]["component_id"] <= min(s | {i}) for i, s in links.items())
    assert all(got[i]["component_id"] == got[j]["component_id"] for i, s in links.items() for j in s)
    for i, _, _ in ODD:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[None]["component_id"], got[None]["kept"]) == (None, None)
    assert multi_index.near_duplicates(vectors(shipped, [])).count() == 0


def test_cells_come_in_order():
    a, b = np.array([0.0, 0.5, 0.2]), np.array([0.1, 0.0])
    got = multi_index.traverse(a, b, 0.31)
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums) and set(got) == {(i, j) for i in range(3) for j in range(2) if a[i] + b[j] <= 0.31}


def test_search_recall(shipped):
    rows = [*some(2, 900), *ODD, (None, [1.0] * 16, 0)]
    asked = vectors(shipped, rows).where("vec_id % 20 = 0")
    got = ann.nearest(vectors(shipped, rows), asked).collect()
    fine = {i: np.array(v, float) for i, v, _ in rows[:900]}
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == {i for i in fine if i % 20 == 0}
    hits = 0
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and q not in {r["vec_id"] for r in rs}
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        assert all(abs(fine[q] @ fine[r["vec_id"]] - r["score"]) < 1e-9 for r in rs)
        best = sorted(((-(fine[q] @ v), i) for i, v in fine.items() if i != q))[:20]
        hits += len({i for _, i in best} & {r["vec_id"] for r in rs})
    assert hits >= 0.9 * 20 * len(by)
    few = vectors(shipped, rows[:3])
    assert ann.nearest(few, few).count() == 6
    assert ann.nearest(vectors(shipped, []), asked).count() == 0


def test_chat_round_trip():
    rng = random.Random(2)
    parts = ["[INST] ", "[/INST]", " </s>", "</s>", "\\", "[", "<", "a", " ", "\n", "[OUT] ", "<s>", "]", "\\[", "[AS x] ", "[/AS]", "[SYS]", "é"]
    for _ in range(20_000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[x", "a]b", "\\"]), "".join(rng.choice(parts) for _ in range(rng.randrange(7)))) for _ in range(rng.randrange(1, 4))]
        got = chat.parse("".join(chat.render(*t) for t in turns))
        assert got is not None and [t[:2] for t in got] == turns
    assert chat.render("user", "plain <b> [x] \\n") == "[INST] plain <b> [x] \\n [/INST]\n"
    assert chat.parse("[INST] x [/INST]") is None and chat.parse("y") is None and chat.parse("") == []


def test_chat_digests(shipped):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "hi"), (2, 0, None, None), (2, 1, "assistant", ""), (None, 5, "assistant", "x\n"), (3, None, "user", "a"), (3, 0, "user", "a"), (3, 0, "user", "a")]
    turns = shipped.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, shown string")
    got = {r["conv_id"]: r for r in chat.digests(turns).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None}
    assert got[1]["turns_sha256"] == digest("user\nhi\nassistant\n</s>[INST] ok [/INST]\n") and got[1]["loss_chars"] == 21
    assert got[1]["loss_sha256"] == digest("</s>[INST] ok [/INST]") and got[2]["turns_sha256"] == digest("\n\nassistant\n\n")
    assert got[3]["n_turns"] == 3 and got[None]["loss_sha256"] == digest("x\n")
    assert chat.digests(turns.limit(0)).count() == 0


def test_pipeline_stages(shipped):
    import corpus_pipeline as P

    sf = "/root/testdata/sf0.001"
    docs = shipped.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in P.STAGES[:-1]:
        out = stage(shipped, docs, sf).cache()
        assert out.columns == docs.columns, name
        ids = {r[0] for r in out.select("doc_id").collect()}
        assert ids <= {r[0] for r in docs.select("doc_id").collect()}
        assert out.count() <= before or name == "mixing sources"
        docs, before = out, out.count()
    last = P.STAGES[-1][1](shipped, docs, sf)
    assert last.count() == before and P.run(shipped, sf).count() == before
    assert P.STAGES[2][1](shipped, docs.limit(0), sf).count() == 0 and P.STAGES[0][1](shipped, docs.limit(0).withColumn("text", F.lit("a")), sf).count() == 0


def test_links_along_the_directions_that_cells_split(shipped):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(800, 64)) * 0.005
    for at in (0, 32):  # an arc in each half, which its codebook is split along
        turn = rng.random(800) * 2 * np.pi
        x[:, at] += np.cos(turn)
        x[:, at + 1] += np.sin(turn)
    x = x.astype(np.float32).astype(float)
    got = {r["vec_id"]: r["n_links"] for r in multi_index.near_duplicates(vectors(shipped, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()}
    x /= np.linalg.norm(x, axis=1)[:, None]
    least, most = (((x @ x.T) >= 0.93 + e).sum(axis=1) - 1 for e in (1e-5, -1e-5))
    assert all(least[i] <= got[i] <= most[i] for i in got) and least.sum() > 1000


def test_visits_stay_few_without_contrast(shipped):
    """Vectors without contrast visit most cells, and each visit carries its vector; before, 3,000 vectors had 81 cells."""
    x = np.random.default_rng(8).normal(size=(3000, 32))
    seen = []
    old, multi_index.blocked = multi_index.blocked, lambda held, asked, *more: seen.append(asked.count()) or old(held, asked, *more)
    try:
        got = multi_index.near_duplicates(vectors(shipped, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect()
    finally:
        multi_index.blocked = old
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(((unit @ unit.T) >= 0.93).sum(axis=1) - 1))
    assert seen[0] <= len(x) * 16
