"""Operators on documents against plain versions on small tables with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import bpe, lines, minhash, mixing, pii, pitman_yor, quality
from corpuslens.llm.common import components, ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, component string, n_lines string, p string, base string"


@pytest.fixture(scope="module")
def shipped(spark):
    return ship(spark)


@pytest.fixture
def docs(shipped):
    def build(rows):
        wide = [(i, t, "en", "s", len(t or ""), "k", "c", "n", "p", "b") for i, t in rows]
        return shipped.createDataFrame(wide, DOCS)

    return build


def prose(rng, n, words=None):
    words = words or [f"w{k}" for k in range(400)]
    return " ".join(rng.choice(words) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (None, "one two"), (6, "same same same same same same"), (6, "same same same same same same"), (7, "x" * 300_000), (8, "é ß 日本 😀 \x1c a")]


def test_components(make):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in components(make("a long, b long", edges)).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components(make("a long, b long", [])).count() == 0


def brute_minhash(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k: k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = top[a], top[b]
                top = {k: min(x, y) if v in (x, y) else v for k, v in top.items()}
    return {i: (len(sets[i]), top[i], top[i] == i) for i in sets}


def test_minhash_against_all_pairs(docs):
    rng = random.Random(1)
    rows = [(i, t) for i, t in ODD if i is not None]
    for g in range(12):
        words = prose(rng, rng.choice([30, 80, 200])).split()
        for k in range(9):
            copy = list(words)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(99)}"
            rows.append((100 + 10 * g + k, " ".join(copy).upper() if k == 3 else " ".join(copy)))
    got = minhash.near_duplicates(docs([*rows, (None, "one")])).collect()
    assert len(got) == len(rows) + 1
    want = brute_minhash(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == want
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, None)]
    assert minhash.near_duplicates(docs([])).count() == 0


def test_patience_alignment():
    assert lines.aligned([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert lines.aligned([], [1]) == []
    for seed in range(200):
        rng = random.Random(seed)
        x, y = ([rng.randrange(8) for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = lines.aligned(x, y)
        assert all(x[i] == y[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs[:-1], pairs[1:]))


def test_line_dedup(docs):
    rng = random.Random(2)
    line = lambda n=12: prose(rng, n)
    block, head = [line() for _ in range(4)], line(10)
    own = [[line(20) for _ in range(3)] for _ in range(4)]
    texts = {
        10: "\n".join([head, own[0][0], *block, own[0][1]]), 11: "\n".join([head, own[1][0], "", *block, own[1][1]]),
        12: "\n".join([own[2][0], *block, own[2][1], *block]), 13: "\n".join([head, own[3][0]]),
        14: "\n".join([head, own[0][0], *block, own[0][1]]), 15: "\n".join([block[2], own[3][1], block[0]]),
    }
    rows = [*ODD, *texts.items()]
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs(rows)).collect()}
    assert len(got) == len({i for i, _ in rows})
    assert got[10]["text"] == texts[10] and got[13]["text"] == texts[13] and got[15]["text"] == texts[15]
    assert got[11]["text"] == "\n".join([head, own[1][0], "", own[1][1]]) and got[11]["deleted_lines"] == [3, 4, 5, 6]
    assert got[12]["text"] == "\n".join([own[2][0], own[2][1]])
    assert got[14]["text"] == "" and got[14]["n_lines"] == 7
    assert got[1]["text"] is None and got[1]["n_lines"] == 0 and got[2]["n_lines"] == 1
    assert got[6]["text"] == ODD[6][1] and got[None]["text"] == "one two"
    assert lines.dedup_lines(docs([])).count() == 0


def test_quality_learns_and_scores_all(docs, make):
    rng = random.Random(3)
    rows, marks = list(ODD), []
    for i in range(100, 420):
        good = i % 3 > 0
        rows.append((i, prose(rng, 40).capitalize() + "." if good else " ".join([rng.choice("abc") * 3] * 40) + " ###"))
        if i < 380:
            marks.append((i, int(good), 0))
    labels = make("doc_id long, quality int, toxic int", [*marks, (None, 1, 0), (390, None, 0), (391, 0, 0), (391, 1, 0)])
    got = quality.score(docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all((r["score"] >= 0.7) == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] and r["doc_id"] >= 380)
    assert [r["score"] for r in quality.score(docs([(1, "a")]), labels.limit(0)).collect()] == [0.5]
    assert quality.score(docs([]), labels).count() == 0


def test_isotonic_steps_rise():
    import numpy as np

    at, level = quality.rising(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(level) >= 0).all() and len(at) == 3


def library_rows(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in rows:
        ids = known.encode(t or "", add_special_tokens=False).ids
        back = known.decode(ids, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        yield i, len(ids), digest(" ".join(map(str, ids))), digest(back)


def test_bpe_equals_the_library(docs):
    rng = random.Random(4)
    rows = [*ODD, (20, "a<|endoftext|>B <|startoftext|>"), (21, "Σίσυφος ΟΔΟΣ İ it's we'll '"), (22, "aaaa" * 40 + " ababab!!! 1234 ４５")]
    rows += [(i, "".join(rng.choice("abcdeinotrsh  .,'") for _ in range(300))) for i in range(30, 60)]
    rows = [(i, t.replace("\x1c", "") if t else t) for i, t in rows]
    got = bpe.encode(docs(rows), keep=True).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted(library_rows(rows), key=key)
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert bpe.encode(docs([])).count() == 0


def plain_spans(text):
    luhn = lambda g: sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(g)))) % 10 == 0
    # Without this the plain pattern takes a time that grows with the square of a long word.
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)] if "@" in text else []
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, lo, hi in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if lo <= len(digits) <= hi and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_pii_base_spans_and_terms(docs):
    rng = random.Random(6)
    parts = ["a@b.c", "%d@e.f", " x@y ", "1.2.3.4", ".5", "300.1.1.1", "0001.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (724) 555-7058", "+12-", "😀", "é", " ", "@", "-", "9" * 25]
    rows = [*ODD, *((i, "".join(rng.choice(parts) for _ in range(rng.randrange(14)))) for i in range(100, 400))]
    got = pii.spans(docs(rows)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == plain_spans(texts[r["doc_id"]] or "")
    told = [(i, f"{prose(rng, 6)} Zorblax wrote from q.r@st.uv on {prose(rng, 6)}") for i in range(1, 7)] + [(i, prose(rng, 30)) for i in range(10, 60)] + [(70, "Zorblax alone")]
    found = {r["doc_id"]: r["terms"] for r in pii.spans(docs(told)).collect()}
    shown = {dict(told)[i][s["start"]: s["end"]] for i, ss in found.items() for s in ss}
    assert {"Zorblax", "wrote"} <= shown and not found[70] and not any(found[i] for i in range(10, 60))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs([*told, (None, "a@b.cd"), (80, None)])).collect()}
    assert "Zorblax" not in clean[1] and "[EMAIL]" in clean[1] and clean[None] == "[EMAIL]" and clean[80] is None and clean[70] == "Zorblax alone"
    assert pii.spans(docs([])).count() == 0


def test_language_model_counts_and_beats_the_base(docs):
    rng = random.Random(8)
    one, two = [f"{a}{k}" for a in "ab" for k in range(60)], [f"{a}{k}" for a in "cd" for k in range(60)]
    rows = [*ODD, *((i, f"the {prose(rng, 30, one)}" if i % 2 else f"der {prose(rng, 30, two)}") for i in range(100, 500))]
    learn = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = pitman_yor.scores(docs(rows), learn).collect()
    assert len(got) == len(rows)
    count, tokens = Counter(), {}
    for i, t in rows:
        tokens[i] = [*(t or "").encode().lower().split(), b"\n"]
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(tokens[i])
    n, v = sum(count.values()), len(count)
    for r in got:
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(count[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    held = [r for r in got if not r["learned"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert pitman_yor.scores(docs([]), learn).count() == 0
    assert pitman_yor.perplexity(pitman_yor.scores(docs(rows), learn)).count() == 2


def test_mixing_reaches_its_targets(docs, make):
    rng = random.Random(9)
    rows = list(ODD) + [(i, prose(rng, 50, ["tion", "eau", "qué"]) if i % 4 == 0 else prose(rng, 50, ["thing", "shy", "wow"])) for i in range(100, 500)]
    known = make("doc_id long, lang string", [(i, "fr" if i % 4 == 0 else "en") for i in range(100, 300)] + [(None, "en"), (301, None)])
    got = mixing.mix(docs(rows), known, "lang", {"fr": 0.5, "en": 0.5}).collect()
    assert len(got) == len(rows) and all(r["rate"] >= 1 and r["copies"] >= 1 for r in got)
    total = [sum(r["n_tokens"] * r["rate"] * r["p"][k] for r in got) for k in (0, 1)]
    assert abs(total[0] / sum(total) - 0.5) < 0.01
    assert all((r["p"][1] > 0.9) == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] and r["doc_id"] >= 100)
    down = mixing.mix(docs(rows), known, "lang", {"fr": 0.5, "en": 0.5}, floor=0.0).collect()
    total = [sum(r["n_tokens"] * r["rate"] * r["p"][k] for r in down) for k in (0, 1)]
    assert min(r["rate"] for r in down) < 1 and abs(total[0] / sum(total) - 0.5) < 0.02
    assert {r["rate"] for r in mixing.mix(docs(rows), known.limit(0), "lang").collect()} == {1.0}
    assert mixing.mix(docs([]), known, "lang").count() == 0


def test_language_model_has_a_context_for_every_word(docs):
    rng = random.Random(18)
    heads = [f"h{k}" for k in range(150)]
    # Each rare head is always followed by its own word; alone both are far below a hundredth of the tokens.
    pair = lambda k: f"{heads[k]} t{k}"
    rows = [(i, " ".join(pair(rng.randrange(150)) for _ in range(40))) for i in range(300)]
    rows += [(1000, " ".join(pair(k) for k in range(0, 150, 3))), (1001, " ".join(f"{heads[k]} t{(k + 7) % 150}" for k in range(0, 150, 3)))]
    got = {r["doc_id"]: r for r in pitman_yor.scores(docs(rows), F.col("doc_id") < 1000).collect()}
    assert math.isclose(got[1000]["base_score"], got[1001]["base_score"], rel_tol=0.01)
    # 50 tails that their heads give away against 50 that they rule out.
    assert got[1000]["score"] > got[1001]["score"] + 50 and got[1000]["score"] > 0.7 * got[1000]["base_score"]


@pytest.mark.parametrize(("n", "base", "discount"), [(2, 0.5, 0.5), (5, 0.3, 0.7), (60, 20.0, 0.8), (1000, 30.0, 0.6), (4000, 5.0, 0.8), (4000, 300.0, 0.5)])
def test_seating_reaches_its_chance_for_any_number_of_customers(n, base, discount):
    import numpy as np

    t, log = np.arange(1, n + 1), np.full(n + 1, -np.inf)  # log of the weight of all seatings at t tables
    log[1] = math.log(base)
    for m in range(1, n):
        with np.errstate(divide="ignore"):
            log[1:] = np.logaddexp(log[1:] + np.log(np.maximum(m - discount * t, 0)), log[:-1] + math.log(base))
    chance = np.exp(log[1:] - log.max())
    mean = (chance * t).sum() / chance.sum()
    spread = math.sqrt((chance * (t - mean) ** 2).sum() / chance.sum())
    got = pitman_yor.tables_of(np.full(5000, n), np.full(5000, base), discount, np.random.default_rng(1))
    assert abs(got.mean() - mean) < 0.01 * mean + 0.03 and abs(got.std() - spread) < 0.05 * spread + 0.02


def plain_sampler(sentences, sweeps, burn):
    """Chances of a (context, word) under the model, customers moved one at a time by the Chinese restaurant rule."""
    rng, d = random.Random(5), pitman_yor.STRENGTH
    pairs = [(c, w) for s in sentences for c, w in zip(["", *s], [*s, ""], strict=True)]
    many = Counter(pairs)
    served = Counter(w for _, w in many)
    share = lambda values: pitman_yor._discount(sum(v == 1 for v in values), sum(v == 2 for v in values))
    low, high, types = share(list(served.values())), share(list(many.values())), len(served)
    contexts, root, seats, held = {p: [n] for p, n in many.items()}, {w: [n] for w, n in served.items()}, Counter(c for c, _ in many), Counter(c for c, _ in pairs)
    size = lambda: (sum(map(sum, root.values())), sum(map(len, root.values())))

    def parent(w, customers, tables):
        return (sum(root[w]) - low * len(root[w]) + (d + low * tables) / (types + 1)) / (d + customers)

    def root_take(w, customers, tables):
        weights = [n - low for n in root[w]] + [(d + low * tables) / (types + 1)]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(root[w]):
            root[w].append(0)
        root[w][k] += 1

    total, times = Counter(), 0
    for sweep in range(sweeps):
        for c, w in pairs:
            at = contexts[c, w]
            k = rng.choices(range(len(at)), at)[0]
            at[k] -= 1
            if not at[k]:
                del at[k]
                seats[c] -= 1
                j = rng.choices(range(len(root[w])), root[w])[0]
                root[w][j] -= 1
                root[w] = [n for n in root[w] if n]
            customers, tables = size()
            k = rng.choices(range(len(at) + 1), [n - high for n in at] + [(d + high * seats[c]) * parent(w, customers, tables)])[0]
            if k == len(at):
                at.append(0)
                seats[c] += 1
                root_take(w, customers, tables)
            at[k] += 1
        if sweep >= burn:
            times += 1
            customers, tables = size()
            for c, w in many:
                total[c, w] += (many[c, w] - high * len(contexts[c, w]) + (d + high * seats[c]) * parent(w, customers, tables)) / (d + held[c])
    return {p: v / times for p, v in total.items()}


def test_language_model_agrees_with_a_plain_sampler(docs):
    rng = random.Random(21)
    # Words of very different counts, nearly every pair seen again: tables of the contexts make much of the root.
    sentences = [[rng.choice("abcdef") + str(int(rng.paretovariate(0.7)) % 9) for _ in range(8)] for _ in range(60)]
    want = plain_sampler(sentences, 100, 30)
    got = pitman_yor.scores(docs([(i, " ".join(s)) for i, s in enumerate(sentences)]), F.lit(True)).collect()
    plain = {i: sum(math.log10(want[p]) for p in zip(["", *s], [*s, ""], strict=True)) for i, s in enumerate(sentences)}
    off = [r["score"] - plain[r["doc_id"]] for r in got]
    assert abs(sum(off)) < 0.01 * abs(sum(plain.values())) and max(map(abs, off)) < 0.6


def test_a_sweep_hands_its_tables_on(make):
    pairs = make("word long, context long, learned long", [(w, c, 1 + (w * c) % 40) for w in range(1, 30) for c in range(1, 12)])
    seated, words, contexts, totals = pitman_yor._sweeps(pairs, 29 * 11, 29, (0.5, 0.6))
    tables = seated.agg(F.sum("total")).first()[0] + pitman_yor.SAMPLES * pairs.where("learned = 1").count()
    assert len(totals) == pitman_yor.SAMPLES and tables == sum(c for c, _ in totals) > pitman_yor.SAMPLES * 29 * 11
    assert contexts.agg(F.sum(F.aggregate("rooms", F.lit(0.0), lambda x, y: x + y))).first()[0] == tables
    mass = [words.agg(F.sum(F.get("mass", F.lit(k)))).first()[0] for k in range(pitman_yor.SAMPLES)]
    assert all(math.isclose(m, c - 0.5 * t) for m, (c, t) in zip(mass, totals, strict=True))


def test_small_batches_are_drawn_together():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"word": [k] * 10, "many": [5] * 10, "base": [1.0] * 10, "grow": [0.1] * 10}) for k in range(100)]
    out = list(pitman_yor._drawn(iter([batches[0].slice(0, 0), *batches]), "many", 0.5, 0))
    assert [b.num_rows for b in out] == [1000] and out[0].schema.names == ["word", "many", "tables"]
    assert not list(pitman_yor._drawn(iter([]), "many", 0.5, 0))


def test_a_chunk_tells_what_it_learns_and_asks_in_one_pass():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(31)
    rows = [(i // 40, i % 3 > 0, None if i == 7 else " ".join(f"w{int(rng.paretovariate(0.6)) % 50}" for _ in range(rng.randrange(30)))) for i in range(120)]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("chunk", "learn", "text"), map(list, zip(*rows[at: at + 25], strict=True)), strict=True))) for at in range(0, 120, 25)]
    got = pa.Table.from_batches(list(pitman_yor._pairs(iter(batches)))).to_pylist()
    seen, asked = Counter(), set()
    for chunk, learn, text in rows:
        words = [*(text or "").split(), "\n"]
        for pair in zip(["\n", *words[:-1]], words, strict=True):
            seen[chunk, pair] += learn
            asked |= set() if learn else {(chunk, pair)}
    assert sorted((r["chunk"], r["seen"], r["asked"]) for r in got) == sorted((c, n, (c, p) in asked) for (c, p), n in seen.items())
    heads = {(r["chunk"], r["word"]) for r in got if r["head"]}
    assert heads == {(r["chunk"], r["word"]) for r in got} and len(heads) == len({(c, p[1]) for c, p in seen})
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2))
    for some in (keys, keys[:1], keys[:0]):
        at, there = pitman_yor._Places(some).of(np.concatenate([keys, keys + np.uint64(1)]))
        assert there.tolist() == [k in set(some.tolist()) for k in keys.tolist()] + [False] * len(keys) and (some[at[there]] == keys[:len(some)]).all()


def test_seating_a_lone_dish_counts_its_own_tables():
    import numpy as np

    # Two customers; the second opens a table with weight base + grow against 1 - discount.
    got = pitman_yor.tables_of(np.full(20_000, 2), np.full(20_000, 0.1), 0.5, np.random.default_rng(2), np.full(20_000, 0.4))
    assert abs((got == 2).mean() - 0.5) < 0.015


def brute_runs(early, late, words, least):
    out = set()
    for i in range(len(early)):
        for j in range(len(late)):
            n = 0
            while i + n < len(early) and j + n < len(late) and early[i + n] == late[j + n]:
                n += 1
            if sum(words[j: j + n]) >= least:
                out.update(range(j, j + n))
    return out


def test_line_dedup_finds_runs_that_shorter_lines_cross(docs):
    passage, heads = [1], [2, 3]
    assert lines.common_blocks(passage + heads, heads + passage, [3, 3, 60], 30) == {2}
    for seed in range(300):
        rng = random.Random(seed)
        size = [rng.choice([3, 8, 14, 40]) for _ in range(10)]
        x, y = ([rng.randrange(1, 10) for _ in range(rng.randrange(14))] for _ in range(2))
        gone = lines.common_blocks(x, y, [size[v] for v in y], 30)
        assert lines.shared_runs(x, y, [size[v] for v in y], 30) == brute_runs(x, y, [size[v] for v in y], 30) <= gone
        left = [v for j, v in enumerate(y) if j not in gone]
        assert not brute_runs(x, left, [size[v] for v in left], 30)
    rng = random.Random(21)
    p, h1, h2 = prose(rng, 60), prose(rng, 5), prose(rng, 6)
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs([(1, f"{p}\n{h1}\n{h2}"), (2, f"{h1}\n{h2}\n{p}")])).collect()}
    assert got == {1: f"{p}\n{h1}\n{h2}", 2: f"{h1}\n{h2}"}


def test_minhash_tries_on_until_a_class_links(docs):
    rng, rows = random.Random(31), []
    for g in range(40):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(100)]
        near = list(words)
        near[30], near[60], near[97], near[98], near[99] = (f"n{rng.randrange(10**6)}" for _ in range(5))
        # Only the first copy is at 75 or more with the words; the others are at 74.5 and as likely to agree in more minhashes.
        copies = [near] + [[*near[:96], f"o{g}", *near[97:99], f"u{k}"] for k in range(12)]
        rows += [(100 * g + k, " ".join(c)) for k, c in enumerate([words, *copies])]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == {i: i - i % 100 for i, _ in rows}


def test_minhash_parities_rule_out_no_link():
    rng = np.random.default_rng(4)
    x, sums, under = [], [], []
    for n in (1, 7, 140, 700, 3000):
        for share in (0.0, 0.05, 0.125, 0.14, 0.143, 0.15, 0.2, 0.5):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[int(n * share):], rng.integers(0, 1 << 63, int(n * share), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            x += [a, b]
            sums.append(len(a) + len(b))
            under.append(100 * both < 75 * (sums[-1] - both))
    bits = minhash.parities(x)
    got = minhash.unlike(bits[::2], bits[1::2], np.array(sums))
    assert not (got & ~np.array(under)).any() and got[np.array(under) & (np.array(sums) == 280)].sum() >= 2


def test_minhash_group_of_near_copies_costs_no_square(docs, monkeypatch):
    """Copies that are all about as like to each other, but not enough, stay apart; before, all pairs of them were moved and confirmed on full sets."""
    rng, rows = random.Random(5), []
    words = prose(rng, 150).split()
    for k in range(120):
        copy = list(words)
        for at in rng.sample(range(150), 5 if k % 2 else 7):
            copy[at] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    tried, old = [], minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda *a: tried.append(old(*a)) or tried[-1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == brute_minhash(rows)
    assert sum(t[3] for t in tried) < 1500


def test_minhash_large_bucket_is_sent_once(shipped, monkeypatch):
    def counted(batches, tries, every):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(list(range(batch.num_rows))), pa.array([1] * batch.num_rows)], ["a", "b", "more"])

    monkeypatch.setattr(minhash, "_within", counted)
    spark = shipped
    rows = spark.range(1_500).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("doc_id"), F.lit(9).cast("long").alias("n"),
                                     F.col("id").alias("component"), F.lit(1_500).cast("long").alias("members"))
    marks = spark.range(1_500).select(F.col("id").alias("doc_id"), F.lit(b"m").alias("mark"))
    # As many rows as classes: none is sent for a second block.
    sent = minhash._closest(rows, marks, 1, False, 1_500).agg(F.count("a"), F.sum("more")).first()
    assert tuple(sent) == (1_500, 1_500)


def test_minhash_blocks_and_finished_buckets_lose_no_link(docs, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(w if rng.random() > 0.02 else f"x{rng.random()}" for w in base)) for k in range(80)]
    want = brute_minhash(rows)
    assert len({top for _, top, _ in want.values()}) > 1
    for block in (8, 1_000):
        monkeypatch.setattr(minhash, "BLOCK", block)
        got = minhash.near_duplicates(docs(rows)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_minhash_tells_pairs_of_a_bucket_as_they_are_found():
    n = 800
    same = bytes(len(minhash._MULT) + minhash.BITS // 8)
    one = pa.table({"key": [1] * n, "i": [0] * n, "j": [0] * n, "block": [0] * n, "doc_id": list(range(n)), "n": [10] * n, "component": list(range(n)), "mark": [same] * n})
    told = list(minhash._within(iter(one.to_batches()), n, True))
    assert sum(b.num_rows for b in told) == n * (n - 1) // 2
    assert max(b.num_rows for b in told) <= minhash.HELD + n
