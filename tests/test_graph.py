import random

import pytest
from pyspark.sql import functions as F

from corpuslens.operators import graph as G
from tests.conftest import rows


@pytest.fixture
def edges(make):
    return lambda pairs, root="r": make("root_path string, src string, dst string", [(root, a, b) for a, b in pairs])


@pytest.fixture
def starts(make):
    return lambda *names, root="r": make("root_path string, start string", [(root, n) for n in names])


def test_hops(edges, starts):
    e = edges([("main", "a"), ("main", "b"), ("a", "b")])
    assert rows(G.deps(e, starts("main"), "forward", 3), "hop", "node") == [(1, "a"), (1, "b")]
    assert rows(G.deps(e, starts("b"), "reverse", 3), "hop", "node") == [(1, "a"), (1, "main")]
    assert rows(G.deps(e, starts("a"), "both"), "direction", "node") == [("forward", "b"), ("reverse", "main")]


def test_hops_are_kept_and_ignore_self_imports(edges, starts):
    chain = edges([(f"n{i}", f"n{i+1}") for i in range(14)] + [("n0", "n0"), ("n1", "n0")])
    assert len(rows(G.deps(chain, starts("n0"), hops=12))) == 12
    assert len(rows(G.deps(chain, starts("n0"), hops=99))) == 14
    assert rows(G.deps(chain, starts("n0")), "node") == [("n1",)]
    with pytest.raises(ValueError):
        G.deps(chain, starts("n0"), hops=0)
    assert len(rows(G.reach(chain, starts("n0")))) == 14


def test_whole_walks_go_both_ways_to_their_ends(edges, starts):
    rng = random.Random(4)
    chain = [(f"n{i}", f"n{i + 1}") for i in range(21)]
    pairs = [*chain, ("n1", "n0"), ("n5", "n5"), ("x", "n3"), *((f"m{rng.randrange(30)}", f"m{rng.randrange(30)}") for _ in range(40))]
    want = []
    for direction, out in (("forward", pairs), ("reverse", [(b, a) for a, b in pairs])):
        for start in {n for p in pairs for n in p} - {"x"}:
            seen, layer, hop = {start}, {start}, 0
            while layer := {b for a, b in out if a in layer} - seen:
                seen, hop = seen | layer, hop + 1
                want.append(("r", start, direction, hop, len(layer)))
    names = sorted({n for p in pairs for n in p} - {"x"})
    got = rows(G.whole_walk_sizes(edges(pairs).union(edges([("n21", "n22")], "other")), starts(*names, "nowhere")))
    assert sorted(got) == sorted(want) and max(w[3] for w in want) == 21
    assert rows(G.whole_walk_sizes(edges([("a", "a"), (None, "b")]), starts("a"))) == []


def test_roots_do_not_mix(edges, starts):
    both = edges([("a", "b")], "r1").union(edges([("b", "c")], "r2"))
    assert rows(G.reach(both, starts("a", root="r1"))) == [("r1", "a", "b", 1)]


def test_unresolved(make, starts):
    d = make("root_path string, importer_file string, importee_file string, raw_target string, line int",
             [("r", "a", None, "os", 1), ("r", "a", None, "os", 2), ("r", "a", "b", "b", 3), ("r", "b", None, "sys", 1)])
    assert rows(G.unresolved(d, starts("a"))) == [("r", "a", "os")]
    assert rows(G.resolved_edges(d)) == [("r", "a", "b")]


@pytest.mark.parametrize("pairs, expected", [
    ([], []),
    ([("a", "b"), ("b", "c"), ("a", "c")], []),
    ([("a", "b"), ("b", "a")], [("a", 2, "a"), ("a", 2, "b")]),
    ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], [("a", 3, "a"), ("a", 3, "b"), ("a", 3, "c")]),
    ([("a", "a")], [("a", 1, "a")]),
    ([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], [("a", 2, "a"), ("a", 2, "b"), ("c", 2, "c"), ("c", 2, "d")]),
])
def test_cycles(edges, pairs, expected):
    assert rows(G.cycles(edges(pairs)), "component", "size", "member") == expected


def components(pairs):
    nodes = {n for p in pairs for n in p}
    out = {n: {b for a, b in pairs if a == n} for n in nodes}

    def reached(n):
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        return seen

    r = {n: reached(n) for n in nodes}
    found = set()
    for n in nodes:
        if n in r[n]:
            group = sorted({m for m in r[n] if n in r[m]} | {n})
            found |= {(group[0], len(group), m) for m in group}
    return sorted(found, key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("seed, n, m", [(1, 40, 50), (2, 30, 60), (3, 60, 70)])
def test_cycles_equal_mutual_reach(edges, seed, n, m):
    rnd = random.Random(seed)
    pairs = sorted({(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)})
    assert rows(G.cycles(edges(pairs)), "component", "size", "member") == components(pairs)


def test_long_cycle_takes_few_rounds(edges, monkeypatch):
    calls = []
    real = G.cut
    monkeypatch.setattr(G, "cut", lambda *a, **k: calls.append(a[1]) or real(*a, **k))
    n = 128
    out = G.cycles(edges([(f"n{i:03}", f"n{(i + 1) % n:03}") for i in range(n)]))
    assert out.count() == n
    assert calls.count("labels") <= 12


def test_impact(make, starts):
    sites = make("root_path string, caller_file string, caller_line int, caller_symbol string, callee_name string, callee_kind string", [
        ("r", "a/b", 1, "f", "x", "call"),
        ("r", "a/b", 1, None, "x", "call"),      # same site: the row with a caller stays
        ("r", "a/bc", 2, "g", "f", "call"),
        ("r", "a/b/c", 3, "x", "g", "call"),     # back to the start
        ("r", "z", 4, None, "g", "type_ref"),
    ])
    out = G.impact(sites, starts("x"), 5)
    assert rows(out, "hop", "caller_file", "caller_line", "caller_symbol") == [
        (1, "a/b", 1, "f"), (2, "a/bc", 2, "g"), (3, "a/b/c", 3, "x"), (3, "z", 4, None),
    ]
    assert rows(G.impact(sites, starts("x")), "hop", "caller_line") == [(1, 1)]
    assert rows(G.impact_in_scope(out, "a/b"), "caller_file") == [("a/b",), ("a/b/c",)]
    symbols = make("root_path string, name string", [("r", "x"), ("r", "x")])
    note = G.impact_notes(symbols, starts("x"), out, "a/b").first()
    assert (note.definitions, note.kept, note.dropped) == (2, 2, 2)
    assert note.note.startswith("2 definitions") and note.note.endswith("; 2 references dropped by `--file` scope")


def test_parts_are_never_broadcast(spark, capsys):
    """A small or well packed file of parts says nothing of their number; before, tables this small were broadcast."""
    from corpuslens.plans import bindings as B

    d = "/root/testdata/sf0.001"
    starts, deps = B.part_starts(spark, d), B.part_deps(spark, d)
    symbols = deps.select("root_path", F.col("importee_file").alias("name"), "line")
    for plan in (deps, B.part_calls(spark, d), G.unresolved(deps, starts), G.impact_definitions(symbols, starts)):
        plan.explain()
        assert "Broadcast" not in capsys.readouterr().out
