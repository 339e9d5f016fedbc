"""Commits ahead against closures; jobs grow with the logarithm of a history."""

import random

import pytest

from corpuslens.operators import commits as C
from tests.conftest import rows

COMMITS = "root_path string, sha string, parent string"
PAIRS = "root_path string, base string, head string"


def test_ahead_count(make):
    # 1 - 2 - 3 - 5(merge of 3, 4), 2 - 4
    commits = make("root_path string, sha string, parent string",
                   [("r", "1", None), ("r", "2", "1"), ("r", "3", "2"), ("r", "4", "2"), ("r", "5", "3"), ("r", "5", "4")])
    pairs = make("root_path string, base string, head string",
                 [("r", "2", "5"), ("r", "3", "5"), ("r", "5", "2"), ("r", "1", "1"), ("r", "gone", "5")])
    assert rows(C.ahead_count(commits, pairs), "base", "head", "ahead") == [
        ("1", "1", 0), ("2", "5", 3), ("3", "5", 2), ("5", "2", 0), ("gone", "5", None),
    ]
    asks = make("root_path string, recorded string, current string",
                [("r", "5", "5"), ("r", "2", "5"), ("r", None, "5"), ("r", "gone", "5")])
    assert rows(C.commits_behind(commits, asks), "recorded", "behind") == [("2", 3), ("5", 0), ("gone", None), (None, None)]


@pytest.fixture
def jobs(monkeypatch):
    """Names of the tables that the module writes, one for each of its jobs."""
    seen = []
    real = C.cut
    monkeypatch.setattr(C, "cut", lambda df, name="cut", count=None: (seen.append(name), real(df, name, count))[1])
    return seen


def test_a_line_takes_two_logarithms_of_jobs(make, jobs):
    n = 2000
    commits = make(COMMITS, [("r", str(i), str(i - 1) if i else None) for i in range(n)])
    pairs = make(PAIRS, [("r", "0", str(n - 1)), ("r", "1500", "7"), ("r", "3", "1999")])
    assert rows(C.ahead_count(commits, pairs), "base", "head", "ahead") == [("0", "1999", 1999), ("1500", "7", 0), ("3", "1999", 1996)]
    assert jobs.count("forest") <= 12 and jobs.count("lines") <= 12 and jobs.count("walk") <= 2
    assert len(jobs) <= 2 * 12 + 9


def test_side_branches_leave_the_main_line_whole(make, jobs):
    """A main line with a short branch at each commit, merged or not: forks do not cut it."""
    n = 200
    history = [("r", f"m{i:03}", f"m{i - 1:03}" if i else None) for i in range(n)]
    history += [("r", f"a{i:03}", f"m{i:03}") for i in range(n)]  # sorts before the main line's commits
    history += [("r", f"m{i:03}", f"a{i - 2:03}") for i in range(2, n, 3)]
    rank = {("m", "m"): 0, ("m", "a"): 1}
    commits = make(COMMITS + ", place int", [(r, s, p, rank.get((s[0], (p or "m")[0]), 0)) for r, s, p in history])
    pairs = make(PAIRS, [("r", "m000", "m199"), ("r", "m198", "m199"), ("r", "a100", "m150")])
    want = closure_counts([(r, s, p) for r, s, p in history], [tuple(p) for p in pairs.collect()])
    assert rows(C.ahead_count(commits, pairs)) == want
    assert jobs.count("walk") <= 4


def closure_counts(history, pairs):
    parents = {}
    for r, s, p in history:
        parents.setdefault((r, s), set()).update({(r, p)} if p else set())

    def reached(c):
        seen, todo = {c}, [c]
        while todo:
            for p in parents.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    known = lambda r, a, b: (r, a) in parents and (r, b) in parents
    out = [(r, a, b, len(reached((r, b)) - reached((r, a))) if known(r, a, b) else None) for r, a, b in set(pairs)]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("seed", range(2))
def test_random_histories_equal_closures(make, seed):
    rng = random.Random(seed)
    history = []
    for r in ("r", "s"):
        for i in range(rng.choice([3, 40, 70])):
            near = range(max(0, i - 6), i)
            for p in rng.sample(near, min(len(near), rng.choice([1, 1, 1, 2, 3]))) or [None]:
                history.append((r, f"c{i}", None if p is None else f"c{p}"))
    history += [("r", "c1", "lost"), ("s", "c0", None), ("s", "c0", None), ("r", None, "c1")]
    shas = sorted({s for _, s, _ in history if s})
    pairs = [(rng.choice("rs"), rng.choice(shas), rng.choice(shas)) for _ in range(60)] + [("r", "lost", "c1"), ("r", None, "c1"), ("t", "c0", "c1")]
    known = [h for h in history if h[1]]
    assert rows(C.ahead_count(make(COMMITS, history), make(PAIRS, pairs))) == closure_counts(known, pairs)


def test_no_pairs_no_commits_and_loops(make):
    commits = make(COMMITS, [("r", "a", "b"), ("r", "b", "a")])
    assert rows(C.ahead_count(commits, make(PAIRS, []))) == []
    assert rows(C.ahead_count(make(COMMITS, []), make(PAIRS, [("r", "a", "b")]))) == [("r", "a", "b", None)]
    with pytest.raises(ValueError, match="ancestor"):
        C.ahead_count(commits, make(PAIRS, [("r", "a", "b")]))
