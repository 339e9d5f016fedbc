import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpuslens import schemas
from corpuslens.operators import registry as R
from corpuslens.sources import records as RC
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


@pytest.fixture
def packages(spark):
    def build(*items):
        base = dict(display_name="D", source_type="git", source_url=None, source_branch=None, path="/c/x", auto_pull=True, harness=None,
                    shallow=False, prepare_scope="global", created_at=T0, updated_at=T0)
        full = [base | {"identifier": i["id"]} | i for i in items]
        return spark.createDataFrame([tuple(f[n] for n in schemas.PACKAGES.names) for f in full], schemas.PACKAGES)

    return build


@pytest.fixture
def conversations(spark):
    def build(*items):
        base = dict(question="q", harness="h", exit_code=0, log_path="p", git_commit_sha=None, git_branch=None, created_at=T0)
        full = [base | i for i in items]
        return spark.createDataFrame([tuple(f[n] for n in schemas.CONVERSATIONS.names) for f in full], schemas.CONVERSATIONS)

    return build


@pytest.fixture
def prepared(spark):
    def build(*items):
        base = dict(content="c", created_at=T0, harness="h", model=None, git_commit_sha=None, git_branch=None, prepare_scope_at_time="global")
        full = [base | i for i in items]
        return spark.createDataFrame([tuple(f[n] for n in schemas.PREPARED.names) for f in full], schemas.PREPARED)

    return build


def test_insert_and_update(packages, make):
    have = packages(dict(id="1", identifier="a"))
    new = packages(dict(id="2", identifier="a"), dict(id="4", identifier="b"), dict(id="3", identifier="b"))
    merged, rejected = R.insert_packages(have, new)
    assert rows(merged, "id") == [("1",), ("3",)] and rows(rejected, "id") == [("2",), ("4",)]
    updates = make("id string, harness string, auto_pull boolean, clear array<string>", [("1", "x", False, None), ("3", None, None, ["harness"]), ("9", "y", None, None)])
    start = merged.withColumn("harness", F.lit("old"))
    after, missing = R.update_packages(start, updates, F.lit(day(5)))
    assert rows(after, "id", "harness", "auto_pull", "display_name") == [("1", "x", False, "D"), ("3", None, True, "D")]
    assert after.where("id = '1'").first().updated_at == day(5)
    assert rows(missing, "id") == [("9",)]


def test_settings(packages, make):
    pk = packages(dict(id="1", identifier="a", harness="claw"), dict(id="2", identifier="b"))
    s = make("identifier string, key string, value string, unset boolean", [
        ("a", "auto-pull", "false", False), ("a", "harness", None, True), ("b", "prepare-scope", "branch", False), ("b", "harness", "nope", False),
        ("b", "auto-pull", "yes", False), ("b", "color", "x", False), ("z", "auto-pull", "true", False), ("a", "prepare-scope", None, True), ("b", "auto-pull", None, False)])
    after, refused = R.set_properties(pk, s, make("name string", [("claw",)]), F.lit(T0))
    assert rows(after, "identifier", "auto_pull", "harness", "prepare_scope") == [("a", False, None, "global"), ("b", True, None, "branch")]
    assert sorted(r.reason for r in refused.collect()) == sorted(
        ["harness not configured", "invalid value", "unknown property", "package not found", "cannot unset", "missing value"])


def test_cascade_and_orphans(packages, conversations, prepared, make):
    pk = packages(dict(id="1"), dict(id="2"))
    cv = conversations(dict(id="c1", package_id="1"), dict(id="c2", package_id="2"), dict(id="c3", package_id="9"))
    maps = prepared(dict(id="m1", package_id="1"))
    p, c, m = R.delete_packages(pk, cv, maps, make("id string", [("1",)]))
    assert (rows(p, "id"), rows(c, "id"), rows(m, "id")) == ([("2",)], [("c2",), ("c3",)], [])
    kept, refused = R.accept_conversations(cv, pk)
    assert rows(kept, "id") == [("c1",), ("c2",)] and rows(refused, "id") == [("c3",)]


def test_history(packages, conversations, make):
    pk = packages(dict(id="1", identifier="a"), dict(id="2", identifier="b"))
    cv = conversations(*(dict(id=f"c{i}", package_id="1", question=f"q{i}", created_at=day(i)) for i in range(10)), dict(id="x", package_id="2"))
    ask = make("identifier string", [("a",)])
    out = R.history(cv, pk, ask, F.lit(day(10)), limit=5).orderBy("rank")
    assert [r.id for r in out.collect()] == ["c9", "c8", "c7", "c6", "c5"]
    assert len(rows(R.history(cv, pk, ask, F.lit(day(10)), since_days=2))) == 2
    assert rows(R.recent_questions(cv, 3), "package_id", "rank", "question") == [("1", 1, "q9"), ("1", 2, "q8"), ("1", 3, "q7"), ("2", 1, "q")]
    assert rows(R.last_activity(cv)) == [("1", day(9)), ("2", T0)]


def test_prepared_maps(prepared, make):
    old = prepared(dict(id="1", package_id="p", content="global"), dict(id="2", package_id="p", git_branch="main", content="main", created_at=day(3)))
    new = prepared(dict(id="3", package_id="p", content="again", created_at=day(1)), dict(id="4", package_id="p", git_branch="main", content="main2", created_at=day(2)))
    both = R.replace_prepared(old, new)
    assert rows(both, "id", "git_branch") == [("3", None), ("4", "main")]
    every = old.unionByName(new)
    assert rows(R.latest_global(every), "id") == [("3",)] and rows(R.latest_per_branch(every), "id") == [("2",)]
    wants = make("package_id string, prepare_scope string, branch string", [("p", "global", "main"), ("p", "branch", "main"), ("p", "branch", None), ("p", "branch", "dev"), ("q", "global", None)])
    out = R.latest_by_scope(both, wants)
    assert rows(out, "package_id", "prepare_scope", "branch", "map.id") == [
        ("p", "branch", "dev", None), ("p", "branch", "main", "4"), ("p", "branch", None, "3"), ("p", "global", "main", "3"), ("q", "global", None, None)]


def test_retention(packages, conversations, prepared):
    pk = packages(
        dict(id="old", path="/c/a"), dict(id="fresh", path="/c/b", created_at=day(9)), dict(id="mate", path="/c/b"),
        dict(id="asked", path="/c/d"), dict(id="mapped", path="/c/e"), dict(id="branch-map", path="/c/f"), dict(id="edge", path="/c/g", created_at=day(5)),
        dict(id="outside", path="/cx/a"), dict(id="local", path="/c/l", source_type="local"))
    cv = conversations(dict(id="1", package_id="asked", created_at=day(8)))
    maps = prepared(dict(id="1", package_id="mapped", created_at=day(8)), dict(id="2", package_id="branch-map", created_at=day(8), git_branch="m"))
    out = R.stale_clones(pk, cv, maps, "/c", F.lit(day(5)))
    assert rows(out, "path", "identifier") == [("/c/a", "old"), ("/c/f", "branch-map")]
    assert rows(R.packages_per_path(pk.where("path = '/c/b'"))) == [("/c/b", 2)]
    gone = pk.where("id in ('old', 'mate', 'outside')").select("id")
    assert rows(R.removable_paths(pk, gone, "/c")) == [("/c/a",)]


def test_clone_reuse_and_nearest(packages, make):
    pk = packages(dict(id="2", source_url="u", created_at=day(1), path="/c/2"), dict(id="1", source_url="u", path="/c/1"), dict(id="3"))
    assert rows(R.first_package_per_url(pk), "id", "path") == [("1", "/c/1")]
    homes = make("path string, identifier string", [("/a", "outer"), ("/a/b", "z"), ("/a/b", "y"), ("/a/bc", "other")])
    paths = make("path string, forced string", [("/a/b/c/d", None), ("/a/b", None), ("/a/x", None), ("/q", None), ("/q/r", "me"), ("/a/bcd", None)])
    assert rows(R.assign_package(paths, homes, "forced"), "path", "package") == [
        ("/a/b", "y"), ("/a/b/c/d", "y"), ("/a/bcd", "outer"), ("/a/x", "outer"), ("/q", None), ("/q/r", "me")]


def test_manifest(spark, packages, make, tmp_path):
    pk = packages(dict(id="1", identifier="a", source_url="u", harness="h", shallow=True), dict(id="2", identifier="b", source_type="local"), dict(id="3", identifier="c"))
    entries, skipped = RC.manifest_entries(pk)
    assert rows(skipped) == [("b",), ("c",)]
    RC.write_manifest(entries, str(tmp_path / "m"))
    assert rows(RC.read_manifest(spark, str(tmp_path / "m"))) == rows(entries)
    doc = tmp_path / "doc.json"
    doc.write_text('{\n  "version": 1,\n  "packages": [\n    {"identifier": "a", "git": "u", "auto_pull": false},\n    {"identifier": "b", "git": "v", "auto_pull": true, "shallow": true}\n  ]\n}\n')
    assert rows(RC.read_manifest(spark, str(doc)), "identifier", "auto_pull", "shallow", "prepare_scope") == [("a", False, False, "global"), ("b", True, True, "global")]
    with pytest.raises(Exception, match="unsupported manifest version 2"):
        RC.parse_manifest(make("manifest string", [('{"version":2,"packages":[]}',)])).count()
    status = R.import_status(RC.read_manifest(spark, str(doc)).withColumn("harness", F.when(F.col("identifier") == "b", "zz")), pk.where("identifier = 'a'"), make("name string", [("h",)]))
    assert rows(status, "identifier", "status") == [("a", "skipped"), ("b", "failed")]
    assert rows(R.import_tally(status)) == [("failed", 1), ("skipped", 1)]


def test_logs(spark, make, tmp_path):
    logs = spark.createDataFrame([("12345678-aa", "p", "@x/y", "q", "h", None, "2024-03-01T10:20:30+00:00", "2024-03-01T10:21:30+00:00", 0, "answer", None, None, None, "global")], schemas.LOG)
    RC.write_logs(logs, str(tmp_path / "logs"))
    back = RC.read_logs(spark, str(tmp_path / "logs"), multiline=False)
    assert rows(back, "id", "shown", "outcome") == [("12345678-aa", "answer", 0)]
    assert logs.select(RC.log_path(F.col("package_identifier"), F.to_timestamp("started_at"), F.col("id")).alias("p")).first().p == "%40x%2Fy/20240301-102030-12345678.json"
    raw = make("raw string", [('{"id": "1", "exit_code": 2}',), ("plain text",), ('{"id":"2","response":"r","exit_code":null}',)])
    assert rows(RC.parse_logs(raw), "id", "shown", "outcome") == [("1", '{"id": "1", "exit_code": 2}', 3), ("2", "r", 2), (None, "plain text", None)]


def test_prompts(packages, conversations, prepared, make):
    pk = packages(dict(id="1", identifier="a", display_name="Ay", shallow=True), dict(id="2", identifier="b"))
    cv = conversations(*(dict(id=f"c{i}", package_id="1", question=f"q{i}", created_at=day(i)) for i in range(5)))
    maps = prepared(dict(id="m", package_id="1", content="MAP", git_commit_sha="abc", created_at=dt.datetime(2024, 1, 2, 3, 4, 5, 60000)))
    asks = make("ask_id string, identifier string, question string, branch string, current_commit string, behind long",
                [("x", "a", "Why?", None, "def", 3), ("y", "b", "How?", None, None, None)])
    out = {r.ask_id: r.prompt for r in R.assemble_prompts(asks, pk, cv, maps, context=3, toolkit="\n[tools]\n").collect()}
    x = out["x"]
    assert x.startswith("You are answering a question about the Ay (a) codebase.\n")
    assert "shallow clone" in x and "(current HEAD `def`, 3 commits behind). Scope: `global`\nMAP\n---" in x
    assert "Prepared at 2024-01-02T03:04:05.060+00:00 on commit `abc`" in x
    assert x.index("- q4\n- q3\n- q2\n\n") < x.index("[tools]") < x.index("\nQuestion: Why?\n\nTreat the prepared")
    assert "q1" not in x and "few commits behind" in x
    assert out["y"].endswith("\nQuestion: How?\n\nExplore the codebase and answer precisely. Reference file paths.\n") and "MAP" not in out["y"]


def test_latest_maps_do_not_aggregate_their_text(prepared):
    maps = prepared(*(dict(id=f"{i:02}", package_id=f"p{i % 3}", git_branch="main" if i % 2 else None, content="text " * i, created_at=day(i % 4)) for i in range(20)))
    for out in (R.latest_global(maps), R.latest_per_branch(maps), R.latest_by_scope(maps, maps.selectExpr("package_id", "'global' AS prepare_scope", "'x' AS branch").distinct())):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert not any("content" in line for line in plan.splitlines() if "Aggregate" in line)
    every = [tuple(r) for r in maps.collect()]
    at = {c: i for i, c in enumerate(maps.columns)}
    for out, null in ((R.latest_global(maps), True), (R.latest_per_branch(maps), False)):
        best = {}
        for r in every:
            if (r[at["git_branch"]] is None) == null:
                key = r[at["package_id"]], r[at["git_branch"]]
                best[key] = max(best.get(key, r), r, key=lambda x: (x[at["created_at"]], x[at["id"]]))
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, best.values()))
