"""Walks over edge tables: reach by hop, impact of a symbol, cycles.

Each round is one job that writes its new rows as a table; the loop ends on the row
count of that write. All roots and all starts go through the same rounds. A small
frontier is broadcast by its size on disk; a large one joins by sort-merge, where
adaptive execution splits partitions that a hub node makes too big.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.paths import in_scope
from corpuslens.session import cut
from corpuslens.skew import salted_join

DEPS_DEFAULT = 1
IMPACT_DEFAULT = 1
TRIMS = 2


def hop_bound(hops: int | None, default: int) -> int:
    """The bound of a walk as asked for; a walk is never cut shorter than that."""
    hops = default if hops is None else hops
    if hops < 1:
        raise ValueError(f"a walk needs one hop at least, not {hops}")
    return hops


def resolved_edges(deps: DataFrame) -> DataFrame:
    """(root_path, src, dst) of the imports that were resolved."""
    return deps.where(F.col("importee_file").isNotNull()).select(
        "root_path", F.col("importer_file").alias("src"), F.col("importee_file").alias("dst")
    )


def reach(edges: DataFrame, starts: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Nodes reachable from each of ``starts(root_path, start)`` at their least hop (1 and up).

    A start counts as visited, so it is never listed for itself. Without ``max_hops``
    the walk goes on until nothing new is found.
    """
    links, n = cut(edges.select("root_path", "src", "dst").dropna().distinct(), "edges")
    at = starts.select("root_path", "start", F.col("start").alias("node")).distinct()
    empty = at.withColumn("hop", F.lit(1)).where(F.lit(False))
    rounds: list[DataFrame] = []
    hop = 0
    while n and (max_hops is None or hop < max_hops):
        hop += 1
        new = (
            at.withColumnRenamed("node", "src").join(links, ["root_path", "src"])
            .where(F.col("dst") != F.col("start"))
            .select("root_path", "start", F.col("dst").alias("node")).distinct()
        )
        if rounds:
            seen = reduce(DataFrame.unionByName, rounds).select("root_path", "start", "node")
            new = new.join(seen, ["root_path", "start", "node"], "left_anti")
        layer, n = cut(new.withColumn("hop", F.lit(hop)), "reach")
        if n:
            rounds.append(layer)
            at = layer.drop("hop")
    return reduce(DataFrame.unionByName, rounds) if rounds else empty


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select("root_path", F.col("dst").alias("src"), F.col("src").alias("dst"))


def deps(
    edges: DataFrame, starts: DataFrame, direction: str = "forward", hops: int | None = None
) -> DataFrame:
    """Dependency walk: (root_path, start, direction, hop, node); ``direction`` may be both."""
    n = hop_bound(hops, DEPS_DEFAULT)
    sides = {"forward": edges, "reverse": reversed_edges(edges)}
    chosen = list(sides) if direction == "both" else [direction]
    parts = [
        reach(sides[side], starts, n).select(
            "root_path", "start", F.lit(side).alias("direction"), "hop", "node"
        )
        for side in chosen
    ]
    return reduce(DataFrame.unionByName, parts)


def unresolved(dep_rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct targets of the starts' own imports that were not resolved."""
    open_targets = dep_rows.where(F.col("importee_file").isNull()).select(
        "root_path", F.col("importer_file").alias("start"), F.col("raw_target").alias("target")
    ).distinct()
    return open_targets.join(starts.select("root_path", "start").distinct(), ["root_path", "start"], "left_semi")


def closure(links: DataFrame) -> DataFrame:
    """(src, dst, hop) of all nodes that each node of ``links(src, dst)`` leads to, at their least hop; none leads to itself.

    What lies more than n hops away lies behind a node exactly n hops away, so each round doubles the hops that are known: as
    many rounds as the logarithm of the longest walk. Bounded by nothing but the result; for a few starts use :func:`reach`.
    """
    hop = 1
    layer, n = cut(links.where("src <> dst").select("src", "dst", F.lit(hop).alias("hop")).distinct(), "closure")
    known = layer
    while n:
        # Only what the last round found can be ``hop`` hops away.
        ends = layer.where(F.col("hop") == hop).select("src", F.col("dst").alias("mid"))
        on = known.select(F.col("src").alias("mid"), "dst", (F.col("hop") + hop).alias("hop"))
        found = ends.join(on, "mid").where("src <> dst").groupBy("src", "dst").agg(F.min("hop").alias("hop"))
        hop *= 2
        layer, n = cut(found.join(known.select("src", "dst"), ["src", "dst"], "left_anti"), "closure", F.count_if(F.col("hop") == hop))
        known = known.unionByName(layer)
    return known


def whole_walk_sizes(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(root_path, start, direction, hop, n): nodes per start, direction and hop of the walks both ways, on to their ends."""
    named, _ = cut(edges.select("root_path", "src", "dst").dropna().where("src <> dst").distinct(), "edges")
    names, links = _numbered(named)
    walk = closure(links)
    side = lambda end, direction: walk.select(F.col(end).alias("node"), F.lit(direction).alias("direction"), "hop")
    # What leads to a node is the same closure, seen from its other end.
    sizes = side("src", "forward").unionByName(side("dst", "reverse")).groupBy("node", "direction", "hop").agg(F.count(F.lit(1)).alias("n"))
    asked = names.withColumnRenamed("name", "start").join(starts.select("root_path", "start").distinct(), ["root_path", "start"], "left_semi")
    return sizes.join(asked, "node").select("root_path", "start", "direction", "hop", "n")


def hop_sizes(walk: DataFrame) -> DataFrame:
    """Nodes per start and hop."""
    return walk.groupBy("root_path", "start", "hop").agg(F.count(F.lit(1)).alias("n"))


def impact(callsites: DataFrame, starts: DataFrame, hops: int | None = None) -> DataFrame:
    """Callsites that use each start symbol, directly or through their callers, by hop.

    A site is its (file, line, callee); of equal sites the one with the least
    (kind, caller, no caller last) stays and alone passes its caller on.
    """
    n = hop_bound(hops, IMPACT_DEFAULT)
    kept = F.min(F.struct("callee_kind", F.col("caller_symbol").isNull(), "caller_symbol"))
    sites, _ = cut(
        callsites.groupBy("root_path", "caller_file", "caller_line", "callee_name")
        .agg(kept.alias("_k"))
        .select(
            "root_path", "caller_file", "caller_line", "callee_name",
            F.col("_k.callee_kind").alias("callee_kind"), F.col("_k.caller_symbol").alias("caller_symbol"),
        ),
        "sites",
    )
    first = starts.select(
        "root_path", "start", F.col("start").alias("callee_name"), F.lit(1).alias("hop")
    ).distinct()
    targets = first
    if n > 1:
        calls = sites.select("root_path", F.col("callee_name").alias("src"), F.col("caller_symbol").alias("dst"))
        further = reach(calls, starts, n - 1)
        targets = first.unionByName(
            further.select("root_path", "start", F.col("node").alias("callee_name"), (F.col("hop") + 1).alias("hop"))
        )
    return targets.join(sites, ["root_path", "callee_name"]).select(
        "root_path", "start", "hop", "caller_file", "caller_line", "caller_symbol", "callee_name", "callee_kind"
    )


def impact_definitions(symbols: DataFrame, starts: DataFrame) -> DataFrame:
    """The definition rows of each start's name, with all columns of ``symbols`` but ``name``, which is ``start``."""
    asked = starts.select("root_path", "start").distinct()
    # Any number of starts: one row per key, so adaptive execution may split a name that many files define.
    return symbols.withColumnRenamed("name", "start").join(asked, ["root_path", "start"])


def impact_in_scope(sites: DataFrame, scope: str) -> DataFrame:
    """Sites at or below ``scope``; applied after the walk, which may pass through other files."""
    return sites.where(in_scope(F.col("caller_file"), F.lit(scope)))


def impact_notes(
    symbols: DataFrame, starts: DataFrame, sites: DataFrame, scope: str | None = None
) -> DataFrame:
    """Per start: definitions of the name, sites kept and dropped by the scope, and a note."""
    keys = ["root_path", "start"]
    defs = symbols.groupBy("root_path", F.col("name").alias("start")).agg(F.count(F.lit(1)).alias("definitions"))
    inside = F.lit(True) if scope is None else in_scope(F.col("caller_file"), F.lit(scope))
    counts = sites.groupBy(*keys).agg(
        F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped")
    )
    # Wording of the note.
    many = F.when(
        F.col("definitions") > 1,
        F.concat(
            F.col("definitions").cast("string"),
            F.lit(" definitions of this name exist; name-based callsite matching may include unrelated references"),
        ),
    )
    lost = F.when(F.col("dropped") > 0, F.concat(F.col("dropped").cast("string"), F.lit(" references dropped by `--file` scope")))
    note = F.concat_ws("; ", many, lost)
    return (
        starts.select(*keys).distinct().join(defs, keys, "left").join(counts, keys, "left")
        .na.fill(0, ["definitions", "kept", "dropped"])
        .withColumn("note", F.when(note != "", note))
    )


def _trim(live: DataFrame) -> DataFrame:
    """Drop edges that cannot lie on a cycle: nothing leads to their source, or on from their target."""
    heads = live.select(F.col("dst").alias("src")).distinct()
    tails = live.select(F.col("src").alias("dst")).distinct()
    return live.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst")


def _labels(live: DataFrame) -> DataFrame:
    """(node, lo, hi): the least node that reaches it, and the least it reaches.

    Known labels are used as extra edges (lo -> node -> hi), so labels travel
    twice as far each round and a path of n edges takes about log n rounds.
    """
    ends = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct()
    state = ends.select("node", F.col("node").alias("lo"), F.col("node").alias("hi"))
    state, changed = cut(state, "labels")
    spark = live.sparkSession
    while changed:
        # min keeps one row per task and node before the shuffle, hubs included.
        step = spark.sql(_SPREAD, live=live, state=state)
        state, changed = cut(step, "labels", F.count_if(F.col("moved")))
        state = state.drop("moved")
    return state


# Labels move along edges and along what is known (lo -> node -> hi); one statement, so one analysis a round.
_SPREAD = """
    WITH along AS (
      SELECT src, dst FROM {live}
      UNION ALL SELECT lo, node FROM {state} WHERE lo <> node
      UNION ALL SELECT node, hi FROM {state} WHERE hi <> node),
    sent AS (
      SELECT inline(array(
          named_struct('node', a.dst, 'lo', s.lo, 'hi', CAST(NULL AS BIGINT)),
          named_struct('node', a.src, 'lo', CAST(NULL AS BIGINT), 'hi', d.hi)))
      FROM along a JOIN {state} s ON a.src = s.node JOIN {state} d ON a.dst = d.node),
    merged AS (
      SELECT node, min(lo) AS lo, min(hi) AS hi, min(was_lo) AS was_lo, min(was_hi) AS was_hi
      FROM (SELECT *, CAST(NULL AS BIGINT) AS was_lo, CAST(NULL AS BIGINT) AS was_hi FROM sent
            UNION ALL SELECT node, lo, hi, lo, hi FROM {state})
      GROUP BY node)
    SELECT node, lo, hi, lo <> was_lo OR hi <> was_hi AS moved FROM merged
"""


def _numbered(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, edges): nodes numbered once in the order of their names, and edges of these numbers.

    Rounds then move and compare single whole numbers, and the least number is the least name.
    """
    ends = links.select("root_path", F.col("src").alias("name")).union(links.select("root_path", "dst")).distinct()
    names, _ = cut(ends.orderBy("root_path", "name").withColumn("node", F.monotonically_increasing_id()), "names")
    out = links
    for side in ("src", "dst"):
        out = out.join(names.select("root_path", F.col("name").alias(side), F.col("node").alias(f"_{side}")), ["root_path", side])
    return names, out.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def cycles(edges: DataFrame) -> DataFrame:
    """Import cycles: (root_path, component, size, member), one row per file on a cycle.

    A cycle is a strongly connected component of two or more nodes, or one node with
    an edge to itself; it is named by its least member. Nodes whose least ancestor
    and least descendant are the same node form one component with it; they are taken
    out, and edges between nodes of different labels cannot lie on a cycle and go.
    The least node of every part left is settled each time, so the loop ends.
    """
    links, _ = cut(edges.select("root_path", "src", "dst").dropna().distinct(), "edges")
    loops = links.where("src = dst").select("root_path", F.col("src").alias("component"), F.col("src").alias("member"))
    names, live = _numbered(links.where("src <> dst"))
    live, n = cut(live, "live")
    # Peel what leads into and out of cycles; a few passes, the labels settle the rest.
    for _ in range(TRIMS):
        before = n
        live, n = cut(_trim(_trim(live)), "live") if n else (live, n)
        if n == before:
            break
    found: list[DataFrame] = []
    while n:
        labels = _labels(live)
        found.append(labels.where("lo = hi").select(F.col("lo").alias("component"), F.col("node").alias("member")))
        rest = labels.where("lo <> hi")
        kept = live.join(rest.select(F.col("node").alias("src"), "lo", "hi"), "src").join(
            rest.select(F.col("node").alias("dst"), "lo", "hi"), ["dst", "lo", "hi"]
        )
        live, n = cut(_trim(kept.select("src", "dst")), "live")
    if not found:
        return loops.select("root_path", "component", F.lit(1).cast("long").alias("size"), "member")
    members = reduce(DataFrame.unionByName, found)
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    big = salted_join(members, sizes, ["component"], "inner", ["member"])
    big = big.join(names.select(F.col("node").alias("member"), "root_path", F.col("name").alias("_member")), "member").join(
        names.select(F.col("node").alias("component"), F.col("name").alias("_component")), "component"
    ).select("root_path", F.col("_component").alias("component"), "size", F.col("_member").alias("member"))
    alone = loops.join(big.select("root_path", "member"), ["root_path", "member"], "left_anti")
    return big.unionByName(
        alone.select("root_path", "component", F.lit(1).cast("long").alias("size"), "member")
    )


CYCLE_ORDER = ["root_path", "size", "component", "member"]


def cycles_ordered(cycle_rows: DataFrame) -> DataFrame:
    """By size, then names: parts are disjoint, so the least member decides between equals."""
    return cycle_rows.orderBy(*CYCLE_ORDER)
