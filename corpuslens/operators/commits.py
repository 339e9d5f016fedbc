"""Commits ahead and behind, by lines of history rather than by commits.

Histories are cut into lines: runs of commits in which each is the next one's parent. What a commit
reaches on a line is all of it up to some place, so a set of ancestors is one number per line
reached. Lines and places come from pointer doubling, in about two times log2 of the longest
history jobs; a walk then goes from line to line, and never lists ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import cut

# A commit's pointer leads 2^k commits up; ``size`` counts what is below it as far as pointers reach.
_JUMP = """
    WITH below AS (SELECT up AS node, sum(size) AS more FROM {s} WHERE up IS NOT NULL GROUP BY up)
    SELECT s.node, t.up, s.depth + coalesce(t.depth, 0) AS depth, s.size + coalesce(b.more, 0) AS size
    FROM {s} s LEFT JOIN {s} t ON s.up = t.node LEFT JOIN below b ON s.node = b.node
"""
# Down to the first commit of a line; ``low`` is known once there is no pointer.
_SINK = "SELECT s.node, t.up, coalesce(s.low, t.low) AS low FROM {s} s LEFT JOIN {s} t ON s.up = t.node"

# A round of the walk. Of a line, places up to b are the base's, and those above it, up to h, are the head's alone. Only
# what became known since the last round (beyond hd and bd) is left through its side exits; the head's side takes
# no exit that the base has, so what both reach is dropped.
_WALK = """
    WITH fresh AS (
      SELECT s.base, s.head, c.to_line AS line, if(c.place > s.b, c.to_place, 0) AS h, if(c.place > s.b, 0, c.to_place) AS b
      FROM {s} s JOIN {cross} c ON s.line = c.line
      WHERE c.place > least(greatest(s.hd, s.b), s.bd) AND c.place <= greatest(s.h, s.b)
        AND ((c.place > greatest(s.hd, s.b) AND c.place <= s.h) OR (c.place > s.bd AND c.place <= s.b))),
    merged AS (
      SELECT base, head, line, max(h) AS h, max(b) AS b, max(hd) AS hd, max(bd) AS bd
      FROM (SELECT base, head, line, h, b, greatest(h, hd) AS hd, b AS bd FROM {s}
            UNION ALL SELECT base, head, line, h, b, 0, 0 FROM fresh)
      GROUP BY base, head, line)
    SELECT * FROM merged
"""
_OPEN = "count_if(h > greatest(hd, b) OR b > bd)"


def history_lines(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of ``commits(root_path, sha, parent)``, and the ways between them.

    First (root_path, sha, own, node, line, place): a commit's number, its line, and its place on it from 1 up, away from the
    root; ``own`` is false for parents that have no row themselves. Then (line, place, to_line, to_place) for each parent that
    is not the next commit of the same line. A column ``place`` of ``commits``, if there is one, orders a commit's parents.

    Each commit follows its first parent, which makes a forest; of several commits that follow the same parent, the one with
    most commits above it has the line, so that a path to the root changes lines log2 n times at most by such forks. The other
    changes are merges.
    """
    spark = commits.sparkSession
    order = F.col("place") if "place" in commits.columns else F.lit(0)
    rows, _ = cut(commits.select("root_path", "sha", "parent", order.alias("place")).where("sha is not null"), "commits")
    ends = rows.select("root_path", "sha", F.lit(True).alias("own")).unionByName(
        rows.where("parent is not null").select("root_path", F.col("parent").alias("sha"), F.lit(False).alias("own")))
    names, total = cut(ends.groupBy("root_path", "sha").agg(F.max("own").alias("own")).withColumn("node", F.monotonically_increasing_id()), "names")
    of = lambda name, as_: names.select("root_path", F.col("sha").alias(name), F.col("node").alias(as_))
    edges = rows.where("parent is not null").groupBy("root_path", "sha", "parent").agg(F.min("place").alias("place"))
    edges, _ = cut(edges.join(of("sha", "child"), ["root_path", "sha"]).join(of("parent", "up"), ["root_path", "parent"]).select("child", "up", "place"), "edges")
    follows = edges.groupBy("child").agg(F.min(F.struct("place", "up"))["up"].alias("up"))
    begin = names.select("node").join(follows, F.col("node") == F.col("child"), "left").select(
        "node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.lit(1).cast("long").alias("size"))
    state, left = cut(begin, "forest", F.count("up"))
    first, rounds = state, 0
    while left:
        rounds += 1
        if rounds > total.bit_length() + 1:
            raise ValueError("a commit is its own ancestor")
        state, left = cut(spark.sql(_JUMP, s=state), "forest", F.count("up"))
    heir = first.where("up is not null").select("node", "up").join(state.select("node", "size"), "node").groupBy("up").agg(
        F.max(F.struct("size", "node"))["node"].alias("node"))
    heir, _ = cut(heir, "heirs")
    low = names.select("node").join(heir, "node", "left").select("node", "up", F.when(F.col("up").isNull(), F.col("node")).alias("low"))
    low, left = cut(low, "lines", F.count("up"))
    while left:
        low, left = cut(spark.sql(_SINK, s=low), "lines", F.count("up"))
    depth = state.select("node", "depth")
    at = low.select("node", "low").join(depth, "node").join(depth.select(F.col("node").alias("low"), F.col("depth").alias("_from")), "low")
    lines, _ = cut(names.join(at.select("node", F.col("low").alias("line"), (F.col("depth") - F.col("_from") + 1).alias("place")), "node"), "placed")
    end = lambda node, line, place: lines.select(F.col("node").alias(node), F.col("line").alias(line), F.col("place").alias(place))
    side = edges.select("child", "up").join(heir.select(F.col("node").alias("child"), "up"), ["child", "up"], "left_anti")
    cross, _ = cut(side.join(end("child", "line", "place"), "child").join(end("up", "to_line", "to_place"), "up").select("line", "place", "to_line", "to_place"), "cross")
    return lines, cross


def ahead_count(commits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Commits reachable from ``head`` but not from ``base``: (root_path, base, head, ahead).

    ``commits(root_path, sha, parent)`` has one row per parent (null for none);
    a pair with an unknown commit gets null. Both ends walk at once, a line in one step; rounds are as many as the changes
    of line on the way, and a round's rows are (pair, line).
    """
    ask, some = cut(pairs.select("root_path", "base", "head").distinct(), "pairs")
    if not some:
        return ask.select("root_path", "base", "head", F.lit(None).cast("long").alias("ahead"))
    lines, cross = history_lines(commits.join(ask.select("root_path").distinct(), "root_path", "left_semi"))
    end = lambda name, short: lines.where("own").select(
        "root_path", F.col("sha").alias(name), F.struct("node", "line", "place").alias(short))
    ask = ask.join(end("base", "b"), ["root_path", "base"], "left").join(end("head", "h"), ["root_path", "head"], "left")
    real = ask.where("b is not null and h is not null and b.node <> h.node").select(F.col("b.node").alias("base"), F.col("h.node").alias("head"), "b", "h")
    zero = F.lit(0).cast("long")
    state = real.select("base", "head", F.col("h.line").alias("line"), F.col("h.place").alias("h"), zero.alias("b")).unionByName(
        real.select("base", "head", F.col("b.line").alias("line"), zero.alias("h"), F.col("b.place").alias("b")))
    state, left = cut(state.groupBy("base", "head", "line").agg(F.max("h").alias("h"), F.max("b").alias("b")).withColumns({"hd": zero, "bd": zero}), "walk", F.count(F.lit(1)))
    while left:
        state, left = cut(commits.sparkSession.sql(_WALK, s=state, cross=cross), "walk", F.expr(_OPEN))
    only = state.groupBy(F.col("base").alias("_b"), F.col("head").alias("_h")).agg(F.sum(F.greatest(F.col("h") - F.col("b"), zero)).alias("n"))
    known = F.col("b").isNotNull() & F.col("h").isNotNull()
    return ask.join(only, (F.col("b.node") == F.col("_b")) & (F.col("h.node") == F.col("_h")), "left").select(
        "root_path", "base", "head", F.when(known, F.coalesce("n", zero)).alias("ahead"))


def commits_behind(commits: DataFrame, asks: DataFrame) -> DataFrame:
    """Adds ``behind`` to ``asks(root_path, recorded, current, ..)``.

    Equal commits are 0 without a walk, a missing one is null; only pairs that differ are walked.
    """
    differ = asks.where(F.col("recorded") != F.col("current")).select(
        "root_path", F.col("recorded").alias("base"), F.col("current").alias("head")
    ).distinct()
    walked = ahead_count(commits, differ).select(
        "root_path", F.col("base").alias("recorded"), F.col("head").alias("current"), F.col("ahead").alias("_n")
    )
    return asks.join(walked, ["root_path", "recorded", "current"], "left").withColumn(
        "behind", F.when(F.col("recorded") == F.col("current"), F.lit(0).cast("long")).otherwise(F.col("_n"))
    ).drop("_n")
