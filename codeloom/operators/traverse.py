"""Traversals: reachability and paths by frontier loops, components by star contraction.

Reachability visits every node once at its smallest depth: the frontier joins the edges, and what was seen is anti-joined.
Paths carry the nodes they have passed as an array. Each round is written to the work folder, so the plan stays short, a
lost executor costs one round, and there is no limit on depth or rows. Keys are data and never part of a query's text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.work import all_stars, materialize, meet, small


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """src, dst along the direction: out, in or both."""
    out = edges.select(F.col("src_key").alias("src"), F.col("dst_key").alias("dst"))
    back = edges.select(F.col("dst_key").alias("src"), F.col("src_key").alias("dst"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def reachable(edges: DataFrame, starts: DataFrame, direction: str = "out", depth: int | None = None, until: Column | None = None, with_start: bool = False, single: bool = False) -> DataFrame:
    """node_key, depth of all nodes that the starts (node_key) reach; the starts only with_start, or if a cycle leads back.

    single: the edges are a written table without repeats, which is not written again.

    until: a condition on node_key; nodes that meet it are returned and not expanded. depth None or 0: no bound.
    """
    hops = directed(edges, direction) if single else materialize(directed(edges, direction).distinct(), "hops")
    front = starts = materialize(starts.select("node_key").distinct(), "front")
    first = small(starts.withColumn("start", F.lit(True)))
    found, level = None, 0
    while level < (depth or 1 << 30):
        level += 1
        step = hops.join(small(front.withColumnRenamed("node_key", "src")), "src").select(F.col("dst").alias("node_key")).distinct()
        if found is not None:
            step = step.join(found.select("node_key"), "node_key", "left_anti")
        # A start that is met again is found, once, and not expanded a second time.
        new = step.join(first, "node_key", "left").select("node_key", F.lit(level).alias("depth"), F.coalesce("start", F.lit(False)).alias("start"))
        new = materialize(new, "front")
        if new.isEmpty():
            break
        found = new if found is None else _short(found.unionByName(new), level)
        front = new.filter("NOT start").select("node_key") if until is None else new.filter("NOT start").filter(~until).select("node_key")
    if found is None:
        found = starts.limit(0).select("node_key", F.lit(0).alias("depth"), F.lit(False).alias("start"))
    if with_start:
        return starts.withColumn("depth", F.lit(0)).unionByName(found.filter("NOT start").select("node_key", "depth"))
    return found.select("node_key", "depth")


def _short(seen: DataFrame, level: int) -> DataFrame:
    """A growing union, written as one table every few rounds, so that its plan stays short."""
    return seen if level % 8 else materialize(seen, "seen")


def _start(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.sparkSession.createDataFrame([(k,) for k in keys], "node_key string")


def walk(hops: DataFrame, front: DataFrame, depth: int, stop: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """node, path, n, done and the columns of hops to carry: every way along hops (src, dst) that repeats no node.

    front: node, path, n. stop: a condition on dst; ways that meet it are done and go no further. If hops has a column left,
    the least number of steps from dst to a goal, ways that cannot reach it within depth are not followed.
    """
    has_goal = "left" in hops.columns
    front = front.select("node", "path", "n", F.lit(False).alias("done"), *(F.lit(None).cast(hops.schema[c].dataType).alias(c) for c in carry))
    out, level = front, 0
    for _ in range(depth):
        open_ = front.filter("NOT done").select("node", "path", "n")
        step = open_.join(hops, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        if has_goal:
            step = step.filter(F.col("n") + 1 + F.col("left") <= depth)
        done = F.lit(False) if stop is None else stop
        front = materialize(step.select(F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("n") + 1).alias("n"), done.alias("done"), *carry), "walk")
        if front.isEmpty():
            break
        level += 1
        out = _short(out.unionByName(front), level)
    return out


def _from(starts: DataFrame) -> DataFrame:
    return starts.select("node_key").distinct().select(F.col("node_key").alias("node"), F.array("node_key").alias("path"), F.lit(0).alias("n"))


def _towards(edges: DataFrame, goals: DataFrame, direction: str, depth: int) -> DataFrame:
    """src, dst, left of the edges on some way of at most depth to a goal."""
    opposite = {"out": "in", "in": "out", "both": "both"}[direction]
    near = reachable(edges, goals, opposite, depth, with_start=True).select(F.col("node_key").alias("dst"), F.col("depth").alias("left"))
    return materialize(directed(edges, direction).distinct().join(small(materialize(near, "near")), "dst"), "hops")


def paths(edges: DataFrame, starts: DataFrame, direction: str = "out", depth: int = 10, target: str | None = None, until: Column | None = None) -> DataFrame:
    """path, n of simple paths as arrays: maximal ones, or cut at depth, or ending at target or where until (a condition on dst) holds.

    With a target, only edges from which it can still be reached in time are followed.
    """
    if target is not None:
        hops = _towards(edges, _start(edges, [target]), direction, depth)
    else:
        hops = materialize(directed(edges, direction).distinct(), "hops")
    stop = until
    if target is not None:
        stop = F.col("dst") == target if until is None else (F.col("dst") == target) | until
    found = walk(hops, _from(starts), depth, stop)
    if target is not None:
        return found.filter("done").select("path", "n")
    # A path is maximal if it is done, cut, or has no edge to a node that is not on it.
    onward = found.filter(~F.col("done") & (F.col("n") < depth)).join(hops, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select("path").distinct()
    return found.filter("n > 0").join(onward, "path", "left_anti").select("path", "n")


def nearest_paths(edges: DataFrame, goal: str, direction: str = "out") -> DataFrame:
    """node_key, depth, path: for every node that leads to the goal a shortest way there, of several the first by its keys.

    One search back from the goal in which each node takes over the way of its next node, so no ways are enumerated.
    """
    back = materialize(directed(edges, {"out": "in", "in": "out", "both": "both"}[direction]).distinct(), "hops")
    front = _start(edges, [goal]).select("node_key", F.lit(0).alias("depth"), F.array("node_key").alias("path"))
    seen, level = front, 0
    while True:
        level += 1
        step = back.join(small(front.select(F.col("node_key").alias("src"), "path")), "src").groupBy(F.col("dst").alias("node_key")).agg(F.min("path").alias("path"))
        step = step.join(seen.select("node_key"), "node_key", "left_anti").select("node_key", F.lit(level).alias("depth"), F.concat(F.array("node_key"), "path").alias("path"))
        front = materialize(step, "front")
        if front.isEmpty():
            return seen.filter("depth > 0")
        seen = _short(seen.unionByName(front), level)


def trace_rows(edges: DataFrame, start: str, direction: str = "out", depth: int = 5) -> DataFrame:
    """path, node_key, depth, more: a call tree as rows; more counts the distinct neighbours of a node cut off by depth."""
    hops = materialize(directed(edges, direction).distinct(), "hops")
    found = walk(hops, _from(_start(edges, [start])), depth)
    cut = found.filter(F.col("n") == depth).join(hops, F.col("node") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).groupBy("path").agg(F.count(F.lit(1)).alias("more"))
    return found.join(cut, "path", "left").select(F.array_join("path", " > ").alias("path"), F.col("node").alias("node_key"), F.col("n").alias("depth"), F.coalesce("more", F.lit(0)).cast("long").alias("more"))


def trace(edges: DataFrame, start: str, depth: int = 5, most: int = 200, skip_builtins: bool = True) -> DataFrame:
    """direction, path, node_key, depth, more: callers (in) and callees (out) that share one budget of most nodes.

    Nodes come by depth, direction and path; more counts the distinct neighbours of a node that depth or the budget leaves out.
    The budget holds at every depth, so a tree of any width costs no more than its part of it.
    """
    ways = [directed(edges, d).distinct().withColumn("direction", F.lit(d)) for d in ("in", "out")]
    hops = ways[0].unionByName(ways[1])
    if skip_builtins:
        hops = hops.filter(~F.col("dst").startswith("builtin:"))
    hops = materialize(hops, "hops")
    two = _start(edges, [start]).crossJoin(edges.sparkSession.createDataFrame([("in",), ("out",)], "direction string"))  # two rows
    front = two.select("direction", F.col("node_key").alias("node"), F.array("node_key").alias("path"), F.lit(0).alias("n"))
    out, eligible, left = front, None, most
    for _ in range(depth + 1):
        step = front.join(hops.withColumnRenamed("direction", "_d"), (F.col("node") == F.col("src")) & (F.col("direction") == F.col("_d"))).filter(~F.array_contains("path", F.col("dst")))
        step = materialize(step.select("direction", F.col("dst").alias("node"), F.col("path").alias("parent"), F.array_append("path", F.col("dst")).alias("path"), (F.col("n") + 1).alias("n")), "trace")
        eligible = step.select("direction", "parent") if eligible is None else eligible.unionByName(step.select("direction", "parent"))
        front = step.filter(F.col("n") <= depth).orderBy("direction", "path").limit(left).select("direction", "node", "path", "n")
        front = materialize(front, "front")
        got = front.count()
        left -= got
        if not got:
            break
        out = out.unionByName(front)
    of = eligible.groupBy("direction", F.col("parent").alias("path")).agg(F.count(F.lit(1)).alias("all"))
    shown = out.filter("n > 0").groupBy("direction", F.slice("path", 1, F.col("n")).alias("path")).agg(F.count(F.lit(1)).alias("shown"))
    met = out.join(of, ["direction", "path"], "left").join(shown, ["direction", "path"], "left")
    more = (F.coalesce("all", F.lit(0)) - F.coalesce("shown", F.lit(0))).cast("long")
    return met.select("direction", F.array_join("path", " > ").alias("path"), F.col("node").alias("node_key"), F.col("n").alias("depth"), more.alias("more"))


def chain_files(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """file, nodes, n: the files of what a trace (node_key) touches, those with most nodes first."""
    met = found.select("node_key").distinct().join(nodes.select("node_key", "file").filter("file IS NOT NULL"), "node_key")
    return met.groupBy("file").agg(F.array_sort(F.collect_set("node_key")).alias("nodes"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file")


def in_files(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, file, node_key: the nodes of the files that a path (wanted) names: the very path, else every file that ends in it.

    Every file is expanded into its own suffixes at separators, so the two sides meet in an equi-join.
    """
    files = nodes.filter("file IS NOT NULL").select("file").distinct()
    parts = F.split("file", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    met = files.select("file", F.explode(ends).alias("end")).join(small(wanted.select("wanted").distinct()), F.col("end") == F.regexp_replace("wanted", "^(?:\\./|/)+", ""))
    exact = F.max(F.when(F.col("file") == F.col("wanted"), 1).otherwise(0)).over(Window.partitionBy("wanted"))
    met = met.withColumn("_exact", exact).filter("_exact = 0 OR file = wanted")
    return met.select("wanted", "file").join(nodes.select("file", "node_key"), "file").select("wanted", "file", "node_key")


def impact(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 1) -> DataFrame:
    """direction, node_key, file, depth: what the starts (node_key) reach and what reaches them, each node once a direction."""
    # Both directions go along the same pairs, which are found once among all edges.
    edges, starts = materialize(edges.select("src_key", "dst_key").distinct(), "pairs"), materialize(starts.select("node_key").distinct(), "starts")
    sides = [reachable(edges, starts, d, depth, single=True).join(starts.select("node_key").distinct(), "node_key", "left_anti").withColumn("direction", F.lit(d)) for d in ("in", "out")]
    met = sides[0].unionByName(sides[1]).join(nodes.select("node_key", "file"), "node_key", "left")
    return met.select("direction", "node_key", "file", "depth")


def inspect(edges: DataFrame, targets: list[str], depth: int = 6, per_pair: int = 10, total: int = 100) -> tuple[DataFrame, DataFrame]:
    """Paths between every ordered pair of the given targets, shortest first; and how many there are of each pair, zeros included.

    All pairs share one walk; ways from which no target can be reached in time are not followed.
    """
    ends = _start(edges, targets).distinct()
    hops = _towards(edges, ends, "out", depth)
    hit = walk(hops, _from(ends), depth).filter("n > 0").join(F.broadcast(ends.withColumnRenamed("node_key", "node")), "node", "left_semi")  # a list that a user names
    hit = materialize(hit.select(F.col("path")[0].alias("from_key"), F.col("node").alias("to_key"), "n", F.array_join("path", " > ").alias("path")), "inspect")
    rank = F.row_number().over(Window.partitionBy("from_key", "to_key").orderBy("n", "path"))
    best = hit.withColumn("rank", rank).filter(F.col("rank") <= per_pair).orderBy("n", "from_key", "to_key", "path").limit(total)
    pairs = edges.sparkSession.createDataFrame([(a, b) for a in targets for b in targets if a != b], "from_key string, to_key string")
    matrix = pairs.join(hit.groupBy("from_key", "to_key").agg(F.count(F.lit(1)).alias("n")), ["from_key", "to_key"], "left").select("from_key", "to_key", F.coalesce("n", F.lit(0)).cast("long").alias("n_paths"))
    return best.select("from_key", "to_key", "n", "path", "rank"), matrix


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node_key, component: the smallest key that undirected edges (src_key, dst_key) reach. Nodes without edges are their own.

    Alternating large-star and small-star steps until all edges are stars; the number of rounds follows the logarithm of the
    size, not the diameter.
    """

    def least_met(pairs: DataFrame) -> DataFrame:
        least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "cc-least")
        return meet(pairs, least, ["u"], "n", F.col("v"), "_m").select("u", "v", F.col("_m.m").alias("m"))

    e = materialize(edges.filter("src_key <> dst_key").select(F.greatest("src_key", "dst_key").alias("u"), F.least("src_key", "dst_key").alias("v")).distinct(), "cc")
    while not all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least_met(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        met = least_met(materialize(large, "cc-large"))
        e = materialize(met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc")
    found = e.select(F.col("u").alias("node_key"), F.col("v").alias("component"))
    if nodes is None:
        return found.unionByName(found.select(F.col("component").alias("node_key"), "component").distinct())
    return nodes.select("node_key").join(found, "node_key", "left").select("node_key", F.coalesce("component", "node_key").alias("component"))


def _rake(left: DataFrame) -> DataFrame:
    """Edges (s, d) between nodes that have edges both in and out: others cannot be in a component of several."""
    ends, begins = left.select(F.col("d").alias("s")).distinct(), left.select(F.col("s").alias("d")).distinct()
    return materialize(left.join(ends, "s", "left_semi").join(begins, "d", "left_semi").select("s", "d"), "scc")


def _compress(left: DataFrame) -> tuple[DataFrame, tuple[list[DataFrame], DataFrame, DataFrame] | None]:
    """Edges without the nodes that have one edge out, and what _expand needs to place these nodes.

    Such nodes form ways; pointer jumping finds where each way ends, in rounds that follow the logarithm of its length. Edges
    into a way go to its end instead. A way without end runs into a ring, which is a component, and nothing comes back from it.
    """
    one = left.groupBy("s").agg(F.min("d").alias("j"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    jumps = materialize(one.select(F.col("s").alias("v"), "j", F.col("s").alias("m")), "jump")
    total = jumps.count()
    if not total:
        return left, None
    keys, steps = jumps.select("v"), [jumps]
    while 1 << (len(steps) - 1) < total:
        onward = jumps.select(F.col("v").alias("_v"), F.col("j").alias("_j"), F.col("m").alias("_m"))
        new = jumps.join(onward, F.col("j") == F.col("_v"), "left").select("v", F.coalesce("_j", "j").alias("j"), F.least("m", "_m").alias("m"), F.col("_v").isNotNull().alias("moved"))
        new = materialize(new, "jump")
        if new.filter("moved").isEmpty():
            break
        jumps = new.select("v", "j", "m")
        steps.append(jumps)
    # What has an end by now, and what runs in a ring. m is the smallest of all nodes that a node of a ring passes.
    inside = keys.select(F.col("v").alias("_v"))
    ended = materialize(jumps.join(inside, F.col("j") == F.col("_v"), "left_anti").select("v", F.col("j").alias("t")), "ended")
    ring = jumps.join(inside, F.col("j") == F.col("_v"), "left_semi").select(F.col("j").alias("_v")).distinct()
    ring = materialize(jumps.join(ring, F.col("v") == F.col("_v"), "left_semi").select(F.col("v").alias("k"), F.col("m").alias("c")), "ring")
    rest = left.join(keys, F.col("s") == F.col("v"), "left_anti")
    entries = materialize(rest.join(ended, F.col("d") == F.col("v")).select("s", "v", "t"), "entries")
    rest = rest.join(keys, F.col("d") == F.col("v"), "left_anti").unionByName(entries.select("s", F.col("t").alias("d")))
    return materialize(rest.filter("s <> d").distinct(), "scc"), (steps, entries, ring)


def _expand(stage: tuple[list[DataFrame], DataFrame, DataFrame], found: DataFrame) -> DataFrame:
    """found (k, c) with the nodes that _compress took out: those on a way from a component back to it, and rings.

    Where an edge of the component enters a way that ends in it, all of the way from there on belongs to it; marks go along
    by jumps of falling powers of two.
    """
    steps, entries, ring = stage
    of = lambda c: found.select(F.col("k").alias(f"_{c}"), F.col("c").alias(f"c{c}"))
    met = entries.join(of("s"), F.col("s") == F.col("_s"), "left").join(of("t"), F.col("t") == F.col("_t"), "left")
    met = met.withColumn("c", F.coalesce("ct", "t")).filter(F.coalesce("cs", "s") == F.col("c"))
    marks = materialize(met.select("v", "c").distinct(), "marks")
    if not marks.isEmpty():
        inside = steps[0].select(F.col("v").alias("_v"))
        for step in reversed(steps):
            ahead = marks.join(step.select("v", "j"), "v").join(inside, F.col("j") == F.col("_v"), "left_semi").select(F.col("j").alias("v"), "c")
            marks = materialize(marks.unionByName(ahead).distinct(), "marks")
    return materialize(found.unionByName(marks.select(F.col("v").alias("k"), "c")).unionByName(ring), "placed")


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node_key, scc: the smallest key of the strongly connected component, by contraction and colouring.

    Nodes without edges in or out are taken off, and ways of nodes with one edge out are contracted, until neither is left; so
    chains, trees and rings need rounds by the logarithm of their length. Each turn on the core that stays: the smallest key
    that reaches a node is its colour; of a colour, the nodes that lead back to the colour's own node are one component and
    leave. Then what was contracted is placed, in reverse. Edges to nodes that are not listed count; repeated edges and loops
    of one node change nothing.
    """
    left = materialize(edges.filter("src_key <> dst_key").select(F.col("src_key").alias("s"), F.col("dst_key").alias("d")).distinct(), "scc")
    found = materialize(left.limit(0).select(F.col("s").alias("k"), F.col("s").alias("c")), "placed")
    stages = []
    while not left.isEmpty():
        while (n := left.count()) > 0:
            left, stage = _compress(_rake(left))
            if stage is not None:
                stages.append(stage)
            if left.count() == n:
                break
        if left.isEmpty():
            break
        colour = left.select(F.explode(F.array("s", "d")).alias("k")).distinct().withColumn("c", F.col("k"))
        while True:
            pushed = left.join(colour, F.col("s") == F.col("k")).groupBy("d").agg(F.min("c").alias("p"))
            new = materialize(colour.join(pushed, F.col("k") == F.col("d"), "left").select("k", F.least("c", "p").alias("c"), F.coalesce(F.col("p") < F.col("c"), F.lit(False)).alias("moved")), "colour")
            colour = new.select("k", "c")
            if new.filter("moved").isEmpty():
                break
        # Backwards within a colour, from the node that gave it.
        same = materialize(left.join(colour.select(F.col("k").alias("s"), F.col("c").alias("cs")), "s").join(colour.select(F.col("k").alias("d"), F.col("c").alias("cd")), "d").filter("cs = cd").select("s", "d", F.col("cs").alias("c")), "same")
        got = colour.filter("k = c").select("k", "c")
        front = got
        while True:
            front = materialize(same.join(front.select(F.col("k").alias("d")), "d").select(F.col("s").alias("k"), "c").distinct().join(got.select("k"), "k", "left_anti"), "back")
            if front.isEmpty():
                break
            got = materialize(got.unionByName(front), "got")
        stages.append(got)
        gone = got.select("k")
        left = materialize(left.join(gone.withColumnRenamed("k", "s"), "s", "left_anti").join(gone.withColumnRenamed("k", "d"), "d", "left_anti").select("s", "d"), "scc")
    for stage in reversed(stages):
        found = materialize(found.unionByName(stage), "placed") if isinstance(stage, DataFrame) else _expand(stage, found)
    # A component is known by one of its nodes so far; its name is the smallest of all.
    all_of = found.unionByName(found.select(F.col("c").alias("k"), "c")).distinct()
    low = materialize(all_of.groupBy("c").agg(F.min("k").alias("scc"), F.count(F.lit(1)).alias("n")), "scc-names")
    named = meet(materialize(all_of, "scc-members"), low, ["c"], "n", F.col("k"), "_m").select("k", F.col("_m.scc").alias("scc"))
    return nodes.select("node_key").join(named, F.col("node_key") == F.col("k"), "left").select("node_key", F.coalesce("scc", "node_key").alias("scc"))


def cycles(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """scc, members: strongly connected components of more than one node."""
    return strong_components(edges, nodes).groupBy("scc").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
