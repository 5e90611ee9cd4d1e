"""Parent-child links to full hierarchies (problem 2): root, level, path, descendants and circles of a call graph.

Method: a weighted disjoint-set forest. Links of nodes with a single parent are combined inside each partition
(path compression with offsets to the local root; partitions are ranges of the key, so that a module stays
together and a hot module is split). Local roots whose own parent lies in another partition are then merged by
joining the contracted links with themselves, which doubles the span of every pointer, so that the rounds grow with
the logarithm of the depth and only contracted links are shuffled. Nodes with several parents, with a link to
themselves, or elected on a circle of single-parent links start trees of their own ("heads"). The graph between heads, which
is large where most keys have several callers, is contracted further: in each round an independent set of heads with few
links is taken out, and their callers are linked to their callees instead, which keeps all ways and adds no links. Each
round takes a share of the graph, however long it is, so that rounds grow with the logarithm of its size. What is left is
solved in one task once it has at most `LOCAL` links; a core that is too dense for it and larger than that is
trimmed and coloured, in rounds that follow the core's own length. Circles and what lies below them are then carried back to the heads
taken out, in reverse order. Paths and marks follow indexed parent jumps of 1, 2, 4, ...
links. Nothing is gathered on the driver but row counts.

Defined results: white space in keys is ignored, links to unknown keys, null and blank references are no links,
repeated rows count once, null keys are skipped, empty tables give an empty result. A key with several callers of
which none is on or below a circle hangs below the caller with the smallest key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrain.operators.orphans import squeeze
from flowgrain.session import cut

#: Links of the contracted graph between heads that one task solves, at most.
LOCAL = 400_000
#: A head may be taken out if that adds at most so many links, or no more than it has.
FILL = 16
#: The contraction ends when a round takes out less than this share of the heads, or when links have grown to so many times what they were.
TAKES, GROWN = 0.02, 3


def call_links(entries: DataFrame, key: str = "function_key", calls: str = "calls_ids", called_by: str = "called_by_ids") -> tuple[DataFrame, DataFrame]:
    """`nodes` (id, key), ids in the order of the keys, and the distinct `links` (parent, child) between nodes.

    A link counts if either side states it and both are keys.
    """
    own = entries.select(squeeze(F.col(key)).alias("key"), calls, called_by).where("key != ''")
    nodes = cut(own.select("key").distinct().repartitionByRange("key").withColumn("id", F.monotonically_increasing_id()))
    stated = own.select("key", F.explode(F.array_distinct(F.transform(calls, squeeze))).alias("other"), F.lit(True).alias("down")).unionByName(
        own.select("key", F.explode(F.array_distinct(F.transform(called_by, squeeze))).alias("other"), F.lit(False).alias("down"))
    )
    pairs = stated.where("other != ''").select(F.expr("if(down, key, other)").alias("p"), F.expr("if(down, other, key)").alias("c")).distinct()
    links = pairs.join(nodes.select(F.col("key").alias("p"), F.col("id").alias("parent")), "p").join(nodes.select(F.col("key").alias("c"), F.col("id").alias("child")), "c")
    return nodes, cut(links.select("parent", "child"))


def _compress(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weighted union-find over one partition's rows (id, up, kind), kind: 0 root, 1 linked, 2 head.

    Gives (id, up, off, state, clean); state: 0 `up` is a root or head, 1 `up` is a local root linked elsewhere,
    2 this is such a local root and `up` its parent elsewhere. clean: `up` is a root without callers.
    """
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    df = pd.concat(rows, ignore_index=True).sort_values("id", ignore_index=True)
    ids, kind, ups = df["id"].to_numpy(), df["kind"].to_numpy().copy(), df["up"].fillna(-1).to_numpy().astype("int64")
    n = len(ids)
    at = np.minimum(np.searchsorted(ids, ups), n - 1)
    linked = (kind == 1) & (ids[at] == ups)
    while True:
        to, off, low = np.where(linked, at, np.arange(n)), linked.astype("int64"), np.minimum(np.arange(n), np.where(linked, at, n))
        for _ in range(max(1, n.bit_length())):
            off, low, to = off + off[to], np.minimum(low, low[to]), to[to]
        loose = linked[to]
        if not loose.any():
            break
        heads = np.unique(low[loose])  # one of every local circle at least; a head more does no harm
        kind[heads], linked[heads] = 2, False
    away = (kind == 1) & ~linked
    state = np.where(away, 2, np.where(kind[to] == 1, 1, 0))
    yield pd.DataFrame({"id": ids, "up": np.where(away, ups, ids[to]), "off": np.where(away, 1, off), "state": state.astype("int32"), "clean": np.where(away, False, kind[to] == 0)})


def _jump(links: DataFrame) -> DataFrame:
    """Follows `up` of (id, up, off, done, clean) to a row that is done or to an id that is no row; circles get heads.

    Each round doubles the span. A round that ends no pointer leaves only pointers into circles; the smallest ids seen
    by them become heads, of which each circle then has one at least, and the rest is followed again.
    """
    ended = None
    open_links = cut(links)
    while True:
        b, left = open_links.withColumn("low", F.least("id", "up")), -1
        while True:
            now = b.where("not done").count()
            if now == 0 or now == left:
                break
            left = now
            t = b.select(F.col("id").alias("t"), F.col("up").alias("t_up"), F.col("off").alias("t_off"), F.col("done").alias("t_done"), F.col("clean").alias("t_clean"), F.col("low").alias("t_low"))
            todo = b.where("not done").join(t, F.col("up") == F.col("t"), "left")
            b = cut(
                todo.select("id", F.coalesce("t_up", "up").alias("up"), (F.col("off") + F.coalesce("t_off", F.lit(0))).alias("off"), F.coalesce("t_done", F.lit(True)).alias("done"), F.coalesce("t_clean", "clean").alias("clean"), F.least("low", "t_low").alias("low")).unionByName(b.where("done"))
            )
        done = b.where("done").drop("low")
        ended = done if ended is None else ended.unionByName(done)
        if now == 0:
            return ended
        rest = b.where("not done")
        heads = rest.select(F.col("low").alias("id")).distinct().withColumn("head", F.lit(True))
        again = open_links.join(rest.select("id"), "id", "left_semi").join(heads, "id", "left")
        open_links = cut(again.select("id", F.expr("if(head, id, up)").alias("up"), F.expr("if(head, 0, off)").cast("long").alias("off"), F.expr("coalesce(head, done)").alias("done"), F.expr("if(head, false, clean)").alias("clean")))


def _circles(edges: DataFrame) -> DataFrame | None:
    """(id, circle) of the nodes of the strongly connected components of two nodes or more; None if there are none."""
    found, left = None, cut(edges.where("a != h").select("a", "h").distinct())
    n = left.count()
    while n:
        while True:  # drop what has no way in or no way out
            left = cut(left.join(left.select(F.col("h").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("h")).distinct(), "h", "left_semi"))
            n, before = left.count(), n
            if n in (0, before):
                break
        if not n:
            break
        color, changed = left.select(F.col("a").alias("id")).union(left.select("h")).distinct().withColumn("color", F.col("id")), 1
        while changed:
            best = left.join(color.withColumnRenamed("id", "a"), "a").groupBy(F.col("h").alias("id")).agg(F.max("color").alias("new"))
            color = cut(color.join(best, "id", "left").select("id", F.greatest("color", "new").alias("color"), (F.col("new") > F.col("color")).alias("moved")))
            changed = color.where("moved").count()
            color = color.drop("moved")
        own = left.join(color.select(F.col("id").alias("a"), F.col("color").alias("ca")), "a").join(color.select(F.col("id").alias("h"), F.col("color").alias("ch")), "h")
        own = cut(own.where("ca = ch").select("a", "h", "ca"))
        reach, fresh = color.where("id = color"), color.where("id = color")
        while True:
            fresh = cut(own.join(fresh.select(F.col("id").alias("h")), "h").select(F.col("a").alias("id"), F.col("ca").alias("color")).distinct().join(reach.select("id"), "id", "left_anti"))
            if fresh.isEmpty():
                break
            reach = cut(reach.unionByName(fresh))
        big = reach.join(reach.groupBy("color").count().where("count > 1").select("color"), "color", "left_semi").select("id", F.col("color").alias("circle"))
        found = big if found is None else found.unionByName(big)
        left = cut(left.join(reach.select(F.col("id").alias("a")), "a", "left_anti").join(reach.select(F.col("id").alias("h")), "h", "left_anti"))
        n = left.count()
    return found


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, circle) of the ids of a bounded graph of links (a, h) that are on a circle, and those below one with a null circle; the label is a circle's smallest id."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    df = pd.concat(rows, ignore_index=True)
    ids, ends = np.unique(df[["a", "h"]].to_numpy().ravel(), return_inverse=True)
    ends = ends.reshape(-1, 2)
    n = len(ids)
    order = np.argsort(ends[:, 0], kind="stable")
    to, first = ends[order, 1], np.searchsorted(ends[order, 0], np.arange(n + 1))
    index, low, part = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, -9, dtype=np.int64)
    on, stack, clock = np.zeros(n, dtype=bool), [], 0
    for root in range(n):  # strongly connected components, depth first without recursion
        if index[root] >= 0:
            continue
        work = [(root, first[root])]
        while work:
            v, k = work.pop()
            if k == first[v]:
                index[v] = low[v] = clock
                clock += 1
                stack.append(v)
                on[v] = True
            elif on[to[k - 1]]:
                low[v] = min(low[v], low[to[k - 1]])
            while k < first[v + 1]:
                w = to[k]
                k += 1
                if index[w] < 0:
                    work += [(v, k), (w, first[w])]
                    break
                if on[w]:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on[w] = False
                        members.append(w)
                        if w == v:
                            break
                    if len(members) > 1 or (to[first[v] : first[v + 1]] == v).any():
                        part[members] = ids[members].min()
    dirty, todo = part > -9, np.flatnonzero(part > -9).tolist()
    while todo:
        v = todo.pop()
        for w in to[first[v] : first[v + 1]].tolist():
            if not dirty[w]:
                dirty[w] = True
                todo.append(w)
    at = np.flatnonzero(dirty)
    yield pd.DataFrame({"id": ids[at], "circle": pd.Series(part[at], dtype="Int64").mask(part[at] == -9)})


def _spoiled(edges: DataFrame, local: int | None = None) -> DataFrame | None:
    """(id, circle) of the heads on a circle of links (a, h), and of those below one with a null circle; None if there is no circle."""
    local = LOCAL if local is None else local
    whole = cut(edges.select("a", "h").distinct())
    loops, left = whole.where("a = h").select(F.col("a").alias("id")), whole.where("a != h")
    n, gone = left.count(), []
    most = GROWN * n
    fed = loops.where("false")  # callees of what was taken out on or below a circle
    while n > local:
        ends = left.select(F.col("a").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(left.select(F.col("h").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
        light = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where(f"i * o <= i + o or i * o <= {FILL}").select("id", F.struct(F.xxhash64("id", F.lit(len(gone))).alias("turn"), "id").alias("turn"))
        of = lambda c: light.select(F.col("id").alias(c), F.col("turn").alias(f"{c}_turn"))  # noqa: B023, E731
        beaten = left.join(of("a"), "a").join(of("h"), "h").select(F.when(F.col("a_turn") > F.col("h_turn"), F.col("h")).otherwise(F.col("a")).alias("id"))
        picked = cut(light.select("id").join(beaten, "id", "left_anti"))
        up = left.join(picked.select(F.col("id").alias("h")), "h", "left_semi").select(F.col("h").alias("id"), F.col("a").alias("p"))
        down = left.join(picked.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("a").alias("id"), F.col("h").alias("c"))
        stay = left.join(picked.select(F.col("id").alias("a")), "a", "left_anti").join(picked.select(F.col("id").alias("h")), "h", "left_anti").select("a", "h")
        now = cut(stay.unionAll(up.join(down, "id").select(F.col("p").alias("a"), F.col("c").alias("h"))).distinct())
        gone.append((picked, up, down))
        fed = cut(fed.unionByName(down.join(loops.unionByName(fed), "id", "left_semi").select(F.col("c").alias("id"))).distinct())
        loops, left = loops.unionByName(now.where("a = h").select(F.col("a").alias("id"))), now.where("a != h")
        n = left.count()
        heads = left.select("a").union(left.select("h")).distinct().count() if n else 0
        if n > most or picked.count() < TAKES * heads:
            break
    loops = cut(loops.distinct())
    if n <= local:
        # what is fed hangs below a circle of its own, -1
        own = left.unionAll(loops.select(F.col("id").alias("a"), F.col("id").alias("h"))).unionAll(fed.select(F.lit(-1).cast("long").alias("a"), F.explode(F.array(F.col("id"), F.lit(-1).cast("long"))).alias("h")).distinct())
        known = cut(own.repartition(1).mapInPandas(_solve, "id long, circle long").where("id >= 0"))
    else:
        known = _dense(left, loops, fed)
    if known.isEmpty():
        return None
    for picked, up, down in reversed(gone):
        circle = known.where("circle is not null")
        above = up.join(circle.select(F.col("id").alias("p"), "circle"), "p").select("id", "circle")
        below = down.join(circle.select(F.col("id").alias("c"), "circle"), "c").select("id", "circle")
        on = above.join(below, ["id", "circle"], "left_semi").distinct()
        under = up.join(known.select(F.col("id").alias("p")), "p", "left_semi").select("id", F.lit(None).cast("long").alias("circle"))
        alone = loops.join(picked, "id", "left_semi").select("id", F.col("id").alias("circle"))
        under = under.unionByName(fed.join(picked, "id", "left_semi").select("id", F.lit(None).cast("long").alias("circle")))
        found = on.select("id", "circle", F.lit(0).alias("r")).unionAll(alone.select("id", "circle", F.lit(1).alias("r"))).unionAll(under.distinct().select("id", "circle", F.lit(2).alias("r")))
        best = found.groupBy("id").agg(F.min_by("circle", "r").alias("circle"))
        # ids that were put among the known because of a link to themselves are told anew
        known = cut(known.join(picked, "id", "left_anti").unionByName(best))
    return known


def _dense(left: DataFrame, loops: DataFrame, fed: DataFrame) -> DataFrame:
    """The same for a core that is too large for one task, by trimming, colouring and rounds along its links."""
    circles = _circles(left)
    alone = loops.select("id", F.col("id").alias("circle"))
    known = alone if circles is None else circles.unionByName(alone.join(circles, "id", "left_anti"))
    known = known.unionByName(fed.join(known, "id", "left_anti").select("id", F.lit(None).cast("long").alias("circle")))
    known = fresh = cut(known)
    while True:
        fresh = cut(left.join(fresh.select(F.col("id").alias("a")), "a").select(F.col("h").alias("id")).distinct().join(known, "id", "left_anti").withColumn("circle", F.lit(None).cast("long")))
        if fresh.isEmpty():
            return known
        known = cut(known.unionByName(fresh))


@dataclass
class Hierarchy:
    """nodes (id, key); links (parent, child); levels (id, root, level): level -1 on, -2 below a circle, root then null;
    tree (id, up): the caller each key hangs below; circle (id, circle): the keys on circles."""

    nodes: DataFrame
    links: DataFrame
    levels: DataFrame
    tree: DataFrame
    circle: DataFrame


def resolve(nodes: DataFrame, links: DataFrame) -> Hierarchy:
    """Roots, levels and circles of a graph given as `nodes` (id, key) and distinct `links` (parent, child)."""
    into = links.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("n"), F.min("parent").alias("up"))
    kinds = nodes.select("id").join(into, "id", "left").select("id", F.expr("case when n is null then null when n = 1 and up != id then up end").alias("up"), F.expr("case when n is null then 0 when n = 1 and up != id then 1 else 2 end").alias("kind"))
    local = cut(kinds.repartitionByRange("id").mapInPandas(_compress, "id long, up long, off long, state int, clean boolean"))
    q = local.select(F.col("id").alias("q"), F.col("up").alias("q_up"), F.col("off").alias("q_off"), "state", "clean")
    border = local.where("state = 2").select("id", "up").join(q, F.col("up") == F.col("q"))
    merged = _jump(border.select("id", F.expr("if(state = 2, q, q_up)").alias("up"), F.expr("if(state = 2, 1, 1 + q_off)").cast("long").alias("off"), (F.col("state") == 0).alias("done"), "clean"))
    m = merged.select(F.col("id").alias("m"), F.col("up").alias("m_up"), F.col("off").alias("m_off"), F.col("clean").alias("m_clean"))
    forest = cut(
        local.join(m, F.expr("case state when 1 then up when 2 then id end") == F.col("m"), "left").select(
            "id", F.coalesce("m_up", "up").alias("root"), F.expr("case when m is null then off when state = 2 then m_off else off + m_off end").alias("off"), F.coalesce("m_clean", "clean").alias("clean")
        )
    )
    clean = forest.where("clean").select("id", "root", F.col("off").cast("int").alias("level"))
    tree = kinds.where("kind = 1").select("id", "up")
    no_circle = nodes.select("id", F.col("id").alias("circle")).where("false")
    dirty = cut(forest.where("not clean").select("id", "root", "off"))
    if dirty.isEmpty():
        return Hierarchy(nodes, links, clean, tree, no_circle)

    heads = dirty.where("id = root").select(F.col("id").alias("h"))
    into_heads = links.select(F.col("parent").alias("u"), F.col("child").alias("h")).join(heads, "h", "left_semi")
    edges = cut(into_heads.join(dirty.select(F.col("id").alias("u"), F.col("root").alias("a")), "u"))
    spoiled = _spoiled(edges)
    if spoiled is None:
        spoiled = no_circle
    head_circle = spoiled.where("circle is not null")
    of = lambda c: head_circle.select(F.col("id").alias(c), F.col("circle").alias(f"{c}_circle"))
    closing = edges.join(of("a"), "a").join(of("h"), "h").where("a_circle = h_circle").select(F.col("u").alias("id"))

    # keys between a closing link and its head: jumps of 2^k callers, longest first, reach every one of them
    inside = cut(dirty.join(head_circle.select(F.col("id").alias("root"), "circle"), "root"))
    steps, jumps = int(inside.agg(F.max("off")).first()[0] or 0).bit_length(), []
    jump = cut(tree.join(inside.where("id != root").select("id"), "id", "left_semi"))
    for k in range(steps):
        jumps.append(jump)
        if k + 1 < steps:
            jump = cut(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")))
    marks = closing.distinct()
    for jump in reversed(jumps):
        marks = cut(marks.unionByName(marks.join(jump, "id").select(F.col("up").alias("id"))).distinct())
    on = cut(inside.join(marks, "id", "left_semi").select("id", "circle"))

    reached = spoiled.select("id")
    bad = dirty.join(reached.select(F.col("id").alias("root")), "root", "left_semi").select("id")
    stuck = bad.join(on.select("id", F.lit(-1).alias("level")), "id", "left").select("id", F.lit(None).cast("long").alias("root"), F.coalesce("level", F.lit(-2)).alias("level"))

    # heads with several callers, none of them on or below a circle: below the smallest caller
    rest = cut(dirty.join(reached.select(F.col("id").alias("root")), "root", "left_anti"))
    levels = clean.unionByName(stuck)
    if not rest.isEmpty():
        first = links.select("parent", F.col("child").alias("id")).join(rest.where("id = root").select("id"), "id", "left_semi").groupBy("id").agg(F.min("parent").alias("p"))
        hung = cut(first.join(forest.select(F.col("id").alias("p"), "root", "off", "clean"), "p"))
        ends = _jump(hung.select("id", F.col("root").alias("up"), (F.col("off") + 1).alias("off"), F.col("clean").alias("done"), "clean"))
        levels = levels.unionByName(rest.join(ends.select(F.col("id").alias("root"), F.col("up").alias("top"), F.col("off").alias("more")), "root").select("id", F.col("top").alias("root"), (F.col("off") + F.col("more")).cast("int").alias("level")))
        tree = tree.unionByName(hung.select("id", F.col("p").alias("up")))
    return Hierarchy(nodes, links, levels, tree, on)


def levels(h: Hierarchy) -> DataFrame:
    """`function_key`, `root_key`, `level_no` of each key; '' and -1 on a circle, '' and -2 below one."""
    roots = h.nodes.select(F.col("id").alias("root"), F.col("key").alias("root_key"))
    return h.levels.join(h.nodes, "id").join(roots, "root", "left").select(F.col("key").alias("function_key"), F.coalesce("root_key", F.lit("")).alias("root_key"), F.col("level").cast("int").alias("level_no"))


def paths(h: Hierarchy) -> DataFrame:
    """`function_key`, `root_key`, `level_no`, `path` (root first) of each key; on and below circles the path is empty.

    Each round puts the path of the key that a path starts below before it, which doubles its length.
    """
    good = h.levels.where("level >= 0").select("id", "level").join(h.nodes, "id")
    p = cut(good.join(h.tree.join(h.levels.where("level > 0").select("id"), "id", "left_semi"), "id", "left").select("id", "level", "up", F.array("key").alias("path")))
    while not p.where("up is not null").isEmpty():
        t = p.select(F.col("id").alias("t"), F.col("up").alias("next"), F.col("path").alias("above"))
        more = p.where("up is not null").join(t, F.col("up") == F.col("t"))
        p = cut(more.select("id", "level", F.col("next").alias("up"), F.concat("above", "path").alias("path")).unionByName(p.where("up is null").select("id", "level", "up", "path")))
    rest = h.levels.where("level < 0").join(h.nodes, "id").select(F.col("key").alias("function_key"), F.lit("").alias("root_key"), F.col("level").cast("int").alias("level_no"), F.array().cast("array<string>").alias("path"))
    return p.select(F.element_at("path", -1).alias("function_key"), F.col("path")[0].alias("root_key"), F.col("level").cast("int").alias("level_no"), "path").unionByName(rest)


def descendants(h: Hierarchy) -> DataFrame:
    """`ancestor_key`, `function_key` for every key and each key that can be reached from it by links.

    Walks of exactly 2^k links are joined before the walks of fewer, so that a tree gives no pair twice. A key on a
    circle is below itself.
    """
    walk = cut(h.links.select(F.col("parent").alias("x"), F.col("child").alias("y")))
    all_pairs, n = walk, walk.count()
    while n:
        longer = walk.select("x", F.col("y").alias("z")).join(all_pairs.select(F.col("x").alias("z"), "y"), "z").select("x", "y")
        all_pairs = cut(all_pairs.unionByName(longer).distinct())
        now = all_pairs.count()
        if now == n:
            break
        n = now
        walk = cut(walk.select("x", F.col("y").alias("z")).join(walk.select(F.col("x").alias("z"), "y"), "z").select("x", "y").distinct())
    k = h.nodes
    return all_pairs.join(k.select(F.col("id").alias("x"), F.col("key").alias("ancestor_key")), "x").join(k.select(F.col("id").alias("y"), F.col("key").alias("function_key")), "y").select("ancestor_key", "function_key")


def circle_links(h: Hierarchy) -> DataFrame:
    """`caller_key`, `callee_key` of the links that run in a circle: both ends are on the same one."""
    c, k = h.circle, h.nodes
    both = h.links.join(c.select(F.col("id").alias("parent"), F.col("circle").alias("pc")), "parent").join(c.select(F.col("id").alias("child"), F.col("circle").alias("cc")), "child").where("pc = cc")
    return both.join(k.select(F.col("id").alias("parent"), F.col("key").alias("caller_key")), "parent").join(k.select(F.col("id").alias("child"), F.col("key").alias("callee_key")), "child").select("caller_key", "callee_key")
