import random

import pytest
from pyspark.sql import functions as F

from flowgrain.operators import hierarchy as h

SCHEMA = "function_key string, calls_ids array<string>, called_by_ids array<string>, id string"


def solve(edges, keys):
    """Plain version: circles, what is below them, levels along the smallest caller."""
    out = {k: set() for k in keys}
    callers = {k: set() for k in keys}
    for a, b in edges:
        if a in out and b in out:
            out[a].add(b)
            callers[b].add(a)

    def reach(k):
        seen, todo = set(), list(out[k])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    reached = {k: reach(k) for k in keys}
    circle = {k for k in keys if k in reached[k]}
    below = {x for k in circle for x in reached[k]} - circle

    def level(k):
        n = 0
        while callers[k]:
            k, n = min(callers[k]), n + 1
        return k, n

    found = {k: ("", -1) if k in circle else ("", -2) if k in below else level(k) for k in keys}
    pairs = {(a, b) for a in keys for b in reached[a]}
    loops = {(a, b) for a in keys for b in out[a] if a in reached[b]}
    return found, pairs, loops


def run(spark, edges, keys):
    rows = [(k, [b for a, b in edges if a == k], None, "extra") for k in keys]
    nodes, links = h.call_links(spark.createDataFrame(rows, SCHEMA))
    g = h.resolve(nodes, links)
    got = {r.function_key: (r.root_key, r.level_no) for r in h.levels(g).collect()}
    pairs = {(r.ancestor_key, r.function_key) for r in h.descendants(g).collect()}
    loops = {(r.caller_key, r.callee_key) for r in h.circle_links(g).collect()}
    paths = {r.function_key: r.path for r in h.paths(g).collect()}
    return got, pairs, loops, paths


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    keys = [f"m{r.randint(0, 3)}|k{i:02d}" for i in range(24)]
    edges = {(r.choice(keys), r.choice(keys)) for _ in range([6, 14, 20, 26, 34, 18][seed])}
    if seed == 1:  # a forest with one way back
        edges = {(keys[r.randrange(i)], keys[i]) for i in range(1, 24)} | {(keys[-1], keys[0])}
    want, pairs, loops = solve(edges, keys)
    got, got_pairs, got_loops, paths = run(spark, sorted(edges), keys)
    assert got == want
    assert got_pairs == pairs
    assert got_loops == loops
    assert {k: (p[0] if p else "", len(p) - 1) for k, p in paths.items()} == {k: v if v[1] >= 0 else ("", -1) for k, v in want.items()}


def spoiled(edges):
    """Plain version of what `_spoiled` gives: the circle of each id by its members, or None below one."""
    ids = {x for e in edges for x in e}
    found, _, _ = solve([(str(a), str(b)) for a, b in edges], [str(i) for i in ids])
    return {int(k): v[1] == -1 for k, v in found.items() if v[1] < 0}


@pytest.mark.parametrize(("seed", "local"), [(1, 0), (2, 20), (3, 1000)])
def test_contraction(spark, seed, local):
    """Circles of the graph between heads, contracted to nothing, to a small core, and not at all."""
    r = random.Random(seed)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range([30, 44, 60, 60][seed])}
    if seed == 1:
        edges |= {(i, i + 1) for i in range(50, 70)} | {(70, 50), (60, 90), (91, 55)}
    got = h._spoiled(spark.createDataFrame(sorted(edges), "a long, h long"), local)
    found = {x.id: x.circle for x in got.collect()} if got is not None else {}
    want = spoiled(edges)
    assert {k: v is not None for k, v in found.items()} == want
    out = {k: {b for a, b in edges if a == k} for k in found}
    _, pairs, _ = solve([(str(a), str(b)) for a, b in edges], [str(x) for e in edges for x in e])
    assert all((found[a] == found[b]) == ((str(a), str(b)) in pairs and (str(b), str(a)) in pairs) for a in out for b in out if a != b and want[a] and want[b])


def test_long_graph_with_two_callers_each(spark, monkeypatch):
    """A graph of 100,000 levels in which each key has two callers is contracted in rounds that take a share of it each.

    Its length would need 100,000 rounds of trimming; here each checkpoint is counted, three a round.
    """
    n, rounds, was = 100_000, [], h.cut
    edges = spark.range(2, n).select(F.explode(F.array(F.col("id") - 1, F.col("id") - 2)).alias("a"), F.col("id").alias("h"))
    edges = edges.unionAll(spark.createDataFrame([(n - 1, n // 2)], "a long, h long"))
    monkeypatch.setattr(h, "cut", lambda df: rounds.append(1) or was(df))
    c = h._spoiled(edges, 120_000).agg(F.count("*"), F.count("circle"), F.countDistinct("circle"), F.min("id")).first()
    assert tuple(c) == (n // 2, n // 2, 1, n // 2)
    assert len(rounds) < 40


def test_long_chain_and_ring(spark):
    chain = [f"c{i:03d}" for i in range(120)]
    ring = [f"r{i:02d}" for i in range(17)]
    edges = list(zip(chain, chain[1:])) + list(zip(ring, [*ring[1:], ring[0]])) + [("r05", "x"), ("x", "y")]
    keys = [*chain, *ring, "x", "y"]
    got, _, loops, paths = run(spark, edges, keys)
    assert got["c119"] == ("c000", 119) and paths["c119"] == chain
    assert all(got[k] == ("", -1) for k in ring) and got["x"] == got["y"] == ("", -2)
    assert len(loops) == 17


def test_odd_rows(spark):
    rows = [(None, ["a"], None, ""), ("a", ["b", " b", None, "", " ", "nowhere"], None, ""), ("a", ["b"], None, ""), ("b", None, ["a "], ""), ("s", ["s"], [], ""), (" ", None, None, "")]
    nodes, links = h.call_links(spark.createDataFrame(rows, SCHEMA))
    got = {r.function_key: (r.root_key, r.level_no) for r in h.levels(h.resolve(nodes, links)).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "s": ("", -1)}
    empty = spark.createDataFrame([], SCHEMA)
    assert h.levels(h.resolve(*h.call_links(empty))).count() == 0
    assert h.descendants(h.resolve(*h.call_links(empty))).count() == 0
    assert h.paths(h.resolve(*h.call_links(empty))).withColumn("n", F.size("path")).count() == 0
