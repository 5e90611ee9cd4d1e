"""Graphs of charts: edges of scripts, order, reachability, findings and rendering.

Nodes (function_key, node_id, node_seq, node_type, raw_code, label) and edges (function_key, edge_ord, source, target, label)
are tables; a graph is all rows of one function_key, whose size a function's source bounds. Repeated nodes count once.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrain.functions.labels import CHART_HEADER, edge_line, node_line, rule_label
from flowgrain.functions.text import strip
from flowgrain.session import by_key, cut

_EDGE = r"^\s*(\w+) -->(?:\|(.*)\|)? (\w+)\s*$"


def distinct_nodes(nodes: DataFrame) -> DataFrame:
    """Each node once, partitioned by graph, so that what is grouped by graph afterwards needs no further shuffle."""
    return by_key(nodes, "function_key").dropDuplicates(["function_key", "node_id"])


def script_edges(charts: DataFrame, key: str = "function_key", script: str = "mermaid_script") -> DataFrame:
    """The edges that scripts hold, in their order; a script that comes twice counts once."""
    rows = charts.where(f"{script} != ''").select(F.col(key).alias("function_key"), F.col(script).alias("s")).distinct()
    rows = rows.select("function_key", F.posexplode(F.split("s", "\n")).alias("edge_ord", "line")).where(F.col("line").contains(" -->"))
    return rows.select("function_key", "edge_ord", F.regexp_extract("line", _EDGE, 1).alias("source"), F.regexp_extract("line", _EDGE, 3).alias("target"), F.nullif(F.regexp_extract("line", _EDGE, 2), F.lit("")).alias("label")).where("source != ''")


_WALK = "nodes array<int>, reached int, unknown array<struct<edge_ord:int,side:string,node_id:string>>"


def _walks(ids: pd.Series, ords: pd.Series, sources: pd.Series, targets: pd.Series, entry: pd.Series) -> pd.DataFrame:
    """Of each graph: the places of its nodes breadth first from its entry, then of the others as they come; how many were reached; edge ends that are no node."""
    out, reached, unknown = [], [], []
    for own, numbers, src, dst, first in zip(ids, ords, sources, targets, entry):
        place, ways = {n: i for i, n in reversed(list(enumerate(own)))}, {}
        odd = []
        for k, a, b in zip(numbers, src, dst):
            ways.setdefault(a, []).append(b)
            odd += [{"edge_ord": k, "side": side, "node_id": n} for side, n in (("source", a), ("target", b)) if n not in place]
        seen, order = set(), []
        queue = deque([first] if first in place else list(own[:1]))
        while queue:
            n = queue.popleft()
            if n in seen:
                continue
            seen.add(n)
            if n in place:
                order.append(place[n])
            queue.extend(b for b in ways.get(n, []) if b not in seen)
        out.append([*order, *(i for i, n in enumerate(own) if n not in seen)])
        reached.append(len(order))
        unknown.append(odd)
    return pd.DataFrame({"nodes": out, "reached": reached, "unknown": unknown})


def _walked(nodes: DataFrame, edges: DataFrame, *more: Column) -> DataFrame:
    """One row a graph: `function_key`, `n` (node_seq, node_id, node_type and more, by node_seq), `e` (edge_ord, source, target, label), `entry`, `w`.

    Many graphs go to Python in one batch; nodes and edges are each shuffled once, by graph.
    """
    walk = F.pandas_udf(_walks, _WALK)
    own = distinct_nodes(nodes).groupBy("function_key").agg(F.array_sort(F.collect_list(F.struct("node_seq", "node_id", "node_type", *more))).alias("n"), F.min_by("node_id", F.when(F.col("node_type") == "START", F.col("node_seq"))).alias("entry"))
    ways = by_key(edges, "function_key").groupBy("function_key").agg(F.array_sort(F.collect_list(F.struct("edge_ord", "source", "target", "label"))).alias("e"))
    both = own.join(ways, "function_key", "full")
    both = both.select("function_key", F.coalesce("n", F.array().cast(own.schema["n"].dataType)).alias("n"), F.coalesce("e", F.array().cast(ways.schema["e"].dataType)).alias("e"), "entry")
    return both.withColumn("w", walk(F.col("n.node_id"), F.col("e.edge_ord"), F.col("e.source"), F.col("e.target"), F.coalesce("entry", F.lit(""))))


def _in_order(walked: DataFrame) -> Column:
    """The nodes of each graph in the order of the walk."""
    return F.transform("w.nodes", lambda i: F.get("n", i))


def breadth_first(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`function_key`, `node_id`, `ord`: each graph's nodes from its START (or first node), breadth first, edges in their order."""
    w = _walked(nodes, edges)
    return w.select("function_key", F.posexplode(_in_order(w)).alias("ord", "x")).select("function_key", "x.node_id", "ord")


def reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`function_key`, `node_id` of the nodes that can be reached from START."""
    w = _walked(nodes, edges).where("entry is not null")
    return w.select("function_key", F.explode(F.slice(_in_order(w), F.lit(1), F.col("w.reached"))).alias("x")).select("function_key", "x.node_id")


def reachable_by_rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for graphs too large for a row: a frontier is joined with the edges until nothing is new."""
    fresh = cut(distinct_nodes(nodes).where("node_type = 'START'").select("function_key", "node_id"))
    found, ways = fresh, cut(edges.select("function_key", F.col("source").alias("node_id"), "target").distinct())
    known = distinct_nodes(nodes).select("function_key", "node_id")
    while not fresh.isEmpty():
        step = ways.join(fresh, ["function_key", "node_id"]).select("function_key", F.col("target").alias("node_id")).distinct()
        fresh = cut(step.join(found, ["function_key", "node_id"], "left_anti").join(known, ["function_key", "node_id"], "left_semi"))
        found = cut(found.unionByName(fresh))
    return found


def _lost() -> Column:
    """The nodes that no way from START leads to; all of them where there is no START."""
    return F.slice(F.transform("w.nodes", lambda i: F.get("n", i)), F.when(F.col("entry").isNull(), 1).otherwise(F.col("w.reached") + 1), F.greatest(F.size("n"), F.lit(1)))


def unreachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes that no way from START leads to."""
    return _walked(nodes, edges).select("function_key", F.explode(_lost()).alias("x")).select("function_key", "x.node_id")


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`function_key`, `edge_ord`, `side`, `node_id` of edge ends that are no node."""
    return _walked(nodes, edges).select("function_key", F.explode("w.unknown").alias("x")).select("function_key", "x.*")


def graph_findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`function_key`, `severity`, `code`, `detail` of what is wrong with a graph, all from one row a graph."""
    blank = strip(F.coalesce("label", F.lit(""))) == ""
    w = _walked(nodes, edges, blank.alias("blank"))
    note = lambda severity, code, detail: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.alias("detail"))
    one = lambda here, x: F.when(here, F.array(x)).otherwise(F.array().cast("array<struct<severity:string,code:string,detail:string>>"))
    count = lambda kind: F.size(F.filter("n", lambda x: x["node_type"] == kind))
    starts, stops = count("START"), count("END")
    labelled = F.filter("n", lambda x: ~F.coalesce(x["node_type"], F.lit("")).isin("START", "END") & x["blank"])
    has = F.size("n") > 0
    found = F.concat(
        one(has & (starts == 0), note("ERROR", "no_start", F.lit(""))),
        one(starts > 1, note("WARNING", "many_starts", starts.cast("string"))),
        one(has & (stops == 0), note("ERROR", "no_end", F.lit(""))),
        F.transform("w.unknown", lambda x: note("ERROR", "unknown_node", F.concat_ws(" ", x["side"], x["node_id"]))),
        F.transform(labelled, lambda x: note("WARNING", "empty_label", x["node_id"])),
        one(F.size(_lost()) > 0, note("WARNING", "unreachable", F.array_join(F.array_sort(F.transform(_lost(), lambda x: x["node_id"])), ", "))),
    )
    return w.select("function_key", F.explode(found).alias("f")).select("function_key", "f.*")


def script_findings(charts: DataFrame, key: str = "function_key", script: str = "mermaid_script") -> DataFrame:
    """`function_key`, `severity`, `code`, `detail` of what is wrong with a script."""
    rows = charts.select(F.col(key).alias("function_key"), F.coalesce(script, F.lit("")).alias("s")).distinct()
    some = rows.where(strip(F.col("s")) != "")
    line = some.select("function_key", F.posexplode(F.split("s", r"\r\n|\r|\n")).alias("n", "line"))
    odd = line.where((F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1)
    note = lambda df, severity, code, detail: df.select("function_key", F.lit(severity).alias("severity"), F.lit(code).alias("code"), detail.alias("detail"))
    return (
        note(rows.where(strip(F.col("s")) == ""), "ERROR", "empty_script", F.lit(""))
        .unionByName(note(some.where(~strip(F.col("s")).startswith(CHART_HEADER.split()[0])), "ERROR", "no_header", F.lit("")))
        .unionByName(note(odd, "WARNING", "odd_quotes", (F.col("n") + 1).cast("string")))
    )


def with_rule_labels(nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Labels by rule where there is none; START and END get theirs, from `names` (function_key, qualified_name) if given."""
    own = distinct_nodes(nodes)
    if names is not None:
        own = own.join(names.groupBy("function_key").agg(F.min("qualified_name").alias("qn")), "function_key", "left")
        start = F.concat(F.lit("Start: "), F.element_at(F.split("qn", "::"), -1))
    else:
        start = F.concat(F.lit("Start: "), F.element_at(F.split(F.substring_index("raw_code", "(", 1), "::"), -1))
    label = F.when(F.col("node_type") == "START", start).when(F.col("node_type") == "END", "End").otherwise(F.coalesce(F.when(strip(F.col("label")) != "", strip(F.col("label"))), rule_label(F.col("node_type"), F.col("raw_code"))))
    return own.withColumn("label", label).drop("qn")


def render(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`function_key`, `mermaid_script`: node lines breadth first, a blank line, edge lines in their order; built within the row of each graph."""
    line = node_line(F.col("node_id"), F.col("node_type"), F.col("label"), F.col("raw_code"))
    w = _walked(nodes, edges, line.alias("line")).where(F.size("n") > 0)
    node_lines = F.array_join(F.transform(_in_order(w), lambda x: F.concat(F.lit("    "), x["line"])), "\n")
    edge_lines = F.array_join(F.transform("e", lambda x: F.concat(F.lit("    "), edge_line(x["source"], x["target"], x["label"]))), "\n")
    return w.select("function_key", F.concat_ws("\n", F.lit(CHART_HEADER), node_lines, F.lit(""), F.when(F.size("e") > 0, edge_lines)).alias("mermaid_script"))
