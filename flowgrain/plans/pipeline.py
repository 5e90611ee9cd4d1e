"""The whole way from a function index and source files to charts, and from source files to a symbol dictionary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrain.functions.labels import enum_summary, macro_summary, parameters, typedef_summary
from flowgrain.functions.text import lines, slice_lines
from flowgrain.operators import cfg, comments, graph, labeling, lookups, resolver, scan
from flowgrain.session import by_key, cut


@dataclass
class Settings:
    """Bounds of a run: statements and lines of an action node, retries of the label model, and the case rule."""

    max_statements: int = 5
    max_lines: int = 10
    retries: int = 2
    whole_cases: bool = False
    client: Callable[[], labeling.Client] | None = None


@dataclass
class Charts:
    nodes: DataFrame
    edges: DataFrame
    results: DataFrame
    findings: DataFrame


def one_of_each(entries: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest by its other columns, so that each run keeps the same."""
    row = F.struct(*[c for c, kind in entries.dtypes if c != key and "map<" not in kind])
    return entries.groupBy(key).agg(F.min(row).alias("r")).select(key, "r.*")


def charts(entries: DataFrame, files: DataFrame, settings: Settings | None = None, knowledge: dict[str, DataFrame] | None = None) -> Charts:
    """Charts of all entries (function_key, qualified_name, file, line, end_line, params, calls_ids, description).

    Files meet entries on their path. An entry whose definition isn't found, or whose graph can't be built, comes out with
    an error and an empty script; the others are not touched by it.
    """
    s = settings or Settings()
    entries = one_of_each(entries, "function_key")
    wanted = by_key(files, "file").join(entries.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.min("source_text").alias("source_text"))
    built = cut(cfg.graphs(wanted, s.max_statements, s.max_lines, s.whole_cases))
    cursors = built.select("file", F.col("qualified_name").alias("name"), "line", F.expr("coalesce(element_at(nodes, 2).end_line, line)").alias("end_line"), F.lit(True).alias("is_definition"), F.col("ord").alias("visit_ord"))
    found = resolver.resolve_cursors(entries, cursors).select("function_key", "file", F.col("visit_ord").alias("ord"))
    own = found.join(built, ["file", "ord"]).select("function_key", "file", "error", "nodes", "edges")
    nodes = own.select("function_key", "file", F.explode("nodes").alias("n")).select("function_key", "file", "n.*").withColumn("label", F.lit(None).cast("string"))
    edges = own.select("function_key", F.explode("edges").alias("e")).select("function_key", "e.*")
    if s.client is not None:
        nodes = _ask(entries, wanted, nodes, knowledge, s)
    nodes = cut(graph.with_rule_labels(nodes, entries))
    scripts = graph.render(nodes, edges)
    results = (
        entries.select("function_key", "qualified_name", F.col("file").alias("source_file"), F.col("line").alias("ord"))
        .join(own.select("function_key", "error"), "function_key", "left")
        .join(scripts, "function_key", "left")
        .select("function_key", "qualified_name", "source_file", "ord", F.coalesce("mermaid_script", F.lit("")).alias("mermaid_script"), F.when(F.col("mermaid_script").isNull(), F.coalesce("error", F.lit("cannot resolve cursor"))).alias("error"))
    )
    findings = graph.graph_findings(nodes, edges).unionByName(graph.script_findings(results.where("error is null")))
    return Charts(nodes, edges, results, findings)


def node_context(entries: DataFrame, files: DataFrame, nodes: DataFrame, knowledge: dict[str, DataFrame] | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What stands beside each node: its callees, the comment near its line, and the symbols its code names."""
    calls = lookups.calls_in_code(nodes, entries)
    told = nodes.where(~F.col("node_type").isin("START", "END", "BREAK", "CONTINUE"))
    near = comments.nearest_comments(comments.source_lines(files), told.select("file", F.col("start_line").alias("line_no")))
    beside = told.select("function_key", "node_id", "file", F.col("start_line").alias("line_no")).join(near, ["file", "line_no"]).select("function_key", "node_id", "comment")
    if knowledge is None:
        return calls, beside, None
    macros = lookups.symbols_in_code(told, knowledge["macros"].select("name", macro_summary(F.col("name"), F.col("value"), F.col("comment")).alias("summary")), "name", macros=True)
    typedefs = lookups.symbols_in_code(told, knowledge["typedefs"].select("name", typedef_summary(F.col("name"), F.col("underlying"), F.col("comment")).alias("summary")), "name")
    values = knowledge["enum_values"]
    told_enums = values.groupBy("enum").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "value", "comment"))), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["comment"].alias("comment"))).alias("v"))
    enums = lookups.enums_in_code(told, values.withColumn("ord", F.xxhash64("enum"))).join(told_enums, "enum").withColumn("summary", F.concat(F.col("enum"), F.lit(" (enum): "), enum_summary(F.lit(""), F.col("v"))))
    parts = [df.select("function_key", "node_id", F.lit(kind).alias("kind"), "summary") for df, kind in ((enums, "enum_context"), (macros, "macro_context"), (typedefs, "typedef_context"))]
    return calls, beside, parts[0].unionByName(parts[1]).unionByName(parts[2])


def type_context(entries: DataFrame, knowledge: dict[str, DataFrame]) -> DataFrame:
    """`function_key`, `types`: a line for each parameter type that the dictionary knows, enumerations before typedefs."""
    values = knowledge["enum_values"].groupBy("enum").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "value", "comment"))), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["comment"].alias("comment"))).alias("v"))
    comments_of = knowledge["enums"].select(F.col("name").alias("enum"), "comment") if "enums" in knowledge else values.select("enum", F.lit("").alias("comment")).where("false")
    told = values.join(comments_of, "enum", "left").select(F.col("enum").alias("name"), F.lit("enum").alias("kind"), F.concat(F.col("enum"), F.lit(" (enum): "), enum_summary(F.coalesce("comment", F.lit("")), F.col("v"))).alias("summary"))
    typedefs = knowledge["typedefs"].select("name", F.lit("typedef").alias("kind"), typedef_summary(F.col("name"), F.col("underlying"), F.col("comment")).alias("summary"))
    notes = lookups.parameter_type_notes(entries, told.unionByName(typedefs))
    return notes.groupBy("function_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "summary"))), lambda x: F.concat(F.lit("  "), x["summary"])), "\n").alias("types"))


def _ask(entries: DataFrame, files: DataFrame, nodes: DataFrame, knowledge: dict[str, DataFrame] | None, s: Settings) -> DataFrame:
    calls, beside, symbols = node_context(entries, files, nodes, knowledge)
    records = labeling.node_records(nodes, calls, beside, symbols)
    called = lookups.resolve_callees(entries, knowledge["functions"] if knowledge else None, files=files)
    callees = called.groupBy("function_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(": ", "signature", F.nullif(F.col("description"), F.lit(""))).alias("t")))), lambda x: x["t"]), "\n").alias("callees"))
    purpose = lookups.purpose(entries, knowledge["functions"]) if knowledge else entries.select("function_key", F.coalesce("description", F.lit("")).alias("purpose"))
    source = files.select("file", lines(F.col("source_text")).alias("l"))
    types = type_context(entries, knowledge) if knowledge else entries.select("function_key", F.lit(None).cast("string").alias("types")).where("false")
    asked = (
        entries.join(types, "function_key", "left").join(records, "function_key").join(purpose, "function_key", "left").join(callees, "function_key", "left").join(source, "file", "left")
        .withColumn("context", labeling.context_text(parameters(F.col("params")), F.col("types"), F.col("purpose"), F.col("callees")))
        .withColumn("prompt", labeling.prompt(F.col("qualified_name"), F.col("params"), F.col("purpose"), F.col("context"), slice_lines(F.col("l"), F.col("line"), F.col("end_line")), F.col("nodes_json")))
    )
    return labeling.apply_labels(nodes, labeling.reply_labels(labeling.ask(asked, s.client, s.retries)))


def knowledge(files: DataFrame) -> dict[str, DataFrame]:
    """The symbol tables of source files (file, source_text)."""
    rows = cut(scan.symbols(by_key(files, "file").groupBy("file").agg(F.min("source_text").alias("source_text"))))
    return {"functions": scan.functions(rows), "enums": scan.enums(rows), "enum_values": scan.enum_values(rows), "macros": scan.macros(rows), "typedefs": scan.typedefs(rows)}
