"""Command line: `python -m flowgrain charts ...` and `python -m flowgrain scan ...`, also for spark-submit."""

from __future__ import annotations

import argparse
import sys

from flowgrain.operators import scan
from flowgrain.operators.labeling import http_client
from flowgrain.plans import pipeline
from flowgrain.session import build_session
from flowgrain.sources import documents, sinks


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="flowgrain", description=__doc__)
    top.add_argument("--master")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("charts", help="charts of the functions of an index")
    one.add_argument("functions")
    one.add_argument("--metadata")
    one.add_argument("--knowledge")
    one.add_argument("--base-path")
    one.add_argument("--out", required=True)
    one.add_argument("--cache")
    one.add_argument("--no-cache", action="store_true")
    one.add_argument("--std", default="c++17", help="taken for compatibility: text is read alike for all versions of the language")
    one.add_argument("--clang-arg", action="append", default=[], help="taken for compatibility: no compiler is run")
    one.add_argument("--verbose", action="store_true", help="show what Spark logs")
    one.add_argument("--function-key", action="append", default=[])
    one.add_argument("--max-stmts", type=int, default=5)
    one.add_argument("--max-lines", type=int, default=10)
    one.add_argument("--whole-cases", action="store_true")
    one.add_argument("--by-stem", action="store_true", help="name documents by the stem of their file only")
    one.add_argument("--llm-url")
    one.add_argument("--llm-model", default="")
    one.add_argument("--llm-chat", action="store_true")
    one.add_argument("--llm-retries", type=int, default=2)
    one.add_argument("--llm-timeout", type=float, default=120)
    two = commands.add_parser("scan", help="the symbol dictionary of a source tree")
    two.add_argument("project_dir")
    two.add_argument("--out", required=True)
    two.add_argument("--project-name", default="unknown")
    two.add_argument("--ext", action="append", default=[])
    two.add_argument("--exclude", action="append", default=[])
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    spark = build_session("flowgrain", args.master)
    spark.sparkContext.setLogLevel("INFO" if getattr(args, "verbose", False) else "WARN")
    if args.command == "scan":
        files = documents.read_sources(spark, args.project_dir, args.ext or documents.EXTENSIONS, [*documents.EXCLUDED, *args.exclude])
        tables = pipeline.knowledge(files)
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{args.out}/{name}")
        sinks.write_documents(sinks.knowledge_items(tables, args.project_name, args.project_dir), args.out, "dictionary")
        for r in scan.stats(tables).collect():  # four rows
            print(f"{r['kind']}: {r['n']}", file=sys.stderr)
        return 0
    cache = sinks.IndexCache(spark, args.cache) if args.cache and not args.no_cache else None
    content = documents.read_text(spark, args.functions).first()["value"] if cache else ""
    entries = cache.load(content) if cache else None
    if entries is None or entries.isEmpty():
        entries = documents.read_functions(spark, args.functions)
        entries = cache.save(content, entries) if cache else entries
    if args.function_key:
        wanted = spark.createDataFrame([(k,) for k in args.function_key], "function_key string")
        missing = wanted.join(entries, "function_key", "left_anti")
        if not missing.isEmpty():
            print("unknown function keys", file=sys.stderr)
            return 1
        entries = entries.join(wanted, "function_key", "left_semi")
    base = args.base_path or (documents.read_metadata(spark, args.metadata).first()["base_path"] if args.metadata else ".")
    files = documents.read_sources(spark, base, excluded=())
    symbols = documents.read_knowledge(spark, args.knowledge) if args.knowledge else None
    client = http_client(args.llm_url, args.llm_model, args.llm_chat, args.llm_timeout) if args.llm_url else None
    made = pipeline.charts(entries, files, pipeline.Settings(args.max_stmts, args.max_lines, args.llm_retries, args.whole_cases, client), symbols)
    results = made.results.cache()
    sinks.write_documents(sinks.file_items(results, args.by_stem), args.out)
    sinks.write_documents(sinks.summary_items(results), args.out, "summary")
    return 0


if __name__ == "__main__":
    sys.exit(main())
