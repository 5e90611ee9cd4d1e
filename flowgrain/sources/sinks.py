"""Writers of results: per-file documents, the summary, the symbol dictionary, and the cache of the function index."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import textwrap
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrain.functions.text import stem


def summary(results: DataFrame) -> DataFrame:
    """`source_file`, `ok`, `errors` of results (source_file, error)."""
    bad = F.coalesce("error", F.lit("")) != ""
    return results.groupBy("source_file").agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("errors"))


def totals(results: DataFrame) -> DataFrame:
    """The same with one more row, of a null file, for all of them."""
    bad = F.coalesce("error", F.lit("")) != ""
    return results.rollup("source_file").agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("errors"))


def file_items(results: DataFrame, by_stem: bool = False) -> DataFrame:
    """`name`, `ord`, `key`, `item`: the results (source_file, ord, function_key, qualified_name, mermaid_script, error) as rows of JSON documents, one document a file.

    by_stem names a document by the stem of its file alone, so that of files of one stem only the last by path is kept;
    else the name keeps the whole path.
    """
    one = F.to_json(F.struct(F.col("function_key").alias("functionKey"), F.col("qualified_name").alias("qualifiedName"), F.col("mermaid_script").alias("mermaidScript"), F.nullif(F.col("error"), F.lit("")).alias("error")))
    rows = results.select(F.concat("source_file", F.lit(".json")).alias("name"), "ord", F.col("function_key").alias("key"), one.alias("item"), "source_file")
    if by_stem:
        rows = rows.withColumn("name", F.concat(stem(F.col("source_file")), F.lit(".json")))
        rows = rows.join(rows.groupBy("name").agg(F.max("source_file").alias("source_file")), ["name", "source_file"], "left_semi")
    return rows.drop("source_file")


def summary_items(results: DataFrame) -> DataFrame:
    """`name`, `ord`, `key`, `item` of the summary: a first row with the totals, then one for each file."""
    per_file = summary(results)
    total = per_file.agg(F.sum(F.col("ok") + F.col("errors")).alias("totalFunctions"), F.sum("errors").alias("totalErrors"))
    head = total.select(F.lit(0).alias("ord"), F.lit("").alias("key"), F.to_json(F.struct(F.coalesce("totalFunctions", F.lit(0)).alias("totalFunctions"), F.coalesce("totalErrors", F.lit(0)).alias("totalErrors"))).alias("item"))
    files = per_file.select(F.lit(1).alias("ord"), F.col("source_file").alias("key"), F.to_json(F.struct(F.col("source_file").alias("sourceFile"), F.col("ok").alias(COUNTED), "errors")).alias("item"))
    return head.unionByName(files).select(F.lit("_summary.json").alias("name"), "ord", "key", "item")


def knowledge_items(tables: dict[str, DataFrame], project_name: str, base_path: str) -> DataFrame:
    """`name`, `ord`, `key`, `item` of the symbol dictionary: rows of the sections functions, enums, macros and typedefs, by name."""
    text = lambda *names: [F.coalesce(F.col(a), F.lit("")).alias(b) for a, b in names]
    member = F.struct(F.col("name").alias("k"), F.struct("value", "comment").alias("v"))
    values = tables["enum_values"].groupBy("enum").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", member.alias("m")))), lambda x: x["m"]).alias("m"))
    enums = tables["enums"].select("name", "file", "comment").join(values, F.col("name") == F.col("enum"))
    sections = (
        ("functions", tables["functions"].select(F.col("qualified_name").alias("key"), F.to_json(F.struct(*text(("qualified_name", "qualifiedName"), ("signature", "signature"), ("file", "file")), "line", *text(("comment", "comment")))).alias("item"))),
        ("enums", enums.select(F.col("name").alias("key"), F.to_json(F.struct(*text(("name", "qualifiedName"), ("file", "file"), ("comment", "comment")), F.map_from_entries("m").alias("values"))).alias("item"))),
        ("macros", tables["macros"].select(F.col("name").alias("key"), F.to_json(F.struct(*text(("name", "name"), ("value", "value"), ("file", "file"), ("comment", "comment")))).alias("item"))),
        ("typedefs", tables["typedefs"].select(F.col("name").alias("key"), F.to_json(F.struct(*text(("name", "name"), ("underlying", "underlying"), ("file", "file"), ("comment", "comment")))).alias("item"))),
    )
    head = F.to_json(F.struct(F.lit(project_name).alias("project_name"), F.lit(base_path).alias("base_path")))
    out = next(iter(tables.values())).sparkSession.range(1).select(F.lit(0).alias("ord"), F.lit("").alias("key"), head.alias("item"))
    for n, (_, rows) in enumerate(sections, 1):
        out = out.unionByName(rows.select(F.lit(n).alias("ord"), "key", "item"))
    return out.select(F.lit("project_knowledge.json").alias("name"), "ord", "key", "item")


SECTIONS = ("functions", "enums", "macros", "typedefs")
#: Fixed value: the field of a summary's file that counts the charts made.
COUNTED = "flowchartsGenerated"


def _list(items: Iterator) -> Iterator[str]:
    """A document that is one array."""
    for n, r in enumerate(items):
        yield ("[\n" if not n else ",\n") + textwrap.indent(json.dumps(json.loads(r["item"]), indent=2, ensure_ascii=False), "  ")
    yield "\n]"


def _summary(items: Iterator) -> Iterator[str]:
    yield json.dumps(json.loads(next(items)["item"]), indent=2)[:-2] + ',\n  "files": ['
    for n, r in enumerate(items):
        yield (",\n" if n else "\n") + textwrap.indent(json.dumps(json.loads(r["item"]), indent=2, ensure_ascii=False), "    ")
    yield "\n  ]\n}"


def _dictionary(items: Iterator) -> Iterator[str]:
    yield json.dumps(json.loads(next(items)["item"]), indent=2, ensure_ascii=False)[:-2]
    section, row = 0, next(items, None)
    for section, name in enumerate(SECTIONS, 1):
        yield f',\n  "{name}": {{'
        first = True
        while row is not None and row["ord"] == section:
            yield ("" if first else ",") + "\n    " + json.dumps(row["key"], ensure_ascii=False) + ": " + json.dumps(json.loads(row["item"]), ensure_ascii=False)
            first, row = False, next(items, None)
        yield "}" if first else "\n  }"
    yield "\n}"


FORMS = {"list": _list, "summary": _summary, "dictionary": _dictionary}


def write_documents(items: DataFrame, folder: str, form: str = "list") -> None:
    """Writes the documents of items (name, ord, key, item) below a folder, given by a path or by a URL of any file system that pyarrow knows.

    The rows of a document go in order through one task, item by item, without being held together. On a cluster the folder
    has to be one that all executors share.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = FORMS[form]

    def write(rows: Iterator) -> None:
        files, path = fs.FileSystem.from_uri(folder if "://" in folder else os.path.abspath(folder))
        for name, own in itertools.groupby(rows, key=lambda r: r["name"]):
            target = f"{path.rstrip('/')}/{name}"
            files.create_dir(target.rsplit("/", 1)[0], recursive=True)
            with files.open_output_stream(target) as out:
                for text in shape(own):
                    out.write(text.encode("utf-8"))

    items.repartition(parts, "name").sortWithinPartitions("name", "ord", "key").foreachPartition(write)


def content_key(content: str) -> str:
    """The cache key of a JSON document, whatever the order of its keys and its spacing."""
    return hashlib.md5(json.dumps(json.loads(content), sort_keys=True).encode()).hexdigest()[:16]


class IndexCache:
    """Keeps the function index of a document as parquet in a folder, under the hash of the document."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def name(self, content: str) -> str:
        return f"{self.folder}/pkb_{content_key(content)}"

    def load(self, content: str) -> DataFrame | None:
        """The index, or None if there is none or it can't be read."""
        try:
            return self.spark.read.parquet(self.name(content)) if self.files.exists(self.path(self.name(content) + "/_SUCCESS")) else None
        except Exception:  # noqa: BLE001  a broken cache is a miss
            return None

    def save(self, content: str, index: DataFrame) -> DataFrame:
        index.write.mode("overwrite").parquet(self.name(content))
        self.drop_stale(content)
        return self.spark.read.parquet(self.name(content))

    def drop_stale(self, content: str) -> None:
        """Deletes what was kept for other documents."""
        for status in self.files.globStatus(self.path(f"{self.folder}/pkb_*")) or []:
            if not status.getPath().toString().endswith(f"pkb_{content_key(content)}"):
                self.files.delete(status.getPath(), True)
