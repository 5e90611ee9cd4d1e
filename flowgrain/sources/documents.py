"""Readers of JSON documents and of source trees.

A document is one JSON object whose keys are data, so it is read whole and parsed with a map type; a key that comes twice
keeps its first place and its last value. Missing and null fields get their defaults.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrain.functions.text import decode, is_system_path

_PARAMS = "array<struct<type:string,name:string>>"
FUNCTION = f"struct<qualifiedName:string,location:struct<file:string,line:int,endLine:int>,parameters:{_PARAMS},params:{_PARAMS},callsIds:array<string>,calledByIds:array<string>,interfaceId:string,description:string>"
KNOWLEDGE = (
    "struct<project_name:string,base_path:string,functions:map<string,struct<qualifiedName:string,signature:string,file:string,line:int,comment:string>>,"
    "enums:map<string,struct<qualifiedName:string,file:string,comment:string,values:map<string,struct<value:string,comment:string>>>>,"
    "macros:map<string,struct<name:string,value:string,file:string,comment:string>>,typedefs:map<string,struct<name:string,underlying:string,file:string,comment:string>>>"
)
# Extensions of C++ files, and directories that are passed over, unless told otherwise.
EXTENSIONS = (".cpp", ".h", ".hpp", ".cc", ".cxx", ".hh")
EXCLUDED = ("build", "_build", "out", "dist", "third_party", "external", "vendor", "test", "tests", "googletest", "gtest")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """`value`: the whole text of each file under a path."""
    return spark.read.text(path, wholetext=True)


def map_entries(parsed: DataFrame, column: str, key: str = "key") -> DataFrame:
    """`key`, `pos`, `v` of a map column: the last value of each key at the place of its first."""
    rows = parsed.select(F.posexplode(F.map_entries(column)).alias("pos", "e"))
    return rows.groupBy(F.col("e.key").alias(key)).agg(F.min("pos").alias("pos"), F.max_by("e.value", "pos").alias("v"))


def function_index(texts: DataFrame) -> DataFrame:
    """The function table of texts (`value`) of the form {key: entry}."""
    v = map_entries(texts.select(F.from_json("value", f"map<string,{FUNCTION}>", {"allowDuplicateKeys": "true"}).alias("m")), "m", "function_key")
    none = F.array().cast("array<string>")
    return v.select(
        "function_key",
        "pos",
        F.coalesce("v.qualifiedName", F.lit("")).alias("qualified_name"),
        F.coalesce("v.location.file", F.lit("")).alias("file"),
        F.coalesce("v.location.line", F.lit(0)).alias("line"),
        F.coalesce("v.location.endLine", F.lit(0)).alias("end_line"),
        F.coalesce("v.parameters", "v.params", F.array().cast(_PARAMS)).alias("params"),
        F.coalesce("v.callsIds", none).alias("calls_ids"),
        F.coalesce("v.calledByIds", none).alias("called_by_ids"),
        F.coalesce("v.interfaceId", F.lit("")).alias("interface_id"),
        F.coalesce("v.description", F.lit("")).alias("description"),
    )


def read_functions(spark: SparkSession, path: str) -> DataFrame:
    return function_index(read_text(spark, path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row: `base_path` ('.' if not given), `project_name` ('unknown')."""
    m = F.from_json("value", "struct<basePath:string,projectName:string>")
    return read_text(spark, path).select(F.coalesce(m["basePath"], F.lit(".")).alias("base_path"), F.coalesce(m["projectName"], F.lit("unknown")).alias("project_name"))


def read_knowledge(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The symbol tables functions, enums, enum_values, macros and typedefs of a dictionary document."""
    parsed = read_text(spark, path).select(F.from_json("value", KNOWLEDGE).alias("k")).select("k.*")
    text = lambda *names: [F.coalesce(f"v.{a}", F.lit("")).alias(b) for a, b in names]
    enums = map_entries(parsed, "enums", "name")
    return {
        "functions": map_entries(parsed, "functions", "name").select("name", "pos", *text(("qualifiedName", "qualified_name"), ("signature", "signature"), ("file", "file"), ("comment", "comment")), F.coalesce("v.line", F.lit(0)).alias("line")),
        "enums": enums.select("name", "pos", *text(("qualifiedName", "qualified_name"), ("file", "file"), ("comment", "comment"))),
        "enum_values": enums.select(F.col("name").alias("enum"), F.posexplode(F.map_entries("v.values")).alias("ord", "e")).select("enum", "ord", F.col("e.key").alias("name"), F.coalesce("e.value.value", F.lit("")).alias("value"), F.coalesce("e.value.comment", F.lit("")).alias("comment")),
        "macros": map_entries(parsed, "macros", "name").select("name", "pos", *text(("value", "value"), ("file", "file"), ("comment", "comment"))),
        "typedefs": map_entries(parsed, "typedefs", "name").select("name", "pos", *text(("underlying", "underlying"), ("file", "file"), ("comment", "comment"))),
    }


def source_paths(files: DataFrame, extensions: Iterable[str] = EXTENSIONS, excluded: Iterable[str] = EXCLUDED) -> DataFrame:
    """The rows (file and more) whose path ends with an extension, whatever its case, and lies in no excluded or hidden directory."""
    folders = F.slice(F.split("file", "/"), 1, F.size(F.split("file", "/")) - 1)
    keep = F.lower(F.concat(F.lit("."), F.substring_index("file", ".", -1))).isin(*extensions)
    return files.where(keep & ~F.exists(folders, lambda p: p.isin(*excluded) | p.startswith(".")) & ~is_system_path(F.col("file")))


def read_sources(spark: SparkSession, path: str, extensions: Iterable[str] = EXTENSIONS, excluded: Iterable[str] = EXCLUDED, ordered: bool = False) -> DataFrame:
    """`file` (below the path), `source_text` of the C++ files of a tree; only files of the given extensions are read.

    Directories that are excluded by name or begin with a dot are passed over, whatever their depth. Spark itself leaves out
    files and directories whose name begins with an underscore or a dot. `ordered` sorts by path part by part; the operators
    need no order, as places carry the path.
    """
    any_case = lambda x: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    glob = "*{" + ",".join(any_case(x) for x in extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    root = F.regexp_replace(F.lit(path), "^file:/*|/+$", "")
    full = F.regexp_replace("path", "^file:/*", "")
    root = F.regexp_replace(root, "^/", "")
    inner = F.when(full.startswith(F.concat(root, F.lit("/"))), F.substring(full, F.length(root) + 2, F.lit(1 << 20))).otherwise(F.regexp_replace("path", "^file:/*", "/"))
    kept = source_paths(raw.select(inner.alias("file"), "content"), extensions, excluded)
    texts = kept.select("file", decode(F.col("content")).alias("source_text"))
    return texts.orderBy(F.split("file", "/")) if ordered else texts
