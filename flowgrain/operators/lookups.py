"""Lookups of functions, callees and symbols: joins against dictionaries, and the merging of repeated entries.

Null keys match nothing; of repeated keys the first in the given order counts where one is to be had; other columns
of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgrain.functions.labels import call_names, full_signature, identifiers, last_name, macro_names, simple_type
from flowgrain.functions.text import strip
from flowgrain.operators.comments import preceding_comments, source_lines


def name_index(entries: DataFrame, name: str = "qualified_name", key: str = "function_key", order: str = "pos") -> DataFrame:
    """name -> keys in input order."""
    return entries.groupBy(name).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, key))), lambda x: x[key]).alias("keys"))


def first_by_name(entries: DataFrame, name: str = "qualified_name", key: str = "function_key", order: str = "pos") -> DataFrame:
    """name -> the first key that bears it."""
    return entries.groupBy(name).agg(F.min_by(key, order).alias(key))


def merge_functions(records: DataFrame, name: str = "qualified_name", order: str = "pos") -> DataFrame:
    """One record per name: the first with a comment, else the last definition, else the first; `first_pos` keeps the place.

    All aggregates are combined before the shuffle.
    """
    row = F.struct(*[c for c in records.columns if c != name])
    chosen = F.coalesce(
        F.min_by(row, F.when(F.coalesce("comment", F.lit("")) != "", F.col(order))),
        F.max_by(row, F.when(F.col("is_definition"), F.col(order))),
        F.min_by(row, order),
    )
    return records.groupBy(name).agg(chosen.alias("r"), F.min(order).alias("first_pos")).select(name, "first_pos", "r.*")


def last_writer(records: DataFrame, name: str, order: str = "pos") -> DataFrame:
    """One record per name: the last; `first_pos` keeps the place of the first."""
    row = F.struct(*[c for c in records.columns if c != name])
    return records.groupBy(name).agg(F.max_by(row, order).alias("r"), F.min(order).alias("first_pos")).select(name, "first_pos", "r.*")


def split_keys(entries: DataFrame, wanted: DataFrame, key: str = "function_key") -> tuple[DataFrame, DataFrame]:
    """The entries of the wanted keys, and the wanted keys that no entry has."""
    return entries.join(wanted.select(key).distinct(), key, "left_semi"), wanted.join(entries.select(key), key, "left_anti")


def resolve_callees(entries: DataFrame, knowledge: DataFrame | None = None, key: str = "function_key", files: DataFrame | None = None) -> DataFrame:
    """`function_key`, `ord`, `callee_id`, `signature`, `description` for every call that is known, in call order.

    An entry of that key is taken first (its comment in the dictionary before its description), then a dictionary
    entry of the name in the key, then, with `files` (file, source_text), the source that the key points to. Callees that are
    in none of these are dropped. Each distinct callee is looked up once, and only then joined to its calls.
    """
    calls = entries.select(F.col(key).alias("caller"), F.posexplode("calls_ids").alias("ord", "callee_id")).where("callee_id is not null")
    known = entries.groupBy(F.col(key).alias("callee_id")).agg(F.min_by(F.struct("qualified_name", "params", "description"), F.struct("loaded_at", "description")).alias("e") if "loaded_at" in entries.columns else F.any_value(F.struct("qualified_name", "params", "description")).alias("e"))
    ids = calls.select("callee_id").distinct().join(known, "callee_id", "left")
    part = F.when(F.col("callee_id").contains("|"), F.get(F.split("callee_id", r"\|"), F.lit(2))).otherwise(F.col("callee_id"))
    ids = ids.withColumn("name", F.coalesce(F.col("e.qualified_name"), part))
    if knowledge is None:
        ids = ids.withColumns({"k_sig": F.lit(None).cast("string"), "k_comment": F.lit(None).cast("string")})
    else:
        own = knowledge.groupBy(F.col("qualified_name").alias("name")).agg(F.min_by(F.struct("signature", "comment"), "pos").alias("k"))
        ids = ids.join(own, "name", "left").withColumns({"k_sig": F.col("k.signature"), "k_comment": F.col("k.comment")})
    some = lambda c: F.when(c != "", c)
    told = ids.select(
        "callee_id",
        F.coalesce(F.when(F.col("e").isNotNull(), full_signature(F.col("e.qualified_name"), F.col("e.params"))), F.col("k_sig")).alias("signature"),
        F.coalesce(some(F.col("k_comment")), some(F.col("e.description")), F.lit("")).alias("description"),
    )
    if files is not None:
        lost = told.where("signature is null").select("callee_id")
        told = told.where("signature is not null").unionByName(callees_in_sources(lost, files).drop("file"))
    return calls.join(told.where("signature is not null"), "callee_id").select(F.col("caller").alias(key), "ord", "callee_id", "signature", "description")


def calls_in_code(nodes: DataFrame, entries: DataFrame, key: str = "function_key") -> DataFrame:
    """`function_key`, `node_id`, `ord`, `signature`, `description`: the callees of the function whose name the code calls.

    Names are matched within the function, so that the join runs on the function's key and the name.
    """
    named = nodes.where(~F.col("node_type").isin("START", "END", "BREAK", "CONTINUE")).select(key, "node_id", F.explode(call_names(F.col("raw_code"))).alias("name"))
    callees = resolve_callees(entries, None, key).withColumn("name", last_name(F.substring_index("signature", "(", 1)))
    return named.join(callees, [key, "name"]).select(key, "node_id", "ord", "signature", "description")


def symbols_in_code(nodes: DataFrame, symbols: DataFrame, name: str, macros: bool = False, code: str = "raw_code") -> DataFrame:
    """The symbols whose name stands in a node's code: the node's key, `token_ord` of the first place, and the symbol.

    With `macros` only upper-case names of three characters or more are looked at.
    """
    tokens = (macro_names if macros else identifiers)(F.col(code))
    return nodes.select("function_key", "node_id", F.posexplode(tokens).alias("token_ord", name)).join(symbols, name)


def enums_in_code(nodes: DataFrame, enum_values: DataFrame, code: str = "raw_code") -> DataFrame:
    """The enumerations (`enum`, `ord`) that a node's code names by themselves or by a member.

    Names are taken in the order of their first place in the code, and each stands for the first enumeration, by `ord`, that
    no earlier name stands for; where names compete, an enumeration counts once, for its first name.
    """
    names = enum_values.select(F.col("name").alias("token"), "enum", "ord").unionByName(enum_values.select(F.col("enum").alias("token"), "enum", "ord")).distinct()
    hits = nodes.select("function_key", "node_id", F.posexplode(identifiers(F.col(code))).alias("token_ord", "token")).join(names, "token")
    per_node = hits.groupBy("function_key", "node_id").agg(F.array_sort(F.collect_set(F.struct("token_ord", "ord", "enum"))).alias("h"))
    step = lambda s, x: F.when((s["last"] == x["token_ord"]) | F.array_contains(s["taken"], x["enum"]), s).otherwise(F.struct(x["token_ord"].alias("last"), F.concat(s["taken"], F.array(x["enum"])).alias("taken")))
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<string>").alias("taken"))
    return per_node.select("function_key", "node_id", F.posexplode(F.aggregate("h", start, step, lambda s: s["taken"])).alias("ord", "enum"))


def parameter_type_notes(entries: DataFrame, types: DataFrame, key: str = "function_key") -> DataFrame:
    """`function_key`, `ord`, `type_name`, `summary` for each distinct simple parameter type in `types` (name, kind, summary).

    An enumeration is taken before a typedef of the same name.
    """
    simple = F.array_distinct(F.transform("params", lambda p: simple_type(p["type"])))
    best = types.groupBy(F.col("name").alias("type_name")).agg(F.min_by("summary", "kind").alias("summary"))
    return entries.select(key, F.posexplode(simple).alias("ord", "type_name")).join(best, "type_name").select(key, "ord", "type_name", "summary")


def purpose(entries: DataFrame, knowledge: DataFrame, simple_names: bool = False, key: str = "function_key") -> DataFrame:
    """`function_key`, `purpose`: the dictionary's comment of the function's name, else its description, else ''.

    simple_names matches the last part of the names instead of the whole ones.
    """
    name: Column = last_name(F.col("qualified_name")) if simple_names else F.col("qualified_name")
    comments = knowledge.where("comment != ''").groupBy(name.alias("name")).agg(F.min_by("comment", "pos").alias("k_comment"))
    return entries.withColumn("name", name).join(comments, "name", "left").select(key, F.coalesce("k_comment", "description", F.lit("")).alias("purpose"))


def first_match(lines: DataFrame, names: DataFrame) -> DataFrame:
    """`file`, `name`, `line_no`, `signature`, `comment`: the first line of a file on which `name (` stands, the text from there up
    to the `{`, over however many lines, and the comment above.

    Lines give the names that they call, which makes an equi-join of it; a match then names the lines of its head.
    """
    called = lines.select("file", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?U)\b(\w+)\s*\("), F.lit(1)))).alias("name"))
    hits = called.join(names.select("file", "name").distinct(), ["file", "name"], "left_semi").groupBy("file", "name").agg(F.min("line_no").alias("line_no"))
    after = Window.partitionBy("file").orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
    opened = lines.select("file", "line_no", F.coalesce(F.min(F.when(F.col("text").contains("{"), F.col("line_no"))).over(after), F.max("line_no").over(after)).alias("until"))
    starts = hits.select("file", "line_no").distinct()
    head = starts.join(opened, ["file", "line_no"]).select("file", "line_no", F.explode(F.sequence("line_no", "until")).alias("n"))
    text = head.join(lines.select("file", F.col("line_no").alias("n"), strip(F.col("text")).alias("t")), ["file", "n"])
    heads = text.groupBy("file", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]), " ").alias("ahead"))
    above = preceding_comments(lines, starts, keep_empty=True, opener=False)
    found = hits.join(heads, ["file", "line_no"]).join(above, ["file", "line_no"], "left")
    return found.select("file", "name", "line_no", strip(F.substring_index("ahead", "{", 1)).alias("signature"), F.coalesce("comment", F.lit("")).alias("comment"))


#: Extensions of the files in which an unknown callee is looked for, in this order.
PROBED = (".cpp", ".h", ".hpp", ".cc")


def callees_in_sources(callees: DataFrame, files: DataFrame) -> DataFrame:
    """`callee_id`, `signature`, `description`, `file` of callees (callee_id: folder|stem|name|...) found in source files (file, source_text).

    Of the files folder/stem with the extensions of `PROBED`, the first that holds `name (` counts.
    """
    part = lambda n: F.get(F.split("callee_id", r"\|"), F.lit(n))
    ids = callees.select("callee_id").distinct().where(F.size(F.split("callee_id", r"\|")) >= 3)
    tried = ids.select("callee_id", last_name(part(2)).alias("name"), F.posexplode(F.array(*(F.concat(part(0), F.lit("/"), part(1), F.lit(x)) for x in PROBED))).alias("probe", "file"))
    lines = source_lines(files.join(tried.select("file").distinct(), "file", "left_semi"))
    found = tried.join(first_match(lines, tried.select("file", "name")), ["file", "name"]).where("signature != ''")
    return found.groupBy("callee_id").agg(F.min_by(F.struct("signature", F.col("comment").alias("description"), "file"), "probe").alias("f")).select("callee_id", "f.*")
