"""Functions paired with their documentation (problem 4).

Method: every file is read by the light C++ front end, which gives declarations, classes with their bases, and
documentation comments, whose tags are parsed. Definitions whose own comment says nothing take, by repeated joins,
the comment of their declaration in the class, then of the method they override in a base class, level by level up the
hierarchy; definitions that stay without documentation are dropped.

Defined results: null and empty texts hold no functions; files of any length are read whole; a repeated file counts
once; what can't be parsed is skipped; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgrain.functions.names import parameter_types
from flowgrain.session import cut, widen
from flowgrain.sources.cpp import declarations

_MARKS = re.compile(r"^[ \t\f]*(?:/{2,}[!<]*|/\*+[!<]*|\*+(?!\w))?|\*+/[ \t]*$", re.M)
_TAG = re.compile(r"^[@\\](\w+)(?:\s*\[[\w,\s]*\])?[ \t]*")
# Documentation tags by what follows them.
_POINTER_TAGS = set("copydoc copybrief copydetails see sa ref link inheritdoc overload snippet include".split())
_NOTE_TAGS = set("todo fixme bug xxx test".split())
_FILE_TAGS = set("file author authors date version since copyright license ingroup defgroup addtogroup relates name fn class internal endinternal cond endcond".split())
_NAMED_TAGS = set("param tparam throw throws exception retval arg".split())
_TODO = re.compile(r"(?i)^\W*(to-?do|fixme|xxx|tbd|hack|wip)\b")
_DIRECTIVE = re.compile(r"(?i)^\W*(nolint\w*|clang-(format|tidy)|cppcheck\W|cpplint|coverity|lint\b|-v:|pragma\b|noqa|pylint|iwyu|lcov_|gcov|uncrustify|astyle|sonar|codespell|fallthrough|keep sorted|region\b|endregion\b|doxygen)")
_POINTER = re.compile(r"(?i)^\W*(see|cf|refer to|same as|as above|ditto|inherited|inherits|documented in|described in|defined in|declared in|details in|look at|siehe|voir|véase)\b(\W*[\w:./()~-]+){0,9}\W*$")
_LICENCE = re.compile(r"(?i)spdx|copyright|licen[cs]e|all rights|distributed under|warrant(y|ies)|\(c\) *(19|20)\d\d|part of the .*(component|project|package|library)")
_CODE = re.compile(r"[;{}]\s*$|^\s*(#\s*(if|include|define|endif|else)\b|(if|for|while|switch)\s*\(.*\)\s*$|else\s*$|return\b.*[;)]$|(case\b.*|default|public|private|protected)\s*:\s*$|[\w.>:\[\]-]+\([^()]*\)\s*[;,]?\s*$)")
_NOTHING = re.compile(r"(?i)^\W*(n/?a|none|nil|null|no (description|comment|documentation|docs?)( yet| available| given)?|undocumented|description( missing)?|missing|empty|tbc|documentation|docs?|comment|to be (documented|written|done|defined)|document (me|this))?\W*$")
_KINDS = set("the this is a an it's its function method member class constructor destructor ctor dtor operator getter setter of for helper routine procedure implementation definition declaration named called int void bool impl name static virtual inline free".split())


_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+")


def _words(text: str) -> set[str]:
    return {w.lower() for w in _NAME_PARTS.findall(text)}


def comment_lines(comment: str) -> list[str]:
    """The lines of a comment without its marks."""
    return [line.strip() for line in _MARKS.sub("", comment).replace("*/", "").split("\n")]


def says_something(comment: str, name: str) -> bool:
    """Whether any line of a comment tells something about the function `name`."""
    own, note = None, False
    for line in comment_lines(comment):
        if not line:
            note = False
            continue
        if m := _TAG.match(line):
            tag, line, note = m[1].lower(), line[m.end() :], False
            if tag in _NOTE_TAGS:
                note = True
                continue
            if tag in _POINTER_TAGS or tag in _FILE_TAGS:
                continue
            if tag in _NAMED_TAGS:
                line = re.sub(r"^[\w.:&*\[\]]+", "", line).strip(" -:")
        if note or not re.search(r"[^\W\d_]", line):
            continue
        if _TODO.search(line):
            note = True
            continue
        if _DIRECTIVE.search(line) or _POINTER.search(line) or _LICENCE.search(line) or _CODE.search(line) or _NOTHING.search(line):
            continue
        own = own or _words(name) | _KINDS
        if not _words(line) <= own:
            return True
    return False


def plain(comment: str) -> str:
    """A comment without marks and tag names, on one line."""
    kept = (re.sub(r"^[@\\](brief|short|details|note|remarks?|return|returns)\s*", "", line) for line in comment_lines(comment))
    return " ".join(line for line in kept if re.search(r"\w", line))


_SCHEMA = "project string, file string, kind string, qualified_name string, line int, end_line int, signature string, is_definition boolean, bases string, comment string, says boolean, target string"


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in _SCHEMA.split(", ")]
    for b in batches:
        rows = []
        for project, file, text in zip(b["project"], b["file"], b["source_text"]):
            for d in declarations(text):
                if d.kind not in ("function", "class"):
                    continue
                parts = [c for c in (d.comment, *d.inline.split("\n")) if c]
                told = [c for c in parts if says_something(c, d.qualified_name)] if d.kind == "function" else []
                target = re.search(r"[@\\]copy(?:doc|brief|details)\s+([\w:~]+)", d.comment) if "copy" in d.comment else None
                rows.append((project, file, d.kind, d.qualified_name, d.line, d.end_line, d.signature, d.is_definition, d.bases, plain("\n".join(told)) if told else "", bool(told), target[1] if target else ""))
        yield pd.DataFrame(rows, columns=columns)


def scan(files: DataFrame) -> DataFrame:
    """One row per function and class declaration of `files` (project, file, source_text), repeated files once."""
    rows = widen(files.where("source_text is not null and source_text != ''").select("project", "file", "source_text")).mapInPandas(_scan, _SCHEMA)
    return rows.dropDuplicates(["file", "line", "qualified_name", "kind"])


def documented(files: DataFrame) -> DataFrame:
    """`project`, `file`, `line`, `qualified_name`, `signature`, `comment`, `inherited_from` of each documented definition.

    inherited_from is null for a comment of the definition itself, else the name whose comment was taken.
    """
    rows = cut(scan(files))
    functions = rows.where("kind = 'function'").withColumn("types", parameter_types(F.col("signature"))).withColumn("method", F.substring_index("qualified_name", "::", -1)).withColumn("owner", F.expr("substring(qualified_name, 1, greatest(length(qualified_name) - length(method) - 2, 0))"))
    out = ["project", "file", "line", "qualified_name", "signature", "comment"]
    found = functions.where("is_definition and says").select(*out, F.lit(None).cast("string").alias("inherited_from"))

    best = Window.partitionBy("project", "owner", "method", "types").orderBy(F.col("is_definition"), "file", "line")
    sources = cut(functions.where("says").withColumn("n", F.row_number().over(best)).where("n = 1").select("project", F.col("owner").alias("at"), "method", "types", F.col("comment").alias("taken"), F.col("qualified_name").alias("inherited_from")))
    bases = (
        rows.where("kind = 'class' and bases != ''")
        .select("project", F.col("qualified_name").alias("at"), F.explode(F.split("bases", r"\s*,\s*")).alias("base"))
        .select("project", "at", F.regexp_replace(F.trim("base"), r"<.*|^::", "").alias("base"))
        .distinct()
    )
    # a base may be named relative to the namespace of the class
    classes = rows.where("kind = 'class'").select("project", F.col("qualified_name").alias("full")).distinct()
    named = classes.withColumn("base", F.explode(F.expr("transform(sequence(1, size(split(full, '::'))), n -> substring_index(full, '::', -n))")))
    bases = cut(bases.join(named, ["project", "base"]).where("full != at").select("project", "at", F.col("full").alias("up")).distinct())

    todo = cut(functions.where("is_definition and not says").select("project", "file", "line", "qualified_name", "signature", "method", "types", F.col("owner").alias("at")))
    seen = todo
    while not todo.isEmpty():
        joined = todo.join(sources, ["project", "at", "method", "types"], "left")
        hit = joined.where("taken is not null")
        found = found.unionByName(hit.select("project", "file", "line", "qualified_name", "signature", F.col("taken").alias("comment"), "inherited_from"))
        rest = joined.where("taken is null").drop("taken", "inherited_from").join(bases, ["project", "at"]).withColumn("at", F.col("up")).drop("up").distinct()
        todo = cut(rest.join(seen.select("file", "line", "at"), ["file", "line", "at"], "left_anti"))
        seen = seen.unionByName(todo)
    one = Window.partitionBy("file", "line", "qualified_name").orderBy(F.col("inherited_from").isNotNull(), "inherited_from", "comment")
    return found.withColumn("n", F.row_number().over(one)).where("n = 1").drop("n")
