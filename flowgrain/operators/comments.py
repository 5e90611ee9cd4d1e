"""Source lines as rows, and the comments beside and above a line.

Comments are found with windows over (file, line_no), so files are worked on in parallel and no file is held as a whole by
Python. Null texts have no lines; files that come twice should be made distinct before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgrain.functions.text import line_comment, lines, strip


def source_lines(files: DataFrame, file: str = "file", text: str = "source_text", scanner: bool = False) -> DataFrame:
    """`file`, `line_no` from 1, `text` of each line."""
    return files.select(F.col(file).alias("file"), F.posexplode(lines(F.regexp_replace(text, "^﻿", ""), scanner)).alias("n", "text")).select("file", (F.col("n") + 1).alias("line_no"), "text")


def inline_comments(line_rows: DataFrame) -> DataFrame:
    """`file`, `line_no`, `comment` of the lines that end in a `//` comment."""
    return line_rows.where(F.col("text").contains("//")).select("file", "line_no", line_comment(F.col("text")).alias("comment")).where("comment != ''")


def nearest_comments(line_rows: DataFrame, targets: DataFrame, above: int = 4) -> DataFrame:
    """`file`, `line_no`, `comment` for the wanted lines: the comment on the line, else those of at most `above` lines before.

    Blank lines are passed over; the search ends at the first line of code. A line that begins with `*` or ends with
    `*/` counts as a comment.
    """
    wanted = targets.select("file", "line_no").distinct()
    near = wanted.select("file", F.explode(F.sequence(F.greatest(F.col("line_no") - above, F.lit(1)), F.col("line_no"))).alias("line_no")).distinct()
    s = strip(F.col("text"))
    kind = F.when(s == "", "blank").when(s.startswith("//"), "line").when(s.endswith("*/") | s.startswith("*"), "block").otherwise("code")
    said = F.when(kind == "line", F.regexp_replace(s, "^[/ ]+", "")).when(kind == "block", F.regexp_replace(F.regexp_replace(s, "^[*/ ]+", ""), "[*/ ]+$", ""))
    rows = line_rows.join(near, ["file", "line_no"], "left_semi").select("file", "line_no", line_comment(F.col("text")).alias("own"), F.struct(F.col("line_no").alias("n"), kind.alias("kind"), said.alias("said")).alias("l"))
    before = Window.partitionBy("file").orderBy("line_no").rangeBetween(-above, -1)
    rows = rows.withColumn("before", F.array_sort(F.collect_list("l").over(before)))
    step = lambda acc, x: F.struct(
        (acc["open"] & (x["kind"] != "code")).alias("open"),
        F.when(acc["open"] & x["kind"].isin("line", "block") & (x["said"] != ""), F.concat(F.array(x["said"]), acc["said"])).otherwise(acc["said"]).alias("said"),
    )
    start = F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("said"))
    above_text = F.aggregate(F.reverse("before"), start, step, lambda acc: strip(F.array_join(acc["said"], " ")))
    return rows.join(wanted, ["file", "line_no"], "left_semi").select("file", "line_no", F.when(F.col("own") != "", F.col("own")).otherwise(above_text).alias("comment"))


def _island(rows: DataFrame, wanted: Column) -> DataFrame:
    """`run`: the number of the run of neighbouring wanted lines that a row belongs to."""
    w = Window.partitionBy("file").orderBy("line_no")
    return rows.withColumn("run", F.sum(F.when(wanted, 0).otherwise(1)).over(w))


def preceding_comments(line_rows: DataFrame, targets: DataFrame, keep_empty: bool = False, opener: bool = True) -> DataFrame:
    """`file`, `line_no`, `comment`: the comment that ends above each wanted line, blank lines between them passed over.

    That is a run of `//` lines or a block from the line with `/*` down to the one that ends with `*/`. keep_empty keeps the
    empty ones of `//` lines; opener takes the words beside `/*` too. The last line of a block of several lines gives a `/`, as
    in the original. Runs are gaps and islands: a running count of other lines numbers them; a block is numbered by
    the last line with `/*` so far. Lines above which there is no comment are left out.
    """
    s = strip(F.col("text"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = line_rows.withColumn("is_comment", s.startswith("//")).withColumn("s", s)
    rows = _island(rows, F.col("is_comment")).withColumn("opened", F.max(F.when(F.col("text").contains("/*"), F.col("line_no"))).over(w))
    rows = rows.withColumn("last_text", F.max(F.when(s != "", F.col("line_no"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    wanted = rows.select("file", "line_no", "last_text").join(targets.select("file", "line_no").distinct(), ["file", "line_no"], "left_semi").where("last_text is not null")
    ends = rows.select("file", F.col("line_no").alias("last_text"), "is_comment", "run", F.coalesce("opened", F.lit(0)).alias("opened"), F.col("s").alias("end"))
    at = wanted.join(ends, ["file", "last_text"])
    lines_of = lambda said: F.array_sort(F.collect_list(F.struct("line_no", said.alias("said"))))
    joined = lambda found: F.array_join(F.transform(found, lambda x: x["said"]), " ")

    said = F.regexp_replace("s", "^[/ ]+", "")
    runs = rows.where("is_comment").groupBy("file", "run").agg(lines_of(said if keep_empty else F.when(said != "", said)).alias("l"))
    beside_lines = at.where("is_comment").join(runs, ["file", "run"]).select("file", "line_no", joined(F.filter("l", lambda x: x["line_no"] <= F.col("last_text"))).alias("comment"))

    blocks = at.where(~F.col("is_comment") & F.col("end").endswith("*/")).select("file", "opened", "last_text").distinct()
    inner = rows.select("file", F.coalesce("opened", F.lit(0)).alias("opened"), "line_no", "text", "s").join(blocks, ["file", "opened"]).where("line_no <= last_text")
    first = strip(F.regexp_replace(strip(F.regexp_replace("text", r"/\*+\s*", "")), r"[*/]+$", ""))
    words = F.when(F.col("line_no") == F.col("opened"), first if opener else F.lit(None)).otherwise(F.regexp_replace("s", r"^[* ]+", ""))
    told = inner.groupBy("file", "opened", "last_text").agg(joined(lines_of(F.when(words != "", words))).alias("comment"))
    above = at.where(~F.col("is_comment") & F.col("end").endswith("*/")).join(told, ["file", "opened", "last_text"]).select("file", "line_no", "comment")
    return beside_lines.unionByName(above)
