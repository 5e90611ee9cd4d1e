"""Which declaration of a file is a function entry's: a range join with scores, cheapest rule first.

Cursors are rows (file, name, line, end_line, is_definition, visit_ord). Entries and cursors meet on the file and
a block of lines that the cursor touches or stands next to, so that the range condition is only a residue of an equi-join. Ties go to the earlier cursor; an entry without a match is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgrain.functions.labels import simple_name
from flowgrain.functions.text import lower_path

# How far a start line may be off, and what a match is worth.
NEAR, FAR = 10, 25
EXACT, PART, END_OFF, DEFINITION, LOOSE, BROAD = 100, 40, 20, 20, -15, -50


def score(name: Column, wanted: Column, line: Column, wanted_line: Column, end_line: Column, wanted_end: Column, is_definition: Column) -> Column:
    """Name, closeness of the start and of the end, and a premium for definitions."""
    return (
        F.when(name == wanted, EXACT).when(name.contains(wanted), PART).otherwise(0)
        - F.abs(line - wanted_line)
        - F.least(F.abs(end_line - wanted_end), F.lit(END_OFF))
        + F.when(is_definition, DEFINITION).otherwise(0)
    )


def resolve_cursors(entries: DataFrame, cursors: DataFrame, key: str = "function_key") -> DataFrame:
    """`function_key`, `tier`, `score` and the fields of the best cursor of each entry.

    Tier 1: the innermost cursor of that name around the entry's first line that starts within 10 lines of it; tier 2: within
    10 lines or around it, however far above it starts, by score; tier 3: within 25 lines, by score. A later tier only counts where no earlier one has a match.
    """
    wanted = entries.select(key, lower_path(F.col("file")).alias("file_id"), F.col("line").alias("want_line"), F.col("end_line").alias("want_end"), F.lower(simple_name(F.col("qualified_name"))).alias("want_name")).distinct()
    c = cursors.withColumn("file_id", lower_path(F.col("file"))).withColumn("c_name", F.lower(simple_name(F.col("name"))))
    block = lambda at: F.floor(at / FAR)
    first, last = block(F.col("line")), block(F.greatest("line", F.coalesce("end_line", "line")))
    blocks = c.withColumn("block", F.explode(F.array_distinct(F.concat(F.array(first - 1), F.sequence(first, F.greatest(last, first + 1))))))
    pairs = wanted.withColumn("block", block(F.col("want_line"))).join(blocks, ["file_id", "block"])
    named = F.col("c_name").contains(F.col("want_name"))
    near = F.abs(F.col("line") - F.col("want_line")) <= NEAR
    around = (F.col("line") <= F.col("want_line")) & (F.col("end_line") >= F.coalesce("want_end", "want_line"))
    tier = F.when(named & near & (F.col("line") <= F.col("want_line")) & (F.col("end_line") >= F.col("want_line")), 1).when(around | (near & named), 2).when(named & (F.abs(F.col("line") - F.col("want_line")) <= FAR), 3)
    points = score(F.col("c_name"), F.col("want_name"), F.col("line"), F.col("want_line"), F.col("end_line"), F.coalesce("want_end", "end_line"), F.col("is_definition"))
    points = points + F.when((tier == 2) & ~around, LOOSE).when(tier == 3, BROAD).otherwise(0)
    ranked = pairs.withColumn("tier", tier).where("tier is not null").withColumn("score", points)
    best = Window.partitionBy(key).orderBy("tier", F.when(F.col("tier") == 1, -F.col("line")), F.col("score").desc(), "visit_ord")
    return ranked.withColumn("n", F.row_number().over(best)).where("n = 1").select(key, "tier", "score", "file", "name", "line", "end_line", "is_definition", "visit_ord")
