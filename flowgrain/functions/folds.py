"""Greedy walks over arrays, as folds inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def greedy_segments(sizes: Column, most: int = 5, most_lines: int = 10) -> Column:
    """The segment number of each element: a new one begins when the current is not empty and would exceed `most` elements or `most_lines` in sum."""

    def step(s: Column, size: Column) -> Column:
        full = (s["n"] > 0) & ((s["n"] >= most) | (s["sum"] + size > most_lines))
        now = F.when(full, s["seg"] + 1).otherwise(s["seg"])
        return F.struct(now.alias("seg"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, size).otherwise(s["sum"] + size).alias("sum"), F.concat(s["out"], F.array(now)).alias("out"))

    start = F.struct(F.lit(0).alias("seg"), F.lit(0).alias("n"), F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, start, step, lambda s: s["out"])
