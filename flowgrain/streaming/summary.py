"""Running counts of flowcharts and errors per file over results that keep arriving.

The engine's counters in streaming form: results are deduplicated by function within the watermark, then counted per
file and window; late rows beyond the watermark are dropped by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_summary(results: DataFrame, at: str = "created_at", delay: str = "1 hour", window: str = "1 day", group: str = "project") -> DataFrame:
    """`window_start`, group, `ok`, `errors` of a stream (or a table) of results (function_key, mermaid_script, error, at)."""
    fatal = F.coalesce("mermaid_script", F.lit("")) == ""
    results = results.withColumn(at, F.col(at).cast("timestamp"))
    once = results.withWatermark(at, delay).dropDuplicatesWithinWatermark(["function_key"]) if results.isStreaming else results.dropDuplicates(["function_key"])
    counted = once.groupBy(F.window(at, window).alias("w"), group).agg(F.count_if(~fatal).alias("ok"), F.count_if(fatal).alias("errors"))
    return counted.select(F.col("w.start").alias("window_start"), group, "ok", "errors")
