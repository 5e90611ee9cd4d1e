"""References to records that do not exist (problem 5): orphan, deleted and late references per table and period.

Method: parent and child keys are put into one long tagged table and grouped by key, with map-side
pre-aggregation; only groups that lack a parent, or whose parent can be too late or already gone for some child,
are kept; those few keys are joined back to the child rows, and counts are summed by period.

Defined results: null and blank reference entries are no references; white space anywhere in a key is ignored;
a row without a key is skipped; a referring key without any load time has no `deleted` or `late` references;
repeated rows and repeated entries count once; empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgrain.session import cut

#: References to one broken key that are joined back in one task, about.
REFERENCES_A_SALT = 100_000
#: Keys with more are spread, over as many tasks as they need; there are at most so many of them, whatever the data.
MOST_HEAVY = 10_000


def squeeze(key: Column) -> Column:
    """A key without any white space."""
    return F.regexp_replace(key, r"(?U)\s+", "")


def referring(entries: DataFrame, key: str, loaded: str, removed: str) -> DataFrame:
    """One row per key: `key`, earliest `loaded`, `removed`."""
    return entries.select(squeeze(F.col(key)).alias("key"), F.col(loaded).alias("loaded"), F.col(removed).alias("removed")).where("key != ''").groupBy("key").agg(F.min("loaded").alias("loaded"), F.max("removed").alias("removed"))


def references(entries: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """`function_key`, `ref_field`, `ref_key`: the distinct references, one a row, so that no key's lists are put together."""
    tagged = lambda f: F.transform(F.array_distinct(F.transform(f, squeeze)), lambda r: F.struct(F.lit(f).alias("ref_field"), r.alias("ref_key")))
    lists = [tagged(f) for f in fields]
    none = F.array().cast("array<struct<ref_field:string,ref_key:string>>")
    rows = entries.select(squeeze(F.col(key)).alias("function_key"), F.explode(F.concat(*(F.coalesce(x, none) for x in lists))).alias("r"))
    return rows.select("function_key", "r.*").where("function_key != '' and ref_key != ''").distinct()


def broken_references(
    entries: DataFrame,
    library: DataFrame,
    key: str = "function_key",
    fields: Sequence[str] = ("calls_ids", "called_by_ids"),
    loaded: str = "loaded_at",
    removed: str = "removed_at",
    library_key: str = "function_key",
) -> DataFrame:
    """`function_key`, `loaded`, `ref_field`, `ref_key`, `reason` of each distinct broken reference.

    `missing`: a key of neither table; `deleted`: removed not after the load of the referring key; `late`: loaded
    after it. Keys of `library` are always there.
    """
    keyed = referring(entries, key, loaded, removed)
    children = references(entries, key, fields).join(keyed.select(F.col("key").alias("function_key"), F.col("loaded").alias("at")), "function_key")

    none = F.lit(None).cast(entries.schema[loaded].dataType)
    tagged = (
        children.select("ref_key", F.lit(0).alias("parent"), none.alias("loaded"), none.alias("removed"), F.col("at").alias("from_at"), F.col("at").alias("to_at"))
        .unionByName(keyed.select(F.col("key").alias("ref_key"), F.lit(1).alias("parent"), "loaded", "removed", none.alias("from_at"), none.alias("to_at")))
        .unionByName(library.select(squeeze(F.col(library_key)).alias("ref_key"), F.lit(2).alias("parent"), none.alias("loaded"), none.alias("removed"), none.alias("from_at"), none.alias("to_at")))
        .groupBy("ref_key")
        .agg(F.max("parent").alias("parent"), F.min("loaded").alias("p_loaded"), F.max("removed").alias("p_removed"), F.min("from_at").alias("from_at"), F.max("to_at").alias("to_at"), F.count_if(F.col("parent") == 0).alias("n"))
    )
    suspects = cut(tagged.where("n > 0 and (parent = 0 or (parent = 1 and (p_removed <= to_at or p_loaded > from_at)))").select("ref_key", "parent", "p_loaded", "p_removed", "n"))
    return (
        spread_join(children, suspects)
        .withColumn("reason", F.expr("case when parent = 0 then 'missing' when p_removed <= at then 'deleted' when p_loaded > at then 'late' end"))
        .where("reason is not null")
        .select("function_key", F.col("at").alias("loaded"), "ref_field", "ref_key", "reason")
    )


def spread_join(children: DataFrame, suspects: DataFrame, each: int = REFERENCES_A_SALT) -> DataFrame:
    """The references (ref_key and more) of the suspects (ref_key, n: how many references it has, and more).

    Where a key has too many for one task, its row is copied and its references are dealt out by a hash. The keys that
    need it are broadcast; by the choice of the bound there are at most MOST_HEAVY.
    """
    most, total = suspects.agg(F.max("n"), F.sum("n")).first()
    each = max(each, (total or 0) // MOST_HEAVY)
    if (most or 0) <= each:
        return children.join(suspects, "ref_key")
    parts = F.when(F.col("n") > each, F.floor(F.col("n") / each) + 1).otherwise(1).cast("int")
    heavy = F.broadcast(suspects.where(F.col("n") > each).select("ref_key", parts.alias("parts")))
    dealt = children.join(heavy, "ref_key", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("function_key", "ref_field"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    return dealt.join(suspects.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), ["ref_key", "part"]).drop("part")


def orphan_report(broken: DataFrame, period: str = "month") -> DataFrame:
    """Counts of broken references per referring table field, period of the referring key's load, and reason.

    Keys without a load time are counted under a null period.
    """
    return (
        broken.groupBy(F.date_trunc(period, "loaded").alias("period"), "ref_field", "reason")
        .agg(F.count("*").alias("n_references"), F.countDistinct("ref_key").alias("n_ref_keys"))
    )
