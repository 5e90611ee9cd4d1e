"""Best representative of each duplicate group (problem 1).

Method: consistent bundles. The fields of a record form bundles that are only taken whole: the function's key, the full
name, the state (declared or defined), the comment, and the place (file and line together). Equal values are first
counted together, so that a function with very many records shuffles few rows; of the candidates of a bundle that agree in
all attributes the dependencies look at, only the most trusted can be part of the best choice, so only it is kept. Branch
and bound then picks at most one candidate of each bundle so that the total trust is largest and all functional
dependencies between bundles hold. `DEPENDENCIES` states them as data: the key determines the name, and the state
determines where the place comes from. The most trusted state (defined) and the most trusted place can exclude each other,
as where a definition is known but its place isn't; then the search takes the declared state with its place.

Defined results: records without a name belong to no function; a missing signature counts as the parameter list
in the name, or as none; null times are oldest, ties go to the smaller record; 0 stands for no value; exact copies
are records of their own; groups of one record give no row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgrain.functions.names import parameter_types, plain_name
from flowgrain.session import cut

#: Comments that say nothing, without the marks around them.
STAND_INS = r"(?i)^\W*(to-?do(\W*(describe|document|write|fill).*)?|xxx.*|fixme.*|tbd|tbc|n/?a|none|nil|null|empty|undocumented|no (comment|description|documentation)( yet| available)?|(comment|description|documentation)( missing| pending)?|missing|unknown|fill in.*|to be (done|written|documented))?\W*$"
_CUT_MARK = r"(?U)\s*(\[\s*(\.{3}|…)\s*\]|\(\s*(\.{3}|…)\s*\)|…|\.{3,})\s*$"
#: Comments are compared within blocks of their first characters; shorter ones take a way of their own.
BLOCK = 12
#: Completed names that are sent to all tasks, at most; more are joined by a shuffle.
SENT = 100_000
_GROUP = ["project", "full", "types"]
#: Functional dependencies between bundles: (bundle, attribute, bundle, attribute) of which chosen candidates have the same
#: value. A candidate that lacks the attribute depends on nothing.
DEPENDENCIES = (("function", "names", "name", "names"), ("state", "kind", "place", "kind"))


def _micros(records: DataFrame, name: str) -> Column:
    """A time as a number that orders alike, 0 for null; without a zone, whatever zone the session has."""
    c = F.col(name)
    if records.schema[name].dataType.simpleString() == "timestamp_ntz":
        n = F.unix_date(F.to_date(c)).cast("long") * 86_400_000_000 + (F.hour(c) * 3_600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.expr(f"extract(second from {name})") * 1_000_000).cast("long")
    else:
        n = F.unix_micros(c)
    return F.coalesce(n + (1 << 59), F.lit(0).cast("long"))


def _rank(tier: Column, at: Column, record: Column) -> Column:
    """Source, recency and order of records as one number of fixed width, so that its maximum needs no sorting."""
    return (tier.cast("long") * (1 << 61) + at).cast("decimal(19,0)") * F.lit(Decimal(2 * 10**19)) + (F.lit(Decimal((1 << 63) - 1)) - record.cast("decimal(19,0)"))


def _long_names(records: DataFrame) -> DataFrame:
    """`p`, `short`, `long`: a project's plain names that lack the outermost namespace of the only full name that ends so.

    Each spelling is read once; each name stands for itself and for its end, in one grouping.
    """
    spelled = records.select(F.col("project").alias("p"), "qualified_name").where("qualified_name is not null").distinct()
    names = spelled.select("p", plain_name(F.col("qualified_name")).alias("name")).where("name != ''")
    as_short = F.struct(F.col("name").alias("short"), F.lit(None).cast("string").alias("long"))
    as_long = F.when(F.col("name").contains("::"), F.struct(F.regexp_replace("name", "^[^:]+::", "").alias("short"), F.col("name").alias("long")))
    ends = names.select("p", F.explode(F.filter(F.array(as_short, as_long), lambda x: x.isNotNull())).alias("x")).select("p", "x.*")
    return ends.groupBy("p", "short").agg(F.count_if(F.col("long").isNull()).alias("own"), F.min("long").alias("long"), F.max("long").alias("other")).where("own > 0 and long = other").select("p", "short", "long")


def _values(records: DataFrame) -> DataFrame:
    """One row per group (`project`, `full`, `types`), bundle and value: smallest record, newest record, number of records.

    Names are completed on the values, which are fewer than the records; equal values of one group are then counted
    together again.
    """
    known = records.select(
        "project",
        plain_name(F.col("qualified_name")).alias("name"),
        parameter_types(F.coalesce("signature", "qualified_name")).alias("types"),
        "record_id",
        _micros(records, "scanned_at").alias("at"),
        F.array(
            F.struct(F.lit("name").alias("bundle"), F.col("qualified_name").alias("value"), F.lit(0).alias("line"), F.expr("if(is_definition, 1, 0)").alias("tier")),
            F.expr(f"if(comment is null or comment rlike r'{STAND_INS}', null, struct('comment' as bundle, comment as value, 0 as line, 0 as tier))"),
            F.expr(r"if(file is null or file rlike r'(?U)^\s*$' or coalesce(line, 0) < 1, null, struct('place' as bundle, file as value, line as line, if(is_definition, 1, 0) as tier))"),
        ).alias("c"),
    ).where("name != ''")
    by_name = (
        known.select("project", "name", "types", "record_id", "at", F.explode("c").alias("c"))
        .where("c is not null")
        .select("project", "name", "types", "c.bundle", "c.value", "c.line", "record_id", _rank(F.col("c.tier"), F.col("at"), F.col("record_id")).alias("rank"))
        .groupBy("project", "name", "types", "bundle", "value", "line")
        .agg(F.min("record_id").alias("first"), F.max("rank").alias("rank"), F.count("*").alias("n"))
    )
    longer = cut(_long_names(records))
    longer = F.broadcast(longer) if longer.count() <= SENT else longer
    named = by_name.join(longer, F.col("project").eqNullSafe(F.col("p")) & (F.col("name") == F.col("short")), "left").withColumn("full", F.coalesce("long", "name"))
    return named.groupBy(*_GROUP, "bundle", "value", "line").agg(F.min("first").alias("first"), F.max("rank").alias("rank"), F.sum("n").alias("n"))


def _whole_comments(comments: DataFrame) -> DataFrame:
    """The comments that are no cut copy: none of the group goes on where they end.

    In binary order a text that goes on follows directly after the one it goes on from.
    """
    stems = comments.withColumn("stem", F.regexp_replace("value", _CUT_MARK, "")).withColumn("marked", F.col("stem") != F.col("value"))
    block = Window.partitionBy(*_GROUP, F.substring("stem", 1, BLOCK)).orderBy("stem", F.col("marked").desc(), "value")
    after = F.lead("stem").over(block)
    # a marked stem comes before the same stem unmarked, of which it is a copy
    long = stems.withColumn("cut", F.coalesce(after.startswith(F.col("stem")) & ((after != F.col("stem")) | F.col("marked")), F.lit(False)))
    # an equal stem may stand between a text and the one that goes on from it
    long = long.withColumn("cut", F.max(F.col("cut") & (after != F.col("stem"))).over(Window.partitionBy(*_GROUP, F.substring("stem", 1, BLOCK), "stem")) | F.col("cut"))
    # stems shorter than a block: only in groups that have one, the beginnings of the other stems are looked at
    short = stems.where(f"length(stem) < {BLOCK}").select(*_GROUP)
    begun = stems.join(short, _GROUP, "left_semi").select(*_GROUP, F.explode(F.expr(f"filter(transform(sequence(1, {BLOCK - 1}), k -> if(k < length(stem), substring(stem, 1, k), null)), x -> x is not null)")).alias("stem"))
    return long.where("not cut").join(begun, [*_GROUP, "stem"], "left_anti").drop("stem", "marked", "cut")


class Candidate(NamedTuple):
    """What may be taken for a bundle: its trust, the attributes that dependencies look at, and its place in the input."""

    trust: int
    attributes: dict[str, str]
    at: int


def choose(bundles: dict[str, list[Candidate]], dependencies: Sequence[tuple[str, str, str, str]] = DEPENDENCIES) -> tuple[int, dict[str, int], int]:
    """Branch and bound: at most one candidate of each bundle, so that the total trust is largest and all dependencies hold.

    Gives the trust, the place taken in each bundle (-1: none), and the number of branches looked at. Bundles with the
    fewest candidates come first, candidates by falling trust; a branch is left as soon as the best of all further bundles,
    whatever the dependencies, can't win against the best choice so far.
    """
    names = sorted(bundles, key=lambda b: len(bundles[b]))
    order = [sorted(bundles[b], key=lambda c: -c.trust) for b in names]
    rest = [0] * (len(order) + 1)
    for i in range(len(order) - 1, -1, -1):
        rest[i] = rest[i + 1] + (order[i][0].trust if order[i] else 0)
    rules: dict[str, list[tuple[str, str, str]]] = {}
    for a, x, b, y in dependencies:
        rules.setdefault(a, []).append((x, b, y))
        rules.setdefault(b, []).append((y, a, x))
    of_name = {b: i for i, b in enumerate(names)}
    before = [[(own, of_name[other], theirs) for own, other, theirs in rules.get(b, ()) if of_name.get(other, len(names)) < i] for i, b in enumerate(names)]
    best, best_taken, looked_at = -1, [], 0
    taken: list[Candidate | None] = [None] * len(order)

    def branch(i: int, total: int) -> None:
        nonlocal best, best_taken, looked_at
        looked_at += 1
        if i == len(order):
            best, best_taken = total, taken.copy()
            return
        for c in order[i]:
            if total + c.trust + rest[i + 1] <= best:
                return
            for own, j, theirs in before[i]:
                o = taken[j]
                if o is not None and own in c.attributes and theirs in o.attributes and c.attributes[own] != o.attributes[theirs]:
                    break
            else:
                taken[i] = c
                branch(i + 1, total + c.trust)
                taken[i] = None
        if total + rest[i + 1] > best:
            branch(i + 1, total)

    branch(0, 0)
    return best, {b: c.at if c else -1 for b, c in zip(names, best_taken)}, looked_at


#: Trust of a group's key: more than all else together, so that it is always taken.
KEY = 1 << 192
def trust(rank: int) -> int:
    """Completeness before source, recency and order of records, as one number that adds up over bundles."""
    return (1 << 130) + rank


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("name_id", pa.int64()), ("comment_id", pa.int64()), ("comment", pa.string()), ("place_id", pa.int64()), ("file", pa.string()), ("line", pa.int32()), ("state", pa.string())])
    for b in batches:
        lists = b.column(b.schema.get_field_index("candidates"))
        bundle, value, line, first, tier, rank = (x.to_pylist() for x in lists.flatten().flatten())
        ends, picked, k = pa.compute.list_value_length(lists).to_pylist(), [], 0
        for full, size in zip(b.column(1).to_pylist(), ends):
            bundles: dict[str, list[Candidate]] = {"function": [Candidate(KEY, {"names": full}, -1)], "state": [], "name": [], "comment": [], "place": []}
            for k in range(k, k + size):
                name = bundle[k]
                seen = {} if name == "comment" else {"names": value[k]} if name == "name" else {"kind": value[k] if name == "state" else "defined" if tier[k] else "declared"}
                bundles[name].append(Candidate(trust(int(rank[k])), seen, k))
            k += 1
            taken = choose(bundles)[1]
            of = lambda name, field, none=None: field[taken[name]] if taken[name] >= 0 else none  # noqa: B023, E731
            picked.append((of("name", first, 0), of("comment", first, 0), of("comment", value), of("place", first, 0), of("place", value), of("place", line), of("state", value)))
        fields = [pa.array(x, kind.field(i).type) for i, x in enumerate(zip(*picked))] if picked else [pa.array([], f.type) for f in kind]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.StructArray.from_arrays(fields, fields=list(kind))], names=[*b.schema.names[:5], "picked"])


def best_records(records: DataFrame) -> DataFrame:
    """One row per function with two records or more: `project`, `qualified_name`, `param_types`, `n_records`,
    `first_id`, and the surviving `comment`, `file`, `line` and `state` with the smallest records that hold each value."""
    values = cut(_values(records))
    kept = values.where("bundle != 'comment'").unionByName(_whole_comments(values.where("bundle = 'comment'")))

    # of the candidates that agree in the attributes of the dependencies only the most trusted is kept: names by whether
    # they are the full one, places by whether a definition stands there
    def row(bundle: str, here: Column, value: Column | None, tier: int) -> Column:
        r = F.max(F.when((F.col("bundle") == bundle) & here, F.struct("rank", "value", "line", "first")))
        as_value = r["value"] if value is None else value
        return F.when(r.isNotNull(), F.struct(F.lit("state" if value is not None else bundle).alias("bundle"), as_value.alias("value"), r["line"].alias("line"), r["first"].alias("first"), F.lit(tier).alias("tier"), r["rank"].alias("rank")))

    full = F.coalesce(F.col("value") == F.col("full"), F.lit(False))
    defined = F.col("rank") >= F.lit(Decimal((1 << 61) * 2 * 10**19))
    always, is_name = F.lit(True), F.col("bundle") == "name"
    sides = F.array(
        row("name", full, None, 0), row("name", ~full, None, 0), row("comment", always, None, 0), row("place", ~defined, None, 0), row("place", defined, None, 1),
        row("name", always, F.lit("declared"), 0), row("name", defined, F.lit("defined"), 1),
    )
    groups = kept.groupBy(*_GROUP).agg(F.sum(F.when(is_name, F.col("n"))).alias("n_records"), F.min(F.when(is_name, F.col("first"))).alias("first_id"), F.filter(sides, lambda c: c.isNotNull()).alias("candidates"))
    picked = groups.where("n_records > 1").select(*_GROUP, "n_records", "first_id", "candidates").mapInArrow(_pick, "project string, full string, types string, n_records long, first_id long, picked struct<name_id:long,comment_id:long,comment:string,place_id:long,file:string,line:int,state:string>")
    return picked.select("project", F.col("full").alias("qualified_name"), F.col("types").alias("param_types"), "n_records", "first_id", "picked.*")
