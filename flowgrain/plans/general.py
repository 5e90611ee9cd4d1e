"""Registered queries of the general problems 2 and 5, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrain.operators import hierarchy, orphans
from flowgrain.session import table


def _hierarchy(spark: SparkSession, d: str) -> hierarchy.Hierarchy:
    return hierarchy.resolve(*hierarchy.call_links(table(spark, d, "function_entries")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.levels(_hierarchy(spark, d))


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    found = hierarchy.paths(_hierarchy(spark, d))
    return found.select("function_key", "root_key", "level_no", F.array_join("path", " > ").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = hierarchy.call_links(table(spark, d, "function_entries"))
    return hierarchy.descendants(hierarchy.Hierarchy(nodes, links, links, links, links))


def p2_circles(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.circle_links(_hierarchy(spark, d))


def _broken(spark: SparkSession, d: str) -> DataFrame:
    return orphans.broken_references(table(spark, d, "function_entries"), table(spark, d, "library_functions"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("function_key", "ref_field", "ref_key", "reason")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_broken(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p2_circles, p5_found, p5_report)}

_LINKS = r"""
n as (select distinct regexp_replace(function_key, '\s', '', 'g') k from function_entries where function_key is not null),
s as (
  select regexp_replace(function_key, '\s', '', 'g') a, regexp_replace(unnest(calls_ids), '\s', '', 'g') b from function_entries
  union select regexp_replace(unnest(called_by_ids), '\s', '', 'g'), regexp_replace(function_key, '\s', '', 'g') from function_entries),
l as (select distinct a, b from s where a in (select k from n) and b in (select k from n))"""

_REACH = f"""with recursive {_LINKS},
r(a, b) as (select a, b from l union select r.a, l.b from r join l on l.a = r.b)"""

_ROOTS = f"""{_REACH},
c as (select distinct a k from r where a = b),
below as (select distinct r.b k from r join c on c.k = r.a where r.b not in (select k from c)),
good as (select k from n where k not in (select k from c) and k not in (select k from below)),
root as (select k from good where k not in (select b from l)),
top as (select g.k, coalesce(min(root.k), g.k) root_key from good g left join r on r.b = g.k left join root on root.k = r.a group by g.k),
lev as (select t.k, t.root_key, count(distinct r.a)::int level_no from top t left join r on r.b = t.k group by 1, 2)"""

_BROKEN = r"""with e as (
  select regexp_replace(function_key, '\s', '', 'g') k, min(loaded_at) since, max(removed_at) gone from function_entries group by 1),
refs as (
  select distinct regexp_replace(function_key, '\s', '', 'g') k, 'calls_ids' f, regexp_replace(unnest(calls_ids), '\s', '', 'g') r from function_entries
  union select distinct regexp_replace(function_key, '\s', '', 'g'), 'called_by_ids', regexp_replace(unnest(called_by_ids), '\s', '', 'g') from function_entries),
b as (
  select c.k function_key, c.since loaded, refs.f ref_field, refs.r ref_key,
    case when lib.k is not null then null when p.k is null then 'missing' when p.gone <= c.since then 'deleted' when p.since > c.since then 'late' end reason
  from refs join e c on c.k = refs.k left join e p on p.k = refs.r
  left join (select distinct function_key k from library_functions) lib on lib.k = refs.r
  where refs.r is not null and refs.r != '')"""

ORACLE = {
    "p2_found": f"""{_ROOTS}
select k function_key, root_key, level_no from lev
union all select k, '', -1 from c union all select k, '', -2 from below""",
    "p2_descendants": f"{_REACH} select a ancestor_key, b function_key from r",
    "p2_circles": f"""{_REACH} select l.a caller_key, l.b callee_key from l where l.a = l.b or exists (select 1 from r where r.a = l.b and r.b = l.a)""",
    "p2_paths": f"""{_ROOTS}
select lev.k function_key, lev.root_key, lev.level_no,
  (select string_agg(x.k, ' > ' order by x.level_no) from lev x where x.k = lev.k or exists (select 1 from r where r.a = x.k and r.b = lev.k)) path
from lev union all select k, '', -1, '' from c union all select k, '', -2, '' from below""",
    "p5_found": f"{_BROKEN} select function_key, ref_field, ref_key, reason from b where reason is not null",
    "p5_report": f"""{_BROKEN} select date_trunc('month', loaded)::timestamp as period, ref_field, reason, count(*) n_references, count(distinct ref_key) n_ref_keys
from b where reason is not null group by 1, 2, 3""",
}
