"""Registered queries of the problems on training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrain.llm import best_record, defects, documented, packing, residue, tokens
from flowgrain.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return best_record.best_records(table(spark, d, "k_functions")).select("first_id", "name_id", "comment_id", "place_id")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    return best_record.best_records(table(spark, d, "k_functions")).select("project", "qualified_name", "param_types", "comment", "file", F.coalesce("line", F.lit(0)).alias("line"), "n_records")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return defects.defects(table(spark, d, "cfg_nodes"), table(spark, d, "flowcharts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return documented.documented(table(spark, d, "source_files")).where("inherited_from is null").select("file", "line", "qualified_name")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented.documented(table(spark, d, "source_files")).select("project", "file", "line", "qualified_name", "signature", "comment", "inherited_from")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    used = p7_packed(spark, d).groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return used.agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count("*") * 2048)).alias("filled"), F.sum("n").alias("n_parts"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(table(spark, d, "documents")).groupBy("kind").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_survivors, p3_found, p4_found, p4_pairs, p6_ids, p7_packed, p7_report, p8_found, p8_kinds)}

_GROUPS = r"""with k as (
  select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(qualified_name, '\s', '', 'g'), '\(.*$', ''), '\.', '::', 'g'), '^:+', '') as nm,
    array_to_string(list_transform(string_split(regexp_replace(regexp_extract(signature, '\((.*)\)', 1), '\s*(::|[&*<>,])\s*', '\1', 'g'), ','),
      lambda p: trim(regexp_replace(trim(p), '^(.*[\s&*>])[A-Za-z_]\w*$', '\1'))), ',') as types
  from k_functions where qualified_name is not null),
ends as (select project, regexp_replace(nm, '^[^:]+::', '') as short, min(nm) as long from (select distinct project, nm from k) where nm like '%::%' group by 1, 2 having count(*) = 1),
g as (select k.*, coalesce(ends.long, nm) as full_name from k left join ends on ends.project = k.project and ends.short = k.nm),
c as (select *, regexp_replace(comment, '\s*(\[\.\.\.\]|…|\.\.\.)\s*$', '') as stem from g
  where comment is not null and not regexp_matches(lower(comment), '^\W*(todo(: describe)?|xxx.*|fixme|tbd|n/?a|none|undocumented|no comment|no description|description missing)?\W*$')),
whole as (select * from c where not exists (select 1 from c o where o.project = c.project and o.full_name = c.full_name and o.types = c.types and starts_with(o.comment, c.stem) and length(o.stem) > length(c.stem))),
wc as (select project, full_name, types, arg_max(comment, (coalesce(scanned_at, timestamp '0001-01-01'), -record_id)) as comment from whole group by 1, 2, 3),
pl as (select project, full_name, types, arg_max((file, line), (is_definition, coalesce(scanned_at, timestamp '0001-01-01'), -record_id)) as place from g
  where trim(file) != '' and line >= 1 group by 1, 2, 3),
r as (select g.project, g.full_name, g.types, count(*) as n_records, min(record_id) as first_id, coalesce(min(record_id) filter (qualified_name = full_name), 0) as name_id,
    coalesce(min(record_id) filter (g.comment = wc.comment), 0) as comment_id, coalesce(min(record_id) filter ((file, line) = place), 0) as place_id,
    any_value(wc.comment) as comment, any_value(place) as place
  from g left join wc using (project, full_name, types) left join pl using (project, full_name, types) group by 1, 2, 3 having count(*) > 1)
"""

ORACLE: dict[str, str] = {
    "p1_found": f"{_GROUPS} select first_id, name_id, comment_id, place_id from r",
    "p1_survivors": f"{_GROUPS} select project, full_name as qualified_name, types as param_types, comment, place[1] as file, coalesce(place[2], 0) as line, n_records from r",
}
