"""Registered queries of the engine's own operators over the project's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgrain.functions import folds, labels, text
from flowgrain.operators import cfg, comments, graph, labeling, lookups, resolver, scan
from flowgrain.plans import pipeline
from flowgrain.session import by_key, table
from flowgrain.sources import documents, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str = "") -> Callable:
    """Registers a query, with its SQL if it has one."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """One row per key: the earliest load, of those the smallest description."""
    e = table(spark, d, "function_entries")
    row = F.struct(*[c for c in e.columns if c != "function_key"])
    return e.groupBy("function_key").agg(F.min_by(row, F.struct("loaded_at", "description")).alias("r")).select("function_key", "r.*")


_E = """e as (select * exclude (n) from (select *, row_number() over (partition by function_key order by loaded_at, description nulls first) n from function_entries) where n = 1)"""
_N = """nd as (select * exclude (n) from (select *, row_number() over (partition by function_key, node_id order by label nulls last, raw_code) n from cfg_nodes) where n = 1)"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per node: of repeated rows the one with the smallest label."""
    n = by_key(table(spark, d, "cfg_nodes"), "function_key")
    row = F.struct(*[c for c in n.columns if c not in ("function_key", "node_id")])
    return n.groupBy("function_key", "node_id").agg(F.min_by(row, F.struct(F.coalesce("label", F.lit("\U0010ffff")), "raw_code")).alias("r")).select("function_key", "node_id", "r.*")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return by_key(table(spark, d, "source_files"), "file").groupBy("file").agg(F.min("source_text").alias("source_text"))


_F = "f as (select file, min(source_text) source_text from source_files group by file)"
_LINES = rf"""{_F}, sl as (select file, string_split_regex(regexp_replace(source_text, '^' || chr(65279), ''), '\r\n|\r|\n') l from f),
sn as (select file, case when l[-1] = '' then l[:-2] else l end l from sl),
ln as (select file, unnest(range(1, len(l) + 1))::int line_no, unnest(l) as text from sn)"""


# scans and sources


@query("""select file, project from (select distinct file, project from source_files) where regexp_matches(lower(file), '\\.(cpp|cc)$') and not regexp_matches(lower(file), '(^|/)(build|_build|out|dist|third_party|external|vendor|test|tests|googletest|gtest)/')
and not regexp_matches(lower(file), '^(/usr/|/lib/|c:/windows/|c:/program files)|/clang/|/c\\+\\+/v1/|/include/c\\+\\+/')""")
def scan_files(spark: SparkSession, d: str) -> DataFrame:
    return documents.source_paths(table(spark, d, "source_files").select("file", "project").distinct(), (".cpp", ".cc"))


@query(f"with {_LINES} select file, line_no, md5(text) as hash from ln")
def source_lines(spark: SparkSession, d: str) -> DataFrame:
    return comments.source_lines(_files(spark, d)).select("file", "line_no", F.md5("text").alias("hash"))


@query("""select event_id, key, 1 as ord, json_extract_string(props, '$.' || key) as value from (select event_id, props, unnest(json_keys(props)) key from events)""")
def json_map_explode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.posexplode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("ord", "e"))
    return e.select("event_id", F.col("e.key").alias("key"), (F.col("ord") + 1).alias("ord"), F.col("e.value").alias("value"))


@query(f"with {_E} select function_key, coalesce(qualified_name, '') qualified_name, file, line, coalesce(end_line, 0) end_line, len(coalesce(params, [])) n_params, len(coalesce(calls_ids, [])) n_calls, coalesce(description, '') description from e")
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Writes every entry as a document of its own and reads it back as an index."""
    e = _entries(spark, d)
    entry = F.struct(F.col("qualified_name").alias("qualifiedName"), F.struct("file", "line", F.col("end_line").alias("endLine")).alias("location"), F.col("params").alias("parameters"), F.col("calls_ids").alias("callsIds"), F.col("called_by_ids").alias("calledByIds"), "description")
    docs = e.select(F.to_json(F.create_map("function_key", entry)).alias("value"))
    back = documents.function_index(docs)
    return back.select("function_key", "qualified_name", "file", "line", "end_line", F.size("params").alias("n_params"), F.size("calls_ids").alias("n_calls"), "description")


# filters and grouping


@query("select o_orderkey, o_custkey from orders where o_custkey = 7")
def key_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_custkey") == 7).select("o_orderkey", "o_custkey")


@query("""select distinct r as callee_id from (select unnest(calls_ids) r from function_entries) where r is not null and trim(r) != '' and r not in (select function_key from function_entries)""")
def unknown_keys(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "function_entries")
    wanted = e.select(F.explode("calls_ids").alias("function_key")).where("function_key is not null and trim(function_key) != ''").distinct()
    return lookups.split_keys(e, wanted)[1].select(F.col("function_key").alias("callee_id"))


@query(f"with {_E} select qualified_name, array_to_string(list(function_key order by function_key), ';') as keys from e group by 1")
def name_index(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d).withColumn("pos", F.col("function_key"))
    return lookups.name_index(e).select("qualified_name", F.array_join("keys", ";").alias("keys"))


@query(f"with {_E} select qualified_name, min(function_key) as function_key from e group by 1")
def first_by_name(spark: SparkSession, d: str) -> DataFrame:
    return lookups.first_by_name(_entries(spark, d).withColumn("pos", F.col("function_key")))


@query(f"with {_E} select file, count(*) as n, min(line) as first_line, array_to_string(list(line order by line), ',') as lines from e group by 1")
def group_by_file(spark: SparkSession, d: str) -> DataFrame:
    g = _entries(spark, d).groupBy("file").agg(F.count("*").alias("n"), F.min("line").alias("first_line"), F.array_sort(F.collect_list("line")).alias("l"))
    return g.select("file", "n", "first_line", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("lines"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "flowcharts").select("function_key", "qualified_name", "mermaid_script", "error").distinct()
    one = c.groupBy("function_key").agg(F.min(F.struct("qualified_name", "mermaid_script", "error")).alias("r")).select("function_key", "r.*")
    where = _entries(spark, d).select("function_key", F.col("file").alias("source_file"), F.col("line").alias("ord"))
    fatal = F.when(F.col("mermaid_script") == "", F.col("error"))
    return one.join(where, "function_key").select("source_file", "ord", "function_key", "qualified_name", "mermaid_script", fatal.alias("error"))


_R = f"""{_E}, c as (select function_key, min((qualified_name, mermaid_script, error)) r from flowcharts group by 1),
res as (select e.file source_file, e.line ord, c.function_key, r[1] qualified_name, r[2] mermaid_script, case when r[2] = '' then r[3] end error from c join e using (function_key))"""


@query(f"with {_R} select source_file, count(*) filter (coalesce(error, '') = '') as ok, count(*) filter (coalesce(error, '') != '') as errors from res group by rollup (source_file)")
def summary_totals(spark: SparkSession, d: str) -> DataFrame:
    return sinks.totals(_results(spark, d))


@query(f"""with {_R}, p as (select source_file, count(*) filter (coalesce(error, '') = '') ok, count(*) filter (coalesce(error, '') != '') errors from res group by 1)
select 0 as ord, '' as key, sum(ok + errors)::bigint as ok, sum(errors)::bigint as errors from p union all select 1, source_file, ok, errors from p""")
def summary_document(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the summary, read back from their JSON."""
    item = F.from_json("item", f"struct<totalFunctions:long,totalErrors:long,sourceFile:string,{sinks.COUNTED}:long,errors:long>")
    return sinks.summary_items(_results(spark, d)).select("ord", F.coalesce(item["sourceFile"], F.lit("")).alias("key"), F.coalesce(item["totalFunctions"], item[sinks.COUNTED]).alias("ok"), F.coalesce(item["totalErrors"], item["errors"]).alias("errors"))


_ITEM = "struct<functionKey:string,qualifiedName:string,mermaidScript:string,error:string>"


def _read_back(items: DataFrame) -> DataFrame:
    i = F.from_json("item", _ITEM)
    return items.select("name", "ord", i["functionKey"].alias("function_key"), i["qualifiedName"].alias("qualified_name"), F.md5(i["mermaidScript"]).alias("script"), i["error"].alias("error"))


@query(f"""with {_R}, st as (select *, regexp_replace(regexp_extract(source_file, '([^/]*)$', 1), '\\.[^.]*$', '') || '.json' as name from res),
w as (select name, max(source_file) source_file from st group by 1)
select st.name, ord, function_key, qualified_name, md5(mermaid_script) as script, nullif(error, '') as error from st join w on w.name = st.name and w.source_file = st.source_file""")
def file_documents_by_stem(spark: SparkSession, d: str) -> DataFrame:
    return _read_back(sinks.file_items(_results(spark, d), by_stem=True))


@query(f"with {_R} select source_file || '.json' as name, ord, function_key, qualified_name, md5(mermaid_script) as script, nullif(error, '') as error from res")
def file_documents(spark: SparkSession, d: str) -> DataFrame:
    return _read_back(sinks.file_items(_results(spark, d)))


@query("""select qualified_name, min(record_id) as first_pos,
coalesce(arg_min(record_id, record_id) filter (coalesce(comment, '') != ''), arg_max(record_id, record_id) filter (is_definition), min(record_id)) as chosen from k_functions group by 1""")
def merge_functions(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "k_functions").withColumn("pos", F.col("record_id"))
    return lookups.merge_functions(k).select("qualified_name", "first_pos", F.col("record_id").alias("chosen"))


@query("select user_id, min(event_id) as first_pos, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by 1")
def last_writer(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id").withColumn("pos", F.col("event_id"))
    return lookups.last_writer(e, "user_id").select("user_id", "first_pos", "event_type", "event_id")


@query("select project, count(*) as n, count(comment) as n_comments, count(distinct file) as n_files from k_functions group by 1")
def knowledge_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "k_functions").groupBy("project").agg(F.count("*").alias("n"), F.count("comment").alias("n_comments"), F.countDistinct("file").alias("n_files"))


_CASES = "cs as (select distinct project, split_part(n, '_', 1) as prefix, n from (select project, regexp_extract(raw_code, '^case ([A-Z]+_[A-Z0-9_]+)', 1) as n from cfg_nodes where node_type = 'CASE') where n != '')"


def _case_members(spark: SparkSession, d: str) -> DataFrame:
    """`project`, `prefix`, `n`: the names of cases by what they begin with, as members of enumerations."""
    n = table(spark, d, "cfg_nodes").where("node_type = 'CASE'").select("project", F.regexp_extract("raw_code", "^case ([A-Z]+_[A-Z0-9_]+)", 1).alias("n"))
    return n.where("n != ''").select("project", F.substring_index("n", "_", 1).alias("prefix"), "n").distinct()


@query(f"""with {_CASES}, v as (select *, row_number() over (partition by project, prefix order by n) i, count(*) over (partition by project, prefix) c from cs)
select project, prefix as enum, prefix || '; values: ' || string_agg(n || '=' || length(n), ', ' order by i) filter (i <= 8) || case when max(c) > 8 then ';   ... and ' || (max(c) - 8) || ' more' else '' end as summary from v group by project, prefix""")
def enum_summary(spark: SparkSession, d: str) -> DataFrame:
    v = _case_members(spark, d).groupBy("project", "prefix").agg(F.array_sort(F.collect_list("n")).alias("v"))
    values = F.transform("v", lambda x: F.struct(x.alias("name"), F.length(x).cast("string").alias("value"), F.lit("").alias("comment")))
    return v.select("project", F.col("prefix").alias("enum"), labels.enum_summary(F.col("prefix"), values).alias("summary"))


@query(f"""with {_CASES}, o as (select *, row_number() over (partition by project, prefix order by n) - 1 as ord from cs),
g as (select *, max(ord) filter (ord % 3 = 1) over (partition by project, prefix order by ord) as given_ord from o)
select project || '.h' as file, project || '::' || prefix as enum, ord::int as ord, n as name, (case when given_ord is null then ord else 16 * given_ord + 2 + ord - given_ord end)::varchar as value,
  case when ord % 3 = 2 then 'above ' || n else 'beside ' || ord end as comment from g""")
def scanned_enums(spark: SparkSession, d: str) -> DataFrame:
    """Enumerations of the names of cases, written as C++ with one member a line, with values and comments of several forms, and scanned."""
    member = Window.partitionBy("project", "prefix").orderBy("n")
    m = _case_members(spark, d).withColumn("ord", F.row_number().over(member) - 1)
    value = F.when(F.col("ord") % 3 == 1, F.concat(F.lit(" = 0x"), F.lower(F.hex("ord")), F.lit("0 + (1 << 1)"))).otherwise("")
    line = F.when(F.col("ord") % 3 == 2, F.concat(F.lit("  // above "), F.col("n"), F.lit("\n  "), F.col("n"), value, F.lit(","))).otherwise(F.concat(F.lit("  "), F.col("n"), value, F.lit(",  // beside "), F.col("ord")))
    body = m.groupBy("project", "prefix").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    one = F.concat(F.lit("enum class "), F.col("prefix"), F.lit(" : int {\n"), F.col("b"), F.lit("\n};\n"))
    texts = body.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list(one)), "\n").alias("t"))
    files = texts.select(F.concat("project", F.lit(".h")).alias("file"), F.concat(F.lit("namespace "), F.col("project"), F.lit(" {\n"), F.col("t"), F.lit("}\n")).alias("source_text"))
    e = scan.enums(scan.symbols(files)).where("name like '%::%'")
    return e.select("file", F.col("name").alias("enum"), F.posexplode("members").alias("ord", "m")).select("file", "enum", "ord", "m.name", "m.value", "m.comment")


# lookups


@query(rf"""with {_E}, c as (select function_key, unnest(range(0, len(calls_ids))) ord, unnest(calls_ids) callee_id from e),
k as (select qualified_name, k[1] signature, k[2] comment from (select qualified_name, arg_min((signature, comment), function_key) k from library_functions group by 1)),
p as (select e.function_key, qualified_name || '(' || coalesce(array_to_string(list_transform(params, lambda x: trim(x.type || ' ' || x.name)), ', '), '') || ')' sig, qualified_name, description from e)
select c.function_key, c.ord::int as ord, c.callee_id, coalesce(p.sig, k.signature) as signature, coalesce(nullif(k.comment, ''), nullif(p.description, ''), '') as description
from c left join p on p.function_key = c.callee_id
left join k on k.qualified_name = coalesce(p.qualified_name, case when c.callee_id like '%|%' then split_part(c.callee_id, '|', 3) else c.callee_id end)
where c.callee_id is not null and coalesce(p.sig, k.signature) is not null""")
def resolve_callees(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "library_functions").withColumn("pos", F.col("function_key"))
    return lookups.resolve_callees(_entries(spark, d), known)


@query(rf"""with {_E}, {_N}, {_F}, code as (select function_key, node_id, raw_code from nd where node_type not in ('START', 'END', 'BREAK', 'CONTINUE') union all select e.function_key, 'file', f.source_text from e join f using (file)),
nm as (select function_key, node_id, unnest(list_distinct(regexp_extract_all(raw_code, '(\w[\w:~<>]*)\s*\(', 1))) as name from code),
c as (select function_key, unnest(range(0, len(calls_ids))) ord, unnest(calls_ids) callee_id from e),
p as (select function_key, split_part(split_part(qualified_name, '::', -1), '<', 1) as name, qualified_name || '(' || coalesce(array_to_string(list_transform(params, lambda x: trim(x.type || ' ' || x.name)), ', '), '') || ')' sig, coalesce(description, '') description from e)
select c.function_key, nm.node_id, c.ord::int as ord, p.sig as signature, p.description from c join p on p.function_key = c.callee_id join nm on nm.function_key = c.function_key and nm.name = p.name""")
def calls_in_code(spark: SparkSession, d: str) -> DataFrame:
    """The callees that nodes name, and those that the file of a function names; nodes of the test tables name none."""
    e, n = _entries(spark, d), _nodes(spark, d).select("function_key", "node_id", "node_type", "raw_code")
    whole = e.join(_files(spark, d), "file").select("function_key", F.lit("file").alias("node_id"), F.lit("ACTION").alias("node_type"), F.col("source_text").alias("raw_code"))
    return lookups.calls_in_code(n.unionByName(whole), e)


@query(rf"""with {_E}, {_LINES}, ids as (select distinct c as callee_id from (select unnest(calls_ids) c from e) where c like '%|%|%'),
tried as (select callee_id, split_part(split_part(split_part(callee_id, '|', 3), '::', -1), '<', 1) as name, probe, split_part(callee_id, '|', 1) || '/' || split_part(callee_id, '|', 2) || ext as file from ids, (values (0, '.cpp'), (1, '.h'), (2, '.hpp'), (3, '.cc')) x(probe, ext)),
lt as (select file, line_no, text from ln where file in (select file from tried)),
c as (select file, line_no, unnest(list_distinct(regexp_extract_all(text, '\b(\w+)\s*\(', 1))) as name from lt),
hit as (select callee_id, file, probe, min(line_no) line_no from tried join c using (file, name) group by 1, 2, 3),
best as (select callee_id, arg_min(file, probe) file, arg_min(line_no, probe) line_no from hit group by 1),
u as (select file, line_no, coalesce(min(case when contains(text, '{{') then line_no end) over (partition by file order by line_no rows between current row and unbounded following), max(line_no) over (partition by file)) until from lt)
select callee_id, file, trim(split_part(string_agg(trim(lt.text, ' ' || chr(9) || chr(12)), ' ' order by lt.line_no), '{{', 1)) as signature from best join u using (file, line_no) join lt on lt.file = best.file and lt.line_no between best.line_no and u.until group by 1, 2""")
def callees_in_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every callee whose key points to a source file, looked up there."""
    ids = _entries(spark, d).select(F.explode("calls_ids").alias("callee_id")).where("callee_id is not null")
    return lookups.callees_in_sources(ids, _files(spark, d)).select("callee_id", "file", "signature")


_MACROS = "m as (select distinct regexp_extract(raw_code, '^case ([A-Z_][A-Z0-9_]{2,})', 1) as name from nd where node_type = 'CASE')"


def _case_names(nodes: DataFrame) -> DataFrame:
    return nodes.where("node_type = 'CASE'").select(F.regexp_extract("raw_code", "^case ([A-Z_][A-Z0-9_]{2,})", 1).alias("name")).where("name != ''").distinct()


@query(rf"""with {_N}, {_MACROS}, t as (select function_key, node_id, unnest(list_distinct(regexp_extract_all(raw_code, '\b([A-Z_][A-Z0-9_]{{2,}})\b', 1))) as name from nd)
select function_key, node_id, name from t join m using (name) where name != ''""")
def macros_in_code(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    return lookups.symbols_in_code(n, _case_names(n), "name", macros=True).select("function_key", "node_id", "name")


@query(rf"""with {_N}, s as (select distinct split_part(qualified_name, '::', -1) as name from library_functions),
t as (select function_key, node_id, unnest(list_distinct(regexp_extract_all(raw_code, '\b([A-Za-z_]\w*)\b', 1))) as name from nd)
select function_key, node_id, name from t join s using (name)""")
def symbols_in_code(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "library_functions").select(labels.last_name(F.col("qualified_name")).alias("name")).distinct()
    return lookups.symbols_in_code(_nodes(spark, d), s, "name").select("function_key", "node_id", "name")


@query(rf"""with {_N}, {_MACROS}, v as (select name, split_part(name, '_', 1) as enum from m where name != ''),
t as (select function_key, node_id, regexp_extract_all(raw_code, '\b([A-Za-z_]\w*)\b', 1) l from nd),
u as (select function_key, node_id, unnest(l) token, unnest(range(0, len(l))) i from t)
select function_key, node_id, (row_number() over (partition by function_key, node_id order by i) - 1)::int as ord, enum
from (select function_key, node_id, enum, min(i) i from u join v on u.token = v.name or u.token = v.enum group by 1, 2, 3)""")
def enums_in_code(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    values = _case_names(n).withColumn("enum", F.substring_index("name", "_", 1)).withColumn("ord", F.crc32("enum"))
    return lookups.enums_in_code(n, values)


@query(rf"""with {_E}, t as (select function_key, list_transform(params, lambda x: regexp_replace(split_part(x.type, '::', -1), '[*&<> ].*', '')) l from e),
u as (select function_key, unnest(l) as type_name, unnest(range(0, len(l))) i from t), g as (select function_key, type_name, min(i) i from u group by 1, 2),
o as (select *, (row_number() over (partition by function_key order by i) - 1)::int as ord from g)
select function_key, ord, type_name, 'type ' || type_name as summary from o where regexp_matches(type_name, '^[A-Z]')""")
def parameter_type_notes(spark: SparkSession, d: str) -> DataFrame:
    """The parameter types of the project's own, which begin with a capital."""
    e = _entries(spark, d)
    types = e.select(F.explode("params").alias("p")).select(labels.simple_type(F.col("p.type")).alias("name")).distinct().where(F.col("name").rlike("^[A-Z]"))
    return lookups.parameter_type_notes(e, types.select("name", F.lit("enum").alias("kind"), F.concat(F.lit("type "), F.col("name")).alias("summary")))


@query(rf"""with {_E}, k as (select qualified_name, arg_min(comment, record_id) c from k_functions where comment != '' group by 1)
select function_key, coalesce(k.c, e.description, '') as purpose from e left join k using (qualified_name)""")
def purpose(spark: SparkSession, d: str) -> DataFrame:
    return lookups.purpose(_entries(spark, d), table(spark, d, "k_functions").withColumn("pos", F.col("record_id")))


@query(rf"""with {_E}, {_LINES}, w as (select distinct file, split_part(split_part(qualified_name, '::', -1), '<', 1) as name from e),
c as (select file, line_no, unnest(list_distinct(regexp_extract_all(text, '\b(\w+)\s*\(', 1))) as name from ln),
hit as (select file, name, min(line_no) as line_no from c join w using (file, name) group by 1, 2),
u as (select file, line_no, coalesce(min(case when contains(text, '{{') then line_no end) over (partition by file order by line_no rows between current row and unbounded following), max(line_no) over (partition by file)) until from ln)
select hit.file, name, hit.line_no, trim(split_part(string_agg(trim(ln.text, ' ' || chr(9) || chr(12)), ' ' order by ln.line_no), '{{', 1)) as signature from hit join u using (file, line_no) join ln on ln.file = hit.file and ln.line_no between hit.line_no and u.until group by 1, 2, 3""")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    names = _entries(spark, d).select("file", labels.last_name(F.col("qualified_name")).alias("name"))
    return lookups.first_match(comments.source_lines(_files(spark, d)), names).select("file", "name", "line_no", "signature")


@query(rf"""with {_E}, c as (select record_id, lower(replace(file, chr(92), '/')) file_id, lower(split_part(split_part(qualified_name, '<', 1), '::', -1)) c_name, line, line + 10 as end_line, is_definition from k_functions where file is not null and line >= 1),
w as (select function_key, lower(replace(file, chr(92), '/')) file_id, line wl, end_line we, lower(split_part(split_part(qualified_name, '<', 1), '::', -1)) wn from e),
p as (select *, contains(c_name, wn) named, abs(line - wl) <= 10 near, line <= wl and end_line >= coalesce(we, wl) around from w join c using (file_id) where abs(line - wl) <= 25),
t as (select *, case when named and near and line <= wl and end_line >= wl then 1 when around or (near and named) then 2 when named then 3 end tier from p),
s as (select *, case when c_name = wn then 100 when named then 40 else 0 end - abs(line - wl) - least(abs(end_line - coalesce(we, end_line)), 20) + case when is_definition then 20 else 0 end
  + case when tier = 2 and not around then -15 when tier = 3 then -50 else 0 end score from t where tier is not null)
select function_key, tier, score, line from (select *, row_number() over (partition by function_key order by tier, case when tier = 1 then -line end, score desc, record_id) n from s) where n = 1""")
def resolve_cursors(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "k_functions").where("file is not null and line >= 1")
    cursors = k.select("file", F.col("qualified_name").alias("name"), "line", (F.col("line") + 10).alias("end_line"), "is_definition", F.col("record_id").alias("visit_ord"))
    return resolver.resolve_cursors(_entries(spark, d), cursors).select("function_key", "tier", "score", "line")


# lines and comments


@query(rf"""with {_LINES} select file, line_no, trim(regexp_extract(text, '^(?:[^"/]|"(?:[^"\\]|\\.)*"|/[^/])*//(.*)$', 1), ' ' || chr(9) || chr(12)) as comment from ln
where trim(regexp_extract(text, '^(?:[^"/]|"(?:[^"\\]|\\.)*"|/[^/])*//(.*)$', 1), ' ' || chr(9) || chr(12)) != ''""")
def inline_comments(spark: SparkSession, d: str) -> DataFrame:
    return comments.inline_comments(comments.source_lines(_files(spark, d)))


_NEAR = r"""nb as (select w.*, x.text as own_text from w join ln x on x.file = w.file and x.line_no = w.line_no),
own as (select *, trim(regexp_extract(own_text, '^(?:[^"/]|"(?:[^"\\]|\\.)*"|/[^/])*//(.*)$', 1), ' ' || chr(9) || chr(12)) as o from nb),
pre as (select own.file, own.line_no, x.line_no as n, trim(x.text, ' ' || chr(9) || chr(12)) as t from own join ln x on x.file = own.file and x.line_no between own.line_no - 4 and own.line_no - 1),
kd as (select *, case when t = '' then 'blank' when starts_with(t, '//') then 'line' when ends_with(t, '*/') or starts_with(t, '*') then 'block' else 'code' end as kind from pre),
lim as (select file, line_no, coalesce(max(case when kind = 'code' then n end), 0) as stop from kd group by 1, 2),
sd as (select kd.file, kd.line_no, kd.n, nullif(case kind when 'line' then regexp_replace(t, '^[/ ]+', '') when 'block' then regexp_replace(regexp_replace(t, '^[*/ ]+', ''), '[*/ ]+$', '') end, '') as said from kd join lim using (file, line_no) where kd.n > stop),
ab as (select file, line_no, trim(string_agg(said, ' ' order by n)) as a from sd group by 1, 2),
near as (select own.file, own.line_no, case when o != '' then o else coalesce(ab.a, '') end as comment from own left join ab using (file, line_no))"""


@query(f"with {_E}, {_LINES}, w as (select distinct file, line as line_no from e), {_NEAR} select file, line_no, comment from near")
def nearest_comments(spark: SparkSession, d: str) -> DataFrame:
    targets = _entries(spark, d).select("file", F.col("line").alias("line_no"))
    return comments.nearest_comments(comments.source_lines(_files(spark, d)), targets)


@query(rf"""with {_E}, {_LINES}, s as (select *, trim(text, ' ' || chr(9) || chr(12)) t from ln),
x as (select *, sum(case when starts_with(t, '//') then 0 else 1 end) over (partition by file order by line_no) run, max(case when t != '' then line_no end) over (partition by file order by line_no rows between unbounded preceding and 1 preceding) last_text,
  max(case when contains(text, '/*') then line_no end) over (partition by file order by line_no) opened from s),
r as (select file, run, max(line_no) last_text, string_agg(nullif(regexp_replace(t, '^[/ ]+', ''), ''), ' ' order by line_no) as comment from x where starts_with(t, '//') group by 1, 2),
tg as (select distinct x.file, x.line_no, x.last_text from x join e on e.file = x.file and e.line = x.line_no),
bl as (select tg.file, tg.line_no, tg.last_text, b.opened from tg join x b on b.file = tg.file and b.line_no = tg.last_text where ends_with(b.t, '*/') and not starts_with(b.t, '//')),
bw as (select bl.file, bl.line_no, x.line_no as n, case when x.line_no = bl.opened then trim(regexp_replace(trim(regexp_replace(x.text, '/\*+\s*', '', 'g'), ' ' || chr(9) || chr(12)), '[*/]+$', ''), ' ' || chr(9) || chr(12)) else regexp_replace(x.t, '^[* ]+', '') end as word from bl join x on x.file = bl.file and x.line_no between coalesce(bl.opened, 0) and bl.last_text)
select tg.file, tg.line_no, coalesce(r.comment, '') as comment from tg join r on r.file = tg.file and r.last_text = tg.last_text
union all select file, line_no, coalesce(string_agg(nullif(word, ''), ' ' order by n), '') from bw group by 1, 2""")
def preceding_comments(spark: SparkSession, d: str) -> DataFrame:
    targets = _entries(spark, d).select("file", F.col("line").alias("line_no"))
    return comments.preceding_comments(comments.source_lines(_files(spark, d)), targets)


@query(rf"""with recursive {_N}, n as (select function_key, node_seq, greatest(end_line - start_line + 1, 1) size, row_number() over (partition by function_key order by node_seq, node_id) i from nd),
g(function_key, i, seg, cnt, tot) as (select function_key, i, 0, 1, size from n where i = 1 union all
  select n.function_key, n.i, case when g.cnt >= 5 or g.tot + n.size > 10 then seg + 1 else seg end, case when g.cnt >= 5 or g.tot + n.size > 10 then 1 else cnt + 1 end, case when g.cnt >= 5 or g.tot + n.size > 10 then n.size else tot + n.size end
  from g join n on n.function_key = g.function_key and n.i = g.i + 1)
select function_key, i::int as i, seg from g""")
def greedy_segments(spark: SparkSession, d: str) -> DataFrame:
    size = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))
    n = _nodes(spark, d).groupBy("function_key").agg(F.array_sort(F.collect_list(F.struct("node_seq", "node_id", size.alias("s")))).alias("l"))
    return n.select("function_key", F.posexplode(folds.greedy_segments(F.col("l.s"))).alias("i", "seg")).select("function_key", (F.col("i") + 1).alias("i"), "seg")


@query(rf"""with {_E}, {_LINES} select e.function_key, md5(string_agg(ln.text, chr(10) order by ln.line_no)) as hash from e join ln on ln.file = e.file and ln.line_no between e.line and e.end_line group by 1""")
def function_source(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d).select("file", text.lines(F.regexp_replace("source_text", "^﻿", "")).alias("l"))
    e = _entries(spark, d).where("end_line is not null").join(f, "file")
    return e.select("function_key", F.md5(text.slice_lines(F.col("l"), F.col("line"), F.col("end_line"))).alias("hash"))


@query(rf"""with {_E}, {_LINES}, p as (select e.function_key, e.line as sl, least(e.end_line, len(l)) as el, 1 + e.line % 4 as sc, 2 + e.line % 7 as ec, l from e join sn on sn.file = e.file where end_line is not null)
select function_key, md5(case when el < sl then '' when el = sl then regexp_replace(substring(l[sl], sc, ec - sc), '^\s+|\s+$', '', 'g') else
  array_to_string(list_concat([regexp_replace(substring(l[sl], sc), '\s+$', '')], list_transform(l[sl + 1:el - 1], lambda x: regexp_replace(x, '\s+$', '')), [regexp_replace(substring(l[el], 1, ec - 1), '\s+$', '')]), chr(10)) end) as hash from p""")
def extent_slice(spark: SparkSession, d: str) -> DataFrame:
    """From a column of each entry's first line to a column of its last."""
    f = _files(spark, d).select("file", text.lines(F.regexp_replace("source_text", "^﻿", "")).alias("l"))
    e = _entries(spark, d).where("end_line is not null").join(f, "file")
    return e.select("function_key", F.md5(text.extent(F.col("l"), F.col("line"), F.col("end_line"), 1 + F.col("line") % 4, 2 + F.col("line") % 7)).alias("hash"))


# scalar functions


def _sql_escape(c: str, table_: dict[str, str]) -> str:
    for a, b in table_.items():
        c = f"replace({c}, '{a}', '{b}')"
    return c


_NODE_TEXT = "replace(replace(replace(replace(label, '<br/>', chr(1)), '<br />', chr(1)), chr(10), chr(1)), chr(13), '')"


@query(f"with {_N} select function_key, node_id, replace({_sql_escape(_NODE_TEXT, labels.NODE_ENTITIES)}, chr(1), '<br/>') as escaped from nd where label is not null")
def escape_node(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where("label is not null").select("function_key", "node_id", labels.escape_node(F.col("label")).alias("escaped"))


@query(f"with {_N} select function_key, node_id, {_sql_escape('raw_code', labels.EDGE_ENTITIES)} as escaped from nd")
def escape_edge(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("function_key", "node_id", labels.escape_edge(F.col("raw_code")).alias("escaped"))


_EDGES = r"""sc as (select distinct function_key, mermaid_script s from flowcharts where mermaid_script != ''),
sp as (select function_key, string_split(s, chr(10)) l from sc),
el as (select function_key, unnest(range(0, len(l)))::int edge_ord, unnest(l) as line from sp),
ed as (select function_key, edge_ord, regexp_extract(line, '^\s*(\w+) -->(?:\|(.*)\|)? (\w+)\s*$', 1) source, regexp_extract(line, '^\s*(\w+) -->(?:\|(.*)\|)? (\w+)\s*$', 3) target,
  nullif(regexp_extract(line, '^\s*(\w+) -->(?:\|(.*)\|)? (\w+)\s*$', 2), '') as label from el where contains(line, ' -->') and regexp_matches(line, '^\s*(\w+) -->(?:\|(.*)\|)? (\w+)\s*$'))"""


@query(f"with {_EDGES} select function_key, edge_ord, source, target, case when lower(trim(label)) in ('yes', 'true', '1') then 'Yes' when lower(trim(label)) in ('no', 'false', '0') then 'No' else nullif(trim(label), '') end as label from ed")
def script_edges(spark: SparkSession, d: str) -> DataFrame:
    e = graph.script_edges(table(spark, d, "flowcharts"))
    return e.withColumn("label", labels.edge_label(F.col("label")))


_COND = "trim(raw_code, ' ' || chr(9) || chr(10))"


def _sql_condition() -> str:
    words = _COND
    for sign, said in (*labels.COMPARISONS, *labels.CONNECTIVES):
        words = f"regexp_replace({words}, '\\s*{sign}\\s*', ' {said} ', 'g')"
    words = f"regexp_replace({words}, '\\b(nullptr|NULL)\\b', 'null', 'g')"
    words = f"regexp_replace(replace(replace({words}, '->', '.'), '&', ' '), '\\w+::', '', 'g')"
    return f"trim(regexp_replace({words}, ';+$', ''))"


def _sql_predicate() -> str:
    """The phrase of a call at the start of a condition, by its first fitting prefix."""
    bare = f"regexp_replace({_COND}, '^!\\s*', '')"
    method = f"regexp_extract({bare}, '^(\\w+)\\s*\\(', 1)"
    out = "case"
    for p in labels.PREDICATES:
        words = f"lower(trim(regexp_replace(substring({method}, {len(p) + 1}), '([A-Z])', ' \\1', 'g')))"
        yes, no = (f"'is ' || {words}", f"'is not ' || {words}") if p in ("is", "are") else (f"'{p}s ' || {words}", f"'does not {p} ' || {words}")
        out += f" when starts_with(lower({method}), '{p}') and length({method}) > {len(p)} then case when starts_with({_COND}, '!') then {no} else {yes} end"
    return out + " end"


@query(f"with {_N} select function_key, node_id, coalesce({_sql_predicate()}, {_sql_condition()}) as said from nd where node_type = 'DECISION'")
def condition_in_words(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where("node_type = 'DECISION'").select("function_key", "node_id", labels.condition(F.col("raw_code")).alias("said"))


_RAW = "substring(trim(raw_code, ' ' || chr(9) || chr(10)), 1, 120)"


@query(rf"""with {_N} select function_key, node_id, case node_type when 'DECISION' then case when {_RAW} like '%?' then {_RAW} else 'Check: ' || {_RAW} || '?' end when 'LOOP_HEAD' then 'Loop: ' || {_RAW} || '?'
when 'SWITCH_HEAD' then 'Switch on: ' || {_RAW} || '?' when 'CASE' then 'Case: ' || {_RAW} when 'DEFAULT_CASE' then 'Default case' when 'RETURN' then 'Return ' || regexp_replace(trim(regexp_replace({_RAW}, '^return', '')), ';+$', '')
when 'BREAK' then 'Exit loop' when 'CONTINUE' then 'Continue to next iteration' when 'TRY_HEAD' then 'Execute with exception handling' when 'CATCH' then 'Handle exception: ' || {_RAW}
else substring(trim(split_part({_RAW}, chr(10), 1)), 1, 80) end as label from nd""")
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("function_key", "node_id", labels.rule_label(F.col("node_type"), F.col("raw_code")).alias("label"))


@query(rf"""with {_E} select function_key, split_part(split_part(qualified_name, '<', 1), '::', -1) as simple_name, split_part(split_part(qualified_name, '::', -1), '<', 1) as last_name, lower(replace(file, chr(92), '/')) as path,
regexp_replace(regexp_extract(file, '([^/]*)$', 1), '\.[^.]*$', '') as stem, qualified_name || '(' || coalesce(array_to_string(list_transform(params, lambda x: trim(x.type || ' ' || x.name)), ', '), '') || ')' as signature,
array_to_string(list_transform(coalesce(params, []), lambda x: regexp_replace(split_part(x.type, '::', -1), '[*&<> ].*', '')), ',') as types from e""")
def names(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("qualified_name")
    types = F.array_join(F.transform(F.coalesce("params", F.array().cast("array<struct<type:string,name:string>>")), lambda p: labels.simple_type(p["type"])), ",")
    return _entries(spark, d).select("function_key", labels.simple_name(q).alias("simple_name"), labels.last_name(q).alias("last_name"), text.lower_path(F.col("file")).alias("path"), text.stem(F.col("file")).alias("stem"), labels.full_signature(q, F.col("params")).alias("signature"), types.alias("types"))


@query("""select distinct k.record_id, p.base_path || '/' || k.file as full_path from k_functions k join projects p using (project) where k.file is not null and not regexp_matches(k.file, '^(/|[A-Za-z]:)')""")
def absolute_paths(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "k_functions").where("file is not null").join(table(spark, d, "projects"), "project")
    return k.where(~F.col("file").rlike("^(/|[A-Za-z]:)")).select("record_id", text.join_path(F.col("base_path"), F.col("file")).alias("full_path")).distinct()


@query("""select distinct k.record_id, substring(k.file, length(p.base_path) + 2) as inner_path from k_functions k join projects p using (project) where starts_with(k.file, p.base_path || '/')""")
def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "k_functions").join(table(spark, d, "projects"), "project").where(F.col("file").startswith(F.concat("base_path", F.lit("/"))))
    return k.select("record_id", text.relative_path(F.col("file"), F.col("base_path")).alias("inner_path")).distinct()


@query("select doc_id, substr(md5(text), 1, 16) as hash, 'pkb_' || substr(md5(text), 1, 16) || '.json' as cache_name from documents where text is not null")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    h = text.content_hash(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", h.alias("hash"), text.cache_name(h).alias("cache_name"))


@query("""select distinct record_id, qualified_name || ' = ' || signature || case when coalesce(comment, '') != '' then '  (' || comment || ')' else '' end as macro, qualified_name || ' → ' || signature || case when coalesce(comment, '') != '' then '  (' || comment || ')' else '' end as typedef from k_functions""")
def symbol_summaries(spark: SparkSession, d: str) -> DataFrame:
    c = [F.col(x) for x in ("qualified_name", "signature", "comment")]
    return table(spark, d, "k_functions").select("record_id", labels.macro_summary(*c).alias("macro"), labels.typedef_summary(*c).alias("typedef")).distinct()


# replies of the label model


@query("""select event_id, props as object from events where props is not null""")
def first_json_object(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("props is not null")
    noisy = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n``` and {more}"))
    return e.select("event_id", labels.first_json_object(noisy).alias("object"))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d).where("node_type not in ('START', 'END')")
    ids = n.groupBy("function_key").agg(F.array_sort(F.collect_list("node_id")).alias("node_ids"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("node_id", "label"))))).alias("m"))
    return ids.select("function_key", F.concat(F.lit("Labels:\n"), F.to_json("m")).alias("reply"), "node_ids")


@query(rf"""with {_N}, n as (select * from nd where node_type not in ('START', 'END')),
a as (select function_key, string_agg(node_id, ', ' order by node_id) filter (label is null) missing, '{{' || coalesce(string_agg(regexp_replace(label, '[^{{}}]', '', 'g'), '' order by node_id), '') || '}}' as marks,
  min(node_id) filter (regexp_replace(label, '[\s\x{{a0}}\x{{3000}}]', '', 'g') = '') blank, min(node_id) filter (length(label) > 300) long from n group by 1),
u as (select function_key, unnest(string_split(marks, '')) as c, unnest(range(0, length(marks))) as i from a),
d as (select function_key, i, sum(case c when '{{' then 1 else -1 end) over (partition by function_key order by i) as depth from u),
k as (select function_key, min(i) filter (depth = 0) as closed from d group by 1)
select function_key, case when closed is null then 'no JSON object' when closed + 1 < length(marks) then 'JSON parse error' when missing is not null then 'missing ids: ' || missing when blank is not null then 'empty label: ' || blank when long is not null then 'too long: ' || long end as error from a join k using (function_key)""")
def reply_errors(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of the labels there are; brackets within labels count, as the original has it."""
    return _replies(spark, d).select("function_key", labeling.reply_error(F.col("reply"), F.col("node_ids")).alias("error"))


_RECORDS = "rec as (select function_key, to_json(list(struct_pack(node_id := node_id, type := node_type, raw_code := substring(raw_code, 1, 300)) order by node_seq, node_id, node_type))::varchar as nodes_json, array_to_string(list(node_id order by node_seq, node_id, node_type), ',') as ids from nd where node_type not in ('START', 'END') group by 1)"


@query(f"with {_N}, {_RECORDS} select function_key, ids, nodes_json from rec")
def node_records(spark: SparkSession, d: str) -> DataFrame:
    return labeling.node_records(_nodes(spark, d)).select("function_key", F.array_join("node_ids", ",").alias("ids"), "nodes_json")


@query(rf"""with {_E}, {_N}, {_LINES}, {_RECORDS}, src as (select e.function_key, string_agg(ln.text, chr(10) order by ln.line_no) as t from e join ln on ln.file = e.file and ln.line_no between e.line and e.end_line group by 1),
p as (select function_key, qualified_name || '(' || coalesce(array_to_string(list_transform(params, lambda x: trim(x.type || ' ' || x.name)), ', '), '') || ')' as sig, coalesce(array_to_string(list_transform(params, lambda x: trim(x.type || ' ' || x.name)), ', '), '') as ps, coalesce(description, '') as descr from e)
select p.function_key, md5('Function: ' || sig || case when descr != '' then chr(10) || 'Purpose: ' || descr else '' end
  || case when ps || descr != '' then chr(10) || chr(10) || '--- Project Context ---' || chr(10) || concat_ws(chr(10), case when ps != '' then 'Parameters: ' || ps end, case when descr != '' then 'Purpose: ' || descr end) else '' end
  || chr(10) || chr(10) || '--- Function Source Code ---' || chr(10) || src.t || chr(10) || chr(10) || '--- Nodes to Label ---' || chr(10) || nodes_json || chr(10) || chr(10) || 'Return ONLY the JSON object mapping each node_id to its label.') as hash
from p join rec using (function_key) join src using (function_key)""")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of each function, with its context, source and nodes."""
    f = _files(spark, d).select("file", text.lines(F.regexp_replace("source_text", "^﻿", "")).alias("l"))
    e = _entries(spark, d).where("end_line is not null").join(f, "file").join(labeling.node_records(_nodes(spark, d)), "function_key")
    context = labeling.context_text(labels.parameters(F.col("params")), F.lit(None).cast("string"), F.col("description"), F.lit(None).cast("string"))
    made = labeling.prompt(F.col("qualified_name"), F.col("params"), F.col("description"), context, text.slice_lines(F.col("l"), F.col("line"), F.col("end_line")), F.col("nodes_json"))
    return e.select("function_key", F.md5(made).alias("hash"))


# graphs


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.script_edges(table(spark, d, "flowcharts"))


_BFS = f"""with recursive {_N}, {_EDGES},
size as (select function_key, count(*) as n, coalesce(arg_min(node_id, node_seq) filter (node_type = 'START'), arg_min(node_id, (node_seq, node_id))) as entry from nd group by 1),
w(function_key, node_id, level, path) as (select function_key, entry, 0, []::int[] from size union all
  select w.function_key, ed.target, w.level + 1, min(list_append(w.path, ed.edge_ord)) from w join ed on ed.function_key = w.function_key and ed.source = w.node_id join size on size.function_key = w.function_key where w.level < size.n group by 1, 2, 3),
seen as (select function_key, node_id, min(level) as level, arg_min(path, level) as path from w group by 1, 2),
bfs as (select nd.*, (row_number() over (partition by nd.function_key order by seen.level is null, seen.level, seen.path, nd.node_seq, nd.node_id) - 1)::int as ord from nd left join seen on seen.function_key = nd.function_key and seen.node_id = nd.node_id)"""


@query(f"{_BFS} select function_key, node_id, ord from bfs")
def breadth_first(spark: SparkSession, d: str) -> DataFrame:
    return graph.breadth_first(_nodes(spark, d), _edges(spark, d))


_REACHED = f"""with recursive {_N}, {_EDGES}, r(function_key, node_id) as (select function_key, node_id from nd where node_type = 'START' union select r.function_key, ed.target from r join ed on ed.function_key = r.function_key and ed.source = r.node_id)"""


@query(f"{_REACHED} select function_key, node_id from r")
def reachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.reachable(_nodes(spark, d), _edges(spark, d))


@query(f"{_REACHED} select function_key, node_id from nd where not exists (select 1 from r where r.function_key = nd.function_key and r.node_id = nd.node_id)")
def unreachable(spark: SparkSession, d: str) -> DataFrame:
    return graph.unreachable(_nodes(spark, d), _edges(spark, d))


@query(f"""with {_N}, {_EDGES}, x as (select function_key, edge_ord, 'source' as side, source as node_id from ed union all select function_key, edge_ord, 'target', 'N' || (right(target, length(target) - 1)::int + edge_ord % 3) from ed)
select x.* from x where not exists (select 1 from nd where nd.function_key = x.function_key and nd.node_id = x.node_id)""")
def dangling_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edge ends that are no node, in graphs whose targets were moved by up to two numbers."""
    e = _edges(spark, d)
    moved = e.withColumn("target", F.concat(F.lit("N"), (F.expr("cast(substring(target, 2) as int)") + F.col("edge_ord") % 3).cast("string")))
    return graph.dangling(_nodes(spark, d), moved)


@query(f"""{_REACHED}, g as (select function_key, count(*) filter (node_type = 'START') s, count(*) filter (node_type = 'END') e from nd group by 1)
select function_key, 'ERROR' as severity, 'no_start' as code, '' as detail from g where s = 0 union all select function_key, 'WARNING', 'many_starts', s::varchar from g where s > 1 union all select function_key, 'ERROR', 'no_end', '' from g where e = 0
union all select ed.function_key, 'ERROR', 'unknown_node', 'source ' || source from ed where not exists (select 1 from nd where nd.function_key = ed.function_key and nd.node_id = source)
union all select ed.function_key, 'ERROR', 'unknown_node', 'target ' || target from ed where not exists (select 1 from nd where nd.function_key = ed.function_key and nd.node_id = target)
union all select function_key, 'WARNING', 'empty_label', node_id from nd where node_type not in ('START', 'END') and regexp_replace(coalesce(label, ''), '[\\s\\x{{a0}}\\x{{3000}}]', '', 'g') = ''
union all select function_key, 'WARNING', 'unreachable', string_agg(node_id, ', ' order by node_id) from nd where not exists (select 1 from r where r.function_key = nd.function_key and r.node_id = nd.node_id) group by 1""")
def graph_findings(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_findings(_nodes(spark, d), _edges(spark, d))


@query(r"""with c as (select distinct function_key, coalesce(mermaid_script, '') s from flowcharts), l as (select function_key, string_split_regex(s, '\r\n|\r|\n') l from c where trim(s) != ''),
u as (select function_key, unnest(range(1, len(l) + 1)) n, unnest(l) as line from l)
select function_key, 'ERROR' as severity, 'empty_script' as code, '' as detail from c where trim(s) = '' union all select function_key, 'ERROR', 'no_header', '' from c where trim(s) != '' and not starts_with(ltrim(s), 'flowchart')
union all select function_key, 'WARNING', 'odd_quotes', n::varchar from u where (length(line) - length(replace(line, '"', ''))) % 2 = 1""")
def script_findings(spark: SparkSession, d: str) -> DataFrame:
    return graph.script_findings(table(spark, d, "flowcharts"))


_SHOWN = "coalesce(nullif(label, ''), nullif(substring(raw_code, 1, 60), ''), node_id)"
_SHOWN = f"replace(replace(replace(replace({_SHOWN}, '<br/>', chr(1)), '<br />', chr(1)), chr(10), chr(1)), chr(13), '')"
_SHOWN = f"replace({_sql_escape(_SHOWN, labels.NODE_ENTITIES)}, chr(1), '<br/>')"
_WAY = "case when lower(trim(label)) in ('yes', 'true', '1') then 'Yes' when lower(trim(label)) in ('no', 'false', '0') then 'No' else nullif(trim(label), '') end"


@query(f"""{_BFS}, top as (select function_key, string_agg('    ' || case when node_type in ('START', 'END') then node_id || '([' || {_SHOWN} || '])' when node_type in ('DECISION', 'LOOP_HEAD', 'SWITCH_HEAD') then node_id || '{{' || {_SHOWN} || '}}' when node_type = 'CATCH' then node_id || '[[' || {_SHOWN} || ']]' else node_id || '[' || {_SHOWN} || ']' end, chr(10) order by ord) as t from bfs group by 1),
way as (select *, {_WAY} as said from ed),
low as (select function_key, string_agg('    ' || source || case when said is null then ' --> ' else ' -->|' || {_sql_escape('said', labels.EDGE_ENTITIES)} || '| ' end || target, chr(10) order by edge_ord) as t from way group by 1)
select top.function_key, '{labels.CHART_HEADER}' || chr(10) || top.t || chr(10) || case when low.t is null then '' else chr(10) || low.t end as mermaid_script from top left join low using (function_key)""")
def render(spark: SparkSession, d: str) -> DataFrame:
    return graph.render(_nodes(spark, d), _edges(spark, d))


# control flow, scanner, whole way


@query()
def built_nodes(spark: SparkSession, d: str) -> DataFrame:
    return cfg.graph_nodes(cfg.graphs(_files(spark, d)))


@query()
def built_edges(spark: SparkSession, d: str) -> DataFrame:
    return cfg.graph_edges(cfg.graphs(_files(spark, d)))


@query(f"with {_E} select distinct e.function_key, e.file, e.line, e.qualified_name from e")
def built_functions(spark: SparkSession, d: str) -> DataFrame:
    """Every definition that the front end finds is an entry, at its line and under its name, and no other is."""
    built = cfg.graphs(_files(spark, d)).where("error is null").select("file", "line", "qualified_name")
    return built.join(_entries(spark, d).select("function_key", "file", "line"), ["file", "line"], "left").select("function_key", "file", "line", "qualified_name")


@query()
def scanned_functions(spark: SparkSession, d: str) -> DataFrame:
    return scan.functions(scan.symbols(_files(spark, d)), simple_names=False).select("qualified_name", "signature", "file", "line", "comment")


_MACRO_LINES = r"""md as (select file, line_no, regexp_extract(text, '^\s*#\s*define\s+(\w+)\s+([^(\s].*)$', 1) as name, trim(regexp_replace(regexp_extract(text, '^\s*#\s*define\s+(\w+)\s+([^(\s].*)$', 2), '//.*', '')) as value from ln where regexp_matches(text, '^\s*#\s*define\s+\w+\s+[^(\s]'))"""


@query(rf"""with {_LINES}, {_MACRO_LINES}
select name, arg_max(value, (file, line_no)) as value, max(file) as file from md where name not like '\_%' escape '\' and not regexp_matches(name, '^[A-Z_]+_H[_H]?$') group by 1""")
def scanned_macros(spark: SparkSession, d: str) -> DataFrame:
    return scan.macros(scan.symbols(_files(spark, d))).select("name", "value", "file")


@query(rf"""with {_E}, {_N}, {_LINES}, told as (select nd.function_key, nd.node_id, e.file, nd.start_line as line_no from nd join e using (function_key) where node_type not in ('START', 'END', 'BREAK', 'CONTINUE')),
w as (select distinct file, line_no from told), {_NEAR}, {_MACRO_LINES}, m as (select name, arg_max(value, (file, line_no)) as value from md where name not like '\_%' escape '\' and not regexp_matches(name, '^[A-Z_]+_H[_H]?$') group by 1),
t as (select function_key, node_id, unnest(list_distinct(regexp_extract_all(raw_code, '\b([A-Z_][A-Z0-9_]{{2,}})\b', 1))) as name from nd join told using (function_key, node_id))
select function_key, node_id, 'comment' as kind, comment as said from told join near using (file, line_no) union all select function_key, node_id, 'macro_context', name || ' = ' || value from t join m using (name)""")
def node_context(spark: SparkSession, d: str) -> DataFrame:
    """What stands beside each node: the comment, and the macros of the sources (told without their comments) that its code names."""
    e, f = _entries(spark, d), _files(spark, d)
    n = _nodes(spark, d).join(e.select("function_key", "file"), "function_key")
    known = pipeline.knowledge(f)
    known["macros"] = known["macros"].withColumn("comment", F.lit(""))
    calls, beside, symbols = pipeline.node_context(e, f, n, known)
    by_call = calls.select("function_key", "node_id", F.lit("call").alias("kind"), F.col("signature").alias("said"))
    return beside.select("function_key", "node_id", F.lit("comment").alias("kind"), F.col("comment").alias("said")).unionByName(by_call).unionByName(symbols.select("function_key", "node_id", "kind", F.col("summary").alias("said")))


@query(rf"""with {_LINES}, i as (select file, line_no, regexp_extract(text, '^\s*#\s*include\s*"([^"]+)"', 1) as inc from ln where regexp_matches(text, '^\s*#\s*include\s*"')),
k as (select distinct regexp_extract(file, '([^/]*)$', 1) as base from f),
b as (select *, row_number() over (partition by file order by line_no) as n from i where regexp_extract(inc, '([^/]*)$', 1) not in (select base from k))
select file, line_no, 'ERROR' as severity, chr(39) || inc || chr(39) || ' file not found' as message from b where n <= 5""")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Included files that are not there, the first five of each file."""
    return scan.diagnostics(comments.source_lines(_files(spark, d)), _files(spark, d)).select("file", "line_no", "severity", "message")


@query()
def charts(spark: SparkSession, d: str) -> DataFrame:
    """Charts of all entries from their sources, with labels by rule."""
    return pipeline.charts(_entries(spark, d), _files(spark, d)).results


# ordinary tables


@query("""select o_orderkey, l_linenumber, l_shipdate, score from (select o_orderkey, l_linenumber, l_shipdate, 100 - abs(date_diff('day', o_orderdate, l_shipdate)) as score,
row_number() over (partition by o_orderkey order by abs(date_diff('day', o_orderdate, l_shipdate)), l_shipdate, l_linenumber, l_partkey, l_suppkey) n from orders join lineitem on l_orderkey = o_orderkey and abs(date_diff('day', o_orderdate, l_shipdate)) <= 30) where n = 1""")
def range_join_top1(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    off = F.abs(F.datediff("l_shipdate", "o_orderdate"))
    pairs = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).where(off <= 30).withColumn("score", 100 - off)
    best = Window.partitionBy("o_orderkey").orderBy(F.col("score").desc(), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return pairs.withColumn("n", F.row_number().over(best)).where("n = 1").select("o_orderkey", "l_linenumber", "l_shipdate", "score")
