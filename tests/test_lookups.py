from itertools import product

from pyspark.sql import functions as F

from flowgrain.operators import lookups


def test_merge_is_the_fold(spark):
    kinds = [("", False), ("", True), ("c", False), ("c", True)]
    rows, want = [], {}
    for n in range(1, 4):
        for seq in product(range(4), repeat=n):
            name = "".join(map(str, seq))
            best = None
            for pos, k in enumerate(seq):
                comment, definition = kinds[k]
                rows.append((name, pos, comment, definition))
                if best is None or (not kinds[seq[best]][0] and (comment or definition)):
                    best = pos
            want[name] = best
    df = spark.createDataFrame(rows, "qualified_name string, pos int, comment string, is_definition boolean")
    got = {r.qualified_name: r.pos for r in lookups.merge_functions(df).collect()}
    assert got == want


def test_callees_in_tiers(spark):
    entries = spark.createDataFrame([("k|f|a::f|", "a::f", [("int", "x")], "does f", ["k|g|a::g|", "lib|x|rt::h|int", "nowhere", None, "k|g|a::g|"]), ("k|g|a::g|", "a::g", [], None, None)], "function_key string, qualified_name string, params array<struct<type:string,name:string>>, description string, calls_ids array<string>")
    known = spark.createDataFrame([("rt::h", "int h(int)", "told", 0), ("a::g", "x", "by the dictionary", 1)], "qualified_name string, signature string, comment string, pos int")
    got = [(r.ord, r.signature, r.description) for r in lookups.resolve_callees(entries, known).orderBy("ord").collect()]
    assert got == [(0, "a::g()", "by the dictionary"), (1, "int h(int)", "told"), (4, "a::g()", "by the dictionary")]
    nodes = spark.createDataFrame([("k|f|a::f|", "N3", "ACTION", "g(1); a::g(2);"), ("k|f|a::f|", "N4", "BREAK", "g()")], "function_key string, node_id string, node_type string, raw_code string")
    assert [(r.node_id, r.ord) for r in lookups.calls_in_code(nodes, entries).orderBy("ord").collect()] == [("N3", 0), ("N3", 4)]


def test_enums_greedy(spark):
    values = spark.createDataFrame([("E", "A", 1), ("F", "A", 2), ("F", "B", 2)], "enum string, name string, ord int")
    nodes = spark.createDataFrame([("k", "N1", "A B"), ("k", "N2", "B A"), ("k", "N3", "x")], "function_key string, node_id string, raw_code string")
    got = {}
    for r in lookups.enums_in_code(nodes, values).orderBy("ord").collect():
        got.setdefault(r.node_id, []).append(r.enum)
    assert got == {"N1": ["E", "F"], "N2": ["F", "E"]}


def test_last_writer_and_index(spark):
    df = spark.createDataFrame([("x", 1, "a"), ("x", 3, "c"), ("y", 2, "b")], "name string, pos int, v string")
    assert {(r.name, r.first_pos, r.v) for r in lookups.last_writer(df, "name").collect()} == {("x", 1, "c"), ("y", 2, "b")}
    e = spark.createDataFrame([("q", "k2", 1), ("q", "k1", 2)], "qualified_name string, function_key string, pos int")
    assert lookups.name_index(e).first()["keys"] == ["k2", "k1"]
    assert lookups.first_by_name(e).first()["function_key"] == "k2"
    hit, miss = lookups.split_keys(e, spark.createDataFrame([("k1",), ("k9",)], "function_key string"))
    assert [r.function_key for r in hit.collect()] == ["k1"] and [r.function_key for r in miss.collect()] == ["k9"]
    assert lookups.last_writer(df.where(F.lit(False)), "name").count() == 0


def test_cursor_far_above(spark):
    """A long function around a stale line is found, however far above it starts; others only within 25 lines."""
    from flowgrain.operators.resolver import resolve_cursors

    entries = spark.createDataFrame([("a", "S.cpp", 500, 510, "n::run"), ("b", "s.cpp", 300, None, "n::walk"), ("c", "s.cpp", 900, 905, "n::far"), ("d", "s.cpp", 900, 905, "n::gone"), ("e", "s.cpp", 124, 126, "n::edge")], "function_key string, file string, line int, end_line int, qualified_name string")
    cursors = spark.createDataFrame([("s.cpp", "n::run", 401, 600, True, 1), ("s.cpp", "n::walk", 275, 280, True, 2), ("s.cpp", "n::far", 925, 926, True, 3), ("s.cpp", "n::gone", 874, 880, True, 4), ("s.cpp", "n::edge", 149, 160, True, 5)], "file string, name string, line int, end_line int, is_definition boolean, visit_ord int")
    got = {r.function_key: (r.tier, r.line) for r in resolve_cursors(entries, cursors).collect()}
    assert got == {"a": (2, 401), "b": (3, 275), "c": (3, 925), "e": (3, 149)}


def test_callees_from_sources(spark):
    """The third tier: a source file that the key points to, by the order of extensions; heads of any length."""
    long_head = "int far(\n" + "".join(f"    int a{i},\n" for i in range(20)) + "    int z)\n{\n}\n"
    files = spark.createDataFrame([("src/a.h", "/** In the header. */\nint near(int x);\n"), ("src/a.hpp", "int near() {}\n"), ("src/b.cc", "// Far\n\n// away.\n" + long_head), ("src/c.cpp", None)], "file string, source_text string")
    entries = spark.createDataFrame([("k", "n::k", ["src|a|n::near|int", "src|b|far|", "src|c|gone|", "src|a", "src|b|n::none|"])], "function_key string, qualified_name string, calls_ids array<string>").selectExpr("*", "cast(null as array<struct<type:string,name:string>>) params", "'' as description")
    got = {r.ord: (r.signature, r.description) for r in lookups.resolve_callees(entries, files=files).collect()}
    assert set(got) == {0, 1} and got[0] == ("int near(int x);", "") and got[1][1] == "away."
    assert got[1][0].startswith("int far( int a0, int a1,") and got[1][0].endswith("int a19, int z)")
    assert lookups.resolve_callees(entries).count() == 0


def test_type_context(spark):
    from flowgrain.plans.pipeline import knowledge, type_context

    files = spark.createDataFrame([("a.h", "// Ways to go.\nenum Mode { ON, OFF };\nusing Id = unsigned long;\n")], "file string, source_text string")
    entries = spark.createDataFrame([("k", [("const n::Mode&", "m"), ("Id", "i"), ("int", "x")]), ("l", [])], "function_key string, params array<struct<type:string,name:string>>")
    got = {r.function_key: r.types for r in type_context(entries.withColumn("params", F.expr("transform(params, p -> struct(regexp_replace(p.type, '^const ', '') as type, p.name as name))")), knowledge(files)).collect()}
    assert got == {"k": "  Mode (enum): Ways to go.; values: ON=0 (Ways to go.), OFF=1 (Ways to go.)\n  Id → unsigned long"}
