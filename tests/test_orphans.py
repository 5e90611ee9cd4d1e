from datetime import datetime as t

from flowgrain.operators.orphans import broken_references, orphan_report

SCHEMA = "function_key string, calls_ids array<string>, called_by_ids array<string>, loaded_at timestamp, removed_at timestamp, key string"


def test_reasons(spark):
    rows = [
        ("a", ["b", " b", "gone", "lib ", None, " ", "early", "l ate"], None, t(2031, 5, 2), None, ""),
        ("a", ["b"], None, t(2031, 6, 2), None, ""),
        ("b", None, ["a", "a"], t(2031, 1, 1), t(2031, 5, 2), ""),
        ("early", [], ["late"], t(2031, 1, 1), None, ""),
        ("late", None, None, t(2031, 7, 1), None, ""),
        (None, ["x"], None, None, None, ""),
        ("untimed", ["b", "x"], None, None, None, ""),
    ]
    entries = spark.createDataFrame(rows, SCHEMA)
    library = spark.createDataFrame([("lib", 1)], "function_key string, key int")
    got = {(r.function_key, r.ref_field, r.ref_key, r.reason) for r in broken_references(entries, library).collect()}
    assert got == {("a", "calls_ids", "b", "deleted"), ("a", "calls_ids", "gone", "missing"), ("a", "calls_ids", "late", "late"), ("early", "called_by_ids", "late", "late"), ("b", "called_by_ids", "a", "late"), ("untimed", "calls_ids", "x", "missing")}
    report = {(r.period, r.ref_field, r.reason): r.n_references for r in orphan_report(broken_references(entries, library)).collect()}
    assert report[(t(2031, 5, 1), "calls_ids", "missing")] == 1 and report[(None, "calls_ids", "missing")] == 1


def test_empty_and_hot(spark):
    library = spark.createDataFrame([], "function_key string")
    assert broken_references(spark.createDataFrame([], SCHEMA), library).count() == 0
    rows = [(f"k{i}", ["hot"] * 3, None, t(2031, 1, 1), None, "") for i in range(500)]
    assert broken_references(spark.createDataFrame(rows, SCHEMA), library).count() == 500


def test_hot_keys_are_dealt_out(spark):
    from flowgrain.operators.orphans import spread_join

    children = spark.createDataFrame([(f"c{i}", "calls_ids", "hot" if i % 3 else f"k{i}") for i in range(300)], "function_key string, ref_field string, ref_key string")
    suspects = children.groupBy("ref_key").count().withColumnRenamed("count", "n")
    plain = sorted(map(tuple, children.join(suspects, "ref_key").select("function_key", "ref_key", "n").collect()))
    dealt = spread_join(children, suspects, each=20)
    assert sorted(map(tuple, dealt.select("function_key", "ref_key", "n").collect())) == plain
    assert spread_join(children.where("false"), suspects.where("false")).count() == 0
