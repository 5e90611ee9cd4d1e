import random

import pytest
from pyspark.sql import functions as F

from flowgrain.functions import folds, labels, names, text
from flowgrain.operators.cfg import segments


def ask(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "out"), [("back(info[index])", "back#40;info#91;index#93;#41;"), ("a;<br />b\nc", "a#59;<br/>b<br/>c"), ("", ""), (None, None), ('&"{}|%^~<>', "#38;#quot;#123;#125;#124;#37;#94;#126;#60;#62;")])
def test_escape_node(spark, raw, out):
    assert ask(spark, labels.escape_node, raw) == out


def test_escape_edge(spark):
    assert ask(spark, labels.escape_edge, "50%~x") == "50%~x"
    assert ask(spark, labels.escape_edge, "a;(b)") == "a#59;#40;b#41;"


@pytest.mark.parametrize(("raw", "out"), [(" TRUE ", "Yes"), ("0", "No"), ("", None), ("case 1", "case 1"), (None, None)])
def test_edge_label(spark, raw, out):
    assert ask(spark, labels.edge_label, raw) == out


@pytest.mark.parametrize(
    ("raw", "out"),
    [("retval == STATUS_OK", "retval equals STATUS_OK"), ("!manager->isConnected()", "manager is not connected"), ("isLimitExceeded(id, event)", "is limit exceeded"), ("hasData()", "hass data"), ("a && ns::b != nullptr", "a AND b does not equal null"), ("", ""), ("x;", "x")],
)
def test_condition(spark, raw, out):
    assert ask(spark, labels.condition, raw) == out


@pytest.mark.parametrize(
    ("kind", "raw", "out"),
    [("RETURN", "return x;", "Return x"), ("DECISION", "ready?", "ready?"), ("DECISION", "a > b", "Check: a > b?"), ("ACTION", "\n  f();\ng();", "f();"), ("BREAK", "break", "Exit loop"), ("CATCH", "catch (E)", "Handle exception: catch (E)"), ("ACTION", "", "")],
)
def test_rule_label(spark, kind, raw, out):
    assert spark.createDataFrame([(kind, raw)], "k string, r string").select(labels.rule_label(F.col("k"), F.col("r"))).first()[0] == out


def test_names(spark):
    assert ask(spark, labels.simple_type, "const Foo&") == "const"
    assert ask(spark, labels.simple_type, "ns::Mode *") == "Mode"
    assert ask(spark, labels.simple_name, "ns::A::foo<T>") == "foo"
    assert ask(spark, labels.last_name, "A<B::C>::f") == "f"
    assert ask(spark, text.content_hash, "abc") == "900150983cd24fb0"
    assert ask(spark, text.stem, "a/b.x.cpp") == "b.x"
    assert ask(spark, names.plain_name, " :: a :: B.c (int, x) ") == "a::B::c"
    assert ask(spark, names.parameter_types, "void f( Buffer & b , int, std::vector<int> v, unsigned int )") == "Buffer&,int,std::vector<int>,unsigned int"
    assert ask(spark, names.parameter_types, "f()") == ""
    assert ask(spark, text.plain_path, "./src//a/../b.cpp") == "src/b.cpp"


@pytest.mark.parametrize(("line", "out"), [('f("http://x"); // real', "real"), ('g("//");', ""), ("// only", "only"), ('a = "x\\" // y"; // z', "z"), ("no", ""), ("/// doc", "/ doc")])
def test_line_comment(spark, line, out):
    assert ask(spark, text.line_comment, line) == out


def test_lines(spark):
    assert ask(spark, text.lines, "a\r\nb\rc\n") == ["a", "b", "c"]
    assert ask(spark, lambda c: text.lines(c, True), "a\x0cb c") == ["a", "b", "c"]
    assert ask(spark, lambda c: text.slice_lines(text.lines(c), F.lit(2), F.lit(9)), "a\nb\nc") == "b\nc"
    assert ask(spark, lambda c: text.slice_lines(text.lines(c), F.lit(3), F.lit(2)), "a\nb\nc") == ""


@pytest.mark.parametrize(("reply", "out"), [('x ```json\n{"a": {"b": 1}} y}', '{"a": {"b": 1}}'), ("none", None), ("{ open", None), ('{"a": "}"}', '{"a": "}'), (None, None)])
def test_first_json_object(spark, reply, out):
    assert ask(spark, labels.first_json_object, reply) == out


def test_greedy_segments(spark):
    assert ask(spark, lambda c: folds.greedy_segments(c), [3, 4, 5, 1, 1, 12, 2], "array<int>") == [0, 0, 1, 1, 1, 2, 3]
    r = random.Random(1)
    rows = [([r.randint(1, 13) for _ in range(r.randint(0, 12))],) for _ in range(60)]
    got = spark.createDataFrame(rows, "x array<int>").select("x", folds.greedy_segments(F.col("x")).alias("s")).collect()
    assert all(list(g.s) == segments(list(g.x), 5, 10) for g in got)


def test_enum_summary(spark):
    values = [("a%d" % i, str(i), "") for i in range(9)]
    got = ask(spark, lambda c: labels.enum_summary(F.lit("kinds"), c), values, "array<struct<name:string,value:string,comment:string>>")
    assert got == "kinds; values: a0=0, a1=1, a2=2, a3=3, a4=4, a5=5, a6=6, a7=7;   ... and 1 more"


def test_plain_paths(spark):
    from flowgrain.functions.text import plain_path

    deep = "/".join("abcdefghijkl") + "/.." * 10 + "/x.h"
    cases = {"A/./B//c.h": "a/b/c.h", deep: "a/b/x.h", "../../a/../b.h": "../../b.h", "/../x": "/x", "/a/b/../../c": "/c", r"A\\B\\..\\c": "a/c", "": "", "./x": "x"}
    df = spark.createDataFrame([(k.replace("\\\\", "\\"), v) for k, v in cases.items()], "p string, want string")
    from pyspark.sql import functions as F

    assert [(r.p, r.got) for r in df.select("p", "want", plain_path(F.col("p")).alias("got")).where("got != want").collect()] == []
