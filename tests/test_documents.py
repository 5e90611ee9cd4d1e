import json
import os

from flowgrain.__main__ import main
from flowgrain.operators import labeling
from flowgrain.plans import pipeline
from flowgrain.sources import documents, sinks
from flowgrain.streaming.summary import running_summary

INDEX = '{"src|a|n::f|int": {"qualifiedName": "n::f", "location": {"file": "src/a.cpp", "line": 3, "endLine": 6}, "params": [{"type": "int", "name": "x"}], "callsIds": ["q"], "description": null}, "k": {}, "k": {"qualifiedName": "last"}}'
CODE = "// top\nnamespace n {\nint f(int x) {\n  // why\n  return x;\n}\n}\n"


def test_function_index(spark, tmp_path):
    (tmp_path / "f.json").write_text(INDEX)
    rows = {r.function_key: r for r in documents.read_functions(spark, str(tmp_path / "f.json")).collect()}
    f = rows["src|a|n::f|int"]
    assert (f.qualified_name, f.file, f.line, f.end_line, f.calls_ids, f.description) == ("n::f", "src/a.cpp", 3, 6, ["q"], "")
    assert rows["k"].qualified_name == "last" and rows["k"].file == "" and len(rows) == 2


def test_sources_and_cli(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("src/a.cpp", "src/B.HPP", "build/c.cpp", ".git/d.cpp", "src/e.txt", "src/z/a.cc"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(CODE.encode() + b"// \xff\n")
    got = documents.read_sources(spark, str(root), ordered=True).collect()
    assert [r.file for r in got] == ["src/B.HPP", "src/a.cpp", "src/z/a.cc"]
    assert "�" in got[0].source_text
    index = tmp_path / "f.json"
    index.write_text(INDEX)
    out = tmp_path / "out"
    assert main(["charts", str(index), "--base-path", str(root), "--out", f"file://{out}", "--cache", str(tmp_path / "cache")]) == 0
    doc = json.loads((out / "src/a.cpp.json").read_text())
    assert doc[0]["functionKey"] == "src|a|n::f|int" and "N3[" in doc[0]["mermaidScript"] and "error" not in doc[0]
    summary = json.loads((out / "_summary.json").read_text())
    assert summary["totalFunctions"] == 2 and summary["totalErrors"] == 1
    assert any(n.startswith("pkb_") for n in os.listdir(tmp_path / "cache"))
    assert main(["charts", str(index), "--base-path", str(root), "--out", str(out), "--cache", str(tmp_path / "cache"), "--function-key", "none"]) == 1
    assert main(["scan", str(root), "--out", str(tmp_path / "k")]) == 0
    known = documents.read_knowledge(spark, str(tmp_path / "k/project_knowledge.json"))
    assert [r.qualified_name for r in known["functions"].collect()] == ["f"]


def test_dictionary_document(spark, tmp_path):
    """The symbol tables come back from their document, with comments and files of enumerations."""
    code = "// Ways.\nenum Mode {  // all\n\n ON, // on\n OFF = 4 // off\n };  \n#define LIMIT 12 // most\nusing Id = long;\nint f(); // told\n"
    tables = pipeline.knowledge(spark.createDataFrame([("a.h", code)], "file string, source_text string"))
    sinks.write_documents(sinks.knowledge_items(tables, "p", "/base"), f"file://{tmp_path}", "dictionary")
    document = json.loads((tmp_path / "project_knowledge.json").read_text())
    assert (document["project_name"], document["base_path"], set(document)) == ("p", "/base", {"project_name", "base_path", "functions", "enums", "macros", "typedefs"})
    assert document["enums"] == {"Mode": {"qualifiedName": "Mode", "file": "a.h", "comment": "Ways.", "values": {"ON": {"value": "0", "comment": "on"}, "OFF": {"value": "4", "comment": "off"}}}}
    back = documents.read_knowledge(spark, str(tmp_path / "project_knowledge.json"))
    assert [(r.enum, r.name, r.value) for r in back["enum_values"].orderBy("ord").collect()] == [("Mode", "ON", "0"), ("Mode", "OFF", "4")]
    assert [tuple(r) for r in back["macros"].select("name", "value", "comment").collect()] == [("LIMIT", "12", "most")]
    from flowgrain.operators import scan

    assert {r.kind: r.n for r in scan.stats(tables).collect()} == {"functions": 1, "enums": 1, "macros": 1, "typedefs": 1}
    none = {k: t.where("false") for k, t in tables.items()}
    sinks.write_documents(sinks.knowledge_items(none, "p", "."), str(tmp_path / "none"), "dictionary")
    assert json.loads((tmp_path / "none/project_knowledge.json").read_text())["macros"] == {}


def test_object_of_a_reply():
    assert labeling.first_object('x {"a": "}"} {"b": 1}') == '{"a": "}' and labeling.first_object("```json\n{}\n```{") == "{}"
    assert labeling.first_object("none") is None and labeling.first_object("{ {") is None


def test_stems_and_key(spark):
    rows = [("a/x.cpp", 1, "k1", "f", "s", None), ("b/x.h", 1, "k2", "g", "", "bad")]
    r = spark.createDataFrame(rows, "source_file string, ord int, function_key string, qualified_name string, mermaid_script string, error string")
    by_stem = sinks.file_items(r, by_stem=True).collect()
    assert [d.name for d in by_stem] == ["x.json"] and json.loads(by_stem[0]["item"]) == {"functionKey": "k2", "qualifiedName": "g", "mermaidScript": "", "error": "bad"}
    assert {d.name for d in sinks.file_items(r).collect()} == {"a/x.cpp.json", "b/x.h.json"}
    assert sinks.content_key('{"b": 1, "a": 2}') == sinks.content_key('{"a":2,\n"b":1}')


def test_replies(spark):
    rows = [("ok", '{"N1": "a", "N9": "more"}'), ("lost", '{"N9": "a"}'), ("number", '{"N1": 5}'), ("blank", '{"N1": " "}'), ("long", json.dumps({"N1": "x" * 301})), ("none", "sorry"), ("null", None)]
    df = spark.createDataFrame([(k, r, ["N1"]) for k, r in rows], "function_key string, reply string, node_ids array<string>")
    from pyspark.sql import functions as F

    got = {r.function_key: r.e for r in df.select("function_key", labeling.reply_error(F.col("reply"), F.col("node_ids")).alias("e")).collect()}
    assert got == {"ok": None, "lost": "missing ids: N1", "number": "not a text: N1", "blank": "empty label: N1", "long": "too long: N1", "none": "no JSON object", "null": "no JSON object"}


def test_model_labels(spark):
    def factory():
        calls = []

        def client(system, user):
            calls.append(user)
            return None if len(calls) == 1 else '{"N3": " Give x back "}'

        return client

    entries = spark.createDataFrame([("k", "n::f", "a.cpp", 3, 6, [("int", "x")], None, "tells")], "function_key string, qualified_name string, file string, line int, end_line int, params array<struct<type:string,name:string>>, calls_ids array<string>, description string")
    files = spark.createDataFrame([("a.cpp", CODE)], "file string, source_text string")
    made = pipeline.charts(entries, files, pipeline.Settings(client=factory), pipeline.knowledge(files))
    assert {r.node_id: r.label for r in made.nodes.collect()} == {"N1": "Start: f", "N2": "End", "N3": "Give x back"}


def test_stream(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/flowcharts.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = running_summary(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), delay="3650 days")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    total = spark.sql("select sum(ok) ok, sum(errors) e from counts").first()
    want = running_summary(table).groupBy().sum("ok", "errors").first()
    assert (total.ok, total.e) == tuple(want)
