import random
from datetime import datetime
from itertools import product

from pyspark.sql import functions as F

from flowgrain.llm.best_record import Candidate, _rank, best_records, choose, trust

SCHEMA = "record_id long, project string, qualified_name string, signature string, file string, line int, comment string, is_definition boolean, scanned_at timestamp, full string"


def day(n):
    return datetime(2031, 1, n)


def rows(*given):
    base = dict(project="p", qualified_name="a::B::f", signature="int f(int x)", file="f.cpp", line=3, comment="Does it.", is_definition=True, scanned_at=day(1), full="x")
    return [tuple({"record_id": i, **base, **g}[c.split()[0]] for c in SCHEMA.split(", ")) for i, g in enumerate(given, 1)]


def found(spark, *given):
    return sorted((r.first_id, r.name_id, r.comment_id, r.place_id) for r in best_records(spark.createDataFrame(rows(*given), SCHEMA)).collect())


def test_names_and_overloads(spark):
    assert found(spark, {"qualified_name": "::a::B::f"}, {"qualified_name": "B::f"}, {"qualified_name": "a.B.f"}, {"qualified_name": "a :: B :: f(int)"}, {}, {"signature": "inline int f( int );"}, {"signature": "int f()"}, {"project": "q"}) == [(1, 5, 1, 1)]
    assert found(spark, {"qualified_name": "B::f"}, {"qualified_name": "B::f"}, {"qualified_name": "c::B::f"}, {}) == [(1, 1, 1, 1)]  # two full names end so
    assert found(spark, {"qualified_name": None}, {"qualified_name": None}) == []


def test_comments(spark):
    whole = "Keeps the newest values. Never blocks."
    assert found(spark, {"comment": whole}, {"comment": whole[:20] + "…", "scanned_at": day(9)}, {"comment": "Keeps", "scanned_at": day(8)}, {"comment": "todo: describe", "scanned_at": day(7)}, {"comment": None, "scanned_at": day(6)}, {"comment": whole, "scanned_at": None})[0][2] == 1
    assert found(spark, {"comment": "A", "scanned_at": None}, {"comment": "B.", "scanned_at": None})[0][2] == 1
    assert found(spark, {"comment": "B."}, {"comment": "A."}, {"comment": "A.", "scanned_at": day(3)})[0][2] == 2
    assert found(spark, {"comment": " "}, {"comment": "n/a"})[0][2] == 0
    assert found(spark, {"comment": "Keeps the newest v [...]", "scanned_at": day(5)}, {"comment": "Keeps the newest v"}, {"comment": "Keeps the newest values."})[0][2] == 3
    assert found(spark, {"comment": "It is short", "scanned_at": day(5)}, {"comment": "It is short and goes on for long."}, {"comment": "It is other.", "scanned_at": day(3)})[0][2] == 3


def test_places(spark):
    assert found(spark, {"is_definition": False, "scanned_at": day(9)}, {"file": "g.cpp"}, {"file": "g.cpp", "line": 0, "scanned_at": day(5)}, {"file": " ", "scanned_at": day(6)}, {"file": None, "scanned_at": day(7)})[0][3] == 2
    assert found(spark, {"is_definition": False}, {"is_definition": False, "line": 4, "scanned_at": day(2)})[0][3] == 2
    assert found(spark, {"line": None}, {"file": ""})[0][3] == 0
    assert found(spark, {"line": 9, "is_definition": False}, {"line": 9}, {"line": 8, "scanned_at": None})[0][3] == 1


def test_odd_tables(spark):
    assert found(spark) == []
    hot = [{"comment": f"Note {i % 7}.", "line": 1 + i % 5} for i in range(2000)]
    assert len(found(spark, *hot)) == 1
    assert found(spark, {"signature": None, "qualified_name": "a::f(int)"}, {"signature": "void f(int y)", "qualified_name": "a::f"}) == [(1, 2, 1, 1)]


def test_the_best_state_may_exclude_every_place(spark):
    """Taken one by one, the bundles would give the state `defined` and a declared place, which breaks a dependency."""
    given = rows({"is_definition": True, "file": None}, {"is_definition": False, "line": 7}, {"is_definition": False, "line": 8, "scanned_at": None})
    r = best_records(spark.createDataFrame(given, SCHEMA)).first()
    assert (r.state, r.file, r.line, r.place_id) == ("declared", "f.cpp", 7, 2)
    given = rows({"is_definition": True, "scanned_at": None}, {"is_definition": False, "line": 7})
    r = best_records(spark.createDataFrame(given, SCHEMA)).first()
    assert (r.state, r.line, r.place_id) == ("defined", 3, 1)


def brute_force(bundles, dependencies):
    best = 0
    names = list(bundles)
    for taken in product(*([None, *bundles[b]] for b in names)):
        of = dict(zip(names, taken))
        if all(of.get(a) is None or of.get(b) is None or x not in of[a].attributes or y not in of[b].attributes or of[a].attributes[x] == of[b].attributes[y] for a, x, b, y in dependencies):
            best = max(best, sum(c.trust for c in taken if c))
    return best


def test_branch_and_bound_against_all_choices():
    r = random.Random(3)
    dependencies = (("a", "x", "b", "x"), ("b", "y", "c", "y"), ("a", "z", "d", "z"))
    differs = fewer = 0
    for _ in range(300):
        bundles = {b: [Candidate(r.randint(1, 50), {k: r.choice("pqr") for k in "xyz" if r.random() < 0.8}, i) for i in range(r.randint(0, 5))] for b in "abcd"}
        total, taken, looked_at = choose(bundles, dependencies)
        assert total == brute_force(bundles, dependencies) == sum(bundles[b][k].trust for b, k in taken.items() if k >= 0)
        differs += total < sum(max((c.trust for c in v), default=0) for v in bundles.values())
        everything = 1
        for v in bundles.values():
            everything *= len(v) + 1
        fewer += looked_at < everything
    assert differs > 150 and fewer > 200
    assert choose({})[:2] == (0, {})


def test_ranks(spark):
    def rank(defined, at, record):
        return spark.sql(f"select {int(defined)} as t, {at} as a, {record}L as r").select(_rank(F.col("t"), F.col("a").cast("long"), F.col("r")).alias("x")).first().x

    order = [rank(True, 0, 5), rank(False, 9, -4), rank(False, 9, 1), rank(False, 8, 1), rank(False, 8, 2), rank(False, 0, 1), rank(False, 0, (1 << 63) - 1)]
    assert order == sorted(order, reverse=True) and len(set(order)) == len(order)
    assert 2 * trust(0) > trust(int(order[0]))  # two bundles filled before one of a better source
