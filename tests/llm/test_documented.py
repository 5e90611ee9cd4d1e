import pytest

from flowgrain.llm.documented import documented, says_something

BASE = """namespace a {
class Base {
 public:
  /// Opens the channel.
  virtual void open(int n);
  virtual void close();
};
class Mid : public Base { void open(int n) override; };
}
"""
LEAF = """namespace a {
class Leaf final : public Mid {
 public:
  void open(int n) override { go(n); }
  //! TODO
  void close() { }
  /** Tells its size. */
  int size() const { return 1; }
  int one() { return 1; }  // no
};
// Joins both.
template <class T>
[[nodiscard]] int join(T a,
   T b) { // at the end
  return 0;
}
}
// int gone() { return 1; }
/* see header */
int far() { return 2; }
"""


@pytest.mark.parametrize(
    ("comment", "name", "out"),
    [
        ("/// Keeps the newest values.", "a::f", True), ("// TODO: more", "f", False), ("//! The function readAll", "a::readAll", False), ("/** read_all() */", "readAll", False), ("// -----", "f", False),
        ("// -----\n// Never blocks.\n// -----", "f", True), ("/**\n * @param x\n * @return\n */", "f", False), ("/** @brief Gives it back.\n * @return see above */", "f", True), ("// NOLINT", "f", False), ("/*\n int x = g();\n f(x);\n*/", "f", False),
        ("// See the interface for details.", "f", False), ("// @copydoc Base", "f", False), ("// SPDX-License-Identifier: X", "f", False), ("", "f", False), ("// (no description)", "f", False), ("/// Prüft den Zustand.", "f", True), ("// clang-format off", "f", False),
        ("// Inverse of pack.", "unpack", True), ("/* x-y.\n*/", "f", True), ("// XXX", "f", False),
    ],
)
def test_says(comment, name, out):
    assert says_something(comment, name) is out


def files(spark, *rows):
    return spark.createDataFrame([("p", *r, "x") for r in rows], "project string, file string, source_text string, line string")


def test_own_and_inherited(spark):
    got = {r.qualified_name: (r.line, r.comment, r.inherited_from) for r in documented(files(spark, ("b.h", BASE), ("l.cpp", LEAF), ("l.cpp", LEAF), ("n.cpp", None), ("e.cpp", ""))).collect()}
    assert got == {"a::Leaf::size": (8, "Tells its size.", None), "a::join": (13, "Joins both. at the end", None), "a::Leaf::open": (4, "Opens the channel.", "a::Base::open")}


def test_endless_hierarchy_and_empty(spark):
    ring = "class A : B { void f() { } };\nclass B : A { void f() { } };\n"
    assert documented(files(spark, ("r.h", ring))).count() == 0
    assert documented(files(spark, ("r.h", "x")).where("false")).count() == 0


def test_carriage_returns(spark):
    got = documented(files(spark, ("l.cpp", LEAF.replace("\n", "\r")))).where("inherited_from is null").collect()
    assert sorted(r.line for r in got) == [8, 13]
