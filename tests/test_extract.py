import pytest
from pyspark.sql import functions as F

from codeloom.extract import erlang, java, python
from codeloom.operators import units as U
from codeloom.sources import ignore

from .conftest import JAVA, PYTHON


def test_python_units():
    found = python.units(PYTHON)
    assert [(k, n, c) for k, n, _, c in found] == [("class", "Base", None), ("class", "Shape", None), ("method", "area", "Shape"), ("method", "label", "Shape"), ("function", "main", None)]
    assert found[0][2] == "class Base: ... {\n}"
    assert found[1][2] == 'class Shape(Base, metaclass=abc.ABCMeta): ... {\n  sides\n  name\n  area(self, scale: float = 1.0, *, unit="(m,2)")\n  label(self)\n}'
    assert found[2][2].startswith("def area(self") and found[2][2].endswith("return self.sides * scale")
    assert found[3][2].startswith("async def label") and "ünïcode" in found[3][2]
    assert [n for _, n, *_ in python.units(PYTHON, decorated=False)] == ["Base", "main"]
    with pytest.raises(SyntaxError):
        python.units("def broken(:\n")


def test_python_parameters():
    text = "def f(a, b=(1, 2), *c: 'x, y', d={')': 1}, **e):  # (no\n    pass\n"
    assert python.units("class A:\n    " + text.replace("\n    ", "\n        "))[0][2] == "class A: ... {\n  f(a, b=(1, 2), *c: 'x, y', d={')': 1}, **e)\n}"


def test_java_units():
    found = java.units(JAVA)
    assert [(k, n, c) for k, n, _, c in found] == [("class", "Parser", None), ("method", "parse", "Parser"), ("method", "add", "Parser"), ("method", "add", "Parser"), ("method", "later", "Parser"), ("class", "Second", None)]
    assert found[0][2].split("\n") == [
        "class Parser extends Base<T> implements One, Two<String, T>: ... {", "  String SQL", "  String OTHER", "  int[] counts", "  Map<String, List<Integer>> index", "  String block",
        "  Map<String, R> parse(String text, List<R> out)", "  void add(int a)", "  void add(int a, int b)", "  void later()", "}",
    ]
    assert found[1][2].startswith("@Override") and found[1][2].rstrip().endswith("}") and "new Runnable()" in found[1][2]
    assert found[3][2] == "void add(int a, int b) { char c = '}'; }"
    assert found[5][2] == "class Second: ... {\n}"


def test_java_scanner_bears_anything():
    for text in ("", "class", "class A", "class A {", "class A { void f( {", '"', "/*", "class A { int x = ; } }}", "@interface Q { int v() default 1; } class B { }", "record R(int a) { }"):
        java.units(text)
    assert [n for _, n, *_ in java.units("@interface Q { int v() default 1; } class B { }")] == ["B"]
    text = "class A { // \u00a0é\n  String s() { return \"\u00a0\"; }\n}"
    assert java.units(text)[1][2] == 'String s() { return "\u00a0"; }'


def test_erlang_units():
    text = '-module(hello).\n-export([hello_world/0]).\nhello_world() ->\n  io:format("Hi. ~n"), 1.5.\n% c.\nother(X) when X > 1 -> ok;\nother(_) -> no.\n'
    assert [(n, c[:5]) for _, n, c, _ in erlang.units(text)] == [("hello_world", "hello"), ("other", "other")]


def test_files_without_a_scanner_are_one_unit():
    assert U.of_text("a/b.xml", "<a/>") == ([("file", "b.xml", "<a/>", None)], None)
    found, why = U.of_text("a/b.py", "def broken(:\n")
    assert [f[0] for f in found] == ["file"] and isinstance(why, SyntaxError)
    assert U.of_text("a/B.JAVA", "class B { }")[0] == [("class", "B", "class B: ... {\n}", None)]


@pytest.mark.parametrize(
    ("lines", "path", "folder", "hit"),
    [
        (["*.log"], "a/b.log", False, True), (["*.log", "!keep.log"], "a/keep.log", False, False), (["/top.py"], "top.py", False, True), (["/top.py"], "src/top.py", False, False), (["build/"], "build", True, True), (["build/"], "build", False, False),
        (["build/"], "x/build/a/b.py", False, True), (["a/**/z"], "a/z", False, True), (["a/**/z"], "a/b/c/z", False, True), (["**/z"], "q/z", False, True), (["a/**"], "a/b/c", False, True), (["a/**"], "a", True, False), (["a/*.c"], "a/x.c", False, True), (["a/*.c"], "b/a/x.c", False, False),
        (["f?o"], "foo", False, True), (["f?o"], "f/o", False, False), (["[a-c].x"], "b.x", False, True), (["[!a-c].x"], "b.x", False, False), (["#c", "", "  "], "#c", False, False), (["\\#c"], "#c", False, True), ([], ".git/config", False, True), ([], "a/.git/x", False, True), ([], ".gitignore", False, False), (["  pad.x  "], "pad.x", False, True),
    ],
)
def test_ignore_rules(spark, lines, path, folder, hit):
    rules = ignore.Ignore(lines)
    assert rules.matches(path, folder) is hit
    if not folder:
        assert spark.createDataFrame([(path,)], "p string").select(ignore.ignored(F.col("p"), rules)).first()[0] is hit
