import os
import sys

import pytest
from pyspark.sql import SparkSession

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


PYTHON = '''"""Module."""
import os

LIMIT = 3


class Base:
    pass


@decorated
class Shape(Base, metaclass=abc.ABCMeta):
    sides = 4
    name: str = "é"
    a, b = 1, 2

    def area(self, scale: float = 1.0, *, unit="(m,2)") -> float:
        return self.sides * scale

    @property
    async def label(self):
        return "ünïcode"

    class Inner:
        def hidden(self): ...


def main(args):
    return Shape().area()
'''

JAVA = '''package org.demo;

import java.util.*;

/** class Fake { void no() {} } */
@Deprecated(since = "1")
public final class Parser<T extends List<? super T>> extends Base<T> implements One, Two<String, T> {
  private static final String SQL = "class X { }", OTHER = "}";
  protected int[] counts;
  Map<String, List<Integer>> index = new HashMap<>() {{ put("a", null); }};
  private final String block = """
    class Inside {
      void nothing() { }
    }
    """;

  public Parser(String name) { this.name = name; }

  @Override
  public <R> Map<String, R> parse(final String text, List<R> out) throws Exception {
    Runnable r = new Runnable() { public void run() { int x = 1; } };
    return text.isEmpty() ? null : new HashMap<>();
  }

  void add(int a) { }
  void add(int a, int b) { char c = '}'; }
  abstract void later(String... many);

  static class Nested { void inner() { } }
  interface Hook { void call(); }
  enum Kind { A, B }
}

interface Alone { void x(); }
class Second { }
'''


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "my-repo"
    files = {
        ".gitignore": "build/\n*.log\n!keep.log\n# note\n/top.py\ndocs/**/draft.xml\n", "src/app/shapes.py": PYTHON, "src/app/__init__.py": "", "src/Parser.java": JAVA, "top.py": "x = 1\n", "src/top.py": "def f(): return 1\n", "conf/a.xml": "<a>\r\n</a>", "docs/x/draft.xml": "<d/>", "build/gen.py": "y = 2\n",
        "run.log": "log", "logo.PNG": "png", "notes.txt": "notes", "broken.py": "def broken(:\n", ".hidden.py": "def h(): pass\n", "_under.py": "def u(): pass\n", ".git/config": "cfg", "lib/.git/x.py": "z = 1",
    }
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode())
    (root / "latin.py").write_bytes(b"# caf\xe9\ndef cafe(): return 1\n")
    return root
