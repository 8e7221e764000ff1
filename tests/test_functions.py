import hashlib
import os.path
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.functions import text as T
from codeloom.functions import vectors as V


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


@pytest.mark.parametrize("path", ["a/b.py", "b.py", ".hidden", "a/.hidden.py", "a.b/c", "x.tar.gz", "a/..b.c", "a/b.", "", "UPPER.PNG", "a.b/.c", "...x.y"])
def test_extension_is_that_of_the_standard_library(spark, path):
    assert one(spark, path, P.extension("x")) == os.path.splitext(path)[1].lower()


def test_paths(spark):
    assert one(spark, "path/to/file.txt", P.package("x")) == "path.to"
    assert one(spark, "file.txt", P.package("x")) is None
    assert one(spark, "path/to/file.txt", P.basename("x")) == "file.txt"
    assert one(spark, "/r/a/b", P.relative("x", "/r/")) == "a/b"
    assert one(spark, ".py", P.language("x")) == "py" and one(spark, "", P.language("x")) == "unknown"
    assert one(spark, "my repo-é1", P.safe_name("x")) == "my_repo_é1"
    assert one(spark, "/src/x", P.path_hash("x")) == hashlib.md5(b"/src/x").hexdigest()[:8]
    assert one(spark, "a/B.HPP", P.highlight_language("x")) == "cpp" and one(spark, "a/b.zzz", P.highlight_language("x")) == ""
    row = spark.createDataFrame([("n", "h", "c" * 40, True), ("n", "h", "c" * 40, False), ("n", "h", None, None)], "n string, h string, c string, m boolean")
    assert [r[0] for r in row.select(P.display_name(F.col("n"), F.col("h"), F.col("c"), F.col("m"))).collect()] == [f"n (h) @ {'c' * 40} (modified)", "n (h) @ cccccccc", "n (h)"]
    assert [r[0] for r in row.select(P.index_version("c", "m")).collect()] == ["c" * 40 + "-latest", "c" * 40, None]


def test_content_hash(spark):
    assert one(spark, "def hello(): pass", T.content_hash("x")) == "f908661f1a5cdcfd95caeed4a3b3d3d5"
    assert one(spark, "def world(): pass", T.content_hash("x")) == "e328728bf82a768301fc9bb3ab695487"


@pytest.mark.parametrize(("text", "clean"), [("Hello\x00World", "Hello World"), ("", ""), (None, ""), ("a\u200bb\ufeffc\u202ad", "abcd"), ("\t\n\r", "\t\n\r"), ("🙂", "🙂")])
def test_sanitize(spark, text, clean):
    assert one(spark, text, T.sanitize("x")) == clean


@pytest.mark.parametrize(("text", "clean"), [("Hello\x00World é", "Hello World "), ("🙂", T.EMPTY), ('a"b\\c\'d', "a b c d"), (None, T.EMPTY), ("a \n\n b", "a b")])
def test_sanitize_aggressive(spark, text, clean):
    assert one(spark, text, T.sanitize_aggressive("x")) == clean


@pytest.mark.parametrize(("text", "clean"), [("a+b, é_1!", "a b é 1"), ("+++", T.PLACEHOLDER), (None, T.PLACEHOLDER), (" a\u3000b ", "a b")])
def test_sanitize_extreme(spark, text, clean):
    assert one(spark, text, T.sanitize_extreme("x")) == clean


@pytest.mark.parametrize(("text", "n"), [("", 0), ("abc", 3), ("x" * 100, 35)])
def test_token_estimate(spark, text, n):
    assert one(spark, text, T.token_estimate("x")) == n


def test_blank_is_what_strip_leaves_nothing_of(spark):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in chars], "x string").select("x", T.is_blank("x").alias("b")).collect()
    assert {r.x for r in rows if r.b} == {c for c in chars if not c.strip()}


def test_prepare(spark):
    assert one(spark, "\u3000\n", T.prepare("x")) == T.PLACEHOLDER
    assert one(spark, "é" * 30_000, T.prepare("x")) == T.EMPTY
    assert one(spark, "x" * 30_000, T.prepare("x")) == "x" * 25_000
    assert one(spark, "é" * 23_000, T.prepare("x")) == "é" * 23_000


def test_cuts(spark):
    assert one(spark, "x" * 4000, T.truncate_unit("x")) == "x" * 4000
    assert one(spark, "é" * 4001, T.truncate_unit("x")) == "é" * 4000 + "... [content truncated]"
    assert one(spark, "x" * 201, T.preview("x")) == "x" * 200 + "..."


def test_decode(spark):
    assert one(spark, bytearray("é\r\nb\rc".encode()), T.decode("x"), "binary") == "é\nb\nc"
    assert one(spark, bytearray(b"caf\xe9"), T.decode("x"), "binary") == "café"


def test_vectors(spark):
    kind = "array<float>"
    assert one(spark, [0.5, 0.25, 0.75], V.resize("x", 4), kind) == [0.5, 0.25, 0.75, 0.0]
    assert one(spark, [0.5, 0.25, 0.75], V.resize("x", 2), kind) == [0.5, 0.25]
    d2 = one(spark, [0.1, 0.2, 0.3, 0.4], V.squared_l2("x", V.literal([0.15, 0.25, 0.35, 0.45])), kind)
    assert d2 == pytest.approx(0.01, abs=1e-6) and 1 / (1 + d2) == pytest.approx(0.990099, abs=1e-6)
    assert one(spark, [1.0], V.squared_l2("x", V.literal([1.0, 2.0])), kind) is None
    assert one(spark, None, V.squared_l2("x", V.literal([1.0])), kind) is None
    assert spark.range(1).select(V.average(F.lit(10), F.lit(3)), V.average(F.lit(10), F.lit(0))).first()[:] == (3.33, 0.0)
    assert spark.range(1).select(V.two_decimals(F.lit(0.987))).first()[0] == "0.99"


def test_random_texts_are_sanitized_as_in_python(spark):
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([rng.randrange(32), rng.randrange(0x300), rng.randrange(0x2000, 0x2100), 0x1F600, 0xFEFF])) for _ in range(rng.randint(0, 30))) for _ in range(300)]

    def plain(t):
        t = "".join(" " if ord(c) < 32 and c not in "\n\r\t" else c for c in t)
        return "".join(c for c in t if not (0x200B <= ord(c) <= 0x200F or 0x202A <= ord(c) <= 0x202E or ord(c) == 0xFEFF))

    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.sanitize("x").alias("y")).collect()
    assert all(r.y == plain(r.x) for r in rows)
