from pyspark.sql import functions as F

from srclens.functions import text as X


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_width(spark):
    cases = {"": 0, "a": 1, "\t": 4, "a\tb": 5, "abcd\t": 8, "é": 1, "世界": 4, "a\t世": 6}
    assert {k: one(spark, k, X.visual_width) for k in cases} == cases


def test_hygiene(spark):
    cases = {
        "": "",
        "﻿a \r\nb\t\r\rc": "a\nb\n\nc\n",
        "\n\na\n\n\n\nb\n\n": "a\n\nb\n",
        "keep \\  \nx": "keep \\  \nx\n",
        "\n\n": "",
    }
    for k, v in cases.items():
        assert one(spark, k, X.hygiene) == v
        assert one(spark, v, X.hygiene) == v


def test_small_functions(spark):
    assert one(spark, "9ab _x a1-b", X.identifiers) == ["_x", "a1", "b"]
    assert one(spark, "a\\\nb??/\r\nc", X.remove_splices) == "abc"
    assert [one(spark, t, X.trivia_only) for t in ("", " /* a **/ // b", "/* a", "x", "/**/ y")] == [True, True, False, False, False]
    assert one(spark, "a, f(b, c), [d, e], )g", X.comma_count) == 3
    assert one(spark, "\x1b[31mred\x1b[0m", X.strip_ansi) == "red"
    assert [one(spark, p, X.valid_path) for p in ("a/b.c", "/a", "a/../b", "a//b", "", "a\\b")] == [True, False, False, False, False, False]
    assert [one(spark, p, X.file_kind) for p in ("x/a.c", "a.H", "dir/makefile", "README.md", "a.h")] == ["c_source", None, "makefile", "markdown", "c_header"]
    assert one(spark, "hi {name} {x}", lambda t: X.fill(t, {"name": F.lit("you")})) == "hi you {x}"
    assert one(spark, "fr_CA.UTF-8", X.locale_of) == "fr" and one(spark, "xx", X.locale_of) == "en"
