import pytest

from srclens.operators import facts, semantics
from srclens.sources import project


def test_evaluate():
    cases = {"1 + 2 * 3": 7, "( 1 << 4 ) | 1": 17, "- 7 / 2": -3, "- 7 % 2": -1, "0x1F": 31, "010": 8, "08": None, "A + 1": 6, "B": None, "1 / 0": None, "! 0 && 2 > 1": 1, "": None, "1 )": None, "~ 0": -1, "1 << 126 << 126": None}
    assert {k: semantics.evaluate(k, {"A": 5}) for k in cases} == cases
    assert semantics.enum_values([("A", None), ("B", None), ("C", "A + 9"), ("D", None), ("E", "f ( )"), ("F", None), ("G", "1"), ("H", None)], {}) == [0, 1, 9, 10, None, None, 1, 2]


SOURCE = "#define N 4\n#define M f(2)\nenum e_x { A, B = 5, C };\nint g[C];\nint f(int n)\n{\n\tint a[N + 1];\n\tint b[n];\n\tint c[M];\n\tint d[];\n}\nchar *p(void)\n{\n\treturn (0);\n}\n#include <stddef.h>\nchar *q(void)\n{\n\treturn (0);\n}\n#undef NULL\nchar *r(void)\n{\n\treturn 0;\n}\n"


def test_facts(spark):
    f = facts.facts(spark.createDataFrame([("a.c", SOURCE)], "path string, content string"))
    rows = semantics.constants_and_arrays(f)
    got = {(r["name"], None if r["value"] is None else int(r["value"]), r["class"]) for r in rows.collect()}
    assert got == {("A", 0, None), ("B", 5, None), ("C", 6, None), ("g", 6, "constant"), ("a", 5, "constant"), ("b", None, "variable"), ("c", None, "unknown"), ("d", None, "incomplete")}
    assert {(r["function"], r["null_known"]) for r in semantics.pointer_returns(f).collect()} == {("p", False), ("q", True), ("r", False)}
    at = {r["name"]: r["start"] for r in rows.where("fact = 'array'").collect()}
    kept, advice = semantics.vla_corrections(spark.createDataFrame([("a.c", at["a"]), ("a.c", at["b"])], "path string, start long"), rows)
    assert [r["start"] for r in kept.collect()] == [at["b"]] and [r["message"] for r in advice.collect()] == ["a"]


def test_project(spark):
    assert project.policy('[project]\nname = "x"\nallowed = ["write", "malloc", "write"]\n') == ("x", ["malloc", "write"])
    for bad in ("a = 1", "[project]\nextra = 1", '[project]\nallowed = ["a b"]', "[project]\n" + "#" * 70_000):
        with pytest.raises(ValueError):
            project.policy(bad)
    kind = "path string, content string, content_hash string, kind string"
    before = spark.createDataFrame([("a", "old", "1", None), ("b", "same", "2", "c"), ("c", "x", "3", "c")], kind)
    after = spark.createDataFrame([("a", "new", "9", None), ("b", "same", "2", "c"), ("c", "y", "8", "c")], kind)
    plan = project.undo_manifest(before, after, "r")
    now = spark.createDataFrame([("a", "new", "9", None), ("c", "z", "7", "c")], kind)
    assert {tuple(r) for r in project.undo(plan, now).collect()} == {("a", "old", "restored"), ("c", None, "conflict")}
    assert [tuple(r) for r in project.quarantine_plan(before).collect()] == [("a", ".quarantine/1-a")]
    assert project.archive({"b": "2", "a": "1"}) == project.archive({"a": "1", "b": "2"})
    d = spark.createDataFrame([("a", 0, None, "error", "R", "m")], "path string, line int, column int, severity string, rule_id string, message string")
    assert tuple(project.markers(d).first()) == ("a", 1, 1, 8, "R", "m")
