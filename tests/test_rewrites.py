import random

import pytest

from srclens.operators import facts, project_rules, rewrites, transforms
from srclens.operators.lexer import tokenize
from srclens.plans import fixtures
from srclens.sources import files


def random_function(r):
    """A function of random statements in random layout."""

    def expression(depth=0):
        kind = r.randint(0, 5 if depth < 2 else 2)
        gap = lambda: r.choice(["", " ", "  "])
        if kind < 3:
            return r.choice(["a", "b", "x", "1", "p->n", "t[i]", "f(a , b)"])
        if kind == 3:
            return f"({expression(depth + 1)})"
        return f"{expression(depth + 1)}{gap()}{r.choice(['+', '-', '*', '==', '&&', '<'])}{gap()}{expression(depth + 1)}"

    def statement(depth=0):
        gap = lambda: r.choice([" ", "\n", "\n\t", "\n    "])
        kind = r.randint(0, 9 if depth < 3 else 3)
        if kind == 0:
            return f"x={expression()};"
        if kind == 1:
            return f"x = {expression()} ? {r.choice('ab')} : 2;"
        if kind == 2:
            return "a=b=x;"
        if kind == 3:
            return f"return {expression()};"
        if kind == 4:
            return f"if({expression()}){gap()}{statement(depth + 1)}"
        if kind == 5:
            return f"if ({expression()}){gap()}{{{gap()}{statement(depth + 1)}{gap()}}}{gap()}else{gap()}{statement(depth + 1)}"
        if kind == 6:
            return f"while ({expression()}){gap()}{{{statement(depth + 1)}{gap()}{statement(depth + 1)}}}"
        if kind == 7:
            return f"for (i=0;i<3;i++){gap()}{statement(depth + 1)}"
        if kind == 8:
            return f"/* note */{statement(depth + 1)}"
        return f"do {{{statement(depth + 1)}}} while ({expression()});"

    body = "".join(r.choice(["\n", " ", "\n\t"]) + statement() for _ in range(r.randint(1, 5)))
    return f"int f({r.choice(['', 'int a,int b', 'void'])}){r.choice([' ', chr(10)])}{{{r.choice(['', 'int i, j=1; char *p;', 'int   i;'])}{body}\n}}\n"


def test_any_source_settles():
    r = random.Random(4)
    changed = 0
    for _ in range(150):
        source = random_function(r)
        new, counts = transforms.fix(source)
        assert transforms.safe(new) and transforms.fix(new)[0] == new
        words = lambda s: sorted(t.text for t in tokenize(s) if t.kind in ("number", "string"))
        assert set(words(source)) <= set(words(new)) | {"0"}
        assert source.count("/* note */") == new.count("/* note */")
        changed += new != source
    assert changed > 100


def test_layout_leaves_the_tokens():
    r = random.Random(9)
    only = frozenset(k for k, (_, layout) in transforms.PHASES.items() if layout)
    for _ in range(100):
        source = random_function(r)
        assert transforms.significant(transforms.fix(source, only=only)[0]) == transforms.significant(source)


@pytest.mark.parametrize("rule,before,after", fixtures.REWRITE_CASES)
def test_cases_settle(rule, before, after):
    asked = (rule,) if rule not in transforms.PHASES else ()
    only = frozenset() if asked else frozenset([rule])
    assert transforms.fix(before, asked, only)[0] == after
    assert transforms.fix(after, asked, only)[0] == after


def test_what_must_stay():
    """Comments, directives, side effects and scopes block rewrites."""
    for rule, body in [
        ("REPLACE_TERNARY", "\tx = a ? /* why */ b : c;\n"),
        ("REPLACE_TERNARY", "\tx = a ? b : c ? d : e;\n"),
        ("REPLACE_TERNARY", "\t*next(x) = a ? b : c;\n"),
        ("REPLACE_FOR_LOOP", "\tfor (i = 0; i < 3; i++)\n\t\tif (a)\n\t\t\tcontinue ;\n"),
        ("REPLACE_FOR_LOOP", "\tfor (int i = 0; i < 3; i++)\n\t\ta++;\n"),
        ("SPLIT_CHAINED_ASSIGNMENT", "\tt[i++] = b = c;\n"),
        ("SPLIT_DECLARATION_ASSIGNMENT", "\tconst int\ta = 1;\n"),
        ("SPLIT_DECLARATION_ASSIGNMENT", "\tint\ta[2] = {1, 2};\n"),
        ("REMOVE_SINGLE_STATEMENT_BRACES", "\tif (a)\n\t{\n\t\tif (b)\n\t\t\tc++;\n\t}\n\telse\n\t\td++;\n"),
        ("REMOVE_SINGLE_STATEMENT_BRACES", "\twhile (a)\n\t{\n\t\t// why\n\t\ta--;\n\t}\n"),
        ("REMOVE_REDUNDANT_ELSE", "\tif (a)\n\t\tb = 1;\n\telse\n\t\treturn (2);\n"),
        ("POINTER_NULL_RETURN", "\treturn (0);\n"),
        ("OPERATOR_SPACING", "\tx = (char *)p;\n\ty = -1;\n\tf(&x, *p, !z);\n"),
    ]:
        source = f"char\t*f(void)\n{{\n{body}}}\n"
        assert transforms.fix(source, only=frozenset([rule]))[0] == source, body
    loop = "int\tf(int i)\n{\n\tfor (i = 0; i < 3; i++)\n\t\twhile (i)\n\t\t\tcontinue ;\n}\n"
    assert "for" not in transforms.fix(loop)[0]  # the continue is the inner loop's


def test_budget_passes_over_what_is_too_long():
    body = "".join(f"\tx = {i};\n" for i in range(20)) + "\tx = a ? 1 : 2;\n\ty = b ? 1 : 2;\n\tx = y = 3;\n"
    new = transforms.fix(f"int\tf(int a)\n{{\n{body}}}\n", only=frozenset(["REPLACE_TERNARY", "SPLIT_CHAINED_ASSIGNMENT"]))[0]
    assert new.count("?") == 2 and "y = 3;\n\tx = y;" in new and len(new.split("\n")) - 4 <= 25


def test_edits():
    assert rewrites.apply_edits("aébc", [(1, 3, "x"), (4, 4, "!"), (1, 3, "x")]) == "axb!c"
    for bad in ([(0, 2, "x"), (1, 3, "y")], [(1, 1, "x"), (1, 1, "y")], [(0, 9, "")]):
        with pytest.raises(ValueError):
            rewrites.apply_edits("abc", bad)


def test_recovery_gives_the_rest():
    rows = facts.Scan("p", fixtures.BROKEN_C["cut.c"] + "int a = `;\n").rows
    assert {r[1] for r in rows} >= {"unsafe", "recovery", "definition"} and {r[2] for r in rows if r[1] == "definition"} == {"good"}
    for source in ("", "}", "{", "((", "#if A\n", "#else\n", "\\", '"', "/*", "#endif\n}\nint f(void)\n{\n}\n"):
        facts.Scan("p", source)
        assert transforms.fix(source)[0] == source or transforms.safe(source)


def test_version_control_output():
    assert files.nul_paths(b"b.c\0a/c.c\0b.c\0") == ["a/c.c", "b.c"] and files.nul_paths(b"") == []
    for bad in (b"a", b"/etc/x\0", b"a/../../b\0", b"\xff\0"):
        with pytest.raises(ValueError):
            files.nul_paths(bad)


def test_ignore_rules(spark):
    rows = [("a/keep.o", False), ("b/x.o", True), ("out/keep.o", True), ("out/deep/k.c", True), ("#odd", True), ("!bang", True), ("doc1/a", True), ("doc/a", False), ("x/doc1/a", True), ("lib/v/a.txt", True), ("lib/v/w/a.txt", True), ("lib/a.md", False), ("t1.c", True), ("t2.c", False), ("sp ", False)]
    patterns = ["# comment", "*.o", "!keep.o", "out/", "\\#odd", "\\!bang", "doc?/", "lib/**/*.txt", "t[!2].c", ""]
    got = spark.createDataFrame(rows, "path string, want boolean").select("path", "want", files.ignored(__import__("pyspark.sql.functions", fromlist=["col"]).col("path"), patterns).alias("got")).collect()
    assert [x["path"] for x in got if x["got"] != x["want"]] == []


def test_serialized_projects_have_a_limit(spark):
    rows = spark.createDataFrame([("p", "a.c", "x" * 50), ("q", "a.c", "x")], "project string, path string, content string")
    stored = files.serialized(rows, 60)
    assert {x["project"]: x["data"] is not None for x in stored.collect()} == {"p": False, "q": True}
    assert [tuple(x) for x in files.deserialized(stored).collect()] == [("q", "a.c", "x")]


def test_unsafe_files_prove_nothing(spark):
    from srclens.operators import rules

    src = {"a.h": "int\tf(void);\n", "b.c": "int\tf(void)\n{\n\treturn (1;\n}\n"}
    assert rules.orphan_prototypes(facts.facts(fixtures.files(spark, src))).count() == 0
    assert rules.orphan_prototypes(facts.facts(fixtures.files(spark, {"a.h": src["a.h"]}))).count() == 1


def test_scopes_and_clock(spark):
    from pyspark.sql import functions as F

    from srclens.operators import headers

    cases = {"/": "root", "//": "root", "/home/me": "home", "/home/me/x": None, "/home/me/x/..": "home", "/usr": "system", "/usr2": None, "/var/x": "system", "/var": "broad", "/a/../../tmp/.": "broad", "/tmp/x": None}
    rows = spark.createDataFrame([(p,) for p in cases], "p string").select("p", project_rules.protected(F.col("p"), ("/home/me/",)).alias("r")).collect()
    assert {r["p"]: r["r"] for r in rows} == cases
    with pytest.raises(ValueError):
        headers.clock("soon")


def test_a_deep_file_harms_no_other(spark):
    deep = "int\tf(void)\n" + "{" * 3000 + "}" * 3000 + "\n"
    src = fixtures.files(spark, {"deep.c": deep, "ok.c": "int\tf(void)\n{\n\treturn 1;\n}\n"})
    got = {x["path"]: (x["content"], x["failure"]) for x in transforms.fixed(src).collect()}
    assert got["deep.c"][0] == deep and got["deep.c"][1].startswith("RecursionError") and got["ok.c"] == ("int\tf(void)\n{\n\treturn (1);\n}\n", None)
    rows = facts.facts(src)
    assert {x["path"] for x in rows.where("fact = 'definition'").collect()} == {"ok.c"} and rows.where("fact = 'unsafe'").count() == 1
