import hypothesis.strategies as st
from hypothesis import given, settings
from pyspark.sql import functions as F

from srclens.functions import text as X
from srclens.operators import lexer
from srclens.operators import transforms as t

MESSY = '#ifdef A\n#define X 1\n#endif\nint\tf()\n{\n\n\tint\ta[ 3 ];;\n\tchar * p;\n\n\tif(a[ 0 ] ,1)\n\t\treturn g(a ,b)+1;\n\tfor (;;)\n\t\t;\n\treturn(a[1]);\n\treturn ;\n\n}\n'
CLEAN = '#ifdef A\n# define X 1\n#endif\nint\tf(void)\n{\n\tint\ta[3];\n\tchar *p;\n\n\tif (a[0], 1)\n\t\treturn (g(a, b)+1);\n\tfor (;;)\n\t\t;\n\treturn (a[1]);\n\treturn ;\n}\n'

#: The rewrites that work on tokens alone.
TOKENS = frozenset({**t.REWRITES, **t.LAYOUT})
WHOLE = CLEAN.replace("\tchar *p", "\tchar\t*p").replace(")+1", ") + 1").replace("for (;;)", "while (1)")


def test_fix():
    got, counts = t.fix(MESSY, only=TOKENS)
    assert got == CLEAN and t.fix(got, only=TOKENS) == (CLEAN, {})
    assert t.fix(MESSY)[0] == WHOLE and t.fix(WHOLE) == (WHOLE, {})
    assert set(counts) == {"REMOVE_EMPTY_STATEMENT", "NO_ARGS_VOID", "RETURN_PARENTHESIS", "COMMA_SPACING", "CONTROL_KEYWORD_SPACING", "SUBSCRIPT_SPACING", "POINTER_SPACING", "PREPROCESSOR_SPACING", "BLOCK_EDGE_BLANK_LINE"}
    assert t.fix("int f( {") == ("int f( {", {})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["int", "x", " ", "\t", "\n", ",", ";", "{", "}", "(", ")", "[", "]", "*", "return", "if", "#", "define", "// c", "\n", '"s, "', "="]), max_size=40))
def test_nothing_is_lost(parts):
    source = "".join(parts)
    whole = t.fix(source)[0]
    assert t.fix(whole)[0] == whole
    got, _ = t.fix(source, only=TOKENS)
    assert t.fix(got, only=TOKENS)[0] == got
    dropped = [k for k in t.significant(source) if k[1] not in ("(", ")", ";", "void")]
    assert [k for k in t.significant(got) if k[1] not in ("(", ")", ";", "void")] == dropped


def test_guards(spark):
    own, other = "#ifndef A_H\n# define A_H\n\nint\ta;\n\n#endif\n", "/* // */\n# ifndef B_H // once\n/* x */\n#\tdefine B_H\nint B_H;\n#endif /* B_H */\n"
    cases = {"": "#ifndef A_H\n# define A_H\n\n\n\n#endif\n", "int\ta;\n": own, own: own, other: other.replace("ifndef B_H", "ifndef A_H").replace("define B_H", "define A_H"), own + "#define X\n": None, "#ifndef B_H\n#define C_H\n#endif\n": None}
    for before, after in cases.items():
        one = spark.createDataFrame([(before,)], "c string")
        new = X.with_guard(F.col("c"), F.lit("A_H"))
        got = one.select(new.alias("n"), X.guarded(new, F.lit("A_H")).alias("g"), X.with_guard(new, F.lit("A_H")).alias("again")).first()
        assert got["n"] == (after or f"#ifndef A_H\n# define A_H\n\n{before.rstrip()}\n\n#endif\n") and got["again"] == got["n"] and got["g"]


def test_fixed(spark):
    rows = t.fixed(spark.createDataFrame([("a.c", MESSY), ("b.c", WHOLE), ("c.c", None)], "path string, content string")).collect()
    assert [(r["path"], r["changed"], bool(r["diff"])) for r in rows] == [("a.c", True, True), ("b.c", False, False), ("c.c", False, False)]


def test_fingerprints_of_all_files(spark):
    """Layout and, unless asked for, comments don't count; a file without any token has a fingerprint too."""
    code = {"a": "int\tx;\n", "b": "int  x ;// c\n", "c": "intx;", "d": "", "e": "\n/* c */", "f": "@ \ufffd", "g": "@\ufffd"}
    files = spark.createDataFrame(list(code.items()), "path string, content string")
    for comments, same in ((False, ["ab", "c", "de", "fg"]), (True, ["a", "b", "c", "d", "e", "fg"])):
        by = {}
        for r in lexer.fingerprint(files, comments).collect():
            by.setdefault(r["fingerprint"], []).append(r["path"])
        assert sorted("".join(sorted(p)) for p in by.values()) == same


def test_rewrites_run_once_for_fingerprints(spark, tmp_path):
    from srclens.plans import corpus

    spark.sql("select id as p_partkey, cast(id % 9 as int) as p_size from range(4)").write.parquet(f"{tmp_path}/part.parquet")
    plan = corpus.q_corpus_fingerprints(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # before, the rewrites, after
