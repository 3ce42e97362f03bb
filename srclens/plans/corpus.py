"""A corpus of C files made from the part table by one expression that both engines read, and queries over it.

Each part gives one file with one function: its number of parameters, locals and
statements come from the row's numbers, and its statements are one of the forms
below.  What every form becomes, and which facts it holds, is stated beside it,
so that SQL over the table says what each query must return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, lexer, report, rules, transforms
from ..operators.facts import view

#: Forms whose rewrite adds lines, with their number: the budget of 25 lines lets some through, in order.
GROWING = {2: 3, 3: 4, 4: 1}
#: (as written, as it must become, binary operators in it, other facts of one statement)
FORMS: list[tuple[str, str, int, dict[str, int]]] = [
    ("\tx=x+1;\n", "\tx = x + 1;\n", 2, {}),
    ("\tif (x)\n\t{\n\t\tx++;\n\t}\n", "\tif (x)\n\t\tx++;\n", 0, {"single_body": 1, "compound": 1}),
    ("\tx = y ? 1 : 2;\n", "\tif (y)\n\t\tx = 1;\n\telse\n\t\tx = 2;\n", 1, {"ternary": 1}),
    ("\tfor (x = 0; x < 3; x++)\n\t\ty++;\n", "\tx = 0;\n\twhile (x < 3)\n\t{\n\t\ty++;\n\t\tx++;\n\t}\n", 2, {"for_loop": 1, "loop": 1}),
    ("\tx = y = 4;\n", "\ty = 4;\n\tx = y;\n", 2, {"chained_assignment": 1}),
    ("\tx++; y++;\n", "\tx++;\n\ty++;\n", 0, {"crowded": 1}),
    ("\tif (x) y++; else y--;\n", "\tif (x)\n\t\ty++;\n\telse\n\t\ty--;\n", 0, {"inline_body": 2}),
    ("\tif (x)\n\t\treturn (1);\n\telse\n\t\treturn (2);\n", "\tif (x)\n\t\treturn (1);\n\treturn (2);\n", 0, {"redundant_else": 1, "return": 2}),
    ("\twhile (x == NULL) {\n\t\tx--;\n\t\ty--;\n\t}\n", "\twhile (x == NULL)\n\t{\n\t\tx--;\n\t\ty--;\n\t}\n", 1, {"null_check": 1, "compound": 1, "loop": 1}),
    ("\t\t\tx = 5;\n  y = 6;\n", "\tx = 5;\n\ty = 6;\n", 2, {}),
    ("\t;\n", "", 0, {"empty_statement": 1}),
]
PARAMETERS = ", ".join(f"int a{i}" for i in range(6))
LOCALS = "".join(f"\tint\tv{i};\n" for i in range(8))
#: Numbers of a row: parameters, locals, statements, form.
P, V, K, N = "(p_size % 6)", "(p_partkey % 8)", "(1 + p_size % 3)", f"(p_partkey % {len(FORMS)})"


def _per_form(values: list[int]) -> str:
    return "CASE " + " ".join(f"WHEN {N} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


#: SQL of DuckDB for the lines of a function's body as written.
BODY = f"{V} + ({V} > 0)::BIGINT + {K} * {_per_form([f[0].count(chr(10)) for f in FORMS])} + 1"


def _repeated(i: int, form: tuple, which: int) -> str:
    if which == 0 or i not in GROWING:
        return f"repeat('{form[which]}', {K})"
    fits = f"least({K}, (25 - ({BODY})) // {GROWING[i]})"
    return f"repeat('{form[1]}', {fits}) || repeat('{form[0]}', {K} - {fits})"


def _source(which: int) -> str:
    """The file of a row as SQL; which: 0 as written, 1 as it must become."""
    form = "CASE " + " ".join(f"WHEN {N} = {i} THEN {_repeated(i, f, which)}" for i, f in enumerate(FORMS)) + " END"
    end = "\treturn x;\n" if which == 0 else "\treturn (x);\n"
    params = f"CASE WHEN {P} = 0 THEN 'void' ELSE substr('{PARAMETERS}', 1, CAST({P} * 8 - 2 AS INT)) END"
    locals_ = f"substr('{LOCALS}', 1, CAST({V} * 9 AS INT)) || CASE WHEN {V} > 0 THEN '\n' ELSE '' END"
    return f"'#include <stdio.h>\n\n' || CASE WHEN p_partkey % 2 = 0 THEN 'static ' ELSE '' END || 'int\tf' || p_partkey || '(' || {params} || ')\n{{\n' || {locals_} || {form} || '{end}}}\n'"


WRITTEN, CLEAN = _source(0), _source(1)


def sources(spark: SparkSession, d: str) -> DataFrame:
    """The files, dealt to all cores: the table is one small file, and to read C takes far longer than to move it."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".c")).alias("path"), F.expr(WRITTEN).alias("content"))
    return rows.repartition(n, "path")


def _facts(spark, d):
    return facts.facts(sources(spark, d))


def q_corpus_functions(spark, d):
    return facts.functions(_facts(spark, d)).select("path", "kind", "name", "is_static", "returns_pointer", "parameter_count", "body_lines")


def q_corpus_locals(spark, d):
    return facts.locals_(_facts(spark, d)).select("path", "function", "name", F.col("line").cast("long").alias("line"), "initial")


def q_corpus_budget(spark, d):
    f = _facts(spark, d)
    out = report.budgets(facts.functions(f), facts.locals_(f))
    return out.select("path", "function", *(F.col(c).cast("long").alias(c) for c in out.columns[2:]))


def q_corpus_limits(spark, d):
    return rules.function_limits(_facts(spark, d)).groupBy("rule_id").agg(F.count("*").alias("n"))


def q_corpus_fixed(spark, d):
    return transforms.fixed(sources(spark, d)).select("path", F.md5(F.col("content").cast("binary")).alias("md5"))


def q_corpus_shapes(spark, d):
    kinds = sorted({k for f in FORMS for k in f[3]} | {"binary_operator"})
    rows = _facts(spark, d).where(F.col("fact").isin(kinds))
    return rows.groupBy("fact").agg(F.count("*").alias("n"))


def q_corpus_initial_blocks(spark, d):
    return view(_facts(spark, d), "initial_block").select("path", F.col("text").cast("long").alias("n_declarations"))


def q_corpus_fingerprints(spark, d):
    """Layout rewrites of a file leave its fingerprint."""
    only = frozenset(k for k, (_, layout) in transforms.PHASES.items() if layout)
    after = transforms.fixed(sources(spark, d), only=only, diffs=False).select("path", "content", "changed")
    both = [lexer.fingerprint(x, comments=True) for x in (sources(spark, d), after)]
    same = both[0].join(both[1].withColumnRenamed("fingerprint", "after"), "path")
    return same.select("path", (F.col("fingerprint") == F.col("after")).alias("same"), "changed")


def q_corpus_inspection(spark, d):
    """Path, kind, bytes and state of each file, one row a file."""
    src = sources(spark, d)
    recovered = view(_facts(spark, d), "recovery").groupBy("path").agg(F.count("*").alias("n"))
    return src.join(recovered, "path", "left").select("path", F.lit("c_source").alias("kind"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("content_hash"), F.coalesce("n", F.lit(0)).alias("n_regions"))


PATH = "'p' || p_partkey || '.c'"
_SHAPES = " UNION ALL ".join(
    f"SELECT '{k}' AS fact, sum({K} * {_per_form([f[3].get(k, 0) if k != 'binary_operator' else f[2] for f in FORMS])}){' + count(*)' if k in ('return', 'compound') else ''} AS n FROM part" for k in sorted({k for f in FORMS for k in f[3]} | {"binary_operator"})
)
ORACLE = {
    "corpus_functions": f"SELECT {PATH} AS path, 'definition' AS kind, 'f' || p_partkey AS name, p_partkey % 2 = 0 AS is_static, false AS returns_pointer, {P}::BIGINT AS parameter_count, ({BODY})::BIGINT AS body_lines FROM part",
    "corpus_locals": f"SELECT {PATH} AS path, 'f' || p_partkey AS function, 'v' || i AS name, 5 + i AS line, true AS initial FROM part, range(8) r(i) WHERE i < {V}",
    "corpus_budget": f"SELECT {PATH} AS path, 'f' || p_partkey AS function, ({BODY})::BIGINT AS lines, greatest(0, 25 - ({BODY}))::BIGINT AS lines_left, {V}::BIGINT AS variables, greatest(0, 5 - {V})::BIGINT AS variables_left, {P}::BIGINT AS parameters, greatest(0, 4 - {P})::BIGINT AS parameters_left FROM part",
    "corpus_limits": f"SELECT * FROM (SELECT 'TOO_MANY_LINES' AS rule_id, count(*) AS n FROM part WHERE {BODY} > 25 UNION ALL SELECT 'TOO_MANY_ARGS', count(*) FROM part WHERE {P} > 4 UNION ALL SELECT 'TOO_MANY_VARS_FUNC', count(*) FROM part WHERE {V} > 5) WHERE n > 0",
    "corpus_fixed": f"SELECT {PATH} AS path, md5({CLEAN}) AS md5 FROM part",
    "corpus_shapes": f"SELECT fact, n::BIGINT AS n FROM ({_SHAPES})",
    "corpus_initial_blocks": f"SELECT {PATH} AS path, {V}::BIGINT AS n_declarations FROM part WHERE {V} > 0",
    "corpus_fingerprints": f"SELECT {PATH} AS path, true AS same, {N} IN (0, 5, 6, 8, 9) AS changed FROM part",
    "corpus_inspection": f"SELECT {PATH} AS path, 'c_source' AS kind, strlen({WRITTEN})::BIGINT AS bytes, sha256({WRITTEN}) AS content_hash, 0::BIGINT AS n_regions FROM part",
}
QUERIES = {k.removeprefix("q_"): v for k, v in list(globals().items()) if k.startswith("q_")}
