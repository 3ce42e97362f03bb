"""Small literal inputs for operators whose inputs the star tables don't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

C_FILES = {
    "src/main.c": '#include <unistd.h>\n#include "lib.h"\n\n#define LIMIT 10\n\nstatic int\tspread(int a)\n{\n\treturn (a);\n}\n\nstatic int\tfold(int a)\n{\n\treturn (spread(a) + spread(1));\n}\n\nstatic int\tnext_of(int a)\n{\n\treturn (a + 1);\n}\n\nint\tmain(void)\n{\n\tint\ti;\n\tint\tj;\n\n\ti = 0;\n\twhile (i < LIMIT)\n\t{\n\t\tint\tlate;\n\n\t\tlate = i;\n\t\ti = next_of(late);\n\t}\n\tj = printf("%d", i);\n\twrite(1, "x", j);\n\treturn (helper(i));\n}\n',
    "src/lib.c": '#include "lib.h"\n#include <stdlib.h>\n\nstruct point\n{\n\tint\tx;\n};\n\nstatic int\tping(int n);\n\nstatic int\tpong(int n)\n{\n\treturn (ping(n));\n}\n\nstatic int\tping(int n)\n{\n\treturn (pong(n));\n}\n\nint\thelper(int n)\n{\n\twhile (1)\n\t{\n\t\tn++;\n\t}\n\treturn (n);\n}\n\nvoid\tnothing(void)\n{\n}\n\nchar\t*many(int a, int b, int c, int d, int e)\n{\n\tchar\t*p;\n\tint\tu;\n\tint\tv;\n\tint\tw;\n\tint\tx;\n\tint\ty;\n\n\tp = malloc(a + b + c + d + e);\n\tfor (;;)\n\t{\n\t\tif (p)\n\t\t\tbreak ;\n\t}\n\treturn (p);\n}\n',
    "src/lib.h": "#ifndef LIB_H\n# define LIB_H\n\nint\t\thelper(int n);\nint\t\torphan(int n);\nvoid\tnothing(void);\nchar\t*many(int a, int b, int c, int d, int e);\n\n#endif\n",
    "src/six.c": "".join(f"int\tf{i}(void)\n{{\n\treturn ({i});\n}}\n\n" for i in range(7)),
}
MAKEFILES = {
    "Makefile": "NAME = app\nSRCS = main.c \\\n\tlib.c gone.c\nOBJS := $(SRCS:.c=.o)\n\nall: $(NAME)\n\n$(NAME): $(OBJS)\n\tcc -o $@ $^\n\nclean fclean:\n    rm -f $(OBJS)\n",
    "lib/Makefile": "NAME = $(X)\nSRC = $(wildcard *.c)\nall:\n\ttrue\nclean:\nfclean:\nre:\n",
}
CHECKER = {
    "a.c": "Error: SPACE_BEFORE_FUNC    (line:   3, col:   4):\tspace before function name\nNotice: GLOBAL_VAR_DETECTED  (line:   1, col:   1):\tGlobal variable present\na.c: Error!\n",
    "b.c": "b.c: OK!\n",
    "c.c": "Notice: GLOBAL_VAR_DETECTED (line: 1, col: 1): Global variable\nc.c: Error!\n",
    "d.c": "Traceback (most recent call last):\n",
}
LEAKS = {
    "run1": "==12== Memcheck\n==12== 1,024 (24 direct, 1,000 indirect) bytes in 1 blocks are definitely lost in loss record 2 of 3\n==12==    at 0x4848899: malloc (in /usr/lib/vg.so)\n==12==    by 0x109170: make_list (list.c:12)\n==12==    by 0x109190: main (main.c:7)\n==12== \n==12== 8 bytes in 1 blocks are possibly lost in loss record 1 of 3\n==12==    at 0x4848899: malloc (in /usr/lib/vg.so)\n==12==    by 0x1091B0: copy (copy.c:30)\n==12== \n==12== 99 bytes in 1 blocks are still reachable in loss record 3 of 3\n",
}


MESSY_C = {"messy.c": "int\tf()\n{\n\n\tint\ta[ 3 ];;\n\tchar * p;\n\n\tif(a[ 0 ] ,1)\n\t\treturn g(a ,b);\n\treturn(a[1]);\n\n}\n"}
CLEAN_C = {"messy.c": "int\tf(void)\n{\n\tint\ta[3];\n\tchar\t*p;\n\n\tif (a[0], 1)\n\t\treturn (g(a, b));\n\treturn (a[1]);\n}\n"}
NATIVE, OFFICIAL = [("a", "R", 1), ("a", "R", 2)], [("a", "R", 1), ("a", "S", 9)]


MEMORY = {
    "run2": "==7== Invalid read of size 4\n==7==    at 0x10: walk (walk.c:9)\n==7==    by 0x11: main (main.c:7)\n==7==  Address 0x4 is not stack'd\n==7== \n==7== Conditional jump or move depends on uninitialised value(s)\n==7==    at 0x4848899: malloc (in /usr/lib/vg.so)\n==7==    by 0x12: main (main.c:3)\n==7== \n==7== HEAP SUMMARY:\n",
}
SHAPES_C = {
    "shapes.c": "#include <stddef.h>\n#define SIZE 4\n#define TWICE(x) ((x) + (x))\n\nenum color\n{\n\tRED,\n\tBLUE = SIZE,\n\tGREY\n};\n\nint\ttable[SIZE + 2];\n\nchar\t*first(char *s)\n{\n\tchar\t*p;\n\n\tp = s;\n\treturn (0);\n}\n\n#undef NULL\n\nchar\t*second(void)\n{\n\treturn (0);\n}\n\nint\tthird(int n)\n{\n\tint\tkept = n + 1;\n\tint\tunused = 3;\n\tint\ta, *p;\n\tint\tfree_size[n];\n\n\ta = kept;\n\treturn (p == 0);\n}\n",
}
BROKEN_C = {
    "arms.c": "int\tone(void)\n{\n#ifdef A\n\tif (1) {\n#else\n\tif (0) {\n#endif\n\t\treturn (1);\n\t}\n\treturn (0);\n}\n\nint\ttwo(void)\n{\n\treturn (2);\n}\n",
    "cut.c": "int\tbad(int a)\n{\n\tif (a\n\treturn (a);\n}\n\nint\tgood(void)\n{\n\treturn (1);\n}\n",
    "odd.c": "int\tf(void)\n{\n\treturn (1 @ 2);\n}\n",
}


def _in(body: str, head: str = "int\tf(int a)") -> str:
    return f"{head}\n{{\n{body}}}\n"


#: (rewrite, before, after), each run alone.
REWRITE_CASES = [
    ("ELSE_NEWLINE", _in("\tif (a)\n\t{\n\t\ta++;\n\t\ta--;\n\t} else\n\t\ta = 2;\n"), _in("\tif (a)\n\t{\n\t\ta++;\n\t\ta--;\n\t}\n\telse\n\t\ta = 2;\n")),
    ("CONTROL_BRACE_NEWLINE", "int\tf(int a) {\n\twhile (a) {\n\t\ta--;\n\t\ta--;\n\t}\n}\n", "int\tf(int a)\n{\n\twhile (a)\n\t{\n\t\ta--;\n\t\ta--;\n\t}\n}\n"),
    ("CONTROL_BODY_NEWLINE", _in("\tif (a) a++;\n\telse a--;\n"), _in("\tif (a)\n\t\ta++;\n\telse\n\t\ta--;\n")),
    ("BLOCK_STATEMENT_NEWLINE", "int\tf(void)\n{ return (1); }\n", "int\tf(void)\n{\n\treturn (1);\n}\n"),
    ("ONE_INSTRUCTION_PER_LINE", _in("\ta++; a--; f(a);\n"), _in("\ta++;\n\ta--;\n\tf(a);\n")),
    ("OPERATOR_SPACING", _in("\ta=b*-c+(d  -1)&&(char *)e;\n"), _in("\ta = b * -c + (d - 1) && (char *)e;\n")),
    ("COMPACT_CONTINUATION", _in("\ta = f(1,\n\t\t2\n\t\t+ 3);\n"), _in("\ta = f(1, 2 + 3);\n")),
    ("FUNCTION_LAYOUT", "int f(void)\n{\n}\n\nunsigned int   *g(void);\nchar h(void);\n", "int\tf(void)\n{\n}\n\nunsigned int\t*g(void);\nchar\t\t\th(void);\n"),
    ("INDENTATION", _in("  if (a)\n  a++;\n\t\twhile (a)\n    {\n\ta--;\n\t  a--;\n  }\n"), _in("\tif (a)\n\t\ta++;\n\twhile (a)\n\t{\n\t\ta--;\n\t\ta--;\n\t}\n")),
    ("INITIAL_DECLARATION_LAYOUT", _in("\tint  b;\n\tchar *p;\n\tb = a;\n"), _in("\tint\tb;\n\tchar\t*p;\n\n\tb = a;\n")),
    ("LINE_TOO_LONG", _in("\tif (first_condition_of_them(a, a) && second_condition_of_them(a) && third(a))\n\t\ta = 1;\n"), _in("\tif (first_condition_of_them(a, a) && second_condition_of_them(a)\n\t\t&& third(a))\n\t\ta = 1;\n")),
    ("REMOVE_SINGLE_STATEMENT_BRACES", _in("\twhile (a)\n\t{\n\t\ta--;\n\t}\n"), _in("\twhile (a)\n\t\ta--;\n")),
    ("REMOVE_REDUNDANT_ELSE", _in("\tif (a)\n\t\treturn (1);\n\telse\n\t\treturn (2);\n"), _in("\tif (a)\n\t\treturn (1);\n\treturn (2);\n")),
    ("ONE_DECLARATION_PER_LINE", _in("\tint\tb, *c, d[3];\n"), _in("\tint\tb;\n\tint\t*c;\n\tint\td[3];\n")),
    ("SPLIT_DECLARATION_ASSIGNMENT", _in("\tint\tb = a;\n\tint\tc;\n\n\tc = b;\n"), _in("\tint\tb;\n\tint\tc;\n\n\tb = a;\n\n\tc = b;\n")),
    ("SPLIT_CHAINED_ASSIGNMENT", _in("\ta += g[1] = 4;\n"), _in("\tg[1] = 4;\n\ta += g[1];\n")),
    ("REPLACE_FOR_LOOP", _in("\tfor (a = 0, b = 1; a < 3; a++)\n\t{\n\t\tf(a);\n\t\tbreak ;\n\t}\n"), _in("\ta = 0;\n\tb = 1;\n\twhile (a < 3)\n\t{\n\t\tf(a);\n\t\tbreak ;\n\t\ta++;\n\t}\n")),
    ("REPLACE_TERNARY", _in("\treturn (a > 0 ? f(a) : -a);\n"), _in("\tif (a > 0)\n\t\treturn (f(a));\n\treturn (-a);\n")),
    ("POINTER_NULL_RETURN", "#include <stddef.h>\n" + _in("\treturn (0);\n", "char\t*f(void)"), "#include <stddef.h>\n" + _in("\treturn (NULL);\n", "char\t*f(void)")),
    ("PREPROCESSOR_SPACING", "#ifdef A\n#define B 1\n#  if C\n#define D\n# endif\n#endif\n", "#ifdef A\n# define B 1\n# if C\n#  define D\n# endif\n#endif\n"),
    ("REMOVE_UNUSED_VARIABLE", _in("\tint\tb;\n\tint\tc = 3;\n\n\tb = a;\n"), _in("\tint\tb;\n\n\tb = a;\n")),
    ("COMPACT_NULL_CHECK", _in("\tif (p->next == NULL && a)\n\t\ta = 1;\n"), _in("\tif (!p->next && a)\n\t\ta = 1;\n")),
    ("DECLARATION_ALIGNMENT", _in("\tint\tb;\n\tunsigned long\t*p;\n\n\tb = a;\n"), _in("\tint\t\t\t\tb;\n\tunsigned long\t*p;\n\n\tb = a;\n")),
]
_TALK = "int a; // one\n/* two */\nint b; /* three */ int c;\n"
_GAPS = "int a;\nint f(void)\n{\n\tint b;\n\tb = 1;\n\n\n}\n"
_OPS = "int f(int a)\n{\n\ta =b+  c;\n\tf( a );\n}\n"


def reported_cases(R) -> list[tuple]:
    """(name, source, edits of a view): rewrites at places a checker names."""
    return [
        ("comments", _TALK, lambda v: R.remove_comments(v, {(1, 8), (2, 1), (3, 8)})),
        ("other place", _TALK, lambda v: R.remove_comments(v, {(1, 9)})),
        ("blank lines", _GAPS, lambda v: R.blank_lines(v, [("NEWLINE_PRECEDES_FUNC", 2), ("NL_AFTER_VAR_DECL", 5), ("EMPTY_LINE_FUNCTION", 6), ("CONSECUTIVE_NEWLINES", 7), ("NOT_KNOWN", 1)])),
        ("spacing", _OPS, lambda v: R.token_spacing(v, [("SPC_AFTER_OPERATOR", 3, 7), ("SPC_BFR_OPERATOR", 3, 9), ("CONSECUTIVE_SPC", 3, 10), ("NO_SPC_AFR_PAR", 4, 6), ("NO_SPC_BFR_PAR", 4, 10)])),
    ]


REPORTED = [
    ("comments", "int a;\nint b; int c;\n"),
    ("other place", _TALK),
    ("blank lines", "int a;\n\nint f(void)\n{\n\tint b;\n\n\tb = 1;\n}\n"),
    ("spacing", "int f(int a)\n{\n\ta = b + c;\n\tf(a);\n}\n"),
]


def files(spark: SparkSession, table: dict[str, str], name: str = "content") -> DataFrame:
    return spark.createDataFrame(list(table.items()), f"path string, {name} string")
