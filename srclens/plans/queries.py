"""One query an operator, over the given tables or over literal fixtures, with SQL for DuckDB beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import facts, lexer, lines, makefile, relate, report, rules, transforms
from ..sources import files, logs
from ..tables import saver
from . import fixtures

#: Both engines read this: documents with tabs, blanks at line ends, blank lines, carriage returns and a byte order mark put in.
MESSY = "CASE WHEN doc_id % 5 = 0 THEN '﻿' ELSE '' END || replace(replace(replace(text, ' the ', chr(9) || 'the '), '. ', '.  ' || chr(10) || chr(10) || chr(10)), ' de ', ' de ' || chr(92) || ' ' || chr(13) || chr(10)) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE chr(10) || chr(10) END"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def messy(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.expr(MESSY).alias("content"))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def line_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return lines.line_rules(messy(spark, d))


def per_supplier(spark: SparkSession, d: str, texts: dict[str, str], column: str = "content") -> DataFrame:
    """(path, column): a project of these files for each supplier, in a folder of its own."""
    listed = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(t).alias("text")) for p, t in texts.items()))
    made = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("/")).alias("folder"), F.explode(listed).alias("f"))
    return made.select(F.concat("folder", "f.path").alias("path"), F.col("f.text").alias(column))


def of_suppliers(sql: str) -> str:
    """SQL of what each of ``per_supplier``'s projects gives, from that of one."""
    return f"SELECT 's' || s_suppkey || '/' || v.path AS path, v.* EXCLUDE (path) FROM supplier, ({sql}) v"


def _c(spark: SparkSession, d: str) -> DataFrame:
    """The facts of the projects, written once: several rules read them."""
    return saver(spark)(facts.facts(per_supplier(spark, d, fixtures.C_FILES)))


def q_line_index(spark, d):
    return lines.line_counts(documents(spark, d))


def q_line_ranges(spark, d):
    return longs(lines.line_ranges(documents(spark, d)), "line", "start", "end").withColumnsRenamed({"start": "start_byte", "end": "end_byte"})


def q_long_lines(spark, d):
    return longs(lines.too_long(lines.lines(messy(spark, d))).select("path", "line", "width"), "line", "width")


def q_hygiene(spark, d):
    return messy(spark, d).select("path", F.md5(X.hygiene(F.col("content")).cast("binary")).alias("fixed"))


def q_hygiene_fix_counts(spark, d):
    t, cols = F.col("content"), []
    for name, step in X.HYGIENE:
        cols.append(F.count_if(step(t) != t).cast("long").alias(name.lower()))
        t = step(t)
    return messy(spark, d).agg(*cols)


def q_trailing_space(spark, d):
    return longs(lines.trailing_space(lines.lines(messy(spark, d))).select("path", "line"), "line")


def q_final_newline(spark, d):
    return lines.missing_final_newline(messy(spark, d)).select("path")


def q_word_counts(spark, d):
    return lines.word_counts(documents(spark, d)).groupBy("word").agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("n_once"))


def q_identifiers(spark, d):
    return documents(spark, d).select("path", F.size(X.identifiers(F.col("content"))).cast("long").alias("n_identifiers"))


def q_duplicate_contents(spark, d):
    return documents(spark, d).groupBy(F.sha2("content", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")


def q_guard_names(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", X.guard_name(F.regexp_extract("url", "[^/]+$", 0)).alias("guard"))


def q_rule_groups(spark, d):
    return report.by_rule(line_diagnostics(spark, d))


def q_top_three(spark, d):
    return longs(report.first_of_each(line_diagnostics(spark, d)).select("severity", "rule_id", "path", "line", "ordinal"), "line", "ordinal")


def _reports(spark, d):
    f = messy(spark, d).select("path", F.when(F.instr("content", "\r") > 0, "carriage return").alias("failure"), (X.hygiene(F.col("content")) != F.col("content")).alias("changed"))
    return f, line_diagnostics(spark, d)


def q_file_status(spark, d):
    return report.file_status(*_reports(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


def q_summary(spark, d):
    return report.exit_code(report.summary(*_reports(spark, d)))


def q_regressions(spark, d):
    before = lines.diagnostics(lines.too_long(lines.lines(documents(spark, d))), "LINE_TOO_LONG", "error")
    return relate.regressions(before, line_diagnostics(spark, d))


def q_multiset_difference(spark, d):
    key = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")]  # texts are not shuffled
    a = lines.lines(messy(spark, d)).where("text <> ''").select("path", "line", *key)
    b = lines.lines(documents(spark, d)).select("path", "line", *key)
    return relate.multiset_difference(a, b, ["path", "h1", "h2"], ["line"]).groupBy("path").agg(F.count("*").alias("n"))


def q_heading_jumps(spark, d):
    levels = F.regexp_extract_all("html", F.lit("<h([1-6])"), F.lit(1))
    h = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("path"), F.posexplode(levels).alias("line", "level")).withColumn("level", F.col("level").cast("int"))
    return h.groupBy("path").agg(F.count("*").alias("n_headings")).join(lines.heading_jumps(h).groupBy("path").agg(F.count("*").alias("n_jumps")), "path", "left").select("path", "n_headings", F.coalesce("n_jumps", F.lit(0)).alias("n_jumps"))


def q_c_functions(spark, d):
    return facts.functions(_c(spark, d)).select("path", "kind", "name", "is_static", "returns_pointer", "parameter_count", "body_lines")


def q_c_function_limits(spark, d):
    return rules.function_limits(_c(spark, d)).select("path", "rule_id", "message")


def q_c_too_many_functions(spark, d):
    return rules.too_many_functions(_c(spark, d)).select("path", "line", "message")


def q_c_budget(spark, d):
    f = _c(spark, d)
    return longs(report.budgets(facts.functions(f), facts.locals_(f)), "lines", "lines_left", "variables", "variables_left", "parameters", "parameters_left")


def q_c_rules(spark, d):
    f = _c(spark, d)
    return rules.late_declarations(f).unionByName(rules.tag_names(f)).unionByName(rules.endless_loops(f))


def q_c_not_allowed(spark, d):
    return rules.not_allowed(_c(spark, d), spark.createDataFrame([("write",), ("malloc",)], "name string")).select("path", "line", "message")


def q_c_orphans(spark, d):
    # names count across files: each project has its own
    project = F.regexp_extract("path", "^s([0-9]+)/", 1)
    src = per_supplier(spark, d, fixtures.C_FILES).withColumn("content", F.regexp_replace("content", F.lit(r"\b(helper|orphan|nothing|many)\b"), F.concat(F.lit("$1_"), project)))
    f = saver(spark)(facts.facts(src))
    return rules.orphan_prototypes(f).unionByName(rules.empty_implementations(f)).select("path", "rule_id", "message")


def q_c_dead_statics(spark, d):
    f = _c(spark, d)
    return relate.dead_statics(facts.functions(f).where("kind = 'definition'"), rules.references(f), saver(spark), rules.blocked(f))


def q_c_tokens(spark, d):
    t = lexer.tokens(per_supplier(spark, d, fixtures.C_FILES))
    back = t.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x.text), "").alias("back"), F.count_if(F.col("class") == "unknown").alias("n_unknown"))
    return back.select("path", F.md5(F.col("back").cast("binary")).alias("md5"), "n_unknown")


def q_folders(spark, d):
    return files.folders(spark.read.parquet(f"{d}/pages.parquet").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")))


def q_c_rewrites(spark, d):
    out = transforms.fixed(per_supplier(spark, d, fixtures.MESSY_C))
    return out.select("path", "content", "changed", F.size(F.filter(F.split("diff", "\n"), lambda x: x.rlike(r"^[-+](?![-+])"))).cast("long").alias("n_diff_lines"))


def values(names: str, *rows: tuple) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


DOCS = "SELECT 'doc' || doc_id AS path, text AS content FROM documents"
LINES = "SELECT path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM d"
D = f"WITH d AS ({DOCS}), l AS ({LINES})"
M = f"WITH d AS (SELECT 'doc' || doc_id AS path, {MESSY} AS content FROM documents), l AS ({LINES})"
_PLAIN = r"(length({0}) - len(regexp_extract_all({0}, '[\p{{Mn}}\p{{Me}}\p{{Cf}}]')))"
WIDTH = "(list_sum(list_transform(string_split(text, chr(9))[:-2], lambda p: (" + _PLAIN.format("p") + " // 4 + 1) * 4)) + " + _PLAIN.format("string_split(text, chr(9))[-1]") + ")"
WIDTH = WIDTH.replace("list_sum(list_transform", "coalesce(list_sum(list_transform").replace("* 4)) +", "* 4)), 0) +")
DIAG = f"{M}, g AS (SELECT path, line, 'error' AS severity, 'LINE_TOO_LONG' AS rule_id FROM l WHERE {WIDTH} > 80 UNION ALL SELECT path, line, 'warning', 'TRAILING_SPACE' FROM l WHERE text[-1] IN (' ', chr(9)))"
#: (path, name, static, pointer, parameters, lines, locals) of the definitions of ``fixtures.C_FILES``, counted by hand.
_DEFINED = [
    *(("src/main.c", n, True, False, 1, 1, 0) for n in ("spread", "fold", "next_of")),
    ("src/main.c", "main", False, False, 0, 14, 3),
    *(("src/lib.c", n, True, False, 1, 1, 0) for n in ("pong", "ping")),
    ("src/lib.c", "helper", False, False, 1, 5, 0),
    ("src/lib.c", "nothing", False, False, 0, 0, 0),
    ("src/lib.c", "many", False, True, 5, 14, 6),
    *(("src/six.c", f"f{i}", False, False, 0, 1, 0) for i in range(7)),
]
_DECLARED = [("src/lib.c", "ping", True, False, 1), ("src/lib.h", "helper", False, False, 1), ("src/lib.h", "orphan", False, False, 1), ("src/lib.h", "nothing", False, False, 0), ("src/lib.h", "many", False, True, 5)]
_T = "content"
STEPS = []
for _f in (
    "CASE WHEN {0}[1] = '﻿' THEN substr({0}, 2) ELSE {0} END",
    "replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))",
    r"regexp_replace({0}, '(^|[^ \t\\])[ \t]+(\n|$)', '\1\2', 'g')",
    "ltrim({0}, chr(10))",
    r"regexp_replace({0}, '\n{{3,}}', chr(10) || chr(10), 'g')",
    "CASE WHEN rtrim({0}, chr(10)) = '' THEN '' ELSE rtrim({0}, chr(10)) || chr(10) END",
):
    STEPS.append(_f)
CHAIN = "".join(f", s{k} AS (SELECT *, {s.format(f't{k - 1}')} AS t{k} FROM s{k - 1})" for k, s in enumerate(STEPS, 1))
FIXED = f"{M}, s0 AS (SELECT path, content AS t0 FROM d){CHAIN}"
ORACLE = {
    "line_index": f"{D} SELECT path, count(*) AS n_lines, sum(strlen(text))::BIGINT AS n_bytes FROM l GROUP BY path",
    "line_ranges": f"{D}, b AS (SELECT path, line, strlen(text) + (line < max(line) OVER (PARTITION BY path))::INT AS size FROM l) SELECT path, line, (sum(size) OVER w - size)::BIGINT AS start_byte, (sum(size) OVER w)::BIGINT AS end_byte FROM b WINDOW w AS (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING)",
    "long_lines": f"{M} SELECT path, line, {WIDTH}::BIGINT AS width FROM l WHERE {WIDTH} > 80",
    "hygiene": f"{FIXED} SELECT path, md5(t6) AS fixed FROM s6",
    "hygiene_fix_counts": f"{FIXED} SELECT " + ", ".join(f"count(*) FILTER (WHERE t{k} <> t{k - 1}) AS {n.lower()}" for k, (n, _) in enumerate(X.HYGIENE, 1)) + " FROM s6",
    "trailing_space": f"{M} SELECT path, line FROM l WHERE text[-1] IN (' ', chr(9))",
    "final_newline": f"{M} SELECT path FROM d WHERE content <> '' AND content[-1] <> chr(10)",
    "word_counts": rf"{D}, w AS (SELECT path, unnest(regexp_extract_all(content, '[\p{{L}}\p{{Nl}}\p{{N}}_]+')) AS word FROM d), c AS (SELECT path, word, count(*) AS n FROM w GROUP BY ALL) SELECT word, sum(n)::BIGINT AS n, count(*) FILTER (WHERE n = 1) AS n_once FROM c GROUP BY word",
    "identifiers": f"{D} SELECT path, len(list_filter(regexp_split_to_array(content, '[^A-Za-z0-9_]+'), lambda x: regexp_matches(x, '^[A-Za-z_]')))::BIGINT AS n_identifiers FROM d",
    "duplicate_contents": f"{D} SELECT sha256(content) AS content_hash, count(*) AS n, min(path) AS first FROM d GROUP BY 1 HAVING count(*) > 1",
    "guard_names": "SELECT page_id, upper(regexp_replace(regexp_extract(url, '[^/]+$'), '[^A-Za-z0-9]', '_', 'g')) AS guard FROM pages",
    "rule_groups": f"{DIAG} SELECT severity, rule_id, count(*) AS n, count(DISTINCT path) AS n_paths FROM g GROUP BY ALL",
    "top_three": f"{DIAG} SELECT severity, rule_id, path, line, row_number() OVER (PARTITION BY severity, rule_id ORDER BY path, line) AS ordinal FROM g QUALIFY ordinal <= 3",
    "file_status": f"{DIAG}, s0 AS (SELECT path, content AS t0 FROM d){CHAIN}, w AS (SELECT DISTINCT path, true AS findings FROM g) SELECT CASE WHEN contains(t0, chr(13)) THEN 'failed' WHEN findings THEN 'findings' WHEN t6 <> t0 THEN 'changed' ELSE 'clean' END AS status, count(*) AS n FROM s6 LEFT JOIN w USING (path) GROUP BY 1",
    "summary": f"{DIAG}, s0 AS (SELECT path, content AS t0 FROM d){CHAIN}, f AS (SELECT count(*) AS n_files, count(*) FILTER (WHERE contains(t0, chr(13))) AS n_failed, count(*) FILTER (WHERE t6 <> t0) AS n_changed FROM s6), e AS (SELECT count(*) FILTER (WHERE severity = 'error') AS n_error, count(*) FILTER (WHERE severity = 'warning') AS n_warning, count(*) FILTER (WHERE severity = 'info') AS n_info, count(DISTINCT path) AS n_with_findings FROM g) SELECT *, CASE WHEN n_failed > 0 THEN 2 WHEN n_error + n_warning > 0 THEN 1 ELSE 0 END AS exit_code FROM f, e",
    "regressions": f"{DIAG}, p AS ({DOCS}), pl AS ({LINES.replace('FROM d', 'FROM p')}), bc AS (SELECT 'LINE_TOO_LONG' AS rule_id, count(*) AS n_before FROM pl WHERE {WIDTH} > 80), ac AS (SELECT rule_id, count(*) AS n_after FROM g GROUP BY 1) SELECT rule_id, coalesce(n_before, 0) AS n_before, n_after FROM ac LEFT JOIN bc USING (rule_id) WHERE n_after > coalesce(n_before, 0)",
    "multiset_difference": f"{M}, p AS ({DOCS}), pl AS ({LINES.replace('FROM d', 'FROM p')}), a AS (SELECT path, text, count(*) AS n FROM l WHERE text <> '' GROUP BY ALL), b AS (SELECT path, text, count(*) AS m FROM pl GROUP BY ALL) SELECT path, sum(greatest(0, n - coalesce(m, 0)))::BIGINT AS n FROM a LEFT JOIN b USING (path, text) GROUP BY path HAVING sum(greatest(0, n - coalesce(m, 0))) > 0",
    "heading_jumps": "WITH h AS (SELECT page_id AS path, unnest(regexp_extract_all(html, '<h([1-6])', 1))::INT AS level, unnest(range(len(regexp_extract_all(html, '<h([1-6])', 1)))) AS line FROM pages), j AS (SELECT *, level > lag(level) OVER (PARTITION BY path ORDER BY line) + 1 AS jump FROM h) SELECT path, count(*) AS n_headings, count(*) FILTER (WHERE jump) AS n_jumps FROM j GROUP BY path",
    "c_rewrites": of_suppliers("SELECT 'messy.c' AS path, '" + fixtures.CLEAN_C["messy.c"].replace("'", "''") + "' AS content, true AS changed, 14::BIGINT AS n_diff_lines"),
    "c_tokens": of_suppliers(values("path, md5, n_unknown", *((p, __import__("hashlib").md5(t.encode()).hexdigest(), 0) for p, t in fixtures.C_FILES.items()))),
    "c_functions": of_suppliers(values("path, kind, name, is_static, returns_pointer, parameter_count, body_lines", *((p, "definition", n, s, q, k, b) for p, n, s, q, k, b, _ in _DEFINED), *((p, "prototype", n, s, q, k, None) for p, n, s, q, k in _DECLARED))),
    "c_budget": of_suppliers(values('path, "function", lines, lines_left, variables, variables_left, parameters, parameters_left', *((p, n, b, 25 - b, v, max(0, 5 - v), k, max(0, 4 - k)) for p, n, _, _, k, b, v in _DEFINED))),
    "c_too_many_functions": of_suppliers(values("path, line, message", ("src/six.c", 26, "f5"))),
    "c_function_limits": of_suppliers(values("path, rule_id, message", ("src/lib.c", "TOO_MANY_ARGS", "many: 5 > 4"), ("src/lib.c", "TOO_MANY_VARS_FUNC", "many: 6 > 5"))),
    "c_rules": of_suppliers(values("path, line, severity, rule_id, message", ("src/main.c", 29, "error", "WRONG_SCOPE_VAR", "late"), ("src/lib.c", 4, "error", "TAG_PREFIX", "struct point"), ("src/lib.c", 23, "warning", "POSSIBLE_INFINITE_LOOP", "helper"))),
    "c_not_allowed": of_suppliers(values("path, line, message", ("src/main.c", 34, "printf"))),
    "c_orphans": "SELECT 's' || s_suppkey || '/' || path AS path, rule_id, name || '_' || s_suppkey AS message FROM supplier, (VALUES ('src/lib.h', 'ORPHAN_PROTOTYPE', 'orphan'), ('src/lib.c', 'EMPTY_IMPLEMENTATION', 'nothing')) v(path, rule_id, name)",
    "c_dead_statics": of_suppliers(values("path, name", ("src/main.c", "spread"), ("src/main.c", "fold"), ("src/lib.c", "ping"), ("src/lib.c", "pong"))),
    "folders": "WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS parts FROM pages) SELECT array_to_string(parts[:n], '/') AS folder, count(*) AS n_files FROM (SELECT parts, unnest(range(1, len(parts))) AS n FROM p) GROUP BY 1",
}
QUERIES = {k.removeprefix("q_"): v for k, v in list(globals().items()) if k.startswith("q_")}
