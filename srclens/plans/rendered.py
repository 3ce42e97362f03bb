"""Queries over Makefiles, headers, plans and settings rendered from the given tables by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import edits, headers, lines, makefile, project_rules, relate, report
from ..sources import files, project
from ..tables import saver
from .queries import DIAG, D, documents, line_diagnostics, longs

_K = "cast(p_partkey AS varchar(20))"
_NL, _TAB, _BACK = "chr(10)", "chr(9)", "chr(92)"
MAKE_PATH = f"concat('m', {_K}, '/Makefile')"
#: A part's Makefile, with what its number decides to leave out or do wrong.
MAKE = f"""concat(CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('NAME = $(X)', {_NL}) ELSE concat('NAME = app', {_K}, {_NL}) END,
  'SRCS = main.c ', CASE p_partkey % 3 WHEN 0 THEN concat({_BACK}, {_NL}, {_TAB}, 'lib.c gone', {_K}, '.c') WHEN 1 THEN '$(wildcard *.c)' ELSE 'empty.c' END, {_NL}, {_NL},
  CASE WHEN p_partkey % 7 = 0 THEN concat('build: ', {_NL}, {_NL}) ELSE '' END, 'all: $(NAME)', {_NL}, {_NL},
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('$(NAME): main.o', {_NL}, {_TAB}, 'cc -o $@ $^', {_NL}, {_NL}) END,
  'clean fclean:', {_NL}, CASE WHEN p_partkey % 6 = 0 THEN '    ' ELSE {_TAB} END, 'rm -f x', {_NL}, CASE WHEN p_partkey % 2 = 0 THEN concat('re: all', {_NL}) ELSE '' END,
  CASE p_size % 10 WHEN 0 THEN concat(repeat('#', 81), {_NL}) WHEN 1 THEN concat('X = a ', {_BACK}, '  ', {_NL}) ELSE '' END)"""
#: SQL of DuckDB for the places of its lines.
_SRCS = "CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 2 END"
_BUILD = f"({_SRCS} + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + 2)"
_RM = f"({_BUILD} + CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END + 2 + CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 3 END + 1)"
_LAST = f"({_RM} + CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END + 1)"
#: A list over many lines, and the whole file with a mark and carriage returns.
EXTRA = f"concat('EXTRA_SRCS := ', repeat(concat('file', {_K}, '.c ', {_BACK}, {_NL}, {_TAB}), p_size % 20), 'z.c')"
MESSY_MAKE = f"concat('\ufeff', replace(concat({MAKE}, {EXTRA}, {_NL}, {_NL}, {_NL}), {_NL}, CASE WHEN p_partkey % 2 = 0 THEN concat(chr(13), {_NL}) ELSE {_NL} END))"
_WORDS = "list_concat(list_transform(range(p_size % 20), lambda i: 'file' || p_partkey || '.c'), ['z.c'])"
_PACKED = f"""list_reduce(list_prepend('EXTRA_SRCS := ', {_WORDS}), lambda acc, w, i: CASE
  WHEN length(replace(string_split(acc, chr(10))[-1], chr(9), '    ')) + length(w) + (CASE WHEN acc[-1] = ' ' THEN 0 ELSE 1 END) + (CASE WHEN i = len({_WORDS}) + 1 THEN 0 ELSE 2 END) <= 80
  THEN acc || (CASE WHEN acc[-1] = ' ' THEN '' ELSE ' ' END) || w ELSE acc || ' ' || chr(92) || chr(10) || chr(9) || w END)"""
_JOINED_MAKE = MAKE.replace(f"concat({_BACK}, {_NL}, {_TAB}, 'lib.c gone', {_K}, '.c')", f"concat('lib.c gone', {_K}, '.c')")
_SHORT_MAKE = MAKE.replace(f"concat({_BACK}, {_NL}, {_TAB}, 'lib.c gone', {_K}, '.c')", "'lib.c'")
#: Headers in pairs of one file name, alone, or named by another file.
HEAD = "concat('d', cast(p_partkey % 3 AS varchar(20)), '/p', cast(CASE WHEN p_partkey % 4 < 2 THEN cast(floor(p_partkey / 4) AS bigint) ELSE p_partkey + 1000000 END AS varchar(20)), '.h')"
NAMED = "concat('int P', cast(p_partkey + 1000000 AS varchar(20)), '_H;')"
BODY = f"concat('int a', {_K}, ';', chr(10))"
GUARD = f"concat('G', {_K}, '_H')"
#: A header without a guard, with its own, with another, or with a part outside of it.
GUARDED = f"CASE p_size % 4 WHEN 0 THEN {BODY} ELSE concat(CASE WHEN p_size % 3 = 0 THEN concat('/* #ifndef X */', chr(10)) ELSE '' END, '#ifndef ', CASE p_size % 4 WHEN 2 THEN 'OLD_H' ELSE {GUARD} END, chr(10), '# define ', CASE p_size % 4 WHEN 2 THEN 'OLD_H' ELSE {GUARD} END, chr(10), {BODY}, '#endif', chr(10), CASE p_size % 4 WHEN 3 THEN concat('# undef X', chr(10)) ELSE '' END) END"
#: A file of two include blocks, in order or not.
INCLUDES = f"concat('#include ', chr(34), 'b.h', chr(34), chr(10), CASE p_size % 3 WHEN 0 THEN concat('#include <stdio.h>', chr(10)) ELSE '' END, '#include ', chr(34), 'A.h', chr(34), chr(10), {BODY}, '#include <', CASE p_size % 2 WHEN 0 THEN 'y' ELSE 'x' END, '.h>', chr(10), '#include <x.h>', chr(10))"
REQUEST = """CASE p_size % 6 WHEN 0 THEN 'no json' WHEN 1 THEN '{"files": [{"path": "/a", "source": "x"}]}' WHEN 2 THEN '{"files": [{"path": "a", "source": "x"}, {"path": "a", "source": "y"}]}' WHEN 3 THEN '{"files": [{"path": "a/../b", "source": "x"}]}' WHEN 4 THEN '{"files": []}' ELSE concat('{"files": [{"path": "p', cast(p_partkey AS varchar(20)), '.c", "source": "x"}]}') END"""
CAPABILITY = "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'quarantine' WHEN 2 THEN 'delete_dead_statics' ELSE 'remove_unused' END"
_C = "cast(c_custkey AS varchar(20))"
EMAIL = f"CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat(' C', {_C}, '@student.42Town.fr ') WHEN 2 THEN concat('c', {_C}, '@example.com') WHEN 3 THEN concat('c', {_C}, '@42.fr') WHEN 4 THEN '' ELSE concat('C', {_C}, '@42.fr') END"
LOGIN = f"CASE c_custkey % 6 WHEN 3 THEN 'someone' WHEN 5 THEN concat('C', {_C}) ELSE NULL END"
FOLDER = f"CASE p_size % 10 WHEN 0 THEN '/' WHEN 1 THEN concat('/usr/lib/x', {_K}) WHEN 2 THEN '/home/' WHEN 3 THEN '/home/a/' WHEN 4 THEN concat('/home/a/', {_K}) WHEN 5 THEN '//tmp' WHEN 6 THEN concat('/tmp/', {_K}) WHEN 7 THEN '/var/./log' WHEN 8 THEN '/opt/../etc' ELSE concat('/srv/', {_K}, '/..') END"
POLICY = "concat('[project]', chr(10), 'name = ', chr(34), 'p', chr(34), chr(10), 'allowed = [', chr(34), 'write', chr(34), ', ', chr(34), 'f', cast(p_size AS varchar(20)), chr(34), ', ', chr(34), 'write', chr(34), ']', chr(10))"
TRACE = "SELECT l_suppkey AS path, l_partkey AS place, l_returnflag AS message, CASE WHEN l_linenumber = 1 THEN l_linestatus END AS tag FROM lineitem"
NATIVE = "SELECT l_suppkey AS path, l_returnflag AS rule_id, l_partkey AS place FROM lineitem WHERE l_linestatus = 'F'"
OFFICIAL = "SELECT DISTINCT l_suppkey AS path, l_returnflag AS rule_id, l_partkey AS place FROM lineitem WHERE l_linenumber < 3"
SPANS = "SELECT l_suppkey AS path, l_partkey AS a, l_partkey + l_linenumber AS b, l_orderkey AS value, l_returnflag AS flag FROM lineitem"


def _part(spark: SparkSession, d: str, **made: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(*(F.expr(v).alias(k) for k, v in made.items()))


def _makefiles(spark, d):
    return _part(spark, d, path=MAKE_PATH, content=MAKE)


def _made(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("FROM lineitem", "FROM {t}"), t=spark.read.parquet(f"{d}/lineitem.parquet")).withColumnsRenamed({"place": "start", "a": "start", "b": "end"})


def _there(spark, d):
    one = lambda name, text: _part(spark, d, path=f"concat('m', {_K}, '/{name}')", content=f"'{text}'")
    return one("main.c", "int a;").unionByName(one("lib.c", "int b;")).unionByName(one("empty.c", "/* nothing */ "))


def q_makefile_missing_targets(spark, d):
    m = _makefiles(spark, d)
    return makefile.missing_targets(m, makefile.logical(m))


def q_makefile_artifact(spark, d):
    return makefile.artifact(makefile.logical(_makefiles(spark, d)))


def q_makefile_sources(spark, d):
    return makefile.source_status(makefile.source_refs(makefile.logical(_makefiles(spark, d))), _there(spark, d), X.trivia_only)


def q_makefile_rules(spark, d):
    m = _makefiles(spark, d)
    wild = makefile.wildcard_sources(makefile.logical(m)).select("path", F.lit("WILDCARD_SOURCE").alias("rule_id"), "line")
    return longs(wild.unionByName(makefile.space_recipes(m).select("path", F.lit("SPACE_RECIPE").alias("rule_id"), "line")), "line")


def q_makefile_checks(spark, d):
    m = _makefiles(spark, d)
    return longs(project_rules.makefile_rules(m, makefile.logical(m)), "line")


def q_makefile_formatted(spark, d):
    return makefile.formatted(_part(spark, d, path=MAKE_PATH, content=MESSY_MAKE))


def q_makefile_without_missing(spark, d):
    m = _makefiles(spark, d)
    return makefile.without_missing(m, makefile.source_status(makefile.source_refs(makefile.logical(m)), _there(spark, d), X.trivia_only))


def q_guard_proofs(spark, d):
    heads = _part(spark, d, path=HEAD, content="'int x;'")
    named = _part(spark, d, path=f"concat('c', {_K}, '.c')", content=f"CASE WHEN p_size % 5 = 0 THEN {NAMED} ELSE '' END")
    return project_rules.guard_proofs(heads.unionByName(named))


def q_c_guards(spark, d):
    h = _part(spark, d, p_partkey="p_partkey", code=GUARDED, guard=GUARD)
    new = X.with_guard(F.col("code"), F.col("guard"))
    return h.select("p_partkey", X.guarded(F.col("code"), F.col("guard")).alias("guarded"), new.alias("content"), X.guarded(new, F.col("guard")).alias("after"))


def q_c_include_blocks(spark, d):
    return longs(lines.include_blocks(lines.lines(_part(spark, d, path=_K, content=INCLUDES))), "first", "last")


def q_c_sorted_includes(spark, d):
    return lines.sort_includes(lines.lines(_part(spark, d, path=_K, content=INCLUDES))).select("path", F.col("line").cast("long").alias("line"), "text")


def q_refused_requests(spark, d):
    return files.from_json(_part(spark, d, request_id="p_partkey", request=REQUEST)).select("request_id", "path", "failure")


def q_granted_plans(spark, d):
    return edits.granted(_part(spark, d, path=_K, capability=CAPABILITY), ["quarantine", "remove_unused"]).select("path")


def q_refused_approvals(spark, d):
    plans = documents(spark, d).select("path", F.sha2("content", 256).alias("original_hash"), F.md5(F.col("content").cast("binary")).alias("replacement_hash"))
    late = plans.withColumn("replacement_hash", F.when(F.col("path").like("%7"), F.lit("other")).otherwise(F.col("replacement_hash")))
    return edits.approved(plans, late).agg(F.count("*").alias("n"), F.lit(plans.count()).cast("long").alias("n_asked"))


def q_identities(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    one = lambda p, e, n: c.select(F.col("c_custkey").alias("who"), F.lit(p).alias("priority"), F.expr(e).alias("email"), F.expr(n).alias("login"))
    return headers.identity(one(1, EMAIL, LOGIN).unionByName(one(2, f"CASE WHEN c_custkey % 12 = 4 THEN concat('z', {_C}, '@42.fr') END", "NULL")))


def q_run_clock(spark, d):
    epochs = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr("CASE WHEN p_size % 7 = 0 THEN 'soon' ELSE cast(p_partkey * 86413 AS varchar(20)) END").alias("epoch"))
    return epochs.select("p_partkey", headers.stamp(F.col("epoch")).alias("stamp"))


def q_protected_scopes(spark, d):
    return _part(spark, d, p_partkey="p_partkey", path=FOLDER).select("p_partkey", F.coalesce(project_rules.protected(F.col("path"), ("/home/a",)), F.lit("none")).alias("reason"))


def q_policy_allowed(spark, d):
    return project.allowed(_part(spark, d, path=_K, content=POLICY)).select("path", "name")


def q_trace_dedup(spark, d):
    return relate.trace_dedup(_made(spark, d, TRACE)).groupBy("path", F.col("tag").isNull().alias("untagged")).agg(F.count("*").alias("n"), F.sum("start").alias("places"))


def q_official_merge(spark, d):
    merged = relate.official_merge(_made(spark, d, NATIVE), _made(spark, d, OFFICIAL))
    return merged.groupBy("path", "rule_id", "source").agg(F.count("*").alias("n"), F.sum("start").alias("places"))


def q_range_lookup(spark, d):
    spans = _made(spark, d, SPANS)
    return edits.lookup(spans.drop("value"), spans.where("flag = 'R'"), "value").select("path", F.col("start").alias("first"), F.col("end").alias("last"), "value")


def q_deleted_ranges(spark, d):
    src = _part(spark, d, path=_K, content=f"concat('int a;', chr(10), chr(10), 'int b;', chr(10), 'int c;', chr(10), chr(10), 'int d;', chr(10), {BODY})")
    gone = lambda s, e, where: src.where(where).select("path", F.lit(s).cast("long").alias("start"), F.lit(e).cast("long").alias("end"))
    ranges = gone(0, 6, "true").unionByName(gone(15, 17, "path like '%1'")).unionByName(gone(16, 18, "path like '%1'"))
    return edits.applied(src, edits.deletions(src, ranges, saver(spark))).select("path", "content", "status")


def q_archive(spark, d):
    """Archives of projects, opened again."""
    whole = project.archives(documents(spark, d).withColumn("project", F.substring("path", -1, 1)), saver(spark))
    return project.opened(whole).select("project", "path", F.octet_length("content").cast("long").alias("bytes"), F.md5(F.col("content").cast("binary")).alias("md5"))


def q_total_order(spark, d):
    rows = line_diagnostics(spark, d).withColumns({"start": F.col("line"), "end": F.col("line")})
    return longs(report.numbered(rows, saver(spark)).select("ordinal", "path", "line", "severity", "rule_id"), "ordinal", "line")


QUERIES = {k.removeprefix("q_"): v for k, v in list(globals().items()) if k.startswith("q_")}
_P = f"WITH m AS (SELECT *, {MAKE_PATH} AS path FROM part)"
ORACLE = {
    "makefile_missing_targets": f"{_P} SELECT path, 're' AS target FROM m WHERE p_partkey % 2 = 1",
    "makefile_artifact": f"{_P} SELECT path, 'app' || p_partkey AS artifact FROM m WHERE p_partkey % 5 > 1",
    "makefile_sources": f"{_P} SELECT path, 'main.c' AS ref, 'exists' AS status FROM m WHERE p_partkey % 3 <> 1 UNION ALL SELECT path, 'empty.c', 'empty' FROM m WHERE p_partkey % 3 = 2 UNION ALL SELECT path, unnest(['lib.c', 'gone' || p_partkey || '.c']), unnest(['exists', 'missing']) FROM m WHERE p_partkey % 3 = 0",
    "makefile_rules": f"{_P} SELECT path, 'WILDCARD_SOURCE' AS rule_id, ({_SRCS})::BIGINT AS line FROM m WHERE p_partkey % 3 = 1 UNION ALL SELECT path, 'SPACE_RECIPE', {_RM} FROM m WHERE p_partkey % 6 = 0",
    "makefile_checks": f"{_P} SELECT path, 1::BIGINT AS line, 'MAKEFILE_NAME_MISSING' AS rule_id FROM m WHERE p_partkey % 5 = 0 UNION ALL SELECT path, 1, 'MAKEFILE_NAME_RULE_MISSING' FROM m WHERE p_partkey % 4 = 0 UNION ALL SELECT path, {_BUILD}, 'MAKEFILE_DEFAULT_RULE' FROM m WHERE p_partkey % 7 = 0 UNION ALL SELECT path, {_LAST}, CASE p_size % 10 WHEN 0 THEN 'MAKEFILE_LINE_TOO_LONG' ELSE 'MAKEFILE_TRAILING_AFTER_BACKSLASH' END FROM m WHERE p_size % 10 < 2",
    "makefile_formatted": f"SELECT {MAKE_PATH} AS path, concat({_JOINED_MAKE}, {_PACKED}, chr(10)) AS content FROM part",
    "makefile_without_missing": f"SELECT {MAKE_PATH} AS path, {_SHORT_MAKE} AS content FROM part",
    "guard_proofs": f"WITH h AS (SELECT {HEAD} AS path, upper(regexp_replace(regexp_extract({HEAD}, '[^/]+$'), '[^A-Za-z0-9]', '_', 'g')) AS guard FROM part), n AS (SELECT 'P' || (p_partkey + 1000000) || '_H' AS guard FROM part WHERE p_size % 5 = 0) SELECT path, guard, CASE WHEN count(*) OVER (PARTITION BY guard) > 1 THEN 'duplicate' WHEN guard IN (SELECT guard FROM n) THEN 'shared' ELSE 'unique' END AS status FROM h",
    "c_guards": f"WITH h AS (SELECT *, {GUARDED} AS code, {GUARD} AS guard, {BODY} AS body FROM part) SELECT p_partkey, p_size % 4 = 1 AS guarded, CASE p_size % 4 WHEN 1 THEN code WHEN 2 THEN replace(code, 'OLD_H', guard) ELSE '#ifndef ' || guard || chr(10) || '# define ' || guard || chr(10) || chr(10) || rtrim(code, chr(10)) || chr(10) || chr(10) || '#endif' || chr(10) END AS content, true AS after FROM h",
    "c_include_blocks": f"SELECT {_K} AS path, 1::BIGINT AS first, (CASE p_size % 3 WHEN 0 THEN 3 ELSE 2 END)::BIGINT AS last, false AS sorted FROM part UNION ALL SELECT {_K}, CASE p_size % 3 WHEN 0 THEN 5 ELSE 4 END, CASE p_size % 3 WHEN 0 THEN 6 ELSE 5 END, p_size % 2 = 1 FROM part",
    "c_sorted_includes": f"""WITH t AS (SELECT {_K} AS path, list_filter([CASE WHEN p_size % 3 = 0 THEN '#include <stdio.h>' END, '#include "A.h"', '#include "b.h"', 'int a' || p_partkey || ';', '#include <x.h>', CASE WHEN p_size % 2 = 0 THEN '#include <y.h>' ELSE '#include <x.h>' END, ''], lambda x: x IS NOT NULL) AS t FROM part) SELECT path, unnest(t) AS text, unnest(range(1, len(t) + 1)) AS line FROM t""",
    "refused_requests": "SELECT p_partkey AS request_id, CASE p_size % 6 WHEN 5 THEN 'p' || p_partkey || '.c' END AS path, CASE p_size % 6 WHEN 0 THEN 'not a request' WHEN 2 THEN 'a path is given twice' WHEN 1 THEN 'a path is not allowed' WHEN 3 THEN 'a path is not allowed' END AS failure FROM part",
    "granted_plans": f"SELECT {_K} AS path FROM part WHERE p_size % 4 <> 2",
    "refused_approvals": "SELECT CASE WHEN count(*) FILTER (WHERE doc_id % 10 = 7) > 0 THEN 0 ELSE count(*) END AS n, count(*) AS n_asked FROM documents",
    "identities": f"SELECT c_custkey AS who, CASE c_custkey % 12 WHEN 1 THEN 'c' || c_custkey WHEN 7 THEN 'c' || c_custkey WHEN 5 THEN 'c' || c_custkey WHEN 11 THEN 'c' || c_custkey WHEN 4 THEN 'z' || c_custkey END AS login, CASE c_custkey % 12 WHEN 1 THEN 'c' || c_custkey || '@student.42town.fr' WHEN 7 THEN 'c' || c_custkey || '@student.42town.fr' WHEN 5 THEN 'c' || c_custkey || '@42.fr' WHEN 11 THEN 'c' || c_custkey || '@42.fr' WHEN 4 THEN 'z' || c_custkey || '@42.fr' END AS email, CASE c_custkey % 6 WHEN 0 THEN 'IDENTITY_UNAVAILABLE' WHEN 2 THEN 'IDENTITY_INVALID_EMAIL' WHEN 3 THEN 'IDENTITY_LOGIN_MISMATCH' WHEN 4 THEN CASE WHEN c_custkey % 12 = 4 THEN NULL ELSE 'IDENTITY_UNAVAILABLE' END END AS problem FROM customer",
    "run_clock": "SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN strftime(make_timestamp(p_partkey * 86413 * 1000000), '%Y/%m/%d %H:%M:%S') END AS stamp FROM part",
    "protected_scopes": "SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 'root' WHEN 1 THEN 'system' WHEN 2 THEN 'broad' WHEN 3 THEN 'home' WHEN 5 THEN 'broad' WHEN 7 THEN 'system' WHEN 8 THEN 'system' WHEN 9 THEN 'broad' ELSE 'none' END AS reason FROM part",
    "policy_allowed": f"SELECT {_K} AS path, unnest(['f' || p_size, 'write']) AS name FROM part",
    "trace_dedup": f"WITH t AS ({TRACE}), k AS (SELECT * FROM t WHERE tag IS NOT NULL OR (path, place, message) NOT IN (SELECT path, place, message FROM t WHERE tag IS NOT NULL)) SELECT path, tag IS NULL AS untagged, count(*) AS n, sum(place)::BIGINT AS places FROM k GROUP BY ALL",
    "official_merge": f"WITH n AS ({NATIVE}), o AS ({OFFICIAL}), a AS (SELECT *, CASE WHEN (path, rule_id, place) IN (SELECT path, rule_id, place FROM o) THEN 'official' ELSE 'native' END AS source FROM n UNION ALL SELECT *, 'official' FROM o WHERE (path, rule_id, place) NOT IN (SELECT path, rule_id, place FROM n)) SELECT path, rule_id, source, count(*) AS n, sum(place)::BIGINT AS places FROM a GROUP BY ALL",
    "range_lookup": f"WITH s AS ({SPANS}), f AS (SELECT path, a, b, min(value) AS value FROM s WHERE flag = 'R' GROUP BY ALL) SELECT s.path, s.a AS first, s.b AS last, f.value FROM s LEFT JOIN f ON s.path = f.path AND s.a = f.a AND s.b = f.b",
    "deleted_ranges": f"SELECT {_K} AS path, 'int b;' || chr(10) || (CASE WHEN p_partkey % 10 = 1 THEN '' ELSE 'int c;' || chr(10) || chr(10) END) || 'int d;' || chr(10) || {BODY} AS content, 'applied' AS status FROM part",
    "archive": f"{D} SELECT right(path, 1) AS project, path, strlen(content)::BIGINT AS bytes, md5(content) AS md5 FROM d",
    "total_order": f"{DIAG} SELECT row_number() OVER (ORDER BY path, line, CASE severity WHEN 'error' THEN 0 ELSE 1 END, rule_id) AS ordinal, path, line, severity, rule_id FROM g",
}
