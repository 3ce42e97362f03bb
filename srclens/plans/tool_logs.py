"""Queries over logs of outside tools, rendered from the events table by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import project_rules
from ..sources import logs
from ..tables import saver
from .queries import longs

_SIZE = "CASE WHEN event_id >= 1000 THEN concat(cast(cast(floor(event_id / 1000) AS bigint) AS varchar(20)), ',', lpad(cast(event_id % 1000 AS varchar(20)), 3, '0')) ELSE cast(event_id AS varchar(20)) END"
_FRAME = "concat('==7==    by 0x10', cast(event_id % 9 AS varchar(20)), ': f', cast(event_id % 9 AS varchar(20)), ' (file', cast(user_id % 5 AS varchar(20)), '.c', CASE WHEN event_id % 7 = 0 THEN '' ELSE concat(':', cast(event_id % 200 + 1 AS varchar(20))) END, ')')"
#: A run's log: each event is one record of five or six lines; every fourth ends before its own frame.
RUN = "concat('run', cast(user_id % 3 AS varchar(20)))"
RECORD = f"""concat('==7== ', CASE event_type WHEN 'purchase' THEN concat({_SIZE}, ' bytes in 1 blocks are definitely lost in loss record 1 of 2')
  WHEN 'click' THEN concat({_SIZE}, ' (8 direct, ', {_SIZE}, ' indirect) bytes in 2 blocks are possibly lost in loss record 2 of 2') WHEN 'error' THEN 'Invalid read of size 4'
  WHEN 'signup' THEN 'Conditional jump or move depends on uninitialised value(s)' ELSE '99 bytes in 1 blocks are still reachable in loss record 3 of 3' END, chr(10),
  '==7==    at 0x4848899: malloc (in /usr/lib/vg.so)', chr(10), CASE WHEN event_id % 4 = 0 THEN concat('==7== ', chr(10)) ELSE '' END, {_FRAME}, chr(10), '==7== ')"""
#: A checked file's log.
CHECKED = "concat('u', cast(user_id AS varchar(20)), '.c')"
CHECK = """concat(CASE event_type WHEN 'error' THEN 'Error' ELSE 'Notice' END, ': RULE_', cast(event_id % 5 AS varchar(20)), '   (line:', lpad(cast(event_id % 900 AS varchar(20)), 4, ' '), ', col:   4):', chr(9), 'message ', event_type)"""
VERDICT = f"CASE user_id % 4 WHEN 0 THEN concat({CHECKED}, ': OK!') WHEN 1 THEN concat({CHECKED}, ': Error!') WHEN 2 THEN 'Traceback (most recent call last):' ELSE '' END"
#: A compiled file's log.
COMPILED = "concat('src/u', cast(user_id AS varchar(20)), '.c')"
_AT = "concat(':', cast(event_id % 99 + 1 AS varchar(20)), ':', cast(user_id % 9 + 1 AS varchar(20)), ': ')"
COMPILE = f"""CASE event_type WHEN 'purchase' THEN concat({COMPILED}, {_AT}, 'warning: unused variable [-Wunused-variable]') WHEN 'error' THEN concat('./', {COMPILED}, {_AT}, 'fatal error: lost')
  WHEN 'click' THEN concat({COMPILED}, {_AT}, 'note: here') WHEN 'signup' THEN concat('inc/x.h', {_AT}, 'error: do not use this [bugprone-branch-clone]') ELSE concat({COMPILED}, {_AT}, 'warning: leak [-Wanalyzer-malloc-leak]') END"""


def _lines(spark: SparkSession, d: str, path: str, text: str, where: str = "true") -> DataFrame:
    """The lines of what is said of each event, in the order of events."""
    made = spark.read.parquet(f"{d}/events.parquet").where(where).select(F.expr(path).alias("path"), "event_id", F.posexplode(F.split(F.expr(text), "\n", -1)).alias("nth", "line"))
    return made.select("path", (F.col("event_id") * 8 + F.col("nth")).alias("at"), "line")


def _checked(spark: SparkSession, d: str) -> DataFrame:
    users = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    last = users.select(F.expr(CHECKED).alias("path"), (F.col("event_id") * 8 + 7).alias("at"), F.expr(VERDICT).alias("line"))
    return _lines(spark, d, CHECKED, CHECK, "event_type in ('error', 'click')").unionByName(last)


def q_leak_records(spark, d):
    found = logs.leaks(_lines(spark, d, RUN, RECORD), saver(spark))
    return longs(found, "record", "line").select("path", "record", "bytes", "indirect", "function", "file", "line")


def q_memory_errors(spark, d):
    return longs(logs.memory_errors(_lines(spark, d, RUN, RECORD), saver(spark)), "record", "line").select("path", "record", "what", "function", "file", "line")


def q_leak_diagnostics(spark, d):
    lines = _lines(spark, d, RUN, RECORD)
    rows = project_rules.leak_rows(logs.leaks(lines, saver(spark)), logs.memory_errors(lines, saver(spark)))
    return rows.groupBy("path", "rule_id", "severity").agg(F.count("*").alias("n"), F.sum(F.col("line").cast("long")).alias("lines"))


def q_checker_log(spark, d):
    return logs.checker(_checked(spark, d))[1]


def q_checker_rows(spark, d):
    return longs(logs.checker(_checked(spark, d))[0], "line", "column").select("path", "advisory", "line", F.col("column").alias("col"), "rule_id", "message")


def q_compiler_log(spark, d):
    return longs(logs.compiler(_lines(spark, d, COMPILED, COMPILE)), "line", "column").select("path", "line", F.col("column").alias("col"), "severity", "rule_id", "message")


QUERIES = {k.removeprefix("q_"): v for k, v in list(globals().items()) if k.startswith("q_")}
_LOSS = f"l AS (SELECT {RUN} AS path, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS record, event_id AS bytes, CASE event_type WHEN 'click' THEN event_id ELSE 0 END AS indirect, CASE WHEN event_id % 4 > 0 THEN 'f' || event_id % 9 END AS function, CASE WHEN event_id % 4 > 0 THEN 'file' || user_id % 5 || '.c' END AS file, CASE WHEN event_id % 4 > 0 AND event_id % 7 > 0 THEN event_id % 200 + 1 END AS line FROM events WHERE event_type IN ('purchase', 'click'))"
_BAD = f"m AS (SELECT {RUN} AS path, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS record, CASE event_type WHEN 'error' THEN 'Invalid read of size 4' ELSE 'Conditional jump or move depends on uninitialised value(s)' END AS what, CASE WHEN placed THEN 'f' || event_id % 9 END AS function, CASE WHEN placed THEN 'file' || user_id % 5 || '.c' END AS file, CASE WHEN placed THEN event_id % 200 + 1 END AS line FROM (SELECT *, event_id % 4 > 0 AND event_id % 7 > 0 AS placed FROM events) WHERE event_type IN ('error', 'signup'))"
ORACLE = {
    "leak_records": f"WITH {_LOSS} SELECT * FROM l",
    "memory_errors": f"WITH {_BAD} SELECT * FROM m",
    "leak_diagnostics": f"WITH {_LOSS}, {_BAD}, a AS (SELECT coalesce(file, path) AS path, 'MEMORY_LEAK' AS rule_id, 'error' AS severity, line FROM l UNION ALL SELECT coalesce(file, path), 'MEMORY_ERROR', 'error', line FROM m) SELECT path, rule_id, severity, count(*) AS n, sum(coalesce(line, 0))::BIGINT AS lines FROM a GROUP BY ALL",
    "checker_log": f"SELECT {CHECKED} AS path, CASE WHEN user_id % 4 > 1 THEN 'failure' WHEN bool_or(event_type = 'error') THEN 'findings' ELSE 'clean' END AS status FROM events GROUP BY user_id",
    "checker_rows": f"SELECT {CHECKED} AS path, event_type = 'click' AS advisory, event_id % 900 AS line, 4::BIGINT AS col, 'RULE_' || event_id % 5 AS rule_id, 'message ' || event_type AS message FROM events WHERE event_type IN ('error', 'click')",
    "compiler_log": f"SELECT {COMPILED} AS path, CASE event_type WHEN 'signup' THEN 0 ELSE event_id % 99 + 1 END AS line, CASE event_type WHEN 'signup' THEN 0 ELSE user_id % 9 + 1 END AS col, CASE WHEN event_type IN ('error', 'signup') THEN 'error' ELSE 'warning' END AS severity, CASE event_type WHEN 'purchase' THEN 'CC_UNUSED_VARIABLE' WHEN 'error' THEN 'CC_STRICT' WHEN 'signup' THEN 'TIDY_BUGPRONE_BRANCH_CLONE' ELSE 'CC_ANALYZER_MALLOC_LEAK' END AS rule_id, CASE event_type WHEN 'purchase' THEN 'unused variable' WHEN 'error' THEN 'lost' WHEN 'signup' THEN 'do not use this' ELSE 'leak' END AS message FROM events WHERE event_type <> 'click'",
}
