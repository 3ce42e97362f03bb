"""Captured logs of external tools as rows.  Nothing is run; an unknown line is a failure, never a clean result.

A log is lines (path, at, line) that ``at`` puts in order: of texts held in rows
(``numbered``), or of files of any size (``read``), whose splits are read side
by side.  A record is a head line and those behind it; which record a line
belongs to is carried over the borders of pieces, so no task reads a whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import Save, running

CHECK = r"^(Error|Notice): ([A-Z0-9_]+)\s+\(line:\s*(\d+), col:\s*(\d+)\):\s*(.*)$"
COMPILER = r"^([^:\n]+):(\d+):(\d+): (warning|error|fatal error|note): (.*?)(?: \[(-W[^\]]+|[a-z]+(?:[-.][A-Za-z0-9.-]+)+)\])?$"
LOSS = r"^==\d+== ([\d,]+)(?: \(([\d,]+) direct, ([\d,]+) indirect\))? bytes in ([\d,]+) blocks are (definitely|indirectly|possibly) lost"
FRAME = r"^==\d+==\s+(?:at|by) 0x[0-9A-F]+: ([^ ]+) \(([^:)]+)(?::(\d+))?\)"
#: What begins a memory error.
MEMORY = r"^==\d+== (Invalid (?:read|write) of size \d+|Conditional jump or move depends on uninitialised value\(s\)|Use of uninitialised value of size \d+|Invalid free\(\).*|Mismatched free\(\).*|Source and destination overlap in .*|Syscall param .* (?:points to|contains) .*)$"
MISSING = r"fatal error: .*(?:No such file or directory|file not found)"
INTERNAL = ("malloc", "calloc", "realloc", "free", "memalign", "strdup", "operator new")


def numbered(logs: DataFrame, text: str = "output") -> DataFrame:
    """Lines (path, at, line) of logs (path, output); at counts them."""
    return logs.select("path", F.posexplode(F.split(text, "\n", -1)).alias("at", "line")).withColumn("at", F.col("at").cast("long"))


def read(spark: SparkSession, path: str, save: Save) -> DataFrame:
    """Lines (path, at, line) of the log files below a path; at is the byte where a line begins."""
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), (F.octet_length("value") + 1).cast("long").alias("size"), F.col("value").alias("line"))
    begun = running(rows, ["path"], ["block", "row"], save, sums={"at": "size"}, own=False)
    return begun.select("path", F.coalesce("at", F.lit(0)).cast("long").alias("at"), "line")


def in_records(lines: DataFrame, head: str, save: Save) -> DataFrame:
    """Lines with ``is_head`` and ``record``: how many heads stand up to them; what is before the first is left out."""
    marked = lines.withColumn("is_head", F.col("line").rlike(head).cast("int"))
    return running(marked, ["path"], ["at"], save, sums={"record": "is_head"}).where("record > 0")


def checker(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Diagnostics (path, advisory, line, column, rule_id, message), and (path, status) with status clean, findings or failure."""
    rows = lines.where(F.trim("line") != "").select("path", "line")
    g = lambda k: F.regexp_extract("line", CHECK, k)
    hit = F.col("line").rlike(CHECK)
    found = rows.where(hit).select("path", (g(1) == "Notice").alias("advisory"), g(3).cast("int").alias("place"), g(4).cast("int").alias("column"), g(2).alias("rule_id"), g(5).alias("message")).withColumnRenamed("place", "line")
    verdict = F.col("line").rlike(r"^[^:]+: (OK|Error)!$")
    said = F.trim("line") != ""
    state = lines.groupBy("path").agg(F.bool_or(said & ~hit & ~verdict).alias("unknown"), F.bool_or(hit & (g(1) == "Error")).alias("errors"), F.bool_or(verdict).alias("verdict"))
    status = F.when(F.col("unknown") | ~F.col("verdict"), "failure").when(F.col("errors"), "findings").otherwise("clean")
    return found, state.select("path", status.alias("status"))


def compiler(lines: DataFrame) -> DataFrame:
    """(path, line, column, severity, rule_id, message); what is said of another file gets line 0; notes go."""
    g = lambda k: F.regexp_extract("line", COMPILER, k)
    rows = lines.where(F.col("line").rlike(COMPILER)).where(g(4) != "note")
    own = F.concat(F.lit("/"), "path").endswith(F.concat(F.lit("/"), F.regexp_replace(g(1), r"^\./", "")))
    rule = F.when(g(6).startswith("-Wanalyzer"), F.concat(F.lit("CC_"), F.upper(F.translate(F.substring(g(6), 3, 200), "-", "_")))).when(g(6).startswith("-W"), F.concat(F.lit("CC_"), F.upper(F.translate(F.substring(g(6), 3, 200), "-", "_")))).when(g(6) != "", F.concat(F.lit("TIDY_"), F.upper(F.translate(g(6), "-.", "__")))).otherwise("CC_STRICT")
    at = lambda k: F.when(own, g(k).cast("int")).otherwise(0)
    return rows.select("path", at(2).alias("at"), at(3).alias("column"), F.when(g(4) == "warning", "warning").otherwise("error").alias("severity"), rule.alias("rule_id"), g(5).alias("message")).withColumnRenamed("at", "line")


def _first_frames(rows: DataFrame, placed: bool = False) -> DataFrame:
    """(path, record, function, file, at): the first frame of each record outside the allocator, before the record's first blank line."""
    g = lambda k: F.regexp_extract("line", FRAME, k)
    frame = F.when(F.col("line").rlike(FRAME) & ~g(1).isin(*INTERNAL) & (~F.lit(placed) | (g(3) != "")), F.struct("at", g(1).alias("function"), g(2).alias("file"), g(3).try_cast("int").alias("line")))
    ended = F.min(F.when(F.col("line").rlike(r"^==\d+==\s*$"), F.col("at")))
    first = rows.groupBy("path", "record").agg(ended.alias("ended"), F.min(frame).alias("f"))
    return first.select("path", "record", F.when(F.col("ended").isNull() | (F.col("f.at") < F.col("ended")), F.col("f")).alias("f"))


def leaks(lines: DataFrame, save: Save) -> DataFrame:
    """(path, record, bytes, indirect, function, file, line): each loss record with its first frame outside the allocator."""
    number = lambda k: F.replace(F.regexp_extract("line", LOSS, k), F.lit(","), F.lit("")).try_cast("long")
    rows = in_records(lines, LOSS, save)
    sizes = rows.where("is_head = 1").select("path", "record", number(1).alias("bytes"), F.coalesce(number(3), F.lit(0)).alias("indirect"))
    return sizes.join(_first_frames(rows), ["path", "record"], "left").select("path", "record", "bytes", "indirect", "f.function", "f.file", F.col("f.line").alias("line"))


def compiler_report(logs: DataFrame, text: str = "output") -> DataFrame:
    """logs (path, output, exit_code): as ``compiler``, but a file whose includes are missing gives one advisory alone, and one that was refused without a line that can be read gives one row that says so."""
    known = compiler(numbered(logs, text))
    lacking = logs.where(F.col(text).rlike(MISSING)).select("path")
    row = lambda d, severity, rule, message: d.select("path", F.lit(0).alias("line"), F.lit(0).alias("column"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule_id"), F.lit(message).alias("message"))
    silent = logs.where("exit_code <> 0").select("path").join(known.select("path").distinct(), "path", "left_anti").join(lacking, "path", "left_anti")
    out = known.join(lacking, "path", "left_anti").select("path", "line", "column", "severity", "rule_id", "message")
    return out.unionByName(row(lacking, "info", "CC_CONFIGURATION_INCOMPLETE", "an include was not found")).unionByName(row(silent, "error", "CC_REJECTED", "refused without a reason that can be read"))


def memory_errors(lines: DataFrame, save: Save) -> DataFrame:
    """(path, what, function, file, line): each memory error with its first placed frame outside the allocator."""
    rows = in_records(lines, MEMORY, save)
    heads = rows.where("is_head = 1").select("path", "record", F.regexp_extract("line", MEMORY, 1).alias("what"))
    return heads.join(_first_frames(rows, placed=True), ["path", "record"], "left").select("path", "record", "what", "f.function", "f.file", F.col("f.line").alias("line"))
