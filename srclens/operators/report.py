"""Aggregates over diagnostics: groups, top-k, status, summary, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import Save, running

#: Severities in rising order.
SEVERITY = {"error": 0, "warning": 1, "info": 2}
#: Fixed values: (weight, cap) of what lowers a score.
SCORE = {"n_error": (8, 45), "n_failed": (8, 30), "n_warning": (5, 25), "n_info": (2, 20), "n_blocked": (10, 30), "n_changed": (1, 10)}
GRADES = [(90, "A"), (80, "B"), (70, "C"), (60, "D"), (0, "F")]


def rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, k in SEVERITY.items():
        out = F.when(severity == name, k).otherwise(out)
    return out


#: What orders or groups diagnostics as well, where they have it.
MORE = ("source", "notes", "help")


def total_order(diagnostics: DataFrame | None = None) -> list:
    """The order of diagnostics; with their table also by those of ``MORE`` that it has."""
    more = [c for c in MORE if diagnostics is not None and c in diagnostics.columns]
    return ["path", "start", "end", rank(F.col("severity")), "rule_id", "message", *more]


def numbered(rows: DataFrame, save: Save) -> DataFrame:
    """rows with ``ordinal``: their place in the total order, counted over all tasks."""
    order = {f"key{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(total_order(rows))}
    keys, keyed = list(order), rows.withColumns(order | {"one": F.lit(1)})
    return running(keyed, [], keys, save, sums={"ordinal": "one"}).drop("one", *keys)


def by_rule(diagnostics: DataFrame) -> DataFrame:
    """Groups of a severity and rule, and of source and help where the rows have them."""
    more = [c for c in ("source", "help") if c in diagnostics.columns]
    return diagnostics.groupBy("severity", "rule_id", *more).agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"))


def first_of_each(diagnostics: DataFrame, k: int = 3) -> DataFrame:
    """The first k rows of each (severity, rule) in (path, line, message) order, with their ordinal."""
    w = Window.partitionBy("severity", "rule_id").orderBy("path", "line", "message")
    return diagnostics.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= k)


def distinct(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.dropDuplicates()


def file_status(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(path, status): files (path, failure, changed); failed before findings before changed before clean; info alone is an advisory."""
    worst = diagnostics.groupBy("path").agg(F.bool_or(F.col("severity") != "info").alias("findings"), F.count("*").alias("n"))
    status = F.when(F.col("failure").isNotNull(), "failed").when(F.col("findings"), "findings").when(F.col("changed"), "changed").when(F.col("n") > 0, "advisory").otherwise("clean")
    return files.join(worst, "path", "left").select("path", status.alias("status"))


def summary(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row of counters, also over no rows; fixes (rule to number) are counted where files have them."""
    fixes = [F.coalesce(F.sum(F.aggregate(F.map_values("fixes"), F.lit(0).cast("long"), lambda a, n: a + n)), F.lit(0)).alias("n_fixes")] if "fixes" in files.columns else []
    f = files.agg(*fixes, F.count("*").alias("n_files"), F.count_if(F.col("failure").isNotNull()).alias("n_failed"), F.count_if(F.coalesce("changed", F.lit(False))).alias("n_changed"))
    d = diagnostics.agg(*(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITY), F.countDistinct("path").alias("n_with_findings"))
    return f.crossJoin(d)  # one row each


def exit_code(counts: DataFrame) -> DataFrame:
    return counts.withColumn("exit_code", F.when(F.col("n_failed") > 0, 2).when(F.col("n_error") + F.col("n_warning") > 0, 1).otherwise(0))


def score(counts: DataFrame) -> DataFrame:
    """counts: one row with the columns of SCORE and n_files, hard_fail.  Adds score and grade; no files is INCOMPLETE with 0."""
    lost = sum((F.least(F.col(c) * w, F.lit(cap)) for c, (w, cap) in SCORE.items()), F.lit(0))
    raw = F.greatest(100 - lost, F.lit(0))
    value = F.when(F.col("n_files") == 0, 0).when(F.col("hard_fail"), F.least(raw, F.lit(59))).otherwise(raw)
    grade = F.lit("F")
    for least, name in reversed(GRADES):
        grade = F.when(value >= least, name).otherwise(grade)
    return counts.withColumns({"score": value.cast("int"), "grade": F.when(F.col("n_files") == 0, "INCOMPLETE").otherwise(grade)})


def budgets(functions: DataFrame, locals_: DataFrame, limits: tuple[int, int, int] = (25, 5, 4)) -> DataFrame:
    """(path, function, lines, variables, parameters and what is left of each)."""
    n = locals_.groupBy("path", "function").agg(F.count("*").alias("variables"))
    out = functions.where("kind = 'definition'").join(n.withColumnRenamed("function", "name"), ["path", "name"], "left")
    used = {"lines": F.col("body_lines"), "variables": F.coalesce("variables", F.lit(0)), "parameters": F.col("parameter_count")}
    cols = [c for (k, v), most in zip(used.items(), limits, strict=True) for c in (v.alias(k), F.greatest(F.lit(0), most - v).alias(f"{k}_left"))]
    return out.select("path", F.col("name").alias("function"), *cols)


def report_json(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(path, report): one JSON document a file, its rows sorted."""
    rows = diagnostics.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "severity", "rule_id", "message"))).alias("diagnostics"))
    out = files.join(rows, "path", "left")
    empty = F.array().cast(rows.schema["diagnostics"].dataType)
    return out.select("path", F.to_json(F.struct(F.lit(2).alias("schema"), "path", "changed", "failure", F.coalesce("diagnostics", empty).alias("diagnostics"))).alias("report"))
