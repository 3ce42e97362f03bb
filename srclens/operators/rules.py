"""Rules over C facts, within a file and over a project.  Each returns diagnostics (path, line, severity, rule_id, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .facts import functions, locals_, view
from .lines import diagnostics

PREFIX = {"struct": "s_", "union": "u_", "enum": "e_"}


def function_limits(rows: DataFrame, lines: int = 25, parameters: int = 4, variables: int = 5) -> DataFrame:
    own = functions(rows).where("kind = 'definition'")
    n = locals_(rows).groupBy("path", "function").agg(F.count("*").alias("variables")).withColumnRenamed("function", "name")
    own = own.join(n, ["path", "name"], "left")
    parts = [("TOO_MANY_LINES", "body_lines", lines), ("TOO_MANY_ARGS", "parameter_count", parameters), ("TOO_MANY_VARS_FUNC", "variables", variables)]
    return reduce(DataFrame.unionByName, [diagnostics(own.where(F.col(c) > most), rule, "error", F.concat("name", F.lit(": "), F.col(c).cast("string"), F.lit(f" > {most}"))) for rule, c, most in parts])


def too_many_functions(rows: DataFrame, most: int = 5) -> DataFrame:
    w = Window.partitionBy("path").orderBy("start")
    return diagnostics(functions(rows).where("kind = 'definition'").withColumn("k", F.row_number().over(w)).where(F.col("k") == most + 1), "TOO_MANY_FUNCS", "error", F.col("name"))


def late_declarations(rows: DataFrame) -> DataFrame:
    return diagnostics(locals_(rows).where(~F.col("initial")), "WRONG_SCOPE_VAR", "error", F.col("name"))


def tag_names(rows: DataFrame) -> DataFrame:
    wrong = reduce(lambda a, b: a | b, [(F.col("owner") == k) & ~F.col("name").startswith(p) for k, p in PREFIX.items()])
    return diagnostics(view(rows, "tag").where(wrong), "TAG_PREFIX", "error", F.concat_ws(" ", "owner", "name"))


def endless_loops(rows: DataFrame) -> DataFrame:
    return diagnostics(view(rows, "loop").where((F.col("n") == 1) & ~F.col("flag")), "POSSIBLE_INFINITE_LOOP", "warning", F.col("owner"))


def external_calls(rows: DataFrame) -> DataFrame:
    """(path, name, line, start) of calls that nothing in the file explains; a file that pastes tokens or is unsafe gives none."""
    calls = view(rows, "call").select("path", "name", F.col("owner").alias("function"), "line", "start")
    pasted = view(rows, "macro").where(F.col("text").contains("##")).select("path").union(view(rows, "unsafe").select("path")).distinct()
    known = view(rows, "macro").select("path", "name").union(functions(rows).where("kind = 'definition'").select("path", "name")).distinct()
    params = view(rows, "parameter").select("path", "name", F.col("owner").alias("function")).distinct()
    seen = locals_(rows).select("path", "name", "function", "scope_start", "scope_end")
    inside = calls.join(seen, ["path", "name", "function"]).where("start >= scope_start AND start < scope_end").select("path", "start").distinct()
    out = calls.join(pasted, "path", "left_anti").join(known, ["path", "name"], "left_anti").join(params, ["path", "name", "function"], "left_anti")
    return out.join(inside, ["path", "start"], "left_anti").select("path", "name", "line", "start")


def not_allowed(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """Calls of what neither the project defines nor the policy allows; nothing at all if any file is unsafe."""
    public = functions(rows).where("kind = 'definition' AND NOT is_static").select("name").distinct()
    bad = external_calls(rows).join(public, "name", "left_anti").join(allowed.select("name"), "name", "left_anti")
    gate = view(rows, "unsafe").agg((F.count("*") == 0).alias("complete"))
    return diagnostics(bad.crossJoin(F.broadcast(gate)).where("complete"), "FUNCTION_NOT_ALLOWED", "error", F.col("name"))  # the gate is one row


def orphan_prototypes(rows: DataFrame) -> DataFrame:
    """Prototypes of headers that no file defines; nothing at all if any file is unsafe."""
    public = functions(rows).where("kind = 'definition' AND NOT is_static").select("name").distinct()
    heads = functions(rows).where("kind = 'prototype' AND NOT is_static").where(F.col("path").endswith(".h"))
    gate = view(rows, "unsafe").agg((F.count("*") == 0).alias("complete"))
    return diagnostics(heads.join(public, "name", "left_anti").crossJoin(F.broadcast(gate)).where("complete"), "ORPHAN_PROTOTYPE", "warning", F.col("name"))  # the gate is one row


def empty_implementations(rows: DataFrame) -> DataFrame:
    """One row for each pair of a header's prototype and an empty definition of its name."""
    heads = functions(rows).where("kind = 'prototype'").where(F.col("path").endswith(".h")).select("name").withColumn("declared", F.lit(True))
    return diagnostics(view(rows, "empty").select("path", "line", "name").join(heads, "name"), "EMPTY_IMPLEMENTATION", "warning", F.col("name"))


def references(rows: DataFrame) -> DataFrame:
    """(path, src, dst) for ``relate.dead_statics``."""
    return view(rows, "reference").select("path", F.col("owner").alias("src"), F.col("name").alias("dst")).distinct()


def blocked(rows: DataFrame) -> DataFrame:
    """(path) of files in which no function can be proved dead: unsafe, token pasting, conditional compilation."""
    pasted = view(rows, "macro").where(F.col("text").contains("##")).select("path")
    conditional = view(rows, "directive").where(F.col("name").isin("if", "ifdef", "ifndef")).select("path")
    return view(rows, "unsafe").select("path").union(pasted).union(conditional).distinct()
