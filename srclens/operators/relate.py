"""Joins, merges and closures between tables of ranges, diagnostics and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .closures import reachable
from .scans import Save, running


def official_merge(native: DataFrame, official: DataFrame, keys: tuple[str, ...] = ("path", "rule_id", "start")) -> DataFrame:
    """Native rows that an official one confirms are relabelled; official rows without a native one are added."""
    met = official.select(*keys).distinct().withColumn("met", F.lit(True))
    own = native.join(met, list(keys), "left").withColumn("source", F.when(F.col("met"), "official").otherwise("native")).drop("met")
    return own.unionByName(official.join(native.select(*keys).distinct(), list(keys), "left_anti").withColumn("source", F.lit("official")))


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rule_id, n_before, n_after) of rules with more rows after than before."""
    b, a = (d.groupBy("rule_id").agg(F.count("*").alias(n)) for d, n in ((before, "n_before"), (after, "n_after")))
    out = a.join(b, "rule_id", "left").select("rule_id", F.coalesce("n_before", F.lit(0)).alias("n_before"), "n_after")
    return out.where("n_after > n_before")


def multiset_difference(after: DataFrame, before: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of after whose ordinal among equal keys exceeds how many before has."""
    n = before.groupBy(*keys).agg(F.count("*").alias("n_before"))
    ranked = after.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(n, keys, "left").where(F.col("ordinal") > F.coalesce("n_before", F.lit(0))).drop("n_before", "ordinal")


def latest_before(points: DataFrame, marks: DataFrame, by: list[str], at: str, mark_at: str, save: Save, out: str = "latest") -> DataFrame:
    """points with the largest mark strictly before them: an as-of join as one sorted pass over both, a key of any size over many tasks."""
    kind = marks.schema[mark_at].dataType
    asks = points.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_is_mark"), F.lit(None).cast(kind).alias("_mark")).distinct()
    told = marks.select(*by, F.col(mark_at).alias("_at"), F.lit(1).alias("_is_mark"), F.col(mark_at).alias("_mark")).where("_mark is not null").distinct()
    # at equal places the point comes first: a mark there is not before it
    seen = running(asks.unionByName(told), by, ["_at", "_is_mark"], save, lasts={out: "_mark"})
    got = seen.where("_is_mark = 0").select(*by, F.col("_at").alias(at), out)
    return points.join(got, [*by, at], "left")


def merge_ranges(ranges: DataFrame, save: Save) -> DataFrame:
    """(path, start, end): ranges that overlap or touch become one.

    Equal ranges are taken once: only the first of them could begin a part, and
    a second pass over the same rows may put another one first.
    """
    ahead = running(ranges.select("path", "start", "end").distinct(), ["path"], ["start", "end"], save, maxima={"ahead": "end"}, own=False)
    fresh = ahead.withColumn("fresh", F.when(F.col("ahead").isNull() | (F.col("start") > F.col("ahead")), 1).otherwise(0))
    parts = running(fresh.drop("ahead"), ["path"], ["start", "end"], save, sums={"part": "fresh"})
    return parts.groupBy("path", "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def edit_conflicts(edits: DataFrame, save: Save) -> DataFrame:
    """Edits (path, start, end) that overlap one before them in (start, end) order, or insert at the same place."""
    seen = running(edits, ["path"], ["start", "end"], save, maxima={"behind": "end", "latest": "start"}, own=False)
    clash = (F.col("start") < F.col("behind")) | ((F.col("start") == F.col("latest")) & (F.col("start") == F.col("end")))
    return seen.where(clash).drop("behind", "latest")


def remap(offsets: DataFrame, edits: DataFrame, save: Save) -> DataFrame:
    """offsets (path, offset) with ``new``: where they stand once the edits (path, start, end, replacement) before them are made.

    A sum over the edits before each offset, in two levels: inside the pieces
    of a path, and over the pieces.  A null replacement deletes.
    """
    size = F.coalesce(F.octet_length("replacement"), F.lit(0))
    shift = edits.groupBy("path", F.col("end").cast("long").alias("at")).agg(F.sum(size - (F.col("end") - F.col("start"))).cast("long").alias("delta"))
    asked = offsets.select("path", F.col("offset").cast("long").alias("at")).distinct().withColumns({"delta": F.lit(0).cast("long"), "asks": F.lit(1)})
    moved = running(asked.unionByName(shift.withColumn("asks", F.lit(0))), ["path"], ["at", "asks"], save, sums={"moved": "delta"})
    return moved.where("asks = 1").select("path", F.col("at").alias("offset"), (F.col("at") + F.col("moved")).alias("new"))


def dead_statics(functions: DataFrame, references: DataFrame, save, blocked: DataFrame | None = None) -> DataFrame:
    """(path, name) of static definitions that no root reaches.

    functions: (path, name, is_static).  references: (path, src, dst), src the
    function that holds the reference, null outside of any.  Roots are the
    functions that are not static and what is named outside of functions.
    blocked: (path), files in which nothing can be proved.
    """
    node = lambda p, n: F.concat_ws("\x00", p, n)
    f = functions.select("path", "name", "is_static", node("path", "name").alias("node"))
    outside = references.where("src is null").select(node("path", "dst").alias("node"))
    roots = f.where(~F.col("is_static")).select("node").unionByName(outside)
    edges = references.where("src is not null").select(node("path", "src").alias("src"), node("path", "dst").alias("dst")).distinct()
    dead = f.where("is_static").join(reachable(roots, edges, save), "node", "left_anti")
    dead = dead if blocked is None else dead.join(blocked, "path", "left_anti")
    return dead.select("path", "name")


def trace_dedup(rows: DataFrame) -> DataFrame:
    """Rows without a tag go where a tagged one has the same start and message."""
    tagged = rows.where("tag is not null").select("path", "start", "message").distinct()
    return rows.where("tag is not null").unionByName(rows.where("tag is null").join(tagged, ["path", "start", "message"], "left_anti"))
