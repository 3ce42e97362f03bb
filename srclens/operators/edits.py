"""Edit sets, approvals and plans over files: what may be written, and what is.

An edit is (path, start, end, replacement) in bytes of its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relate import merge_ranges
from .scans import Save


def applied(files: DataFrame, edits: DataFrame) -> DataFrame:
    """files (path, content) with ``status``: edits made from right to left, equal ones once.

    All edits of a file are refused (conflict) if two overlap, insert at one
    place, or one leaves the file; a file without edits is unchanged.
    """
    w = Window.partitionBy("path").orderBy("start", "end", "replacement")
    one = edits.select("path", "start", "end", F.coalesce("replacement", F.lit("")).alias("replacement")).distinct()
    clash = (F.lead("start").over(w) < F.col("end")) | ((F.lead("start").over(w) == F.col("start")) & (F.lead("end").over(w) == F.col("end")))
    bad = F.coalesce(clash, F.lit(False)) | (F.col("start") < 0) | (F.col("end") < F.col("start"))
    own = one.withColumn("bad", bad).groupBy("path").agg(F.bool_or("bad").alias("bad"), F.max("end").alias("last"), F.sort_array(F.collect_list(F.struct("start", "end", F.encode("replacement", "UTF-8").alias("new"))), asc=False).alias("edits"))
    data = F.encode("content", "UTF-8")
    make = lambda acc, e: F.concat(F.substring(acc, F.lit(1), e["start"].cast("int")), e["new"], F.substring(acc, (e["end"] + 1).cast("int"), F.octet_length(acc)))
    joined = files.join(own, "path", "left")
    status = F.when(F.col("edits").isNull(), "unchanged").when(F.col("bad") | (F.col("last") > F.octet_length("content")), "conflict").otherwise("applied")
    new = F.when(status == "applied", F.decode(F.aggregate("edits", data, make), "UTF-8")).otherwise(F.col("content"))
    return joined.select("path", new.alias("content"), status.alias("status"))


def approved(plans: DataFrame, approvals: DataFrame) -> DataFrame:
    """plans (path, original_hash, replacement_hash) that were approved with just these hashes; none at all if an approval has no plan."""
    keys = ["path", "original_hash", "replacement_hash"]
    unmet = approvals.select(*keys).join(plans.select(*keys), keys, "left_anti").agg((F.count("*") == 0).alias("all_met"))
    return plans.join(approvals.select(*keys).distinct(), keys, "left_semi").crossJoin(F.broadcast(unmet)).where("all_met").drop("all_met")  # one row


#: What a run may be allowed to take away.
GRANTS = ("remove_comments", "remove_unused", "delete_dead_statics", "delete_orphan_prototypes", "quarantine", "remove_missing_sources")


def granted(plans: DataFrame, grants: list[str]) -> DataFrame:
    """plans (.., capability) that need no grant or have it; an unknown grant is an error."""
    if unknown := set(grants) - set(GRANTS):
        raise ValueError(f"no such grant: {sorted(unknown)}")
    return plans.where(F.col("capability").isNull() | F.col("capability").isin(*grants))


def deletions(files: DataFrame, ranges: DataFrame, save: Save) -> DataFrame:
    """Edits that take whole lines: ranges (path, start, end) widened to the lines they touch, with one blank line behind them, and merged."""
    data = F.encode("content", "UTF-8")
    both = ranges.join(files.select("path", "content"), "path")
    before = F.decode(F.substring(data, F.lit(1), F.col("start").cast("int")), "UTF-8")
    behind = F.decode(F.substring(data, (F.col("end") + 1).cast("int"), F.octet_length("content")), "UTF-8")
    left = F.octet_length(before) - F.octet_length(F.regexp_extract(before, r"[^\n]*\z", 0))
    right = F.col("end") + F.octet_length(F.regexp_extract(behind, r"\A[^\n]*(?:\n(?:[ \t]*\n)?)?", 0))
    return merge_ranges(both.select("path", left.cast("long").alias("start"), right.cast("long").alias("end")), save).withColumn("replacement", F.lit(""))


def mentions(texts: DataFrame, names: DataFrame, identifiers) -> DataFrame:
    """(path, start, name): texts (path, start, text) that hold a name as a whole identifier, by an equality join on their identifiers."""
    words = texts.select("path", "start", F.explode(F.array_distinct(identifiers(F.col("text")))).alias("name"))
    return words.join(names.select("name").distinct(), "name").select("path", "start", "name")


def lookup(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left (path, start, end) with the first value of right at just the same range."""
    first = right.groupBy("path", "start", "end").agg(F.min(value).alias(value))
    return left.join(first, ["path", "start", "end"], "left")
