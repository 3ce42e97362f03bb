"""Makefiles as tables: logical lines, assignments, rules, source references, and their rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound, final_newline, normalize_eol, packed, remove_bom
from .lines import lines

ASSIGN = r"^\s*(?:export\s+|override\s+)*([A-Za-z0-9_.]+)\s*(:::=|::=|:=|\+=|\?=|!=|=)\s*(.*)$"
RULE = r"^([^\s#:=][^#:=]*?)\s*::?(?!=)(.*)$"
MANDATORY = ("all", "clean", "fclean", "re")
LIST = r"^([A-Za-z0-9_.]+)([ \t]*)(:::=|::=|:=|\+=|\?=|=)[ \t]*(.*)$"
SOURCES = r"(?i)^(SRCS?|SOURCES?|.*_SRCS?)$"


def logical(sources: DataFrame) -> DataFrame:
    """(path, line, text): lines joined over a backslash at their end, outside of define blocks."""
    rows = lines(sources)
    w = Window.partitionBy("path").orderBy("line")
    opens, closes = F.col("text").rlike(r"^\s*define\b"), F.col("text").rlike(r"^\s*endef\b")
    depth = F.sum(opens.cast("int") - closes.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("inside", (depth > 0) | closes)
    starts = ~F.coalesce(F.lag("text").over(w).endswith("\\"), F.lit(False))
    rows = rows.withColumn("group", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("inside"))
    part = F.when(F.col("text").endswith("\\"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    joined = rows.groupBy("path", "group").agg(F.min("line").alias("line"), F.sort_array(F.collect_list(F.struct("line", part.alias("part")))).alias("parts"))
    return joined.select("path", "line", F.array_join(F.transform("parts", lambda p: p.part), " ").alias("text"))


def assignments(rows: DataFrame) -> DataFrame:
    """rows of ``logical``: (path, line, name, op, value)."""
    g = lambda k: F.regexp_extract("text", ASSIGN, k)
    value = F.trim(F.regexp_replace(F.regexp_replace(g(3), r"(?<!\\)#.*$", ""), r"\s+", " "))
    return rows.where(F.col("text").rlike(ASSIGN) & ~F.col("text").startswith("\t")).select("path", "line", g(1).alias("name"), g(2).alias("op"), value.alias("value"))


def targets(rows: DataFrame) -> DataFrame:
    """(path, line, target)"""
    hit = F.col("text").rlike(RULE) & ~F.col("text").startswith("\t") & ~F.col("text").rlike(ASSIGN)
    return rows.where(hit).select("path", "line", F.explode(F.split(F.trim(F.regexp_extract("text", RULE, 1)), r"\s+")).alias("target"))


def missing_targets(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """(path, target): the mandatory targets that a Makefile has not."""
    has = targets(rows).groupBy("path").agg(F.collect_set("target").alias("has"))
    gap = F.array_except(F.array(*map(F.lit, MANDATORY)), F.coalesce("has", F.array().cast("array<string>")))
    return sources.select("path").join(has, "path", "left").select("path", F.explode(gap).alias("target"))


def wildcard_sources(rows: DataFrame) -> DataFrame:
    return assignments(rows).where(F.lower("value").rlike(r"\$\(wildcard|\*\.[co]\b"))


def source_refs(rows: DataFrame) -> DataFrame:
    """(path, line, name, ref): literal .c words of source variables all of whose words are literal .c names."""
    own = assignments(rows).where(F.col("name").rlike(SOURCES)).withColumn("words", F.filter(F.split("value", " "), lambda x: x != ""))
    return own.where(F.forall("words", lambda x: x.rlike(r"^[^$%*()\s]+\.c$"))).select("path", "line", "name", F.explode("words").alias("ref"))


def source_status(refs: DataFrame, files: DataFrame, trivia) -> DataFrame:
    """(path, ref, status): refs are relative to their Makefile; missing, empty or exists."""
    folder = F.regexp_replace("path", "[^/]+$", "")
    asked = refs.select("path", "ref", F.concat(folder, F.regexp_replace("ref", r"^\./", "")).alias("file"))
    there = files.select(F.col("path").alias("file"), trivia(F.col("content")).alias("trivia"))
    status = F.when(F.col("trivia").isNull(), "missing").when(F.col("trivia"), "empty").otherwise("exists")
    return asked.join(there, "file", "left").select("path", "ref", status.alias("status"))


def artifact(rows: DataFrame) -> DataFrame:
    """(path, artifact): the first NAME, if it is a plain file name."""
    first = assignments(rows).where("name = 'NAME'").groupBy("path").agg(F.min_by("value", "line").alias("artifact"))
    return first.where(~F.col("artifact").rlike(r"[$/\s]") & (F.col("artifact") != ""))


def space_recipes(sources: DataFrame) -> DataFrame:
    """Lines indented by blanks below a rule, before the next line at the margin."""
    rows = lines(sources)
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("text").rlike(r"^[^\s#]"), F.col("text").rlike(RULE) & ~F.col("text").rlike(ASSIGN))
    return rows.withColumn("mark", mark).withColumn("in_rule", F.last("mark", True).over(w)).where(F.col("in_rule") & F.col("text").rlike(r"^ +\S")).select("path", "line", "text")


def _compacted(block: Column, gone: Column) -> Column:
    """A block of lines joined by backslashes: an explicit list of .c files in as few lines as 80 columns take, without those that are gone; anything else stays."""
    height = lambda t: F.size(F.split(t, "\n"))

    def of_text(text: Column) -> Column:
        part = lambda k: F.regexp_extract(text, LIST, k)

        def of_words(words: Column) -> Column:
            plain = (F.size(words) > 0) & part(1).rlike(SOURCES) & F.forall(words, lambda w: w.rlike(r"^[^$%*()\s#]+\.c$"))

            def of_kept(kept: Column) -> Column:
                fewer = F.size(kept) < F.size(words)
                new = packed(kept, F.concat(part(1), part(2), part(3), F.lit(" ")))
                return F.when(F.size(kept) > 0, bound(new, lambda n: F.when(n.isNotNull() & (fewer | (height(n) < height(block))), n).otherwise(block))).otherwise(block)

            return F.when(plain, bound(F.filter(words, lambda w: ~F.array_contains(gone, w)), of_kept)).otherwise(block)

        return F.when(text.rlike(LIST), bound(F.filter(F.split(part(4), r"\s+"), lambda w: w != ""), of_words)).otherwise(block)

    return bound(F.regexp_replace(block, r"[ \t]*\\\n[ \t]*", " "), of_text)


def compacted(content: Column, gone: Column) -> Column:
    """A Makefile with its lists of sources packed; a line feed behind a backslash does not end a block."""
    blocks = F.split(content, r"(?<!\\)\n", -1)
    return F.array_join(F.transform(blocks, lambda b: _compacted(b, gone)), "\n")


def formatted(sources: DataFrame) -> DataFrame:
    """sources (path, content): without mark and carriage returns, lists packed, one line feed at the end."""
    clean = normalize_eol(remove_bom(F.coalesce("content", F.lit(""))))
    return sources.select("path", bound(compacted(clean, F.array().cast("array<string>")), final_newline).alias("content"))


def without_missing(sources: DataFrame, status: DataFrame) -> DataFrame:
    """sources (path, content) without the references that ``source_status`` calls missing; lists are packed again."""
    gone = status.where("status = 'missing'").groupBy("path").agg(F.collect_set("ref").alias("gone"))
    joined = sources.join(gone, "path", "left")
    return joined.select("path", compacted(F.coalesce("content", F.lit("")), F.coalesce("gone", F.array().cast("array<string>"))).alias("content"))
