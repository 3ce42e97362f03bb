"""Line tables and the rules that look at one line, or at one and its neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

INCLUDE = r'^\s*#\s*include\s*(?:<([^>]+)>|"([^"]+)")\s*$'


def lines(sources: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, text): one row a line; a text that ends in a line feed has an empty last line."""
    return sources.select(F.col(path).alias("path"), F.posexplode(F.split(content, "\n", -1)).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def line_ranges(sources: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, line, start, end): byte range of each line with its line feed."""


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(p, np.frombuffer(c.as_buffer(), np.uint8)) for p, c in zip(b.column(0), b.column(1), strict=True) if c.is_valid]
            ends = [np.append(np.flatnonzero(data == 10) + 1, len(data)) for _, data in texts]
            n = np.array([len(e) for e in ends], np.int64)
            end = np.concatenate([np.zeros(0, np.int64), *ends]).astype(np.int64)
            start = np.concatenate([np.zeros(0, np.int64), *(np.append(0, e[:-1]) for e in ends)]).astype(np.int64)
            line = np.concatenate([np.zeros(0, np.int64), *(np.arange(1, k + 1) for k in n)]).astype(np.int64)
            paths = pa.array([p.as_py() for p, _ in texts], pa.string()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([paths, pa.array(line), pa.array(start), pa.array(end)], ["path", "line", "start", "end"])

    return sources.select(F.col(path).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "path string, line long, start long, `end` long")


def position(content: Column, offset: Column) -> Column:
    """struct(line, byte_col, visual_col), from 1, of a byte offset; null inside a character."""
    head = F.substring(F.encode(content, "UTF-8"), F.lit(1), offset)
    ok = F.is_valid_utf8(head.cast("string"))
    rows = F.split(head.cast("string"), "\n", -1)
    last = F.element_at(rows, -1)
    return F.when(ok, F.struct(F.size(rows).alias("line"), (F.octet_length(last) + 1).alias("byte_col"), (X.visual_width(last) + 1).alias("visual_col")))


def diagnostics(rows: DataFrame, rule: str, severity: str, message: Column | str = "") -> DataFrame:
    """(path, line, severity, rule_id, message)"""
    return rows.select("path", "line", F.lit(severity).alias("severity"), F.lit(rule).alias("rule_id"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def too_long(rows: DataFrame, most: int = 80) -> DataFrame:
    return rows.withColumn("width", X.visual_width(F.col("text"))).where(F.col("width") > most)


def trailing_space(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("text").rlike(r"[ \t]\z"))


def missing_final_newline(sources: DataFrame, content: str = "content") -> DataFrame:
    return sources.where((F.col(content) != "") & ~F.endswith(F.col(content), F.lit("\n")))


def heading_jumps(headings: DataFrame) -> DataFrame:
    """headings: (path, line, level).  Those more than one level below the one before."""
    w = Window.partitionBy("path").orderBy("line")
    return headings.withColumn("previous", F.lag("level").over(w)).where(F.col("level") > F.col("previous") + 1)


def headings(rows: DataFrame) -> DataFrame:
    """Headings outside code fences, marked by signs before them or by a line below: (path, line, level)."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("text").rlike(r"^ {0,3}(```|~~~)")
    inside = F.sum(fence.cast("int")).over(w) % 2 == 1
    level = F.length(F.regexp_extract("text", r"^ {0,3}(#{1,6})(?:[ \t]|$)", 1))
    order = Window.partitionBy("path").orderBy("line")
    below = F.lead("text").over(order)
    # a line below makes a heading of one line of plain text; of several it is the last that stands here
    plain = ~F.col("text").rlike(r"^\s*$|^ {0,3}([#>`~*+-]|\d+[.)])|^    ") & (level == 0)
    level = F.when(level > 0, level).when(plain & below.rlike(r"^ {0,3}=+[ \t]*$"), 1).when(plain & below.rlike(r"^ {0,3}-+[ \t]*$"), 2).otherwise(0)
    return rows.withColumn("inside", inside).withColumn("level", level).where((F.col("level") > 0) & ~F.col("inside")).select("path", "line", "level")


def include_key(text: Column) -> Column:
    """(0 for <system>, 1 for "project", lower-cased name) of a line that is one include; else null."""
    system, own = F.regexp_extract(text, INCLUDE, 1), F.regexp_extract(text, INCLUDE, 2)
    return F.when(text.rlike(INCLUDE), F.struct(F.when(system != "", 0).otherwise(1).alias("group"), F.lower(F.concat(system, own)).alias("name")))


def islands(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``island``: consecutive values of order share one."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("island", F.col(order) - F.row_number().over(w))


def include_blocks(rows: DataFrame) -> DataFrame:
    """(path, first, last, sorted): runs of include lines, and whether they stand in order."""
    found = islands(rows.withColumn("key", include_key(F.col("text"))).where("key is not null"), ["path"], "line")
    w = Window.partitionBy("path", "island").orderBy("line")
    wrong = F.coalesce(F.lag("key").over(w) > F.col("key"), F.lit(False))
    return found.withColumn("wrong", wrong).groupBy("path", "island").agg(F.min("line").alias("first"), F.max("line").alias("last"), (~F.bool_or("wrong")).alias("sorted")).drop("island")


def sort_includes(rows: DataFrame) -> DataFrame:
    """rows with the lines of each include block in stable order; no other line moves."""
    found = islands(rows.withColumn("key", include_key(F.col("text"))).where("key is not null"), ["path"], "line")
    slot, rank = Window.partitionBy("path", "island").orderBy("line"), Window.partitionBy("path", "island").orderBy("key", "line")
    placed = found.withColumn("slot", F.row_number().over(slot)).withColumn("rank", F.row_number().over(rank))
    moved = placed.select("path", "island", F.col("rank").alias("slot"), F.col("text").alias("new"))
    new = placed.join(moved, ["path", "island", "slot"]).select("path", "line", "new")
    return rows.join(new, ["path", "line"], "left").select("path", "line", F.coalesce("new", "text").alias("text"))


def word_counts(sources: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, word, n): counted within each row, so that nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            coded = lists.flatten().dictionary_encode()
            n = len(coded.dictionary)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            keys, counts = np.unique(row * n + coded.indices.to_numpy(), return_counts=True)
            of, word = (pa.array(keys // n), pa.array(keys % n)) if n else (pa.array([], pa.int64()),) * 2
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), coded.dictionary.take(word), pa.array(counts.astype(np.int64))], ["path", "word", "n"])

    rows = sources.select(F.col(path).cast("string").alias("path"), X.word_list(F.col(content)).alias("w"))
    return rows.mapInArrow(run, "path string, word string, n long")


def line_counts(sources: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, n_lines, n_bytes): lines, and bytes without their line feeds."""
    n = F.size(F.split(content, "\n", -1))
    return sources.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), n.cast("long").alias("n_lines"), (F.octet_length(content) - n + 1).cast("long").alias("n_bytes"))


def line_rules(sources: DataFrame, most: int = 80) -> DataFrame:
    """Diagnostics of the rules on one line, in one pass over the lines."""
    rows = lines(sources)
    hit = lambda cond, severity, rule: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule_id"), F.lit("").alias("message")))
    found = F.array(hit(X.visual_width(F.col("text")) > most, "error", "LINE_TOO_LONG"), hit(F.col("text").rlike(r"[ \t]\z"), "warning", "TRAILING_SPACE"))
    return rows.select("path", "line", F.inline(F.filter(found, lambda x: x.isNotNull())))
