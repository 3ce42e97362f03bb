"""A budget that is spent in order: a row that no longer fits is passed over and costs nothing.

What is spent after a row depends on every row before it, so no running sum
will do.  But a run of rows is a table from what was spent before it to what is
spent behind it, at most budget + 2 numbers, and tables compose.  Rows are cut
into blocks in order, every block becomes a table, the tables are composed by
piece and by group to what was spent before each block, and the blocks are then
replayed side by side.  No task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import Save, in_pieces, matched

#: Rows of a block are 2**BLOCK at most.
BLOCK = 10
GROUP = ["path", "function"]


def _through(states: Column, table: Column) -> Column:
    return F.transform(states, lambda s: table[s])


def _entries(listed: Column, start: Column) -> Column:
    """What was spent before each of some tables in order, from what was before the first."""
    begin = F.struct(start.cast("int").alias("now"), F.array().cast("array<int>").alias("before"))
    step = lambda acc, t: F.struct(t["table"][acc["now"]].alias("now"), F.concat(acc["before"], F.array(acc["now"])).alias("before"))
    return F.aggregate(listed, begin, step, lambda acc: acc["before"])


def spent(rows: DataFrame, save: Save, budget: int = 25, block: int = BLOCK) -> DataFrame:
    """rows (path, function, ordinal, lines, used) with ``accepted``: in order, those whose lines still fit.

    used: what was spent before the first row, one value a group (the least
    counts).  Lines that are null or negative cost nothing.
    """
    cost = F.greatest(F.coalesce(F.col("lines"), F.lit(0)), F.lit(0)).cast("long")
    cut = in_pieces(rows.select(*GROUP, "ordinal", "lines", "used"), GROUP, ["ordinal", "lines"], save)
    item = F.struct("place", "ordinal", "lines", cost.alias("cost"))
    blocks = cut.withColumn("block", F.shiftright("place", block)).groupBy(*GROUP, "piece", "block").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    states = F.sequence(F.lit(0), F.lit(budget + 1))  # the last: more than the budget
    # all states at once through the rows of a block
    fits = lambda s, cost: F.when(s + cost <= budget, (s + cost).cast("int")).otherwise(s)
    table = F.aggregate("rows", states, lambda m, r: F.transform(m, lambda s: fits(s, r["cost"])))
    tables = blocks.select(*GROUP, "piece", "block", table.alias("table"))
    pieces = save(tables.groupBy(*GROUP, "piece").agg(F.sort_array(F.collect_list(F.struct("block", "table"))).alias("tables")))
    whole = pieces.select(*GROUP, "piece", F.aggregate("tables", states, lambda m, t: _through(m, t["table"])).alias("table"))
    before = cut.groupBy(*GROUP).agg(F.least(F.greatest(F.min("used"), F.lit(0)), F.lit(budget + 1)).alias("start"))
    groups = whole.groupBy(*GROUP).agg(F.sort_array(F.collect_list(F.struct("piece", "table"))).alias("tables"))  # as many as pieces at most
    joined = matched(groups, before, GROUP).select(*GROUP, "tables", F.coalesce("start", F.lit(0)).alias("start"))
    at_piece = joined.select(*GROUP, F.explode(F.arrays_zip(F.col("tables.piece").alias("piece"), _entries(F.col("tables"), F.col("start")).alias("start"))).alias("e")).select(*GROUP, "e.*")
    inner = matched(pieces, at_piece, [*GROUP, "piece"])
    at_block = inner.select(*GROUP, F.explode(F.arrays_zip(F.col("tables.block").alias("block"), _entries(F.col("tables"), F.col("start")).alias("start"))).alias("e")).select(*GROUP, "e.*")
    ready = matched(blocks, at_block, [*GROUP, "block"])

    def replay(acc: Column, r: Column) -> Column:
        ok = acc["now"] + r["cost"] <= budget
        row = F.struct(r["ordinal"].alias("ordinal"), r["lines"].alias("lines"), ok.alias("accepted"))
        return F.struct(F.when(ok, (acc["now"] + r["cost"]).cast("int")).otherwise(acc["now"]).alias("now"), F.concat(acc["out"], F.array(row)).alias("out"))

    kind = "array<struct<" + ", ".join(f"{c}: {cut.schema[c].dataType.simpleString()}" for c in ("ordinal", "lines")) + ", accepted: boolean>>"
    begin = F.struct(F.col("start").cast("int").alias("now"), F.array().cast(kind).alias("out"))
    return ready.select(*GROUP, F.explode(F.aggregate("rows", begin, replay, lambda acc: acc["out"])).alias("r")).select(*GROUP, "r.*")
