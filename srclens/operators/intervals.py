"""Joins of points and ranges by cells and by dyadic nodes.

Short ranges, at most ``SHORT`` offsets, and all points are dealt out by path
and cell of ``1 << CELL`` offsets: a point is one row, a range one in each of
the two cells at most that it touches.  A cell's rows come to their task sorted
by place, a batch at a time; what still holds of a batch's ranges is carried to
the next one, so that a task holds a batch and the ranges that reach over its
end.  Nothing is compared that doesn't meet.

Longer ranges are unions of dyadic nodes.  A range [start, end) is the union of
at most two nodes a level (all numbers with the same quotient by a power of
two), some 2 log2 of its length.  A point asks for its own node at each level
that some range uses.  A point and a range that holds it meet at exactly one
node and others at none, so the joins are plain equality joins on (path, level,
node) that give no false candidates; a long range makes few rows, and a path
with many ranges is spread over its nodes.  Offsets are below 2**61 in size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of an offset inside its cell, and the length of ranges that are met there.
CELL, SHORT = 16, 1 << 14
#: Pairs handed on together.
FLUSH = 1 << 17
KEY = ["path", "level", "node"]


def nodes(start: str, end: str) -> Column:
    """The nodes of [start, end) as array<struct<level, node>>; none of an empty range."""
    s, e = f"cast({start} as bigint)", f"cast({end} as bigint)"
    low, high = f"shiftright({s} + shiftleft(1L, k) - 1, k)", f"shiftright({e}, k)"
    pick = lambda odd, node: f"if({low} < {high} and {odd} & 1 = 1, struct(k as level, {node} as node), null)"
    # one level more than the logarithm says: it may be rounded down
    levels = f"sequence(0, cast(floor(log2({e} - {s})) as int) + 1)"
    return F.expr(f"if({e} > {s}, flatten(transform({levels}, k -> filter(array({pick(low, low)}, {pick(high, f'{high} - 1')}), x -> x is not null))), null)")


def dealt(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """ranges with (level, node), a row a node."""
    return ranges.withColumn("at", F.explode(nodes(start, end))).select("*", "at.level", "at.node").drop("at")


def asked(points: DataFrame, at: str, by_node: DataFrame) -> DataFrame:
    """points with (level, node), a row for each level that by_node uses."""
    levels = by_node.agg(F.collect_set("level").alias("levels"))  # one row of at most 63 numbers
    return points.crossJoin(F.broadcast(levels)).withColumn("level", F.explode("levels")).drop("levels").withColumn("node", F.expr(f"shiftright(cast({at} as bigint), level)"))


def holding(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Every point with every range of its path that holds it, each pair once; other column names must differ."""
    by_node = dealt(ranges, start, end)
    return asked(points, at, by_node).join(by_node, KEY).drop("level", "node")


def _split(ranges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The short ranges and the long ones; None where there are no long ones."""
    length = F.col("end") - F.col("start")
    long = ranges.where(length > SHORT)
    return ranges.where(length <= SHORT), None if long.isEmpty() else long


def _in_cells(rows: DataFrame, order: list[str], once: bool = False) -> DataFrame:
    """rows (path, cell, side, start, ..) dealt out by cell and sorted there by place, side and ``order``.

    A range that began before its cell is at the cell's border, before all that
    begins there.  once: equal rows, which lie in the same cells, are taken once,
    without a shuffle of their own.
    """
    dealt_out = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "cell")
    border = F.shiftleft("cell", CELL)
    return (dealt_out.distinct() if once else dealt_out).sortWithinPartitions("path", "cell", F.greatest("start", border), F.col("start") >= border, "side", *order)


def _cells(start: str, last: str) -> Column:
    """The cells from that of start to that of last."""
    return F.explode(F.sequence(F.shiftright(F.col(start).cast("long"), CELL), F.shiftright(F.expr(last).cast("long"), CELL)))


def _numbered(b: pa.RecordBatch) -> np.ndarray:
    """A number for each row's (path, cell), growing along the sorted rows."""
    path = b["path"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cell = b["cell"].fill_null(0).to_numpy(zero_copy_only=False)
    return np.cumsum(np.r_[False, (np.diff(path) != 0) | (np.diff(cell) != 0)])


def _swept(rows: DataFrame, meet: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, int], tuple[np.ndarray, Iterator[pa.RecordBatch]]], schema: T.StructType) -> DataFrame:
    """Over rows of ``_in_cells``: meet(batch, begin, end, n) gives the ranges that may be carried on, and what is found.

    begin and end: the rows' places as numbers that grow along (path, cell,
    offset); the first n rows of a batch were carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            n = 0 if held is None else held.num_rows
            both = b if not n else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            group, base = _numbered(both), both["cell"].fill_null(0).to_numpy(zero_copy_only=False) << CELL
            inside = lambda c: (group << (CELL + 1)) + np.clip(both[c].cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) - base, 0, 1 << CELL)  # noqa: B023, E731
            begin, end = inside("start"), inside("end")
            kept, found = meet(both, begin, end, n)
            yield from found
            held = both.take(pa.array(kept[(group[kept] == group[-1]) & (end[kept] > begin[-1])]))

    return rows.mapInArrow(run, schema)


def _pairs(points: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(point, range) of sorted points in [begin, end), some ``FLUSH`` at a time."""
    low = np.searchsorted(points, begin)
    n = np.maximum(np.searchsorted(points, end) - low, 0)
    total = np.concatenate([[0], np.cumsum(n)])
    first = 0
    while first < len(n):
        last = max(first + 1, int(np.searchsorted(total, total[first] + FLUSH, "right")) - 1)
        own = n[first:last]
        if own.any():
            at = np.arange(own.sum()) - np.repeat(total[first:last] - total[first], own) + np.repeat(low[first:last], own)
            yield at, np.repeat(np.arange(first, last), own)
        first = last


def _sided(df: DataFrame, side: int, cells: Column, *more: str) -> DataFrame:
    return df.select("path", cells.alias("cell"), F.lit(side).cast("byte").alias("side"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *more)


def owner(points: DataFrame, ranges: DataFrame, at: str = "start") -> DataFrame:
    """points with ``owner``: the name of the first range [start, end) of the same path that holds them.

    Of the ranges of a cell in order only those count that end behind all before
    them: the owner of a point is the first of these that ends behind it, if it
    has begun.  Of long ranges a node keeps the first alone.
    """
    kind = points.schema[at].dataType
    rest = [c for c in points.columns if c not in ("path", at)]
    r = ranges.select("path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "name").where("end > start and path is not null")
    short, long = _split(r)
    more = F.struct(*rest).alias("more") if rest else F.lit(None).cast("boolean").alias("more")
    asks = points.select("path", F.shiftright(F.col(at).cast("long"), CELL).alias("cell"), F.lit(1).cast("byte").alias("side"), F.col(at).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(None).cast(r.schema["name"].dataType).alias("name"), more)
    told = _sided(short, 0, _cells("start", "end - 1"), "name", F.lit(None).cast(asks.schema["more"].dataType).alias("more"))
    out = T.StructType([*(asks.schema[c] for c in ("path", "start", "more")), T.StructField("own_start", T.LongType()), T.StructField("own_end", T.LongType()), T.StructField("owner", r.schema["name"].dataType)])

    def meet(b: pa.RecordBatch, begin: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, Iterator[pa.RecordBatch]]:
        side = b["side"].to_numpy(zero_copy_only=False)
        own, ask = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        most = np.maximum.accumulate(end[own])
        own = own[np.diff(most, prepend=-1) > 0]
        i = np.searchsorted(end[own], begin[ask], "right")
        whose = np.append(own, -1)[i]
        known = b["start"].is_valid().to_numpy(zero_copy_only=False)[ask] & (whose >= 0)
        known &= (begin[whose] <= begin[ask]) & (begin[whose] >> (CELL + 1) == begin[ask] >> (CELL + 1))
        whose = pa.array(whose, mask=~known)
        asked, told = b.take(pa.array(ask)), b.take(whose)
        return own, iter([pa.RecordBatch.from_arrays([asked["path"], asked["start"], asked["more"], told["start"], told["end"], told["name"]], out.names)])

    seen = _swept(_in_cells(told.unionAll(asks), ["start", "end", "name"]), meet, out)
    named = lambda d, who: d.select("path", F.col("start").cast(kind).alias(at), *(F.col(f"more.{c}").alias(c) for c in rest), who.alias("owner")).select(*points.columns, "owner")
    if long is None:
        return named(seen, F.col("owner"))
    own = F.struct(F.col("start").alias("start"), F.col("end").alias("end"), F.col("name").alias("name")).alias("own")
    by_node = dealt(long.select("path", own), "own.start", "own.end").groupBy(*KEY).agg(F.min("own").alias("own"))
    first = asked(points.select("path", F.col(at).cast("long").alias("at")).distinct(), "at", by_node).join(by_node, KEY).groupBy("path", "at").agg(F.min("own").alias("own"))
    both = seen.join(first.withColumnsRenamed({"path": "p", "at": "a"}), (F.col("path") == F.col("p")) & (F.col("start") == F.col("a")), "left")
    near = F.when(F.col("own_start").isNotNull(), F.struct(F.col("own_start").alias("start"), F.col("own_end").alias("end"), F.col("owner").alias("name")))
    return named(both, F.least(near, F.col("own"))["name"])


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, a_start, a_end, b_start, b_end) of ranges that share an offset; an empty range meets those that begin before and end behind it.

    Of two ranges that overlap one starts in the other: every pair is found
    once, in the cell of the later start.
    """
    one = lambda d: d.select("path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("end >= start and path is not null")
    a, b = one(a), one(b)
    # of a long range its start alone is in a cell
    last = f"if(end - start > {SHORT}, start, greatest(start, end - 1))"
    # where starts are equal b comes first: an a that starts there starts in it
    rows = _sided(b, 0, _cells("start", last)).unionAll(_sided(a, 1, _cells("start", last)))
    names = ["path", "a_start", "a_end", "b_start", "b_end"]
    out = T.StructType([rows.schema["path"], *(T.StructField(c, T.LongType()) for c in names[1:])])

    def meet(r: pa.RecordBatch, begin: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, Iterator[pa.RecordBatch]]:
        side, start, stop = (r[c].to_numpy(zero_copy_only=False) for c in ("side", "start", "end"))
        short = stop - start <= SHORT
        fresh = (start >> CELL) == r["cell"].to_numpy(zero_copy_only=False)
        fresh[:n] = False

        def found() -> Iterator[pa.RecordBatch]:
            for mine in (1, 0):
                p, q = np.flatnonzero(fresh & (side == mine)), np.flatnonzero(short & (side != mine))
                for i, j in _pairs(begin[p], begin[q], end[q]):
                    i, j = p[i], q[j]
                    x, y = (i, j) if mine else (j, i)
                    # the later start: a's, where it is no empty range at the other's start; b's, where it is later
                    good = (start[x] > start[y]) | ((start[x] == start[y]) & (stop[x] > start[x])) if mine else start[y] > start[x]
                    x, y = x[good], y[good]
                    yield pa.RecordBatch.from_arrays([r["path"].take(pa.array(x)), *(pa.array(v) for v in (start[x], stop[x], start[y], stop[y]))], names)

        return np.flatnonzero(short), found()

    near = _swept(_in_cells(rows, ["start", "end"], once=True), meet, out)
    named = lambda d, p: None if d is None else d.distinct().withColumnsRenamed({"start": f"{p}_start", "end": f"{p}_end"})
    x, y, x_long, y_long = named(a, "a"), named(b, "b"), named(_split(a)[1], "a"), named(_split(b)[1], "b")
    if y_long is not None:
        near = near.unionByName(holding(x, "a_start", y_long, "b_start", "b_end").where("a_start > b_start or a_end > a_start").select(*names))
    if x_long is not None:
        near = near.unionByName(holding(y, "b_start", x_long, "a_start", "a_end").where("b_start > a_start").select(*names))
    return near


def containing(ranges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(path, start, end, name): every candidate (path, start, end, name) that holds a range whole, its end included."""
    c = candidates.select("path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "name").where("end >= start and path is not null")
    x = ranges.select("path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).where("end >= start and path is not null")
    # a range that ends at the candidate's end may start there: one offset more
    short, long = _split(c.withColumn("end", F.col("end") + 1))
    kind = c.schema["name"].dataType
    rows = _sided(short, 0, _cells("start", "end - 1"), "name").unionAll(_sided(x, 1, F.shiftright("start", CELL), F.lit(None).cast(kind).alias("name")))
    names = ["path", "start", "end", "name"]
    out = T.StructType([rows.schema[c] for c in names])

    def meet(r: pa.RecordBatch, begin: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, Iterator[pa.RecordBatch]]:
        side, stop = (r[c].to_numpy(zero_copy_only=False) for c in ("side", "end"))
        p, q = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        codes = r["name"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        often = len(np.unique(codes[q])) < len(q)

        def found() -> Iterator[pa.RecordBatch]:
            seen = np.zeros(0, np.int64)
            for i, j in _pairs(begin[p], begin[q], end[q]):
                i, j = p[i], q[j]
                good = stop[i] < stop[j]
                i, j = i[good], j[good]
                if often:  # candidates of one name count once for a range
                    pair, first = np.unique(i * (len(codes) + 1) + codes[j] + 1, return_index=True)
                    first = first[~np.isin(pair, seen)]
                    seen = np.union1d(seen, pair)
                    i, j = i[first], j[first]
                asked, told = r.take(pa.array(i)), r["name"].take(pa.array(j))
                yield pa.RecordBatch.from_arrays([asked["path"], asked["start"], asked["end"], told], names)

        return q, found()

    near = _swept(_in_cells(rows, ["start", "end", "name"], once=True), meet, out)
    if long is None:
        return near
    held = holding(x.distinct(), "start", long.distinct().withColumnsRenamed({"start": "c_start", "end": "c_end"}), "c_start", "c_end")
    return near.unionByName(held.where("end < c_end").select(*names)).distinct()
