"""Running values over rows in order, for keys of any size.

A window by key puts all rows of a key into one task.  Here rows are
range-partitioned by key and place, so that a key may lie in many pieces; a
window runs inside each piece, every piece gives one summary, and what the
earlier pieces of a key amount to is carried over the borders.  A piece's first
key alone can have begun before it, so there are at most as many carried rows
as pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Save = Callable[[DataFrame], DataFrame]


def in_pieces(rows: DataFrame, by: list[str], order: list[str], save: Save) -> DataFrame:
    """rows with ``piece`` and ``place``: numbers that grow with (by, order), place over all rows; equal rows are split too."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order, "tie"]
    sorted_ = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return save(sorted_.drop("tie").withColumns({"piece": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))


def matched(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """a joined with b on columns of equal names; nulls equal nulls.  small: b is known to be small whatever the input."""
    other = b.withColumnsRenamed({n: f"{n}_" for n in names})
    keys = reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names))
    return a.join(F.broadcast(other) if small else other, keys, how).drop(*(f"{n}_" for n in names))


def running(rows: DataFrame, by: list[str], order: list[str], save: Save, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, maxima: dict[str, str] | None = None, own: bool = True) -> DataFrame:
    """rows with running columns (new name -> column): sums, latest values that are not null, and maxima of the rows up to each row, with it or (own=False) without it.

    Nulls are passed over; where there is nothing before a row the value is
    null.  rows must have no columns piece, place or tie.
    """
    cut = in_pieces(rows, by, order, save)
    inside = Window.partitionBy(*by, "piece").orderBy("place").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    before = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    #: by kind: over a window, of a whole piece, of two values one behind the other
    kinds = {
        "sum": (F.sum, F.sum, lambda a, b: a + b),
        "last": (lambda c: F.last(c, ignorenulls=True), lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))), lambda a, b: b),
        "max": (F.max, F.max, F.greatest),
    }
    wanted = [(kind, n, c) for kind, named in (("sum", sums), ("last", lasts), ("max", maxima)) for n, c in (named or {}).items()]
    whole = [kinds[kind][1](c).alias(f"carry_{n}") for kind, n, c in wanted]
    carry = cut.groupBy(*by, "piece").agg(*whole).select(*by, "piece", *(kinds[kind][0](f"carry_{n}").over(before).alias(f"carry_{n}") for kind, n, _ in wanted))
    carry = carry.where(reduce(Column.__or__, (F.col(f"carry_{n}").isNotNull() for _, n, _ in wanted)))
    ran = cut.withColumns({n: kinds[kind][0](c).over(inside) for kind, n, c in wanted})
    # at most one row a piece
    joined = matched(ran, carry, [*by, "piece"], "left", small=True)
    both = lambda kind, a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(kinds[kind][2](a, b))
    return joined.select(*rows.columns, *(both(kind, F.col(f"carry_{n}"), F.col(n)).alias(n) for kind, n, _ in wanted))
