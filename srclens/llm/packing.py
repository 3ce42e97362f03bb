"""Best-fit packing (operator 13) by swap-based local search.

A document is its token ids and an end id; only one longer than a sequence is
cut, into whole sequences and a rest.  Pieces of less than a sequence are dealt
evenly to groups of at most ``PIECES``; a task packs a group best-fit, longest
first, then searches locally: pieces of the emptiest bin move to fuller ones,
are exchanged one for one, two for one or one for two, always so that the sum of
squared fills grows, until bins are empty or nothing helps.  Bins that are not
full yet, and they alone, are dealt anew to groups of ``BINS`` and searched
again, round by round, until they are as few as their tokens allow or two rounds
in a row saved none.  No task holds more than a group, whatever the input, and
every round's bins are a written table.

Defined results.  A null text is an empty one: its piece is the end id alone.
Repeated rows are packed each on its own.  Texts may be of any length.  An empty
table gives no sequences.  Other columns are not read.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions
from .vocabulary import word_ids

LENGTH, END_ID = 4096, 1
#: Pieces packed together at first, and bins searched together in a round.
PIECES, BINS = 8192, 128
#: Rounds of dealing anew at most; each leaves a valid packing.
ROUNDS = 12
BIN = "bin long, fill long, members array<long>, lengths array<int>"


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, piece, start, length, crc): crc over the piece's ids as little-endian 32-bit numbers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), struct.pack("<I", end_id)
        for b in batches:
            rows = []
            for i, doc in enumerate(b.column(0).to_pylist()):
                ids = words.text(b.column(1)[i].as_py() or "") + end
                rows += ((doc, at // length, at, min(length, len(ids) // 4 - at), zlib.crc32(ids[4 * at : 4 * (at + length)])) for at in range(0, len(ids) // 4, length))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            types = [b.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["doc", "piece", "start", "length", "crc"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, f"doc {kind}, piece int, start long, length long, crc long")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions: longest first, each to the fullest bin that holds it."""
    room: dict[int, list[list[int]]] = defaultdict(list)
    open_rooms: list[int] = []  # sorted rooms that some bin has
    bins = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect_left(open_rooms, lengths[i])
        if at == len(open_rooms):
            own, left = [], capacity
            bins.append(own)
        else:
            left = open_rooms[at]
            own = room[left].pop()
            if not room[left]:
                open_rooms.pop(at)
        own.append(i)
        left -= lengths[i]
        if left:
            if not room[left]:
                open_rooms.insert(bisect_left(open_rooms, left), left)
            room[left].append(own)
    return bins


class Search:
    """Local search over a group of bins, each a dictionary of length -> pieces of that length."""

    def __init__(self, bins: list[list[tuple[int, int]]], capacity: int):
        self.capacity, self.bins = capacity, []
        for members in bins:
            own = defaultdict(list)
            for piece, length in members:
                own[length].append(piece)
            self.bins.append(own)
        self.fill = [sum(n for _, n in members) for members in bins]

    def choices(self, x: int, two: bool) -> list[tuple[int, ...]]:
        """One piece, or up to two, of a bin, by length; a bin has fewer than a hundred different ones of 4,096 tokens."""
        own = sorted(self.bins[x])
        one = [(n,) for n in own]
        return one + [p for p in itertools.combinations_with_replacement(own, 2) if p[0] != p[1] or len(self.bins[x][p[0]]) > 1] if two else one

    def best(self, x: int, y: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """What x gives and what y gives back so that y grows most and still holds it, and squared fills grow."""
        gap = self.capacity - self.fill[y]
        least = max(0, self.fill[x] - self.fill[y])  # y must grow by more than x is ahead
        found, most = None, least
        for give, back in ((False, None), (False, False), (True, False), (False, True)):  # move, one for one, two for one, one for two
            given, returned = self.choices(x, give), [()] if back is None else self.choices(y, back)
            a, b = np.array([sum(g) for g in given]), np.array([sum(r) for r in returned])
            gain = a[:, None] - b[None, :]
            gain[gain > gap] = -1
            i, j = divmod(int(gain.argmax()), len(b))
            if gain[i, j] > most:
                found, most = (given[i], returned[j]), gain[i, j]
            if most == gap:
                break
        return found

    def exchange(self, x: int, y: int, given: tuple[int, ...], returned: tuple[int, ...]) -> None:
        for source, target, some in ((x, y, given), (y, x, returned)):
            for n in some:
                self.bins[target][n].append(self.bins[source][n].pop())
                if not self.bins[source][n]:
                    del self.bins[source][n]
                self.fill[source] -= n
                self.fill[target] += n

    def run(self) -> None:
        least = -(-sum(self.fill) // self.capacity)
        stuck: set[int] = set()
        while True:
            under = sorted((x for x in range(len(self.bins)) if 0 < self.fill[x] < self.capacity), key=lambda x: self.fill[x])
            if sum(f > 0 for f in self.fill) <= least or len(under) < 2:
                return
            source = next((x for x in under if x not in stuck), None)
            if source is None:
                return
            moved = False
            for y in reversed(under):
                if y != source and self.fill[source] and self.fill[y] < self.capacity and (found := self.best(source, y)):
                    self.exchange(source, y, *found)
                    moved = True
            if moved:
                stuck.clear()
            else:
                stuck.add(source)

    def result(self) -> list[list[tuple[int, int]]]:
        return [[(p, n) for n, own in bin_.items() for p in own] for bin_, fill in zip(self.bins, self.fill, strict=True) if fill]


def _bins(found: list[list[tuple[int, int]]]) -> pa.Table:
    """Bins as rows; a bin is named by its least piece."""
    return pa.table({
        "bin": pa.array([min(p for p, _ in b) for b in found], pa.int64()),
        "fill": pa.array([sum(n for _, n in b) for b in found], pa.int64()),
        "members": pa.array([[p for p, _ in b] for b in found], pa.list_(pa.int64())),
        "lengths": pa.array([[n for _, n in b] for b in found], pa.list_(pa.int32())),
    })


def packed(items: DataFrame, ws: Workspace, capacity: int = LENGTH, group: int = PIECES, group_bins: int = BINS) -> DataFrame:
    """Bins (bin, fill, members, lengths) of items (item, length), each shorter than the capacity."""

    def first(t: pa.Table) -> pa.Table:
        ids, lengths = t["item"].to_pylist(), t["length"].to_pylist()
        return _bins([[(ids[i], lengths[i]) for i in b] for b in best_fit(lengths, capacity)])

    def again(t: pa.Table) -> pa.Table:
        search = Search([list(zip(m, n, strict=True)) for m, n in zip(t["members"].to_pylist(), t["lengths"].to_pylist(), strict=True)], capacity)
        search.run()
        return _bins(search.result())

    def dealt(df: DataFrame, key: str, k: int, n: int, size: int):
        """df in even groups of about ``size`` rows, over as many tasks as there are groups, up to the usual number."""
        groups = max(1, -(-n // size))
        named = df.withColumn("group", F.pmod(F.xxhash64(F.lit(k), key), F.lit(groups)))
        return named.repartition(min(groups, partitions(df.sparkSession)), "group").groupBy("group")

    bins = dealt(items, "item", 0, items.count(), group).applyInArrow(first, BIN)
    def told(bins: DataFrame) -> tuple[int, int, int]:
        """How many bins there are, how many are not full, and their tokens."""
        open_ = F.col("fill") < capacity
        return tuple(bins.agg(F.count("*"), F.count_if(open_), F.coalesce(F.sum(F.when(open_, F.col("fill"))), F.lit(0))).first())

    bins, done, spared = ws.save(bins, "bins0"), [], 0
    _, count, tokens = told(bins)
    for k in range(1, ROUNDS + 1):
        if count <= -(-tokens // capacity) or spared > 1:
            break
        done.append(bins.where(F.col("fill") == capacity))
        bins = ws.save(dealt(bins.where(F.col("fill") < capacity), "bin", k, count, group_bins).applyInArrow(again, BIN), f"bins{k}")
        made, left, tokens = told(bins)
        spared = 0 if made < count else spared + 1
        count = left
    return _all([*done, bins])


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def sequences(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc, piece, start, length, crc, sequence, offset): one row a piece."""
    ws = Workspace(docs.sparkSession, "packing")
    # a piece's number names it in every bin
    cut = ws.save(pieces(docs, path, length, end_id, id_col, text_col).withColumn("item", F.monotonically_increasing_id()), "pieces")
    bins = packed(cut.where(F.col("length") < length).select("item", "length"), ws, length, **options)
    offsets = F.expr("transform(sequence(1, size(lengths)), i -> aggregate(slice(lengths, 1, i - 1), 0L, (s, x) -> s + x))")
    placed = bins.select(F.col("bin").alias("sequence"), F.explode(F.arrays_zip(F.col("members").alias("item"), offsets.alias("offset"))).alias("m")).select("sequence", "m.item", "m.offset")
    rest = cut.where(F.col("length") < length).join(placed, "item")
    whole = cut.where(F.col("length") == length).select("*", F.col("item").alias("sequence"), F.lit(0).cast("long").alias("offset"))
    return rest.unionByName(whole).drop("item")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
    return out.select(F.col("doc").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")
