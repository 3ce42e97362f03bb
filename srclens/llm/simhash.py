"""SimHash near-dedup (operator 6) by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most three bits are linked.  A
fingerprint is cut into two segments of 32 bits: of three differing bits one
segment holds one at most, so both fingerprints agree on that segment once the
right bit is made a wildcard.  Each distinct fingerprint is indexed under the 32
one-wildcard variants of each segment, equal variants meet by an equality
shuffle, and the bits are counted.

Equal fingerprints are one node.  A variant's fingerprints are verified in
bounded blocks and give a spanning forest, not all pairs.  A variant with more
than ``LIMIT`` fingerprints is dealt anew by its other segment: three differing
bits leave five of the eight half bytes untouched, so under one choice of five
the fingerprints meet again, at most 2**13 distinct ones together.

Defined results.  Null, empty and blank texts have fingerprint 0 and are linked
like any other.  Repeated rows are linked through their equal fingerprints; an
id that repeats with other texts has a fingerprint and a component each.  A
row without id keeps its fingerprint; its component is that of its fingerprint,
and null where no row with an id is in it.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions
from .components import components
from .fingerprint import fingerprint
from .repeats import keyed

LIMIT = 4096
BLOCK = 512
#: All choices of five of a segment's eight half bytes.
MASKS = [sum(15 << 4 * i for i in five) for five in combinations(range(8), 5)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc, t1, t2, fp): the text's 128-bit key, and its fingerprint as a signed long."""
    rows = keyed(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3)
            fps = np.fromiter((fingerprint(texts[i].as_py() or b"", shingle) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fps.view(np.int64))], ["doc", "t1", "t2", "fp"])

    return rows.mapInArrow(run, f"doc {docs.schema[id_col].dataType.simpleString()}, t1 long, t2 long, fp long")


def forest(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within ``distance`` bits, directly or through others; one fewer than the members of each group."""
    n = len(fps)
    if n == 2:
        return (fps[:1], fps[1:]) if int(fps[0] ^ fps[1]).bit_count() <= distance else (fps[:0], fps[:0])
    parent = np.arange(n)
    left, right, open_ = [], [], n - 1

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(0, n, BLOCK):
        for j in range(i, n, BLOCK):
            near = np.bitwise_count(fps[i : i + BLOCK, None] ^ fps[None, j : j + BLOCK]) <= distance
            for x, y in zip(*np.nonzero(near), strict=True):
                if (x + i) < (y + j) and (p := root(x + i)) != (q := root(y + j)):
                    parent[max(p, q)] = min(p, q)
                    left.append(x + i)
                    right.append(y + j)
                    open_ -= 1
            if not open_:
                return fps[left], fps[right]
    return fps[left], fps[right]


def _verify(distance: int, limit: int | None):
    """Over rows sorted by (key, fp): links of each key's fingerprints; those of a key with more than limit come back as (key, fp, over)."""

    def out(a, b, over: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), over))], ["a", "b", "over"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for b in batches:
            k = np.concatenate([held_k, b.column(0).to_numpy()])
            f = np.concatenate([held_f, b.column(1).to_numpy().view(np.uint64)])
            if over is not None and (n := int(np.searchsorted(k, over, "right"))):
                yield out(k[:n], f[:n].view(np.int64), True)
                k, f = k[n:], f[n:]
            if not len(k):
                held_k, held_f = k, f
                continue
            over = None
            cut = int(np.searchsorted(k, k[-1]))
            yield from keys(k[:cut], f[:cut])
            held_k, held_f = k[cut:], f[cut:]
            if limit and len(held_k) > limit:
                over = held_k[0]
                yield out(held_k, held_f.view(np.int64), True)
                held_k, held_f = held_k[:0], held_f[:0]
        yield from keys(held_k, held_f)

    def keys(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True]) if len(k) else np.zeros(1, np.int64)
        size = np.diff(edge)
        left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        two = edge[:-1][size == 2]
        good = np.bitwise_count(f[two] ^ f[two + 1]) <= distance if len(two) else np.zeros(0, bool)
        left.append(f[two[good]])
        right.append(f[two[good] + 1])
        for i in np.flatnonzero(size > 2):
            if limit and size[i] > limit:
                yield out(k[edge[i] : edge[i + 1]], f[edge[i] : edge[i + 1]].view(np.int64), True)
                continue
            a, b = forest(f[edge[i] : edge[i + 1]], distance)
            left.append(a)
            right.append(b)
        yield out(np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64), False)

    return run


def links(distinct: DataFrame, ws: Workspace, distance: int = 3) -> DataFrame:
    """(a, b): a forest of the links between distinct fingerprints (one column, fp)."""
    n = partitions(distinct.sparkSession)
    schema = "a long, b long, over boolean"
    variants = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")
    half = "CASE WHEN v < 32 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295L END"
    keyed = distinct.select("fp", variants).selectExpr(f"shiftleft(cast(v AS long), 32) | (({half}) & ~shiftleft(1L, v % 32)) AS key", "fp")
    found = ws.save(keyed.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_verify(distance, LIMIT), schema), "variants")
    other = "CASE WHEN shiftright(a, 32) < 32 THEN b & 4294967295L ELSE shiftrightunsigned(b, 32) END"
    masks = F.explode(F.array(*map(F.lit, MASKS))).alias("mask")
    over = found.where("over").select("a", "b", masks).selectExpr(f"xxhash64(a, mask, ({other}) & mask) AS key", "b AS fp")
    again = over.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_verify(distance, None), schema)
    return found.where("not over").select("a", "b").unionAll(again.select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(doc, t1, t2, fp, component): component is the smallest id reachable by links; t1 and t2 key the text."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard each find up to 3 differing bits")
    ws = Workspace(docs.sparkSession, "simhash")
    fps = ws.save(fingerprints(docs, id_col, text_col, shingle), "fps")
    nodes = ws.save(fps.groupBy("fp").agg(F.min("doc").alias("least")), "nodes")
    groups = components(links(nodes.select("fp"), ws, distance), ws)
    ws.drop("variants")
    label = nodes.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("label"))
    least = label.groupBy("label").agg(F.min("least").alias("component"))
    of = ws.save(label.join(least, "label").select("fp", "component"), "labels")
    return fps.join(of, "fp").select("doc", "t1", "t2", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the texts whose group holds a smaller id; rows without id stay, and so does another text of an id that goes."""
    gone = near_duplicates(docs, id_col, text_col, **options).where("doc <> component").select("doc", "t1", "t2").distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), F.struct("*").alias("row"))
    return rows.join(gone, ["doc", "t1", "t2"], "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
