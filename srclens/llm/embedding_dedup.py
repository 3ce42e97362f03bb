"""Embedding near-dedup (operator 2) by sorted projection passes.

1. Equal vectors are one node, keyed by a 128-bit hash of their bytes.
2. In each pass a node's key is the concatenation of 64 random one-bit hashes
   (signs of random projections).  All passes are range-partitioned and sorted
   in one shuffle; each vector is compared with its next ``WINDOW`` neighbours
   in its pass by matrix products, across partition borders too, and verified
   links are kept as a forest.
3. Links of all passes are united into components.
4. Windows are bounded, groups are not: inside a component links are counted
   exactly, in blocks of at most about ``BLOCK`` vectors of one angle to the
   component's first vector.  By the triangle inequality two bins of angles that
   add up to less than the threshold's are linked throughout, and two that are
   further apart not at all, whatever the number of vectors in them; only blocks
   of the other bins are multiplied out.  No pairs are written.

The number of passes is measured.  ``PROBES`` vectors get a partner just at the
threshold, and one scan counts how many vectors lie between the two in each of
``TRIALS`` passes.  The passes are enough that in the densest group of probes, too,
a pair meets in some window with probability ``recall``, however unevenly the
vectors are spread; there are 4095 at most.  What no pass brings together is missed; the tests and the
README give measured recall.

Defined results.  Vectors that are null, empty, zero or hold null or non-finite
components link with nothing, and neither do rows without id (their component is
null, and they are kept).  Vectors of different lengths never link.  Repeated
rows are vectors of their own.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, partitions
from .components import components

WINDOW, BLOCK = 512, 1024
#: Vectors that get a partner to measure by, how many of them are judged together, and the passes they are measured in.
PROBES, GROUP, TRIALS = 512, 32, 32
#: Angles this close to a bound are multiplied out.
SLACK = 1e-6


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec, data): the vector's bytes; null where it can't link."""
    single = vectors.schema[vec_col].dataType.elementType == T.FloatType()
    kind = np.dtype("<f4" if single else "<f8")
    rows = vectors.select(F.col(id_col).alias("vec"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v in b.column(1):
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy().astype(kind)
                    x = x if np.isfinite(x).all() and x.any() else None
                out.append(None if x is None else (x + kind.type(0)).tobytes())  # -0 becomes 0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["vec", "data"])

    kinds = [T.StructField("vec", vectors.schema[id_col].dataType), T.StructField("data", T.BinaryType())]
    out = rows.mapInArrow(run, T.StructType(kinds))
    key = F.concat(F.lpad(F.hex(F.xxhash64("data")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), "data")), 16, "0"))
    return out.select("vec", "data", F.when(F.col("data").isNotNull() & F.col("vec").isNotNull(), key).alias("key"))


def unit(data: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    x = x / abs(x).max(axis=1, keepdims=True)  # squares of very large or small components are none
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sort_keys(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(row, pass): 64 signs of projections each, as numbers of their order."""
    bits = (x @ planes > 0).reshape(len(x), -1, 64)
    return (np.packbits(bits, axis=2).view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def planes_of(seed: int, size: int, width: int, passes: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).normal(size=(width, passes * 64))


def measured_passes(nodes: DataFrame, total: int, cosine: float, recall: float, kind: str, seed: int) -> int:
    """Passes by what lies between probes and partners at the threshold; of several lengths of vectors, the most that one needs."""
    if total <= WINDOW + 1:
        return 1
    held: dict[int, list[bytes]] = {}
    for row in nodes.orderBy("key").limit(PROBES).collect():  # keys are hashes: a sample
        held.setdefault(len(row["data"]), []).append(bytes(row["data"]))
    ends: dict[int, np.ndarray] = {}
    r = np.random.default_rng(seed)
    for size, data in held.items():
        x = unit(data, kind)
        if x.shape[1] > 1:
            # every other partner lies towards another vector, the rest anywhere
            to = np.where(np.arange(len(x))[:, None] % 2, x[r.permutation(len(x))], 0) + r.normal(size=x.shape) * 1e-3
            to -= (to * x).sum(1)[:, None] * x
            y = cosine * x + (1 - cosine**2) ** 0.5 * to / np.linalg.norm(to, axis=1)[:, None]
            ends[size] = np.stack([sort_keys(v, planes_of(seed + 1, size, x.shape[1], TRIALS)) for v in (x, y)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {size: np.zeros((TRIALS, 2 * e.shape[1] + 1), np.int64) for size, e in ends.items()}
        for b in batches:
            data = b.column(0).to_pylist()
            sizes = np.array([len(d) for d in data])
            for size in set(sizes.tolist()) & set(ends):
                x = unit([d for d in data if len(d) == size], kind)
                order = sort_keys(x, planes_of(seed + 1, size, x.shape[1], TRIALS))
                for t in range(TRIALS):
                    at = np.searchsorted(np.sort(ends[size][:, :, t].ravel()), order[:, t])
                    counts[size][t] += np.bincount(at, minlength=counts[size].shape[1])
        for size, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(c.size, size)), pa.array(np.arange(c.size)), pa.array(c.ravel())], ["size", "at", "n"])

    needed = 1
    sums: dict[int, np.ndarray] = {size: np.zeros(TRIALS * (2 * e.shape[1] + 1)) for size, e in ends.items()}
    for row in nodes.select("data").mapInArrow(run, "size long, at long, n long").groupBy("size", "at").agg(F.sum("n").alias("n")).collect():
        sums[row["size"]][row["at"]] = row["n"]
    for size, e in ends.items():
        below = sums[size].reshape(TRIALS, -1).cumsum(axis=1)
        between = np.empty(e.shape[1:])
        for t in range(TRIALS):
            at = np.searchsorted(np.sort(e[:, :, t].ravel()), e[:, :, t])
            between[:, t] = abs(below[t][at[0]] - below[t][at[1]])
        # the first half of the passes ranks the probes by what is between, the other one measures
        ranked = between[np.argsort(np.log1p(between[:, : TRIALS // 2]).mean(axis=1)), TRIALS // 2 :] < WINDOW
        for group in np.array_split(ranked, max(1, len(ranked) // GROUP)):
            meet = max(group.mean(), 0.5 / group.size)
            needed = max(needed, math.ceil(math.log(1 - recall) / math.log(1 - min(meet, 0.999))))
    return min(needed, 4095)


def projected(nodes: DataFrame, passes: int, kind: str, seed: int) -> DataFrame:
    """nodes: (key, data).  (pass, order, key, data): the sort key of each node in each pass; vectors of one length stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            data = b.column(1).to_pylist()
            sizes = np.array([len(d) for d in data])
            for size in np.unique(sizes):
                of = np.flatnonzero(sizes == size)
                x = unit([data[i] for i in of], kind)
                if size not in planes:
                    planes[size] = planes_of(seed, int(size), x.shape[1], passes)
                order = np.concatenate([sort_keys(x, planes[size][:, 64 * p : 64 * p + 1024]) for p in range(0, passes, 16)], axis=1)
                part = b.take(pa.array(of))
                for p in range(passes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), int(size) * 4096 + p)), pa.array(order[:, p]), *part.columns], ["pass", "order", "key", "data"])

    return nodes.mapInArrow(run, "pass long, order long, key string, data binary")


def near(keys: list[str], x: np.ndarray, group: np.ndarray, cosine: float, first: int = 0) -> tuple[list[str], list[str]]:
    """A forest of the links between vectors at most WINDOW apart in the same group; pairs of rows below first are known."""
    n = len(keys)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    single = x.astype(np.float32)
    for i in range(0, n, WINDOW):
        j, end = min(n, i + WINDOW), min(n, i + 2 * WINDOW)
        if end <= first:
            continue
        a, b = np.nonzero(single[i:j] @ single[i:end].T >= np.float32(cosine - 1e-5))
        a, b = a + i, b + i
        keep = (b > a) & (b - a <= WINDOW) & (b >= first) & (group[a] == group[b])
        a, b = a[keep], b[keep]
        while len(a):
            # of the pairs still apart, the first of each row is tried
            label = np.array([root(k) for k in range(i, end)])
            apart = label[a - i] != label[b - i]
            a, b = a[apart], b[apart]
            rows = np.unique(a, return_index=True)[1]
            hit = np.einsum("ij,ij->i", x[a[rows]], x[b[rows]]) >= cosine
            for k in rows[hit]:
                p, q = root(a[k]), root(b[k])
                if p != q:
                    parent[q] = p
                    left.append(keys[a[k]])
                    right.append(keys[b[k]])
            a, b = np.delete(a, rows), np.delete(b, rows)
    return left, right


FOUND = "a string, b string, border long, pass long, order long, key string, data binary"
_NAMES = ["a", "b", "border", "pass", "order", "key", "data"]


def scan(cosine: float, kind: str):
    """Over a sorted partition: links, and its first and last WINDOW rows for the borders before and after it."""

    def links(left: list[str], right: list[str]) -> pa.RecordBatch:
        n = len(left)
        return pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), *(pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], _NAMES)

    def border(rows: pa.RecordBatch, at: int) -> pa.RecordBatch:
        n = rows.num_rows
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.array(np.full(n, at)), *rows.columns], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tail, sent = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            if sent < WINDOW:
                yield border(b.slice(0, WINDOW - sent), part)
                sent += min(b.num_rows, WINDOW - sent)
            known = tail.num_rows if tail is not None else 0
            whole = pa.Table.from_batches([tail, b] if known else [b]).combine_chunks().to_batches()[0]
            yield from pairs(whole, known)
            tail = whole.slice(max(0, whole.num_rows - WINDOW))
        if tail is not None:
            yield border(tail, part + 1)

    def pairs(rows: pa.RecordBatch, known: int) -> Iterator[pa.RecordBatch]:
        group, keys, data = rows.column(0).to_numpy(), rows.column(2).to_pylist(), rows.column(3).to_pylist()
        size = np.array([len(d) for d in data])
        edge = np.flatnonzero(np.r_[True, size[1:] != size[:-1], True])
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            yield links(*near(keys[i:j], unit(data[i:j], kind), group[i:j], cosine, known - i))

    def over_border(table: pa.Table) -> pa.Table:
        rows = table.select(["pass", "order", "key", "data"]).sort_by([("pass", "ascending"), ("order", "ascending"), ("key", "ascending")]).combine_chunks()
        return pa.Table.from_batches([x for b in rows.to_batches() for x in pairs(b, 0)] or [links([], [])]).select(["a", "b"])

    return run, over_border


def links(nodes: DataFrame, ws: Workspace, cosine: float, recall: float, kind: str, seed: int = 5) -> DataFrame:
    """(a, b): verified links between nodes (key, data), a forest of each window's."""
    total = nodes.count()
    passes = measured_passes(nodes, total, cosine, recall, kind, seed)
    # a window must not reach beyond the next partition
    n = max(1, min(partitions(nodes.sparkSession), total * passes // (8 * WINDOW)))
    run, over_border = scan(cosine, kind)
    ordered = projected(nodes, passes, kind, seed).repartitionByRange(n, "pass", "order", "key").sortWithinPartitions("pass", "order", "key")
    found = ws.save(ordered.mapInArrow(run, FOUND), "windows")
    borders = found.where("border is not null").groupBy("border").applyInArrow(over_border, "a string, b string")
    return found.where("a is not null").select("a", "b").unionAll(borders)


def count_links(members: DataFrame, ws: Workspace, cosine: float, kind: str) -> DataFrame:
    """members: a table (component, key, copies, data).  (key, n): copies of the other nodes of the component within the threshold.

    Every join is of two tables or of their plain shuffles, so that AQE can
    split a component that holds many of the vectors.
    """
    limit = math.acos(cosine)
    whole = ws.save(members.groupBy("component").agg(F.count("*").alias("size"), F.sum("copies").alias("all")), "whole")
    sized = members.join(whole, "component")
    pair = sized.where("size = 2").select("key", (F.col("all") - F.col("copies")).alias("n"))  # what joined them is their link
    pivot = ws.save(members.where("key = component").select("component", F.col("data").alias("pivot")), "pivot")
    many = ws.save(sized.where("size > 2").select("component", "key", "copies", "size", "data"), "many")

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, p = (np.array([unit([d], kind)[0] for d in b.column(i).to_pylist()]) for i in (4, 5))
            angle = np.arccos(np.einsum("ij,ij->i", x, p).clip(-1, 1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(angle, pa.float64())], ["component", "key", "copies", "size", "data", "angle"])

    rows = many.join(pivot, "component")
    rows = rows.mapInArrow(angles, "component string, key string, copies long, size long, data binary, angle double")
    # bins of a thousandth of a radian; what is sure of two bins is sure of all their vectors
    rows = ws.save(rows.withColumn("bin", F.when(F.col("size") > BLOCK, F.floor(F.col("angle") * 1000)).otherwise(0)).drop("size"), "angles")
    bins = ws.save(rows.groupBy("component", "bin").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.sum("copies").alias("copies"), F.ceil(F.count("*") / BLOCK).alias("cuts")), "bins")
    other = bins.select("component", *(F.col(c).alias(f"{c}2") for c in ("bin", "low", "high", "copies", "cuts")))
    met = bins.join(other, "component").where((F.greatest("low", "low2") - F.least("high", "high2")) <= limit + SLACK)  # at most 3,142 bins a component
    sure = F.col("high") + F.col("high2") <= limit - SLACK
    all_of = ws.save(met.where(sure).groupBy("component", "bin").agg(F.sum("copies2").alias("n"), F.bool_or(F.col("bin") == F.col("bin2")).alias("own")), "sure")
    certain = rows.select("component", "bin", "key", "copies").join(all_of, ["component", "bin"]).select("key", (F.col("n") - F.when(F.col("own"), F.col("copies")).otherwise(0)).alias("n"))
    # the others are multiplied out in blocks of a bin, cut by the key's hash
    cut = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    some = met.where(~sure).select("component", "bin", "bin2", "cuts2", cut("cuts").alias("cut")).select("component", "bin", "bin2", "cut", cut("cuts2").alias("cut2"))
    some = ws.save(some, "blocks")
    dealt = rows.join(bins.select("component", "bin", "cuts"), ["component", "bin"]).withColumn("cut", F.pmod(F.xxhash64("key"), "cuts"))
    dealt = ws.save(dealt.select("component", "bin", "cut", "key", "copies", "data"), "dealt")
    place = ["component", "bin", "cut", "bin2", "cut2"]
    one = dealt.join(some, ["component", "bin", "cut"]).select(*place, F.lit(0).alias("side"), "key", "copies", "data")
    two = dealt.withColumnsRenamed({"bin": "bin2", "cut": "cut2"}).join(some, ["component", "bin2", "cut2"]).select(*place, F.lit(1).alias("side"), "key", "copies", "data")

    def multiply(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        a, b = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        keys, y = a["key"].to_pylist(), unit(b["data"].to_pylist(), kind)
        if not len(keys) or not len(y):
            return pa.table({"key": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        n = ((unit(a["data"].to_pylist(), kind) @ y.T >= cosine) * b["copies"].to_numpy()[None, :]).sum(axis=1)
        same = dict(zip(b["key"].to_pylist(), b["copies"].to_pylist(), strict=True))
        n -= np.array([same.get(k, 0) for k in keys])
        return pa.table({"key": keys, "n": pa.array(n, pa.int64())})

    counted = one.unionAll(two).groupBy(*place).applyInArrow(multiply, "key string, n long")
    return pair.unionAll(certain).unionAll(counted).groupBy("key").agg(F.sum("n").cast("long").alias("n"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, recall: float = 0.97) -> DataFrame:
    """(vec, n_links, component, kept): one row a row of vectors; see the module for what is exact."""
    ws = Workspace(vectors.sparkSession, "embeddings")
    kind = "<f4" if vectors.schema[vec_col].dataType.elementType == T.FloatType() else "<f8"
    rows = ws.save(clean(vectors, id_col, vec_col), "rows")
    groups = rows.where("key is not null").groupBy("key").agg(F.min("vec").alias("least"), F.count("*").alias("copies"))
    data = rows.select("key", "vec", "data").join(groups.select("key", F.col("least").alias("vec")), ["key", "vec"], "left_semi").dropDuplicates(["key"]).select("key", "data")
    nodes = ws.save(groups.join(data, "key"), "nodes")
    label = components(links(nodes.select("key", "data"), ws, cosine, recall, kind), ws).withColumnRenamed("node", "key")
    members = ws.save(nodes.join(label, "key"), "members")
    counts = ws.save(count_links(members, ws, cosine, kind), "counts")
    least = ws.save(members.groupBy("component").agg(F.min("least").alias("first")), "least")
    known = members.join(least, "component").select("key", "first")
    each = nodes.select("key", "least", "copies").join(known, "key", "left").join(counts, "key", "left")
    each = each.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "least").alias("component"))
    each = ws.save(each, "links")
    out = rows.select("vec", "key").join(each, "key", "left")
    component = F.coalesce("component", "vec")
    return out.select("vec", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("vec") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


#: All pairs; for tables up to some thousand vectors.
ORACLE = """
WITH RECURSIVE ok AS (
    SELECT vec_id, embedding::DOUBLE[] AS e, len(embedding) AS n FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  unit AS (SELECT vec_id, n, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM ok),
  pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.n = b.n AND a.vec_id <> b.vec_id WHERE list_dot_product(a.u, b.u) >= 0.9),
  reach(a, b) AS (SELECT vec_id, vec_id FROM ok UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
  least AS (SELECT a, min(b) AS component FROM reach GROUP BY a),
  links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN links ON links.a = vec_id
"""
