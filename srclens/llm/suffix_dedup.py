"""Suffix-array dedup (operator 10): byte strings that stand twice, by difference-cover suffix sorting.

The suffixes are dealt out by the anchor of their ``width``-byte window: equal
windows have equal anchors, so what must become neighbours in suffix order is
always dealt to the same sort.  Runs whose anchor stands once hold no repeat and
are left out; equal runs (by a 128-bit digest of their bytes) are sorted once,
with their number.  Each task then takes whole anchors, a bounded number of
bytes at a time, sorts the sampled suffixes by triples, recurses on their names,
merges the remaining suffixes and compares the first ``width`` bytes of
neighbours, byte for byte.

An anchor with more different bytes than a task sorts at a time is dealt anew
first, by what its windows share: windows at one place relative to the anchor,
``STEPS`` of them together, by a hash of the bytes that all of them hold.  What
stands alone then falls away, and the rest is sorted in the same way.

Defined results.  Null text is empty text.  A text under ``width`` bytes loses
nothing.  Repeated rows are copies of each other whatever their ids, which may
be null.  A position counts as elsewhere also within the same text, overlaps
included.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, partitions
from .repeats import KEY, NAME, RUN, byte_units, contents, keyed, run_rows, run_schema, runs, shared, with_text
from .rolling import BYTE, PIECE, blocks, windows
from .suffix_sort import suffix_array

WIDTH, GRAM = 400, 128
#: Bytes sorted at a time; an anchor of more is dealt anew.
SORT_BYTES = 1 << 20
#: Windows dealt together when an anchor is dealt anew, and when that was not enough.  Single windows leave nothing to tell apart.
STEPS = (16, 1)
#: Bytes of results handed on together.
FLUSH = 1 << 22
RANGES = "c1 long, c2 long, ranges array<struct<a: long, b: long>>"
PAIRS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _alike(read: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x, y), ascending by x, whose windows are equal byte for byte; read: ``size`` bytes from each place on.

    Pairs at one distance that follow one another share all but a byte, so a
    stretch of them is compared once; pairs of a stretch with a difference, each alone.
    """
    if not len(x):
        return x, y
    first = np.flatnonzero(np.r_[True, (np.diff(x) != 1) | (np.diff(y) != 1)])
    n = np.diff(np.r_[first, len(x)])
    words = -(-(n + width - 1) // size)
    good = np.empty(len(first), bool)
    for i, j in blocks(np.r_[0, np.cumsum(words)], PIECE >> 3):
        w = words[i:j]
        begin = np.cumsum(w) - w
        step = np.minimum(size * (np.arange(w.sum()) - np.repeat(begin, w)), np.repeat(n[i:j] + (width - 1 - size), w))
        good[i:j] = np.logical_and.reduceat(read[np.repeat(x[first[i:j]], w) + step] == read[np.repeat(y[first[i:j]], w) + step], begin)
    good = np.repeat(good, n)
    a, b = x[~good], y[~good]
    for step in [width - size, *range(0, width - size, size)]:
        same = read[a + step] == read[b + step]
        if not same.all():
            a, b = a[same], b[same]
    return np.r_[x[good], a], np.r_[y[good], b]


def repeated(texts: list[bytes], many: list[bool], width: int) -> list[np.ndarray]:
    """For each text, for each of its windows: whether the window also starts elsewhere in the texts, or the text has copies."""
    # symbol 0 parts the texts, so that no window of a text equals one that reaches over its end
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    raw = b"\0".join(texts) + bytes(9)
    joined = np.frombuffer(raw, np.uint8)[: at[-1]].astype(np.uint16) + 1
    joined[at[1:] - 1] = 0
    order = suffix_array(joined)
    starts = np.zeros(len(joined), bool)
    for t, a in zip(texts, at, strict=False):
        starts[a : a + len(t) - width + 1] = True
    order = order[starts[order]]
    x, y = order[:-1], order[1:]
    # adjacent prefixes, eight bytes at a time: the first and last of each pair, then whole stretches of neighbouring pairs
    size = 8 if width >= 8 else 1
    read = np.ndarray((len(raw) - size + 1,), f"<u{size}", raw, 0, (1,))
    for step in (width - size, 0):
        same = read[x + step] == read[y + step]
        x, y = x[same], y[same]
    other = np.full(len(joined), -1)
    other[x] = y
    x = np.flatnonzero(other >= 0)
    y = other[x]
    x, y = _alike(read, x, y, width, size)
    twice = np.zeros(len(joined), bool)
    twice[x] = twice[y] = True
    return [twice[a : a + len(t) - width + 1] | m for t, a, m in zip(texts, at, many, strict=False)]


def as_ranges(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def sort_anchors(width: int, limit: int):
    """Over rows (anchor, c1, c2, copies, bytes) sorted by anchor, to RANGES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and row[0] != held[-1][0] and size > limit:
                    yield sorted_(held)
                    held, size = [], 0
                if held and row[:3] == held[-1][:3]:
                    continue
                held.append(row)
                size += len(row[4])
        if held:
            yield sorted_(held)

    def sorted_(held: list[tuple]) -> pa.RecordBatch:
        flags = repeated([h[4] for h in held], [h[3] > 1 for h in held], width)
        return pa.RecordBatch.from_arrays([pa.array([h[1] for h in held]), pa.array([h[2] for h in held]), pa.array([as_ranges(f) for f in flags], PAIRS)], [*NAME, "ranges"])

    return run


def cut_bytes(texts: DataFrame, width: int) -> DataFrame:
    """(t1, t2, text, wanted) to (anchor, c1, c2, copies, bytes): the bytes of each wanted run."""
    names = [*RUN, "copies"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols, cut, size = [[] for _ in names], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(cut, pa.binary())], [*names, "bytes"])

        for b in batches:
            for text, wanted in zip(b.column(2), b.column(3), strict=True):
                whole = text.as_py()
                for r in wanted.as_py():
                    for col, c in zip(cols, names, strict=True):
                        col.append(r[c])
                    cut.append(whole[r["start"] : r["start"] + r["n"] + width - 1])
                    size += len(cut[-1])
                    if size > FLUSH:
                        yield out()
                        cols, cut, size = [[] for _ in names], [], 0
        yield out()

    return texts.mapInArrow(run, "anchor long, c1 long, c2 long, copies long, bytes binary")


def runs_anew(over: DataFrame, width: int, gram: int, step: int) -> DataFrame:
    """over: (anchor, c1, c2, copies, bytes).  As ``repeats.runs``, of runs keyed by their own digest: ``step`` windows that stand alike relative to their anchor together.

    The new anchor is a hash of the old one, of that place and of the bytes that any such windows share.
    """
    step = min(step, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, keys = [], []
            for anchor, c1, c2, copies, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = np.frombuffer(text, np.uint8)
                last = len(data) - width + 1
                first = np.arange(last)
                if step > 1:  # the anchor of the first dealing: where it stands in each window
                    at = np.flatnonzero(windows(BYTE[data], gram).view(np.int64) == anchor)
                    first = at[np.searchsorted(at, first)]
                block = (first - np.arange(last)) // step
                edge = np.flatnonzero(np.r_[True, (np.diff(first) != 0) | (np.diff(block) != 0)])
                for s, e in zip(edge.tolist(), [*edge[1:].tolist(), last], strict=True):
                    low = int(first[s]) - step * int(block[s])
                    core = text[low : low + width - step + 1]
                    new = hashlib.blake2b(core, digest_size=8, key=f"{anchor} {block[s]}".encode()).digest()
                    name = hashlib.blake2b(text[s : e + width - 1], digest_size=16).digest()
                    rows.append((int.from_bytes(new), np.frombuffer(name, np.int64), copies, s, e - s))
                    keys.append((c1, c2))
            if rows:
                anchors, digests, copies, start, n = zip(*rows, strict=True)
                t1, t2 = (pa.array(c, pa.int64()) for c in zip(*keys, strict=True))
                yield run_rows(np.array(anchors, np.uint64), np.array(digests), [t1, t2], pa.nulls(len(rows), pa.int64()), np.array(copies), np.array(start), np.array(n), np.zeros(len(rows), bool))

    return over.mapInArrow(run, run_schema(T.LongType()))


def repeated_ranges(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, limit: int = SORT_BYTES) -> DataFrame:
    """(t1, t2, ranges): where the windows start that also start elsewhere, per text that has one."""
    return _ranges(rows, runs(rows, width, gram, byte_units), Workspace(rows.sparkSession, "suffix-dedup"), width, gram, limit, 0)


def _ranges(rows: DataFrame, all_runs: DataFrame, ws: Workspace, width: int, gram: int, limit: int, level: int) -> DataFrame:
    """rows: (doc, t1, t2, text), all_runs: their runs.  (t1, t2, ranges): see ``repeated_ranges``; level: how often the anchors were dealt anew."""
    n, name = partitions(rows.sparkSession), lambda x: f"{x}{level}"
    kept = ws.save(shared(all_runs), name("runs"))
    each = contents(kept, ws, name("contents"))
    alone = F.expr("kinds = 1 and not twice")  # one content, in several places: its windows are repeated as a whole
    size = F.col("size") + F.col("kinds") * (width - 1)
    large = (size > limit) if level < len(STEPS) else F.lit(False)
    wanted = each.where(~alone).select(F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2"), F.col("at.start").alias("start"), *RUN, F.least("copies", F.lit(2)).alias("copies"), "n", large.alias("large"))
    pieces = cut_bytes(with_text(rows, wanted.where("not large")), width)
    done = ws.save(pieces.repartition(n, "anchor").sortWithinPartitions(*RUN).mapInArrow(sort_anchors(width, limit), RANGES), name("sorted"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))).alias("ranges")
    parts = done.where(F.size("ranges") > 0).unionAll(each.where(alone).select(*NAME, whole))
    if level < len(STEPS) and not wanted.where("large").isEmpty():
        over = ws.save(cut_bytes(with_text(rows, wanted.where("large")), width), name("over"))
        texts = over.select(F.lit(None).cast("long").alias("doc"), F.col("c1").alias("t1"), F.col("c2").alias("t2"), F.col("bytes").alias("text"))
        inner = _ranges(texts, _anew(over, width, gram, level), ws, width, gram, limit, level + 1)
        parts = parts.unionAll(inner.select(F.col("t1").alias("c1"), F.col("t2").alias("c2"), "ranges"))
    # one row a place: AQE splits the places of a hot content, whose other side is one row
    places = kept.select(*NAME, *KEY, "start").join(parts, NAME)
    shifted = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("start")).alias("a"), (r["b"] + F.col("start")).alias("b")))
    out = places.groupBy(*KEY).agg(F.flatten(F.collect_list(shifted)).alias("ranges"))
    out = ws.save(out, name("ranges"))
    ws.drop(name("runs"), name("contents"), name("sorted"), name("over"))
    return out


def _anew(over: DataFrame, width: int, gram: int, level: int) -> DataFrame:
    """The runs of ``over``, dealt anew."""
    return runs_anew(over.select(*RUN, "copies", "bytes"), width, gram, STEPS[level])


def spans_of(ranges: pa.ListArray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ranges: per text the ranges [a, b) of its windows, or null.  (text, a, b): sorted ranges of bytes that cover the same windows and don't touch."""
    text = np.repeat(np.arange(len(ranges)), pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False))
    lo, hi = (ranges.flatten().field(c).to_numpy() for c in ("a", "b"))
    base = (np.cumsum(lengths.astype(np.int64) + 1) - lengths - 1)[text]  # a byte between texts, so that none touch
    order = np.argsort(base + lo, kind="stable")
    text, base, lo, hi = text[order], base[order], (base + lo)[order], np.maximum.accumulate((base + hi + (width - 1))[order])
    first = np.r_[True, lo[1:] > hi[:-1]][: len(lo)]
    last = np.r_[first[1:], True][: len(lo)]
    return text[first], (lo - base)[first], (hi - base)[last]


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, limit: int = SORT_BYTES, texts: bool = True) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256, spans, kept): one row a row of docs.

    spans: the removed ranges of bytes.  kept: the bytes that are left, null if not texts.
    """
    rows = keyed(docs, id_col, text_col)
    joined = rows.join(repeated_ranges(rows, width, gram, limit), KEY, "left").select("doc", "text", "ranges")

    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, lo, hi = spans_of(b.column(2), pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False), width)
            at = np.searchsorted(of, np.arange(b.num_rows + 1))
            gone = np.r_[0, np.cumsum(hi - lo)]
            spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], ["a", "b"]))
            lo, hi, first, size, out = lo.tolist(), hi.tolist(), 0, 0, []
            for i, (s, e) in enumerate(itertools.pairwise(at.tolist())):
                text = b.column(1)[i].as_py()
                n = len(text)
                if s < e:
                    view = memoryview(text)
                    text = b"".join([view[x:y] for x, y in zip([0, *hi[s:e]], [*lo[s:e], n], strict=True)])
                out.append((n, int(gone[e] - gone[s]), e - s, hashlib.sha256(text).hexdigest(), text if texts else None))
                size += len(text) if texts else 0
                if size > FLUSH or i + 1 == b.num_rows:
                    cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(out)), *cols[:-1], spans.slice(first, len(out)), cols[-1]], names)
                    first, size, out = i + 1, 0, []

    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    span = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    fields = [T.StructField("doc", docs.schema[id_col].dataType), *longs, T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType())]
    return joined.mapInArrow(run, T.StructType(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: All windows as hashes of their bytes, two hexadecimal digits a byte.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
  windows AS (SELECT doc_id, p, md5_number(substr(x, 2 * p - 1, 800)) AS h FROM (SELECT doc_id, x, unnest(range(1, n - 398)) AS p FROM d WHERE n >= 400)),
  often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
  hit AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS island FROM windows JOIN often USING (h)),
  runs AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM hit GROUP BY doc_id, island),
  marked AS (SELECT *, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before FROM runs),
  cut AS (SELECT *, a > before OR a = 1 AS fresh FROM marked),
  spans AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM cut) GROUP BY doc_id, k),
  edges AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER w, n + 1) AS b FROM (SELECT doc_id, a, b, n FROM spans JOIN d USING (doc_id) UNION ALL SELECT doc_id, 0, 1, n FROM d) WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
  kept AS (SELECT doc_id, string_agg(substr(x, 2 * a - 1, 2 * (b - a)), '' ORDER BY a) AS x FROM edges JOIN d USING (doc_id) GROUP BY doc_id),
  gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.x)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)
"""
