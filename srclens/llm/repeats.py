"""What the two operators on long repeated passages share: content-defined runs and where they stand.

A window is ``width`` consecutive units (bytes or words).  Each window has an
anchor, the smallest hash of the runs of ``gram`` units in it, so equal windows
have equal anchors.  Neighbouring windows with one anchor make a *run*, a path
that does not branch as long as its content is the same; a text has about
2 / (width - gram) runs a unit.  A run is known by its anchor and by a 128-bit
BLAKE2b digest of its bytes, taken from the text itself.  Only runs whose anchor
stands somewhere else too can hold a repeated window.

Texts are keyed by a 128-bit hash of their content, so that copies are worked
on once and ids may be null or repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, key_filter, may_hold, partitions
from .rolling import _MASK, BYTE, PIECE, WHITE, blocks, prefix, sliding_min, spans, text_buffer, windows, words

KEY = ["t1", "t2"]
#: The digest of a run's bytes.
NAME = ["c1", "c2"]
RUN = ["anchor", *NAME]
#: What ``shared`` knows of a row: nothing, that its anchor stands twice, or that it only says so of its anchor.
OPEN, SURE, TOKEN = 0, 1, 2
#: Windows in a run at most; a longer one is cut.
LONGEST = 4096


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, t1, t2, text as bytes)"""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.cast("binary").alias("text"))


class Units:
    """Units of texts that stand end to end: a value each, each text's end among them, and the bytes of any span of them."""

    __slots__ = ("begin", "data", "end", "ends", "values")

    def __init__(self, values: np.ndarray, ends: np.ndarray, data: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None):
        """begin, end: where each unit stands in data; one byte a unit where not given."""
        self.values, self.ends, self.data, self.begin, self.end = values, ends, data, begin, end

    def digests(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The digests of the units [a, b), two words each."""
        low, high = (a, b) if self.begin is None else (self.begin[a], self.end[b - 1])
        view = memoryview(np.ascontiguousarray(self.data))
        found = [hashlib.blake2b(view[x:y], digest_size=16).digest() for x, y in zip(low.tolist(), high.tolist(), strict=True)]
        return np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)


def byte_units(data: np.ndarray, ends: np.ndarray) -> Units:
    """Each byte a unit."""
    return Units(BYTE[data], ends, data)


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text cut before white space into pieces of about PIECE bytes."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data):
            white = np.flatnonzero(WHITE[data[end : end + PIECE]])
            end = end + int(white[0]) if len(white) else min(len(data), end + PIECE)
            if len(white):
                break
        yield data[at:end]
        at = end


def _words(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(value, begin, end, bytes, place): each word, its place in the words joined by one blank, those, and its place in data."""
    start, stop = words(data)
    keep = ~WHITE[data]
    keep[1:] |= keep[:-1].copy()  # the first white space behind a word
    flat = np.where(WHITE[data], np.uint8(32), data)[keep]
    begin = np.cumsum(keep)[start] - 1 if len(start) else start
    return spans(prefix(BYTE[data]), start, stop), begin, begin + (stop - start), flat, start


def word_units(data: np.ndarray, ends: np.ndarray) -> Units:
    """Each word a unit; the bytes of a span are its words, joined by one blank."""
    if len(ends) == 1:
        found = [_words(piece) for piece in pieces(data)] or [_words(data)]
        at = np.cumsum([0, *(len(f[3]) + 1 for f in found)])
        flat = np.concatenate([np.append(f[3], np.uint8(32)) for f in found])
        values, begin, end = (np.concatenate([f[k] + (at[i] if k else np.uint64(0)) for i, f in enumerate(found)]) for k in (0, 1, 2))
        if len(found) > 1:  # a piece that ends in white space would leave two blanks
            keep = ~WHITE[flat]
            keep[1:] |= keep[:-1].copy()
            place = np.cumsum(keep) - 1
            flat, begin, end = flat[keep], place[begin], place[end - 1] + 1
        return Units(values, np.array([len(values)]), flat, begin, end)
    gaps = np.full(len(data) + len(ends), 32, np.uint8)  # texts stand end to end: a blank between them keeps words apart
    gaps[np.arange(len(data)) + np.searchsorted(ends, np.arange(len(data)), "right")] = data
    values, begin, end, flat, start = _words(gaps)
    return Units(values, np.searchsorted(start, ends + np.arange(len(ends))), flat, begin, end)


def runs_of(units: Units, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, n, anchor, digest, twice) of all runs; start counts from the text's first unit, n is the number of windows."""
    values, ends = units.values, units.ends
    reach = width - gram + 1
    h = windows(values, gram)
    low = sliding_min(h, reach)
    if not len(low):
        e = np.zeros(0, np.int64)
        return e, e, e, e.view(np.uint64), e.reshape(0, 2), e.astype(bool)
    begins = np.concatenate([[0], ends[:-1]])
    new = np.r_[True, low[1:] != low[:-1]]
    new[begins[begins < len(low)]] = True
    a = np.flatnonzero(new)
    text = np.searchsorted(ends, a, "right")
    b = np.minimum(np.r_[a[1:], len(low)], np.maximum(ends[text] - width + 1, a))
    a, b, text = a[b > a], b[b > a], text[b > a]
    if len(a) and (b - a).max() > LONGEST:
        cuts = -(-(b - a) // LONGEST)
        place = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        a, b, text = np.repeat(a, cuts) + LONGEST * place, np.repeat(b, cuts), np.repeat(text, cuts)
        b = np.minimum(b, a + LONGEST)
    return text, a - begins[text], b - a, low[a], units.digests(a, b + width - 1), _twice(h, low, a, b, reach)


def _twice(h: np.ndarray, low: np.ndarray, a: np.ndarray, b: np.ndarray, reach: int) -> np.ndarray:
    """Whether the smallest hash of the windows [a, b) stands in them more than once; no for a single window."""
    out = np.zeros(len(a), bool)
    pick = np.flatnonzero(b > a + 1)
    if not len(pick):
        return out
    edge = np.full(reach - 1, _MASK, np.uint64)
    least = np.flatnonzero(h == ~sliding_min(np.concatenate([edge, ~low, edge]), reach))  # the smallest of some window
    first, last = np.searchsorted(least, a[pick]), np.searchsorted(least, b[pick] + reach - 1)
    size = last - first
    begin = np.cumsum(size) - size
    at = least[np.arange(size.sum()) + np.repeat(first - begin, size)]
    out[pick] = np.add.reduceat(h[at] == np.repeat(low[a[pick]], size), begin, dtype=np.int64) > 1
    return out


LONGS = pa.int64()


def run_rows(anchor: np.ndarray, digest: np.ndarray, keys: list[pa.Array], doc: pa.Array, copies: np.ndarray, start: np.ndarray, n: np.ndarray, twice: np.ndarray) -> pa.RecordBatch:
    """Rows of a batch's runs, with what the batch alone tells of their anchors, and a row a known anchor that says so."""
    kinds, of = np.unique(anchor, return_inverse=True)
    many = (np.bincount(of, copies, len(kinds)) > 1) | (np.bincount(of, twice, len(kinds)) > 0)
    told = pa.array(kinds[many].view(np.int64))
    k = len(told)
    both = lambda c, kind=LONGS: pa.concat_arrays([c, pa.nulls(k, kind)])
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([pa.array(anchor.view(np.int64)), told])]
        + [both(pa.array(np.ascontiguousarray(digest[:, i]))) for i in (0, 1)]
        + [both(c) for c in keys]
        + [both(doc, doc.type), pa.array(np.r_[copies, np.full(k, 2)].astype(np.int64)), both(pa.array(start)), both(pa.array(n)), pa.array(np.r_[twice, np.zeros(k, bool)])]
        + [pa.array(np.r_[np.where(many[of], SURE, OPEN), np.full(k, TOKEN)].astype(np.int64))],
        [*RUN, *KEY, "doc", "copies", "start", "n", "twice", "known"],
    )


def run_schema(doc: T.DataType) -> T.StructType:
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    return T.StructType([*longs(*RUN, *KEY), T.StructField("doc", doc), *longs("copies", "start", "n"), T.StructField("twice", T.BooleanType()), *longs("known")])


def runs(rows: DataFrame, width: int, gram: int, units: Callable) -> DataFrame:
    """rows: (doc, t1, t2, text).  The runs of every text: (anchor, c1, c2, t1, t2, doc, copies, start, n, twice, known).

    Copies in one batch give their runs once, with their number and smallest id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b.select([0, 1, 2])]).append_column("row", pa.array(np.arange(b.num_rows)))
            once = t.group_by(KEY).aggregate([("doc", "min"), ("row", "min"), ("row", "count")]).sort_by("row_min")
            data, offsets = text_buffer(b.column(3).take(once["row_min"].combine_chunks()))
            found = []
            for first, last in blocks(offsets):
                if last - first == 1 and offsets[last] - offsets[first] > PIECE and units is byte_units:
                    for s in range(int(offsets[first]), int(offsets[last]), PIECE):  # each window stands in one piece
                        e = min(int(offsets[last]), s + PIECE + width - 1)
                        r = list(runs_of(units(data[s:e], np.array([e - s])), width, gram))
                        found.append([r[0] + first, r[1] + (s - offsets[first]), *r[2:]])
                else:
                    r = runs_of(units(data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first]), width, gram)
                    found.append([r[0] + first, *r[1:]])
            if found:
                text, start, n, anchor, digest, twice = (np.concatenate(x) for x in zip(*found, strict=True))
                of = pa.array(text)
                t1, t2, doc, copies = (pc.take(once[c].combine_chunks(), of) for c in (*KEY, "doc_min", "row_count"))
                yield run_rows(anchor, digest, [t1, t2], doc, copies.to_numpy(), start, n, twice)

    return rows.mapInArrow(run, run_schema(rows.schema["doc"].dataType))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by anchor: those whose anchor stands twice at least.  One row is held at most."""
    held, passed = None, None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        anchor, copies, known = (b.column(k).to_numpy() for k in (0, 6, 10))
        twice = b.column(9).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        good = (np.add.reduceat(np.where(known == OPEN, copies, 2), edge) > 1) | np.logical_or.reduceat(twice, edge)
        good[0] |= passed is not None and anchor[0] == passed
        passed, held = (anchor[-1], None) if good[-1] else (None, b.slice(b.num_rows - 1))
        yield b.filter(pa.array(np.repeat(good, np.diff(np.r_[edge, b.num_rows])) & (known != TOKEN)))


def shared(all_runs: DataFrame) -> DataFrame:
    """The runs whose anchor stands more than once.

    Rows of which their own batch knows it are dealt out by text, and one row a
    batch says it of their anchor: an anchor of any number of runs sends a
    bounded number of rows a batch to the task that decides.
    """
    n = partitions(all_runs.sparkSession)
    to = F.when(F.col("known") == SURE, F.col("t1")).otherwise(F.col("anchor"))
    return all_runs.repartition(n, to).sortWithinPartitions("anchor").mapInArrow(_shared, all_runs.schema).drop("known")


def contents(some_runs: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """(anchor, c1, c2, copies, doc, at, twice, n, kinds, size): each distinct run once, with one place where it stands.

    kinds: distinct contents of its anchor; size: windows of all of them together.
    Both tables are written first, so that AQE can split a hot anchor in their join.
    """
    each = some_runs.groupBy(*RUN).agg(F.sum("copies").alias("copies"), F.min("doc").alias("doc"), F.min(F.struct(*KEY, "start")).alias("at"), F.max("twice").alias("twice"), F.max("n").alias("n"))
    each = ws.save(each, f"{name}-each")
    of = ws.save(each.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("size")), f"{name}-of")
    out = ws.save(each.join(of, "anchor"), name)
    ws.drop(f"{name}-each", f"{name}-of")
    return out


def one_per_text(rows: DataFrame, wanted: DataFrame | None = None, most: int = 1 << 20) -> DataFrame:
    """rows less the copies that a task has already sent: pre-aggregation before a shuffle by text.

    wanted: a table of keys (t1, t2); rows that are surely none of them go too,
    so that a join with it shuffles few texts in vain.
    """
    words = None if wanted is None else key_filter(wanted.select(*KEY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            if words is not None:
                b = b.filter(pa.array(may_hold(words, b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False))))
            new = []
            for k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                new.append(k not in seen)
                seen.add(k)
            if len(seen) > most:
                seen.clear()
            yield b.filter(pa.array(new, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def with_text(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t1, t2, text, wanted): each text with a list of what is wanted of it, once but for copies that different tasks hold."""
    per_text = wanted.groupBy(*KEY).agg(F.collect_list(F.struct(*[c for c in wanted.columns if c not in KEY])).alias("wanted"))
    return one_per_text(rows, wanted).select(*KEY, "text").join(per_text, KEY).dropDuplicates(KEY)


def union_of(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges [a, b) that cover the same units and don't touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
