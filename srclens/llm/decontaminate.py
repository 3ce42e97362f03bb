"""Benchmark decontamination (operator 5) over a distributed positional inverted index.

1. The benchmark is taken in blocks of at most ``BLOCK_BYTES`` of text (an item
   is never cut), so that the driver and the tasks hold the words and windows of
   one block alone, as arrays of numbers.
2. A pass over the documents counts the vocabulary's words in the corpus.
3. A second pass stores the postings (term, text, position) of the two rarest
   terms of each window.
4. Each window's candidates are the intersection of these two lists, both
   shifted by the term's offset: an equality join on (term, text, position).
5. The postings of all terms are stored where candidates stand, from the texts
   that have one, and each candidate's remaining lists are intersected: what has
   a posting at every offset is a match.  No text is compared.

``matches`` with a slop also returns proximity matches: the two rarest terms
meet in bins of positions, and a span that holds all of a window's terms, in any
order, among at most ``slop`` other words is a match.

Texts are keyed by a 128-bit hash of their content, so copies share postings.

Defined results.  Null and wordless texts have no words and no hits; items
without words or without id give no window.  Repeated rows each get their row.
Ids may be null or repeat.  Other columns are not read.  No words or no items:
every row with zeros.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace
from .repeats import one_per_text

BLOCK_BYTES = 8 << 20
#: Bytes of a text that are cut into words at a time.
CHUNK = 1 << 21
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
KEY = ["t1", "t2"]


def words_of(text: bytes | None) -> Iterator[tuple[int, list[bytes]]]:
    """The lower-cased words of a text with the index of the first, a bounded piece at a time."""
    text, at, base = text or b"", 0, 0
    while at < len(text):
        piece = text[at : at + CHUNK].translate(_KEEP)
        if at + CHUNK < len(text) and (cut := piece.rfind(b" ")) > 0:
            piece = piece[:cut]
        elif at + CHUNK < len(text):  # one word longer than a piece
            whole = text[at:].translate(_KEEP)
            piece = whole[: cut if (cut := whole.find(b" ", CHUNK)) > 0 else len(whole)]
        at += len(piece)
        words = piece.split()
        yield base, words
        base += len(words)


class Windows:
    """The windows of one block of items: driver-side arrays of a bounded size.

    windows: a row of vocabulary ids each, -1 beyond the end of a short one.
    """

    def __init__(self, items: list[tuple[object, bytes | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        rows, of = [np.zeros((0, n), np.int32)], []
        for k, (_, text) in enumerate(items):
            words = [w for _, part in words_of(text) for w in part]
            ids = np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words), np.int32, len(words))
            if len(ids):
                ids = np.concatenate([ids, np.full(max(0, n - len(ids)), -1, np.int32)])
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, n))
                of += [k] * len(rows[-1])
        self.windows, window = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.items = sorted({(int(w), str(items[k][0])) for w, k in zip(window.ravel(), of, strict=True)})

    def seeds(self, spark: SparkSession, counts: np.ndarray) -> tuple[DataFrame, set[int]]:
        """(window, size, ids, term, shift, term2, shift2) and all of those terms: the rarest term and the next rarest other one, null if there is none."""
        ids = self.windows
        order = np.argsort(np.where(ids < 0, np.iinfo(np.int64).max, counts[ids]), axis=1, kind="stable")
        ranked = np.take_along_axis(ids, order, axis=1)
        other = (ranked != ranked[:, :1]) & (ranked >= 0)
        second, has = other.argmax(axis=1), other.any(axis=1)
        rows = np.arange(len(ids))
        term2, shift2 = ranked[rows, second], order[rows, second]
        size = (ids >= 0).sum(axis=1)
        flat = pa.ListArray.from_arrays(pa.array(np.r_[0, size.cumsum()], pa.int32()), pa.array(ids[ids >= 0], pa.int64()))
        cols = [pa.array(rows, pa.int64()), pa.array(size, pa.int64()), flat, pa.array(ranked[:, 0], pa.int64()), pa.array(order[:, 0], pa.int64())]
        cols += [pa.array(c, pa.int64(), mask=~has) for c in (term2, shift2)]
        table = pa.table(cols, ["window", "size", "ids", "term", "shift", "term2", "shift2"])
        return spark.createDataFrame(table), set(ranked[:, 0].tolist()) | set(term2[has].tolist())


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> Iterator[Windows]:
    """Streams the items to the driver, a bounded block at a time."""
    block, size = [], 0
    rows = benchmark.where(F.col(id_col).isNotNull()).select(id_col, F.col(text_col).cast("binary"))
    for item, text in rows.toLocalIterator(prefetchPartitions=False):
        block.append((item, bytes(text or b"")))
        size += len(text or b"")
        if size >= BLOCK_BYTES:
            yield Windows(block, n)
            block, size = [], 0
    if block:
        yield Windows(block, n)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("second"), text).alias("t2"), text.cast("binary").alias("text"))


def count_terms(rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, t1, t2, n_words) a row, and (term, n) of each batch beside them."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, n_words = Counter(), []
            for text in b.column(3):
                n = 0
                for _, words in words_of(text.as_py()):
                    n += len(words)
                    counts.update(words)
                n_words.append(n)
                if len(counts) > 1 << 18:
                    counts = Counter({w: c for w, c in counts.items() if w in vocabulary})
            total = np.zeros(size, np.int64)
            for w in counts.keys() & vocabulary.keys():
                total[vocabulary[w]] = counts[w]
            terms = np.flatnonzero(total)
            rows, more = len(n_words), len(terms)
            both = lambda c, kind: pa.concat_arrays([c, pa.nulls(more, kind)])
            yield pa.RecordBatch.from_arrays(
                [both(b.column(0), b.column(0).type), both(b.column(1), pa.int64()), both(b.column(2), pa.int64()), both(pa.array(n_words, pa.int64()), pa.int64())]
                + [pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(x, pa.int64())]) for x in (terms, total[terms])],
                ["doc", "t1", "t2", "n_words", "term", "n"],
            )

    fields = [T.StructField("doc", rows.schema["doc"].dataType)] + [T.StructField(c, T.LongType()) for c in ("t1", "t2", "n_words", "term", "n")]
    return rows.mapInArrow(run, T.StructType(fields))


def postings(rows: DataFrame, vocabulary: dict[bytes, int], terms: set[int]) -> DataFrame:
    """rows: (doc, t1, t2, text).  (term, t1, t2, pos): where each of the terms stands."""
    kept = np.zeros(len(vocabulary) + 1, bool)  # the last is for -1
    kept[list(terms)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, pos, of = [], [], []
            for i, text in enumerate(b.column(3)):
                for base, ids in ids_of(text.as_py(), vocabulary):
                    at = np.flatnonzero(kept[ids])
                    term.append(ids[at])
                    pos.append(at + base)
                    of.append(np.full(len(at), i))
            yield posting_rows(b, term, pos, of)

    return rows.mapInArrow(run, POSTINGS)


POSTINGS = "term long, t1 long, t2 long, pos long"


def ids_of(text: bytes | None, vocabulary: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray]]:
    """The vocabulary ids of a text's words, -1 for others, with the index of the first, a bounded piece at a time."""
    get = vocabulary.get
    for base, words in words_of(text):
        yield base, np.fromiter((get(w, -1) for w in words), np.int64, len(words))


def posting_rows(b: pa.RecordBatch, term: list, pos: list, of: list) -> pa.RecordBatch:
    term, pos, of = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (term, pos, of))
    keys = [b.column(b.schema.get_field_index(c)).take(pa.array(of)) for c in KEY]
    return pa.RecordBatch.from_arrays([pa.array(term), *keys, pa.array(pos)], ["term", *KEY, "pos"])


def local_postings(rows: DataFrame, found: DataFrame, vocabulary: dict[bytes, int], ws: Workspace, name: str) -> DataFrame:
    """(term, t1, t2, pos): all vocabulary terms in the ranges [low, high) of positions of found (t1, t2, low, high)."""
    wanted = ws.save(found.groupBy(*KEY).agg(F.collect_set(F.struct("low", "high")).alias("wanted")), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, pos, of = [], [], []
            for i, (text, ranges) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                low, high = (ranges.values.field(c).to_numpy() for c in ("low", "high"))
                for base, ids in ids_of(text.as_py(), vocabulary):
                    cover = np.zeros(len(ids) + 1, np.int64)
                    inside = (low < base + len(ids)) & (high > base)
                    np.add.at(cover, np.maximum(low[inside] - base, 0), 1)
                    np.add.at(cover, np.minimum(high[inside] - base, len(ids)), -1)
                    at = np.flatnonzero((cover.cumsum()[:-1] > 0) & (ids >= 0))
                    term.append(ids[at])
                    pos.append(at + base)
                    of.append(np.full(len(at), i))
            yield posting_rows(b, term, pos, of)

    return one_per_text(rows, wanted).select(*KEY, "text").join(wanted, KEY).mapInArrow(run, POSTINGS)


def candidates(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """(window, size, t1, t2, start): where a window's two rarest terms both have a posting at their offset."""
    first = index.join(seeds, "term").where("pos >= shift").select("window", "size", *KEY, (F.col("pos") - F.col("shift")).alias("start"), "term2", "shift2")
    alone = first.where("term2 is null")
    both = first.where("term2 is not null").withColumn("pos", F.col("start") + F.col("shift2"))
    both = both.join(index.select(F.col("term").alias("term2"), *KEY, "pos"), ["term2", *KEY, "pos"], "left_semi")
    return both.select("window", "size", *KEY, "start").unionAll(alone.select("window", "size", *KEY, "start")).distinct()


def intersect(found: DataFrame, seeds: DataFrame, index: DataFrame) -> DataFrame:
    """found: candidates, index: postings of all their terms.  The candidates that have a posting of every term at its offset."""
    each = found.join(seeds.select("window", F.posexplode("ids").alias("offset", "term")), "window").withColumn("pos", F.col("start") + F.col("offset"))
    held = each.join(index, ["term", *KEY, "pos"], "left_semi").groupBy("window", "size", *KEY, "start").agg(F.count("*").alias("terms"))
    return held.where("terms = size").drop("terms")


def near_candidates(index: DataFrame, seeds: DataFrame, slop: int) -> DataFrame:
    """(window, size, t1, t2, pos): postings of a window's rarest term with one of its next rarest within size + slop words.

    Positions are cut into bins of the longest reach, so that partners meet by equality in the same bin or one beside it.
    """
    reach = seeds.agg(F.max("size")).first()[0] + slop
    first = index.join(seeds, "term").select("window", "size", *KEY, "pos", "term2")
    bins = F.explode(F.array(*(F.floor(F.col("pos") / reach) + d for d in (-1, 0, 1)))).alias("bin")
    both = first.where("term2 is not null").select("*", bins)
    there = index.select(F.col("term").alias("term2"), *KEY, F.col("pos").alias("other"), F.floor(F.col("pos") / reach).alias("bin"))
    both = both.join(there, ["term2", *KEY, "bin"]).where(F.abs(F.col("pos") - F.col("other")) < F.col("size") + slop)
    return both.select("window", "size", *KEY, "pos").unionAll(first.where("term2 is null").select("window", "size", *KEY, "pos")).distinct()


def spans_near(found: DataFrame, seeds: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    """found: of ``near_candidates``.  (window, size, t1, t2, start): the shortest span, the first of several, of at most size + slop words around each that holds all the window's terms as often as it does."""
    reach = F.col("size") + slop
    words = seeds.select("window", F.explode("ids").alias("term")).groupBy("window", "term").agg(F.count("*").alias("times"))
    kinds = words.groupBy("window").agg(F.count("*").alias("kinds"))
    # starts of spans: every place from which one could reach the posting
    at = found.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.col("pos") - reach + 1), F.col("pos"))).alias("start"))
    each = at.join(words, "window").select("window", "size", *KEY, "pos", "start", "term", "times")
    inside = index.select("term", *KEY, F.col("pos").alias("other")).distinct()
    held = each.join(inside, ["term", *KEY]).where((F.col("other") >= F.col("start")) & (F.col("other") < F.col("start") + reach))
    per_term = held.groupBy("window", "size", *KEY, "pos", "start", "term", "times").agg(F.sort_array(F.collect_list("other")).alias("others")).where(F.size("others") >= F.col("times"))
    last = F.expr("others[int(times) - 1]")
    span = per_term.groupBy("window", "size", *KEY, "pos", "start").agg(F.count("*").alias("n"), F.max(last).alias("last")).join(kinds, "window").where("n = kinds")
    length = F.struct((F.col("last") - F.col("start") + 1).alias("length"), "start")
    return span.groupBy("window", "size", *KEY, "pos").agg(F.min(length).alias("best")).select("window", "size", *KEY, F.col("best.start").alias("start"), F.col("best.length").alias("length")).distinct()


def covered(found: DataFrame) -> DataFrame:
    """found: (t1, t2, start, size).  (t1, t2, n_hit): the words in any of a text's windows, each once."""
    w = Window.partitionBy(*KEY).orderBy("start", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.greatest(F.col("start"), F.coalesce(F.max(F.col("start") + F.col("size")).over(w), F.lit(0)))
    new = F.greatest(F.lit(0), F.col("start") + F.col("size") - ahead)
    return found.withColumn("new", new).groupBy(*KEY).agg(F.sum("new").cast("long").alias("n_hit"))


def _blocks(rows: DataFrame, ws: Workspace, benchmark: DataFrame, item_col: str, item_text: str, n: int, slop: int | None) -> Iterator[tuple[DataFrame, DataFrame, DataFrame]]:
    """Per block of items its counts and number of words, matches (window, size, t1, t2, start, length), and (window, item)."""
    spark = rows.sparkSession
    for k, block in enumerate(blocks_of(benchmark, item_col, item_text, n)):
        counted = ws.save(count_terms(rows, block.vocabulary), f"counts{k}")
        counts = np.zeros(len(block.vocabulary) + 1, np.int64)
        for term, total in counted.where("term is not null").groupBy("term").agg(F.sum("n")).collect():
            counts[term] = total
        seeds, terms = block.seeds(spark, counts)
        index = ws.save(postings(one_per_text(rows), block.vocabulary, terms), f"postings{k}")
        if slop is None:
            found = ws.save(candidates(index, seeds), f"candidates{k}")
            ranges = found.select(*KEY, F.col("start").alias("low"), (F.col("start") + F.col("size")).alias("high"))
            hit = intersect(found, seeds, local_postings(rows, ranges, block.vocabulary, ws, f"ranges{k}")).withColumn("length", F.col("size"))
        else:
            found = ws.save(near_candidates(index, seeds, slop), f"candidates{k}")
            ranges = found.select(*KEY, F.greatest(F.lit(0), F.col("pos") - F.col("size") - slop + 1).alias("low"), (F.col("pos") + F.col("size") + slop).alias("high"))
            hit = spans_near(found, seeds, local_postings(rows, ranges, block.vocabulary, ws, f"ranges{k}"), slop)
        hit = ws.save(hit.select(*KEY, "start", "size", "length", (F.col("window") + (k << 40)).alias("window")), f"found{k}")
        ws.drop(f"postings{k}", f"candidates{k}", f"ranges{k}")
        of = spark.createDataFrame(pa.table({"window": pa.array([w + (k << 40) for w, _ in block.items], pa.int64()), "item": pa.array([i for _, i in block.items], pa.string())}))
        yield counted, hit, of


def matches(docs: DataFrame, benchmark: DataFrame, slop: int, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """(doc, item, start, length, exact): where a window of an item stands, and where its words stand close together.

    length: the words from the first to the last of the span; exact: whether the window stands there word for word.
    """
    rows = _rows(docs, id_col, text_col)
    out = []
    for name, with_slop in (("decontaminate-exact", None), ("decontaminate-near", slop)):
        for _, hit, of in _blocks(rows, Workspace(docs.sparkSession, name), benchmark, item_col, item_text, n, with_slop):
            out.append(hit.join(of, "window").select(*KEY, "item", "start", "length", F.lit(with_slop is None).alias("exact")))
    none = "t1 long, t2 long, item string, start long, length long, exact boolean"
    found = docs.sparkSession.createDataFrame([], none)
    for part in out:
        found = found.unionAll(part)
    found = found.groupBy(*KEY, "item", "start", "length").agg(F.max("exact").alias("exact"))
    return rows.select("doc", *KEY).join(found, KEY).select("doc", "item", "start", "length", "exact")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 10) -> DataFrame:
    """(doc, t1, t2, n_words, n_hit, items): one row a row of docs; items: the sorted ids, as strings, of the items with a window in it."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    rows = _rows(docs, id_col, text_col)
    parts = list(_blocks(rows, ws, benchmark, item_col, item_text, n, None))
    if not parts:
        stats = count_terms(rows, {})
        return stats.select("doc", *KEY, "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    stats, all_found, all_items = parts[0]
    for _, f, i in parts[1:]:
        all_found, all_items = all_found.unionAll(f), all_items.unionAll(i)
    items = all_found.select(*KEY, "window").distinct().join(all_items, "window").groupBy(*KEY).agg(F.sort_array(F.collect_set("item")).alias("items"))
    result = ws.save(covered(all_found.select(*KEY, "start", "size").distinct()).join(items, KEY), "result")
    out = stats.where("term is null").select("doc", *KEY, "n_words").join(result, KEY, "left")
    return out.select("doc", *KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the texts that hold a window of the benchmark."""
    gone = contamination(docs, benchmark, id_col, text_col, **options).where("n_hit > 0").select(*KEY).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("t1"), F.xxhash64(F.lit("second"), text_col).alias("t2"))
    return rows.join(gone, KEY, "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
  win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS p FROM i WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT n FROM win),
  occ AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
  hit AS (SELECT doc_id, p, occ.n, item_id FROM occ JOIN win USING (s) WHERE occ.n = win.n),
  words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
  its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
