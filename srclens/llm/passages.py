"""Substring dedup (operator 9): long repeated passages of words, by De Bruijn compaction.

Windows of ``width`` words are the k-mers, the edges of a De Bruijn graph whose
nodes are the runs of width - 1 words between neighbours.

1. Each text's edges are compacted where no branch can be told from its own
   content: a run of edges with one anchor (``repeats``) is a path, named by the
   128-bit digest of its words.
2. Spark joins equal paths over all texts.  A path that is the only one of its
   anchor does not branch; it stays whole.
3. Where different paths meet in an anchor, the graph branches: their edges are
   unpacked, joined by the 128-bit digest of their words, and each learns the source of its words,
   the coordinates (smallest id, text, position) where they stand first.
4. Neighbouring edges whose sources are neighbours too are compacted again into
   spans (start, end, source); a span whose coordinates don't run on is cut.

Defined results.  Null text has no words.  A text under ``width`` words loses
nothing.  Rows that repeat an id are one document: they are no source for each
other.  A row without id is no source and loses nothing.  Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace
from .repeats import KEY, NAME, RUN, contents, keyed, pieces, runs, shared, union_of, with_text, word_units

WIDTH, GRAM = 50, 20
#: Edges, or bytes of texts, handed on together.
FLUSH = 1 << 22


def edges(texts: DataFrame, width: int) -> DataFrame:
    """(t1, t2, text, wanted) to (anchor, c1, c2, place, i, one, two): the digest of each edge of the wanted paths, from the words at its source."""
    names = [*RUN, "doc", "t1", "t2", "pos"]
    doc = texts.schema["wanted"].dataType.elementType["doc"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.column(3).type.value_type.field("doc").type
            for t1, t2, text, wanted in zip(*b.columns, strict=True):
                data = np.frombuffer(text.as_py(), np.uint8)
                units, rows = word_units(data, np.array([len(data)])), wanted.as_py()
                n = np.array([r["n"] for r in rows])
                i = np.concatenate([np.arange(r["n"]) for r in rows])
                pos = i + np.repeat([r["start"] for r in rows], n)
                digest = units.digests(pos, pos + width)
                of = pa.array(np.repeat(np.arange(len(rows)), n))
                cols = [pa.array([r[c] for r in rows], kind if c == "doc" else pa.int64()).take(of) for c in (*RUN, "doc")]
                keys = [pa.repeat(t, len(i)) for t in (t1, t2)]
                yield pa.RecordBatch.from_arrays([*cols, *keys, pa.array(pos), pa.array(i), *(pa.array(np.ascontiguousarray(digest[:, k])) for k in (0, 1))], [*names, "i", "one", "two"])

    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    return texts.mapInArrow(run, T.StructType([*longs(*RUN), T.StructField("doc", doc), *longs("t1", "t2", "pos", "i", "one", "two")]))


def sources(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(t1, t2, spans array<struct<a, b, owner>>): edges [a, b) of a text stand in document owner, and in none of a smaller id."""
    ws = Workspace(rows.sparkSession, "passages")
    kept = ws.save(shared(runs(rows, width, gram, word_units)), "paths")
    each = contents(kept, ws, "contents").where("doc is not null")
    branch = each.where("kinds > 1").select(F.col("at.t1").alias("t1"), F.col("at.t2").alias("t2"), F.col("at.start").alias("start"), *RUN, "n", "doc")
    unpacked = edges(with_text(rows, branch), width)
    unpacked = ws.save(unpacked.select(*NAME, "i", F.struct("doc", "t1", "t2", "pos").alias("source"), "one", "two"), "edges")
    first = ws.save(unpacked.groupBy("one", "two").agg(F.min("source").alias("source")), "first")
    own = unpacked.drop("source").join(first, ["one", "two"])  # both are tables, so that AQE can split a hot edge
    path = Window.partitionBy(*NAME).orderBy("i")  # at most repeats.LONGEST edges
    run_on = (F.lag("source.doc").over(path) == F.col("source.doc")) & (F.lag("source.t1").over(path) == F.col("source.t1")) & (F.lag("source.pos").over(path) + 1 == F.col("source.pos"))
    cut = own.withColumn("new", F.when(F.coalesce(run_on, F.lit(False)), 0).otherwise(1)).withColumn("span", F.sum("new").over(path))
    spans = cut.groupBy(*NAME, "span").agg(F.min("i").alias("a"), (F.max("i") + 1).alias("b"), F.first("source.doc").alias("owner"))
    spans = spans.groupBy(*NAME).agg(F.collect_list(F.struct("a", "b", "owner")).alias("spans"))
    whole = each.where("kinds = 1").select(*NAME, F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b"), F.col("doc").alias("owner"))).alias("spans"))
    spans = ws.save(spans.unionAll(whole), "spans")
    ws.drop("edges", "first")
    # a text without a copy of a smaller id keeps what it owns itself
    least = kept.groupBy(*KEY).agg(F.min("doc").alias("own"), F.sum("copies").alias("copies"), F.max("doc").alias("most"))
    foreign = F.filter("spans", lambda s: (s["owner"] < F.col("own")) | (F.col("own") < F.col("most")) | (F.col("copies") > 1))
    shifted = F.transform("spans", lambda s: F.struct((s["a"] + F.col("start")).alias("a"), (s["b"] + F.col("start")).alias("b"), s["owner"].alias("owner")))
    # one row a place: AQE splits the places of a hot path, whose other side is one row
    places = ws.save(kept.select(*NAME, *KEY, "start").join(spans, NAME).select(*KEY, shifted.alias("spans")), "places")
    places = places.join(least, KEY).select(*KEY, foreign.alias("spans")).where(F.size("spans") > 0)
    out = places.groupBy(*KEY).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = ws.save(out, "sources")
    ws.drop("paths", "contents", "spans", "places")
    return out


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, texts: bool = True) -> DataFrame:
    """(doc, n_words, n_removed, kept_sha256, spans, kept): one row a row of docs.

    spans: the removed ranges of words.  kept: the words that are left, joined by blanks, null if not texts.
    """
    rows = keyed(docs, id_col, text_col)
    joined = rows.join(sources(rows, width, gram), KEY, "left").select("doc", "text", "spans")

    names = ["doc", "n_words", "n_removed", "kept_sha256", "spans", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string()]

    def row(doc, text: bytes, sources: list[dict]) -> tuple:
        data = np.frombuffer(text, np.uint8)
        spans = union_of([(s["a"], s["b"] + width - 1) for s in sources if doc is not None and s["owner"] < doc])
        total, gone, left, h, blank = 0, sum(e - a for a, e in spans), [], hashlib.sha256(), b""
        for piece in pieces(data):
            found = piece.tobytes().split()
            at = 0
            for a, e in [*((max(0, a - total), max(0, e - total)) for a, e in spans), (len(found), len(found))]:
                if at < a and at < len(found):
                    part = blank + b" ".join(found[at:a])
                    h.update(part)
                    left.append(part if texts else b"")
                    blank = b" "
                at = max(at, e)
            total += len(found)
        return total, gone, h.hexdigest(), [{"a": a, "b": e} for a, e in spans], b"".join(left).decode() if texts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, size, out = 0, 0, []
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                out.append(row(b.column(0)[i].as_py(), text, b.column(2)[i].as_py() or []))
                size += len(text) if texts else 0
                if size > FLUSH or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(out)), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names)
                    first, size, out = i + 1, 0, []

    span = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    fields = [T.StructField("doc", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    fields += [T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.StringType())]
    return joined.mapInArrow(run, T.StructType(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


#: All windows as hashes of their words.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  windows AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
  first AS (SELECT h, min(doc_id) AS least FROM windows GROUP BY h),
  hit AS (SELECT doc_id, p FROM windows JOIN first USING (h) WHERE least < doc_id),
  gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 50)) AS q FROM hit)),
  words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM d),
  kept AS (SELECT doc_id, count(gone.q) AS n_removed, string_agg(word, ' ' ORDER BY q) FILTER (WHERE gone.q IS NULL) AS text FROM words LEFT JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
