"""Quality classifier (operator 1): a byte-level convolutional network over whole texts.

Learns from a bounded, documented sample of labelled rows: of each label the
``TRAIN_ROWS`` rows with the smallest hash of their id, those over
``TRAIN_BYTES`` of text left out.  Rows whose crc32(id as text) mod 3 is 1 are
never learned from.  Scoring reads every text to its end.

Defined results.  Null text scores as empty text.  Labels other than 0 and 1,
labels that contradict each other, and labels without a text teach nothing; of
texts that share an id the smallest teaches; without any labels the score is the
untrained network's.  Rows without id score like any other and their held_out
is null.  Repeated rows score alike.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytenet
from .rolling import blocks, text_buffer

TRAIN_ROWS = {0: 1500, 1: 3000}
TRAIN_BYTES = 1 << 15


def held_out(id_col):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[list[np.ndarray], np.ndarray]:
    """The training rows, on the driver: at most sum(TRAIN_ROWS) * TRAIN_BYTES bytes."""
    open_ = labels.where(~held_out(id_col)).groupBy(F.col(id_col).alias("doc")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("most")).where("label = most").drop("most")
    picked = [open_.where(F.col("label") == k).orderBy(F.xxhash64("doc"), "doc").limit(n) for k, n in TRAIN_ROWS.items()]
    ids = [r for part in picked for r in part.collect()]
    if not ids:
        return [], np.zeros(0, np.int64)
    spark = docs.sparkSession
    wanted = spark.createDataFrame(ids, open_.schema)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc"), text.alias("text")).where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(wanted), "doc")
    got = rows.groupBy("doc", "label").agg(F.min("text").alias("text")).collect()
    got.sort(key=lambda r: r["doc"])
    return [np.frombuffer(bytes(r["text"]), np.uint8) for r in got], np.array([r["label"] for r in got])


def fit(docs: DataFrame, labels: DataFrame, **columns) -> bytenet.Params:
    return bytenet.train(*sample(docs, labels, **columns))


def scores(docs: DataFrame, model: bytenet.Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, score): one row a row of docs."""
    return score_column(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), model, "text").select("doc", "score")


def score_column(rows: DataFrame, model: bytenet.Params, text_col: str, out: str = "score") -> DataFrame:
    """rows with one column more: the probability of label 1."""
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_buffer(b.column(at))
            probs = [np.zeros(0)]
            for first, last in blocks(offsets, bytenet.SEGMENT):
                probs.append(bytenet.score(model, [data[offsets[i] : offsets[i + 1]] for i in range(first, last)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(probs))], [*b.schema.names, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())]))


def accepted(docs: DataFrame, model: bytenet.Params, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs that score ``least`` or more, with their own columns."""
    rows = docs.select(F.col(text_col).alias("text"), F.struct("*").alias("row"))
    return score_column(rows, model, "text").where(F.col("score") >= least).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scores(docs, fit(docs, labels))
    return out.select(F.col("doc").alias("doc_id"), held_out("doc").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
