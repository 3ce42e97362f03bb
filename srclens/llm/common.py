"""What the operators of this subpackage share: tables in the shared folder, keys, partition counts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: By application: the folder of our own where the session names none, as in tests.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and all is on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="srclens-")
    return _OWN[app]


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class Workspace:
    """Tables that cut lineage: written as Parquet to the shared folder, read back with their own schema.

    They outlive lost executors.  ``drop`` removes one that nothing reads any
    more; what is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, *partition_by: str) -> DataFrame:
        df.write.option("compression", "zstd").mode("overwrite").parquet(self.path(name), partitionBy=list(partition_by) or None)
        return self.load(name, df)

    def load(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = hadoop_path(self.spark, self.path(name))
            fs.delete(p, True)

    def close(self) -> None:
        with contextlib.suppress(Exception):
            fs, p = hadoop_path(self.spark, self.root)
            fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bytes_total(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path, by the file system's own count."""
    fs, p = hadoop_path(spark, path)
    return fs.getContentSummary(p).getLength()


#: Bits of a filter at most, 8 MB: what a task holds and the driver sends, whatever the number of keys.
FILTER_BITS = 1 << 26
_LOW = (1 << 46) - 1


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of keys (t1, t2) as words of 64 bits, about ten bits a key up to ``FILTER_BITS``; beyond that it lets more through.

    Only the words of the filter come to the driver, never the keys.
    """
    bits = min(FILTER_BITS, 1 << max(12, (10 * keys.count()).bit_length()))
    at = F.explode(F.array(*(F.expr(f"((t1 & {_LOW}L) + {k} * shiftrightunsigned(t2, 18)) & {bits - 1}L") for k in range(4)))).alias("at")
    words = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["set"].to_numpy()
    return out


def may_hold(words: np.ndarray, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
    """Which keys ``key_filter`` may have seen: all that it has, and few others."""
    bits, step = len(words) * 64, (t2.view(np.uint64) >> np.uint64(18)).view(np.int64)
    out = np.ones(len(t1), bool)
    for k in range(4):
        at = ((t1 & _LOW) + k * step) & (bits - 1)
        out &= (words[at >> 6] >> (at & 63)) & 1 == 1
    return out


def ascii_lower(c):
    """Lower-cases A-Z alone; plain lower() where all characters are ASCII."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))
