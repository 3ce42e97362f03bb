"""Results kept by content, so that only what is new is looked at again.

Results live in a table that is bucketed by key and only appended to: a lookup
shuffles the files' keys into its buckets, never the table.  Counts of findings
are kept up to date by signed rows: what a file that is gone had is taken off,
what a new one has is put on, and files that stay are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A result: how often each rule was found.
RESULT = "key string, counts array<struct<rule_id: string, n: bigint>>"


class ResultCache:
    """key -> counts by rule, in a bucketed table below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.name = spark, f"results_{uuid.uuid4().hex[:12]}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = folder.rstrip("/")
        self._append(spark.createDataFrame([], RESULT))

    def _append(self, results: DataFrame) -> None:
        results.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.folder}/{self.name}").format("parquet").mode("append").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, results: DataFrame) -> None:
        """Keeps results (key, counts) of keys that are not kept yet."""
        self._append(results.dropDuplicates(["key"]).join(self.table().select("key"), "key", "left_anti").select("key", "counts"))

    def found(self, files: DataFrame) -> DataFrame:
        """files (.., key) with their counts; null where nothing is kept."""
        return files.join(self.table().hint("merge"), "key", "left")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _summed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(F.inline("counts")).select("rule_id", (F.lit(sign) * F.col("n")).alias("n"))


def refreshed(cache: ResultCache, totals: DataFrame, before: DataFrame, after: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(rule_id, n) after a change, from the totals (rule_id, n) before it.

    before, after: files (path, key, content); evaluate gives (key, counts) of
    files, with a row for each key.  Files of the same path and key are not
    read; a content that was seen before is looked up, not evaluated.
    """
    same = ["path", "key"]
    gone = before.select(*same).join(after.select(*same), same, "left_anti")
    new = after.join(before.select(*same), same, "left_anti")
    known = cache.found(new.select("key").distinct())
    cache.add(evaluate(new.join(known.where("counts is null").select("key"), "key", "left_semi").dropDuplicates(["key"])))
    off, on = (_summed(cache.found(d.select("key")), s) for d, s in ((gone, -1), (new, 1)))
    return totals.select("rule_id", "n").unionByName(off).unionByName(on).groupBy("rule_id").agg(F.sum("n").alias("n")).where("n <> 0")
