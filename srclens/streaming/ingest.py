"""Source files as a stream: new files are read as they appear, findings per rule are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lines


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of (path, content) that arrive in folder."""
    return spark.readStream.schema("path string, content string").parquet(folder)


def findings(sources: DataFrame) -> DataFrame:
    """(rule_id, n) over all files so far; the same line rules as in batch."""
    rows = lines.lines(sources)
    long, space = lines.too_long(rows).select(F.lit("LINE_TOO_LONG").alias("rule_id")), lines.trailing_space(rows).select(F.lit("TRAILING_SPACE").alias("rule_id"))
    return long.unionByName(space).groupBy("rule_id").agg(F.count("*").alias("n"))
