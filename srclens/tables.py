"""Written tables that cut lineage: Parquet in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: By application: the folder of our own where the session names none, as in tests.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where the session names none and all is on one machine."""
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="srclens-")
    return _OWN[app]


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the process ends."""
    root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def close() -> None:
        with contextlib.suppress(Exception):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(close)
    return root


def saver(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table and reads it back; what it wrote goes when the process ends."""
    root, count = fresh_folder(spark, "tables"), iter(range(1 << 62))

    def save(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(count)}"
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return save
