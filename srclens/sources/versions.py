"""Files under versions: a log of commits, each made whole or not at all.

A commit first writes its files to a folder of its own, then claims the next
number of the log by making that entry where none is.  Only one writer can make
an entry, so two that plan on the same version cannot both pass over each
other: the later one looks at what has been committed since its base, and is
refused if any of its files is among it; otherwise it takes the next number.  A
folder that no entry names was broken off and counts nothing.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, content string"


@dataclass(frozen=True)
class Entry:
    version: int
    base: int
    folder: str
    note: str


class Versions:
    """The versions below a folder that driver and executors share; version 0 has no files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def _entry(self, version: int) -> str:
        return f"{self.root}/log/{version:020d}.json"

    def entries(self, after: int = 0) -> list[Entry]:
        """The log, one entry a commit, from a version on."""
        folder = self._path(f"{self.root}/log")
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        wanted = [n for n in names if n.endswith(".json") and not n.startswith(".") and int(n[:-5]) > after]
        return [Entry(**json.loads(self._read(f"{self.root}/log/{n}"))) for n in wanted]

    def latest(self) -> int:
        return max((e.version for e in self.entries()), default=0)

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _claim(self, entry: Entry) -> bool:
        """Makes the entry unless there is one of its number; whole or not at all."""
        target, own = self._entry(entry.version), f"{self.root}/log/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(own), False)
        stream.write(bytearray(json.dumps(vars(entry)).encode()))
        stream.close()
        try:
            local = self._path(target).toUri()
            if (self._fs.getUri().getScheme() or "file") == "file":
                os.link(self._path(own).toUri().getPath(), local.getPath())  # fails where there is one
            else:
                self._context.rename(self._path(own), self._path(target), self._no_overwrite())
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            with contextlib.suppress(Exception):
                self._fs.delete(self._path(own), False)

    def _no_overwrite(self):
        kind = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        out = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        out[0] = kind.getEnumConstants()[0]
        return out

    def _rows(self, entries: list[Entry]) -> DataFrame:
        """(path, content, version) of what the entries wrote; a null content is a deletion."""
        if not entries:
            return self.spark.createDataFrame([], f"{FILES}, version long")
        # one row a commit
        numbers = self.spark.createDataFrame([(e.folder, e.version) for e in entries], "folder string, version long")
        files = self.spark.read.schema(FILES).parquet(*(f"{self.root}/data/{e.folder}" for e in entries))
        named = files.select("path", "content", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"))
        return named.join(numbers, "folder").select("path", "content", "version")

    def as_of(self, version: int | None = None) -> DataFrame:
        """(path, content, version): each file as its last commit up to a version left it; deleted ones are absent."""
        rows = self._rows([e for e in self.entries() if version is None or e.version <= version])
        last = rows.groupBy("path").agg(F.max("version").alias("version"))
        return rows.join(last, ["path", "version"]).where("content is not null").select("path", "content", "version")

    def changed_since(self, version: int) -> DataFrame:
        """(path) of files that commits behind a version wrote."""
        return self._rows(self.entries(version)).select("path").distinct()

    def commit(self, changes: DataFrame, base: int, note: str = "") -> tuple[int | None, DataFrame]:
        """Commits changes (path, content; null: delete), planned on version ``base``, one row a path.

        Gives the new version and no rows, or None and the paths that were
        committed since: then nothing has been written.
        """
        folder = uuid.uuid4().hex
        place = f"{self.root}/data/{folder}"
        changes.select("path", "content").write.option("compression", "zstd").parquet(place)
        own = self.spark.read.schema(FILES).parquet(place).select("path")
        seen = base
        clash = own.limit(0)
        while True:
            fresh = self.entries(seen)
            if fresh:
                clash = own.join(self._rows(fresh).select("path").distinct(), "path", "left_semi").distinct()
                if not clash.isEmpty():
                    said = f"{self.root}/refused/{folder}"
                    clash.write.parquet(said)
                    self._fs.delete(self._path(place), True)
                    return None, self.spark.read.schema("path string").parquet(said)
                seen = fresh[-1].version
            self._fs.mkdirs(self._path(f"{self.root}/log"))
            if self._claim(Entry(seen + 1, base, folder, note)):
                return seen + 1, clash

    def revert(self, version: int, note: str = "") -> tuple[int | None, DataFrame]:
        """Takes a commit back: its files as they were before it; refused if one was committed since."""
        (entry,) = [e for e in self.entries() if e.version == version]
        before = self.as_of(version - 1).select("path", "content")
        return self.commit(self._rows([entry]).select("path").join(before, "path", "left"), version, note or f"revert {version}")
