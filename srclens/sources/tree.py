"""A project folder as a data source: one row a file, read folder by folder.

The driver walks folders alone; a folder's files are listed and read by the
task that has it.  Pruned folders, folders that a filter on ``path`` rules out,
and repositories inside the project are not entered.  Links are not followed.
Files that a filter on ``path``, ``bytes`` or ``kind`` rules out are not opened.
Any store that pyarrow's file systems reach will do.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

SCHEMA = "path string, kind string, bytes long, content binary"
#: Folders that are never entered, and what marks a repository.
PRUNED = frozenset([".git", ".svn", ".hg", "node_modules", "target"])
REPOSITORY = ".git"
#: Bytes of contents in a batch, but for a single file of more.
BATCH = 1 << 24


def kind_of(path: str) -> str | None:
    """What ``functions.text.file_kind`` says, for a path in a task."""
    name = path.rsplit("/", 1)[-1]
    if name.endswith(".c"):
        return "c_source"
    if name.endswith(".h"):
        return "c_header"
    if name.lower() == "makefile":
        return "makefile"
    return "markdown" if re.match(r"README(\.|$)", name) else None


class Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TreeReader(DataSourceReader):
    def __init__(self, root: str, content: bool = True):
        self.root, self.content = root.rstrip("/") or "/", content
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            own = (isinstance(f, IsNotNull) and f.attribute in (("path",), ("kind",), ("bytes",))) or (isinstance(f, (LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)) and f.attribute == ("bytes",)) or (isinstance(f, (EqualTo, In)) and f.attribute in (("path",), ("kind",))) or (isinstance(f, (StringStartsWith, StringEndsWith)) and f.attribute == ("path",))
            if own:
                self.kept.append(f)
            else:
                yield f

    def _store(self) -> tuple[pafs.FileSystem, str]:
        if re.match(r"^[a-z][a-z0-9+.-]*://?", self.root) and not self.root.startswith("file:"):
            return pafs.FileSystem.from_uri(self.root)
        return pafs.LocalFileSystem(), re.sub("^file:/+", "/", self.root)

    def wanted(self, path: str, size: int | None = None) -> bool:
        """Whether a file can pass the filters on its path, kind and size."""
        for f in self.kept:
            value = size if f.attribute == ("bytes",) else kind_of(path) if f.attribute == ("kind",) else path
            if f.attribute == ("bytes",) and size is None:
                continue
            ok = {
                IsNotNull: lambda: value is not None,
                LessThan: lambda: value < f.value,
                LessThanOrEqual: lambda: value <= f.value,
                GreaterThan: lambda: value > f.value,
                GreaterThanOrEqual: lambda: value >= f.value,
                EqualTo: lambda: value == f.value,
                In: lambda: value in f.value,
                StringStartsWith: lambda: (value or "").startswith(f.value),
                StringEndsWith: lambda: (value or "").endswith(f.value),
            }[type(f)]()
            if not ok:
                return False
        return True

    def _may_hold(self, folder: str) -> bool:
        """Whether a folder (with its slash) can hold a path that the filters let through."""
        for f in self.kept:
            if f.attribute == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith)):
                values = f.value if isinstance(f, In) else [f.value]
                if not any(v is not None and (v.startswith(folder) or (isinstance(f, StringStartsWith) and folder.startswith(v))) for v in values):
                    return False
        return True

    def _entries(self, store: pafs.FileSystem, base: str, folder: str) -> list[tuple[str, pafs.FileInfo]]:
        """The name and state of what stands in a folder, without links."""
        place = f"{base}/{folder}".rstrip("/")
        found = [(e.base_name, e) for e in store.get_file_info(pafs.FileSelector(place))]
        local = isinstance(store, pafs.LocalFileSystem)
        return sorted((n, e) for n, e in found if not (local and os.path.islink(f"{place}/{n}")))

    def partitions(self) -> list[InputPartition]:
        store, base = self._store()
        out, todo = [], [""]
        while todo:
            folder = todo.pop()
            names = self._entries(store, base, folder)
            if folder and any(n == REPOSITORY for n, _ in names):
                continue
            if any(e.type == pafs.FileType.File and self.wanted(folder + n) for n, e in names):
                out.append(Folder(folder))
            todo += [f"{folder}{n}/" for n, e in names if e.type == pafs.FileType.Directory and n not in PRUNED and self._may_hold(f"{folder}{n}/")]
        return sorted(out, key=lambda p: p.path) or [Folder("")]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, base = self._store()
        rows, held = [], 0
        for name, e in self._entries(store, base, partition.path):
            path = partition.path + name
            if e.type != pafs.FileType.File or not self.wanted(path, e.size):
                continue
            data = None
            if self.content:
                with store.open_input_stream(f"{base}/{path}") as f:
                    data = f.read()
                held += e.size
            rows.append((path, kind_of(path), e.size, data))
            if held >= BATCH:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "kind", "bytes", "content"])


class Tree(DataSource):
    """``spark.read.format("project_tree").load(root)``; with the option content=false no file is opened."""

    @classmethod
    def name(cls) -> str:
        return "project_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], self.options.get("content", "true") != "false")


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Tree)
