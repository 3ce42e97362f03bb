"""Project settings and plans: policy, undo and quarantine manifests, archives, editor markers."""

from __future__ import annotations

import io
import struct
import tomllib
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import Save, matched, running

MAX_POLICY = 64 << 10
#: A fixed time, so that equal files give equal archives.
EPOCH = (1980, 1, 1, 0, 0, 0)


def policy(text: str) -> tuple[str, list[str]]:
    """Name and allowed functions of '[project] name, allowed = [...]'; anything else is an error."""
    if len(text.encode()) > MAX_POLICY:
        raise ValueError("the policy is too large")
    data = tomllib.loads(text)
    project = data.get("project")
    if set(data) != {"project"} or not isinstance(project, dict) or not set(project) <= {"name", "allowed"}:
        raise ValueError("a policy has one table, project, with name and allowed")
    name, allowed = project.get("name", ""), project.get("allowed", [])
    if not isinstance(name, str) or not all(isinstance(a, str) and a.isidentifier() for a in allowed):
        raise ValueError("allowed lists function names")
    return name, sorted(set(allowed))


def allowed(policies: DataFrame) -> DataFrame:
    """(path, name): the functions that the policies (path, content) allow, each once; a policy that can't be read is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, a) for p, c in zip(f["path"], f["content"], strict=True) for a in policy(c)[1]]
            yield pd.DataFrame(rows, columns=["path", "name"])

    return policies.select("path", "content").mapInPandas(run, "path string, name string")


def undo_manifest(before: DataFrame, after: DataFrame, run_id: str) -> DataFrame:
    """(run_id, path, hash_before, hash_after, content): what a run changed, with what brings it back."""
    b = before.select("path", F.col("content_hash").alias("hash_before"), "content")
    a = after.select("path", F.col("content_hash").alias("hash_after"))
    return b.join(a, "path").where("hash_before <> hash_after").select(F.lit(run_id).alias("run_id"), "path", "hash_before", "hash_after", "content")


def undo(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(path, content, status): restored where the file is still as the run left it, else conflict or missing."""
    now = current.select("path", F.col("content_hash").alias("now"))
    status = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("hash_after"), "restored").otherwise("conflict")
    return manifest.join(now, "path", "left").select("path", F.when(status == "restored", F.col("content")).alias("content"), status.alias("status"))


def quarantine_plan(files: DataFrame, folder: str = ".quarantine") -> DataFrame:
    """(path, target) of unexpected files; nothing is moved."""
    return files.where("kind is null").select("path", F.concat(F.lit(folder + "/"), F.substring("content_hash", 1, 12), F.lit("-"), F.regexp_extract("path", "[^/]+$", 0)).alias("target"))


def markers(diagnostics: DataFrame) -> DataFrame:
    """(path, startLineNumber, startColumn, severity, code, message) as editors want them, from 1."""
    return diagnostics.select("path", F.greatest("line", F.lit(1)).alias("startLineNumber"), F.greatest(F.coalesce("column", F.lit(1)), F.lit(1)).alias("startColumn"), F.when(F.col("severity") == "error", 8).when(F.col("severity") == "warning", 4).otherwise(2).alias("severity"), F.col("rule_id").alias("code"), "message")


def archive(files: dict[str, str]) -> bytes:
    """A ZIP of stored entries in path order; equal files give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for path in sorted(files):
            z.writestr(zipfile.ZipInfo(path, EPOCH), files[path])
    return out.getvalue()


#: From this offset on, and from this number of entries on, records are those of ZIP64.
FAR, MANY = (1 << 31) - 1, 65535
PIECE = pa.schema([("project", pa.string()), ("at", pa.int64()), ("data", pa.binary())])
FILE = pa.schema([("project", pa.string()), ("path", pa.string()), ("content", pa.string())])
#: Bytes handed on together.
FLUSH = 1 << 22


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _entry(path: str, content: str, at: int) -> tuple[bytes, bytes]:
    """A stored entry that begins at an offset, and its record in the directory."""
    name, data = path.encode(), content.encode()
    mode = 0 if path.isascii() else 0x800
    time, day = EPOCH[3] << 11 | EPOCH[4] << 5 | EPOCH[5] // 2, EPOCH[0] - 1980 << 9 | EPOCH[1] << 5 | EPOCH[2]
    far = struct.pack("<2HQ", 1, 8, at) if at > FAR else b""
    own = (mode, zipfile.ZIP_STORED, time, day, zlib.crc32(data), len(data), len(data), len(name))
    version = 45 if far else 20
    record = struct.pack("<4s6H3I5H2I", b"PK\1\2", 3 << 8 | version, version, *own, len(far), 0, 0, 0, 0o600 << 16, 0xFFFFFFFF if far else at)
    return struct.pack("<4s5H3I2H", b"PK\3\4", 20, *own, 0) + name + data, record + name + far


def _end(count: int, size: int, at: int) -> bytes:
    """What ends an archive whose directory of ``size`` bytes begins at an offset."""
    out = b""
    if count > MANY or size > FAR or at > FAR:
        out = struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, count, count, size, at) + struct.pack("<4sIQI", b"PK\6\7", 0, at + size, 1)
        count, size, at = min(count, 0xFFFF), min(size, 0xFFFFFFFF), min(at, 0xFFFFFFFF)
    return out + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, count, count, size, at, 0)


def archives(files: DataFrame, save: Save) -> DataFrame:
    """(project, at, data): the archive of each project's files (project, path, content) in pieces.

    A project's pieces in the order of ``at`` are the bytes that ``archive``
    gives: an entry each, a directory record each, and the end.  Places come from
    running sums over the sizes alone, so a project of any size is packed by all
    tasks.  Project and path are not null.  Of files of one path that with the
    greatest SHA-256 counts; a null content is an empty file.
    """
    known = files.select("project", "path", F.coalesce("content", F.lit("")).alias("content")).withColumn("sha", F.sha2("content", 256))
    name = F.octet_length("path")
    each = known.groupBy("project", "path").agg(F.max(F.struct("sha", F.octet_length("content").cast("long").alias("n"))).alias("own"))
    each = each.select("project", "path", "own.sha", (F.col("own.n") + name + 30).alias("size"), (name + 46).cast("long").alias("listed"), F.lit(1).cast("long").alias("one"))
    ran = running(each, ["project"], ["path"], save, sums={"at": "size", "list_at": "listed", "number": "one"}, own=False)
    placed = save(ran.na.fill(0, ["at", "list_at", "number"]))
    # a far entry's record is 12 bytes longer
    whole = placed.groupBy("project").agg(F.sum("size").alias("total"), F.sum("listed").alias("listing"), F.count("*").alias("count"), F.count_if(F.col("at") <= FAR).alias("near"))
    far = lambda n: 12 * F.greatest(n - F.col("near"), F.lit(0))
    places = matched(placed, whole, ["project"]).select("project", "path", "sha", "at", (F.col("total") + F.col("list_at") + far(F.col("number"))).alias("record_at"))
    ends = whole.select("project", "count", (F.col("listing") + far(F.col("count"))).alias("listing"), "total")
    todo = known.join(places, ["project", "path", "sha"]).dropDuplicates(["project", "path", "sha"]).select("project", "path", "content", "at", "record_at")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i in range(b.num_rows):
                project, path, content, at, record_at = (c[i].as_py() for c in b.columns)
                entry, record = _entry(path, content, at)
                rows += [(project, at, entry), (project, record_at, record)]
                size += len(entry)
                if size > FLUSH or i + 1 == b.num_rows:
                    yield _rows(rows, PIECE)
                    rows, size = [], 0

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(r["project"], r["total"] + r["listing"], _end(r["count"], r["listing"], r["total"])) for r in b.to_pylist()], PIECE)

    return todo.mapInArrow(pack, "project string, at long, data binary").unionByName(ends.mapInArrow(close, "project string, at long, data binary"))


def opened(pieces: DataFrame) -> DataFrame:
    """(project, path, content) of archives in pieces (project, at, data), each entry by its own header; one whose checksum differs is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for project, data in zip(b.column(0), b.column(1), strict=True):
                piece = data.as_buffer()
                if piece[:4].to_pybytes() != b"PK\3\4":
                    continue
                crc, _, n, name, extra = struct.unpack("<3I2H", piece[14:30].to_pybytes())
                path, content = piece[30 : 30 + name].to_pybytes().decode(), piece[30 + name + extra : 30 + name + extra + n].to_pybytes()
                if zlib.crc32(content) != crc:
                    raise zipfile.BadZipFile(f"bad checksum: {path}")
                rows.append((project.as_py(), path, content.decode()))
                size += n
                if size > FLUSH:
                    yield _rows(rows, FILE)
                    rows, size = [], 0
            yield _rows(rows, FILE)

    return pieces.select("project", "data").mapInArrow(run, "project string, path string, content string")
