"""WARC (operator 7): a converter of legacy ARC archives, and the round trip of ``pages`` through it.

``write_arc`` stores pages as ARC archives of version 1 or 2 (odd and even
partitions); ``convert`` parses the version's header lines and declared lengths
and writes WARC archives with synthesised record ids, dates, types and digests;
``read`` reads those back.  Archives are written by Spark's own text writer, so
they go wherever Spark can write and a lost task is written again; each begins
with its version block or warcinfo record.  Payloads are not shuffled unless
the table of repeated payloads is too large to broadcast.

Defined results.  Null html is an empty payload.  Of records with equal
payloads of at least ``SMALL`` bytes those with the smallest id are responses
(several, if rows repeat it) and the others revisit it; records without id
revisit it too, and are responses where no record with an id has the payload.
Null urls are '-'.  White space in urls is percent-encoded.  An empty table
gives empty archives.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc
from .common import Workspace, hadoop_path

SMALL = 100
#: Records in an archive at most, with the one that begins it, and its bytes before compression but for a single record of more.
RECORDS, ARCHIVE_BYTES = 1024, 1 << 28
DATE = "20240101000000"


def size_class(size: Column) -> Column:
    """0 for payloads of which ``RECORDS`` fit an archive, then one more for each four times the size.

    Each class has archives of its own, so that a long page takes records from
    the archives of such pages alone.
    """
    least = F.lit(max(1, ARCHIVE_BYTES // RECORDS - 4096))
    return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)) / least) / 2)).cast("int")


def _per_archive(kind: int) -> int:
    """How many records an archive of a size class takes."""
    return max(2, RECORDS >> 2 * kind)


def _classes(sizes: DataFrame) -> list[int]:
    """The size classes of a column ``size``; at most some twenty numbers."""
    return sorted(sizes.agg(F.collect_set(size_class(F.coalesce("size", F.lit(0))))).first()[0])


def _folders(spark: SparkSession, path: str) -> dict[int, str]:
    """By size class the folder of its archives below path; archives of other makers count as one class of the largest records."""
    fs, p = hadoop_path(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    found = {int(n.removeprefix("class=")): f"{path}/{n}" for n in names if n.startswith("class=")}
    return found or {99: path}


def _archive(df: DataFrame, path: str, records: int) -> None:
    """Rows (value as bytes) one after the other, each closed by a line feed."""
    df.select(F.col("value").cast("string")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").option("maxRecordsPerFile", records).mode("overwrite").text(path)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of about ``size`` bytes."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += sum(len(v) for v in row if isinstance(v, (bytes, str))) + 64
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> None:
    """Archives of pages below path, a folder for each class of sizes."""
    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html"))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    for kind in _classes(rows.select(size.alias("size"))) or [0]:
        _write_class(rows.where(size_class(size) == kind), f"{path}/class={kind}", _per_archive(kind), date)


def _write_class(rows: DataFrame, path: str, per: int, date: str) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version = 1 + part % 2

        def records() -> Iterator[tuple[bytes]]:
            n, offset, name = 0, 0, ""
            for b in batches:
                for page, url, html in zip(*(b.column(i) for i in range(3)), strict=True):
                    if n % per == 0:
                        name = f"pages-{part:05d}-{n // per:05d}.arc"
                        block = arc.arc_block(version, name, date)
                        offset = len(block) + 1
                        n += 1
                        yield (block,)
                    record = arc.arc_record(version, name, url.as_py(), date, arc.http_block(page.as_py(), html.as_py() or b""), offset)
                    offset += len(record) + 1
                    n += 1
                    yield (record,)

        yield from _batches(records(), ["value"], [pa.binary()])

    _archive(rows.mapInArrow(run, "value binary"), path, per)


def _files(spark: SparkSession, path: str, schema: str, names: list[str], kinds: list[pa.DataType], each) -> DataFrame:
    """each: from a file's bytes to rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                yield from _batches(each(data.as_py()), names, kinds)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(page, url, date, head, payload, bytes, digest) of each record of the ARC archives below path; page is null where the record names none."""

    def each(data: bytes) -> Iterator[tuple]:
        for head, content in arc.read_arc(arc.stream(data)):
            http, fields, body = arc.split_http(content)
            yield (arc.page_of(fields), head["URL"], head["Archive-date"], http, body if payload else None, len(body), hashlib.sha256(body).hexdigest())

    names = ["page", "url", "date", "head", "payload", "bytes", "digest"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
    return _files(spark, path, "page string, url string, date string, head binary, payload binary, bytes long, digest string", names, kinds, each)


def convert(spark: SparkSession, source: str, target: str, id_type: str = "long", small: int = SMALL) -> None:
    """ARC archives below source to WARC archives below target."""
    ws = Workspace(spark, "warc-convert")
    page = F.col("page").cast(id_type)
    known = read_arc(spark, source, payload=False).where(F.col("bytes") >= small).groupBy("digest")
    first = known.agg(F.min(page).alias("first"), F.min_by("url", page).alias("first_url"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    first = ws.save(first, "first")
    folders = _folders(spark, source)
    for kind, folder in folders.items():
        rows = read_arc(spark, folder).join(first, "digest", "left")
        _convert_class(rows, page, f"{target}/class={kind}", _per_archive(kind), small)
    ws.close()


def _convert_class(rows: DataFrame, page: Column, target: str, per: int, small: int) -> None:
    revisit = F.coalesce((F.col("bytes") >= small) & ~F.coalesce(page == F.col("first"), F.lit(False)) & F.col("first").isNotNull(), F.lit(False))
    rows = rows.select("page", "url", "date", "head", F.when(revisit, None).otherwise(F.col("payload")).alias("payload"), "digest", F.when(revisit, F.col("first").cast("string")).alias("refers"), "first_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def own(page: str | None) -> str:
            return "none" if page is None else f"page {page}"

        def records() -> Iterator[tuple[bytes]]:
            n = 0
            for b in batches:
                for page, url, date, head, payload, digest, refers, first_url in zip(*(c for c in b.columns), strict=True):
                    when = arc.iso(date.as_py())
                    if n % per == 0:
                        fields = [("WARC-Record-ID", arc.record_id(f"warcinfo {part} {n}", target)), ("WARC-Date", when), ("Content-Type", "application/warc-fields")]
                        n += 1
                        yield (arc.warc("warcinfo", fields, b"software: srclens\r\nformat: WARC File Format 1.1\r\n"),)
                    d = digest.as_py()
                    fields = [("WARC-Record-ID", arc.record_id(own(page.as_py()), d)), ("WARC-Date", when), ("WARC-Target-URI", url.as_py()), ("WARC-Payload-Digest", f"sha256:{d}"), ("Content-Type", "application/http; msgtype=response")]
                    n += 1
                    if refers.as_py() is None:
                        yield (arc.warc("response", fields, head.as_py() + (payload.as_py() or b"")),)
                    else:
                        fields += [("WARC-Profile", arc.REVISIT), ("WARC-Refers-To", arc.record_id(own(refers.as_py()), d)), ("WARC-Refers-To-Target-URI", first_url.as_py()), ("WARC-Refers-To-Date", when)]
                        yield (arc.warc("revisit", fields, head.as_py()),)

        yield from _batches(records(), ["value"], [pa.binary()])

    _archive(rows.mapInArrow(run, "value binary"), target, per)


def read(spark: SparkSession, path: str, id_type: str = "long", html: bool = False) -> DataFrame:
    """(page, url, record_id, record_type, bytes, digest, refers_id, html) of each page's record below path.

    A payload's digest is computed anew and must be the one the record states.
    """

    def each(data: bytes) -> Iterator[tuple]:
        for head, block in arc.read_warc(arc.stream(data)):
            kind = head["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            _, http, body = arc.split_http(block)
            stated = head["warc-payload-digest"].removeprefix("sha256:")
            if kind == "response" and hashlib.sha256(body).hexdigest() != stated:
                raise ValueError("a payload's digest is not that of its bytes")
            size = len(body) if kind == "response" else int(http["content-length"])
            yield (arc.page_of(http), head["warc-target-uri"], head["warc-record-id"], kind, size, stated, head.get("warc-refers-to"), body if html else None)

    names = ["page", "url", "record_id", "record_type", "bytes", "digest", "refers_id", "html"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]
    out = _files(spark, path, "page string, url string, record_id string, record_type string, bytes long, digest string, refers_id string, html binary", names, kinds, each)
    return out.withColumn("page", F.col("page").cast(id_type)).withColumn("html", F.col("html").cast("string"))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to): pages to ARC, ARC to WARC, and WARC read back."""
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    ws = Workspace(spark, "archives")
    write_arc(pages, ws.path("arc"), id_col, url_col, html_col)
    convert(spark, ws.path("arc"), ws.path("warc"), kind)
    ws.drop("arc")
    records = ws.save(read(spark, ws.path("warc"), kind).drop("html", "url"), "records")
    met = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("page").alias("refers_to"))
    asked = records.where("refers_id is not null").select("refers_id").distinct()
    met = met.join(asked, "refers_id", "left_semi").dropDuplicates(["refers_id"])
    out = records.join(met, "refers_id", "left")
    return out.select("page", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumnRenamed("page", "page_id")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  f AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN least < page_id THEN least END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
