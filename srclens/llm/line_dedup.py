"""Line dedup (operator 8, native): levelled sorted runs of line hashes.

``LineIndex`` keeps what it has seen as sorted runs, tables bucketed and sorted
by the line's hash.  A batch of documents is reduced to one row a line hash,
merge-joined with every run without shuffling the runs, and the hashes that no
run knows become a new run of level 0.  When a level holds ``fanout`` runs they
are compacted into one of the next level; runs never share a hash, so that is a
union.  Only DataFrame functions are used.

Defined results.  A line's key is the line without leading and trailing
white space, A-Z lower-cased.  Keys under ``min_chars`` code points never drop.
Null text is one empty line.  A row without id is kept whole and makes no line
repeat.  Rows that repeat an id are one document: its lines stay in each of
them.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower, partitions

WHITE = " \t\n\x0b\x0c\r"
KEY = ["h1", "h2"]
#: Ids that the borders of batches are taken from.
SAMPLE = 1000


def line_key(line):
    return ascii_lower(F.trim(line, F.lit(WHITE)))


def split_lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineIndex:
    """Levelled runs of (h1, h2, owner): the 128-bit hash of a line key and the id that holds the line."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.levels: list[list[str]] = []
        self.made = 0

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, entries: DataFrame, level: int) -> None:
        table, self.made = f"{self.name}_{self.made}", self.made + 1
        n = partitions(self.spark)
        entries.repartition(n, *KEY).write.format("parquet").option("compression", "zstd").bucketBy(n, *KEY).sortBy(*KEY).saveAsTable(table)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)

    def compact(self) -> None:
        """Merges each level that is full into one run of the next."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                self._write(reduce(DataFrame.unionAll, [self.spark.table(t) for t in full]), level + 1)
                self._drop(full)

    def owners(self, batch: DataFrame, ws: Workspace, name: str) -> DataFrame:
        """batch: (doc, h1, h2).  Returns the hashes of the batch that repeat, with the id that keeps each; adds the new ones."""
        own = batch.groupBy(*KEY).agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
        held = []
        for i, table in enumerate(self.runs()):
            own = own.join(self.spark.table(table).withColumnRenamed("owner", f"owner{i}").hint("merge"), KEY, "left")
            held.append(F.col(f"owner{i}"))
        known = F.coalesce(*held) if held else F.lit(None).cast(batch.schema["doc"].dataType)
        own = ws.save(own.select(*KEY, "least", "most", known.alias("known")), name)
        self._write(own.where("known is null").select(*KEY, F.col("least").alias("owner")), 0)
        self.compact()
        return own.where("known is not null or least < most").select(*KEY, F.coalesce("known", "least").alias("owner"))

    def _drop(self, tables: list[str]) -> None:
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")

    def drop(self) -> None:
        self._drop(self.runs())
        self.levels = []


def borders(ids: DataFrame, batches: int) -> list:
    """ids: (doc), of any type that has an order.  Up to batches - 1 ids that cut them into batches of about equal size, from a sample of ``SAMPLE`` by hash."""
    picked = ids.where("doc is not null").orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE)
    found = picked.agg(F.sort_array(F.collect_list("doc")).alias("ids")).first()["ids"]
    out = []
    for i in range(1, batches):
        cut = found[len(found) * i // batches] if found else None
        if cut is not None and (not out or cut != out[-1]):
            out.append(cut)
    return out


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """(doc, text64, drops): the positions of the lines that each document loses, as a flag for every line up to the last of them."""
    spark = docs.sparkSession
    ws = Workspace(spark, "line-dedup")
    lines = (
        docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text64"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
        .where("doc is not null")
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "text64", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    edges = borders(docs.select(F.col(id_col).alias("doc")), batches)
    number = F.lit(0)
    for edge in edges:
        number = number + (F.col("doc") > edge).cast("int")
    # a folder a batch, so that each batch reads its own lines alone
    lines = ws.save(lines.withColumn("batch", number), "lines", "batch")
    index = LineIndex(spark, fanout)
    drops = []
    try:
        for i in range(len(edges) + 1):
            batch = lines.where(F.col("batch") == i)
            owners = index.owners(batch.select("doc", *KEY), ws, f"owners{i}")
            drops.append(ws.save(batch.join(owners, KEY).where("doc <> owner").select("doc", "text64", "pos"), f"drops{i}"))
            ws.drop(f"owners{i}")
    finally:
        index.drop()
        ws.drop("lines")
    at = reduce(DataFrame.unionAll, drops).groupBy("doc", "text64").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    flags = F.expr("flatten(transform(at, (p, j) -> concat(array_repeat(false, p - if(j = 0, -1, at[j - 1]) - 1), array(true))))")
    return at.select("doc", "text64", flags.alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc, text64, n_lines, n_dropped, kept): one row a row of docs, ``kept`` being the text that is left."""
    drops = dropped_lines(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text64"), F.col(text_col).alias("whole"))
    lines = split_lines(F.col("whole"))
    kept = F.filter("lines", lambda x, i: ~F.coalesce(F.get("drops", i), F.lit(False)))
    out = rows.join(drops, ["doc", "text64"], "left")
    out = out.withColumn("n_dropped", F.when(F.col("drops").isNull(), 0).otherwise(F.size(F.filter("drops", lambda d: d))).cast("long"))
    text = F.when(F.col("drops").isNull(), F.coalesce("whole", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return out.withColumn("lines", lines).select("doc", "text64", F.size("lines").cast("long").alias("n_lines"), "n_dropped", text.alias("kept"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the repeated lines gone from the text; rows and other columns stay, a text that loses nothing stays as it is."""
    drops = dropped_lines(docs, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text64"), F.struct("*").alias("row")).join(drops, ["doc", "text64"], "left")
    kept = F.filter(split_lines(F.col("row")[text_col]), lambda x, i: ~F.coalesce(F.get("drops", i), F.lit(False)))
    text = F.when(F.col("drops").isNull(), F.col("row")[text_col]).otherwise(F.array_join(kept, "\n"))
    return rows.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("doc").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_LINES = """
  {docs}, lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM d),
  keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
  owner AS (SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
  marked AS (SELECT doc_id, pos, line, least IS NOT NULL AND least < doc_id AS gone FROM keyed LEFT JOIN owner USING (k))
"""
ORACLE = (
    "WITH "
    + _LINES.format(docs="d AS (SELECT doc_id, text FROM documents)")
    + """SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id"""
)
