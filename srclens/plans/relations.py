"""Queries over ranges, offsets, budgets, graphs and wrapped lines made from the given tables, with SQL for DuckDB beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import budgets, closures, intervals, lines, relate
from ..sources import tree
from ..sources.cache import ResultCache, refreshed
from ..sources.versions import Versions
from ..tables import fresh_folder, saver
from .queries import MESSY, WIDTH, documents, messy

#: Both engines read these: line items as ranges, short ranges, places and edits of a supplier's file.
PATH = "concat('s', cast(l_suppkey as varchar(20)))"
NAME = "concat(cast(l_orderkey as varchar(20)), '-', cast(l_linenumber as varchar(20)))"
PLACE = "(l_orderkey * 7 + l_linenumber) % 140000"
RANGES = f"SELECT {PATH} AS path, l_partkey * 7 AS a, l_partkey * 7 + cast(l_quantity AS bigint) * 30 AS b, {NAME} AS name FROM lineitem"
SHORT = f"SELECT {PATH} AS path, l_partkey * 5 AS a, l_partkey * 5 + cast(l_quantity AS bigint) % 9 AS b, {NAME} AS name FROM lineitem"
PLACES = f"SELECT {PATH} AS path, {PLACE} AS place FROM lineitem"
EDITS = f"SELECT {PATH} AS path, l_partkey * 7 AS a, l_partkey * 7 + l_linenumber AS b, repeat('x', cast(l_quantity AS int) % 9) AS replacement FROM lineitem"
COSTS = "SELECT l_suppkey AS path, l_returnflag AS part, l_orderkey * 8 + l_linenumber AS ordinal, cast(l_quantity AS bigint) AS cost, l_suppkey % 40 AS used FROM lineitem"
BUDGET = 500
NEXT = "SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_quantity > 49"
FUNCTIONS = "SELECT concat('u', cast(p_partkey % 5 AS varchar(20))) AS path, concat('f', cast(p_partkey AS varchar(20))) AS name, p_size > 4 AS is_static FROM part"
CALLS = "SELECT concat('u', cast(l_partkey % 5 AS varchar(20))) AS path, concat('f', cast(l_partkey AS varchar(20))) AS src, concat('f', cast(l_partkey + 5 * l_suppkey AS varchar(20))) AS dst FROM lineitem"


def _made(spark: SparkSession, d: str, sql: str, table: str = "lineitem") -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {t}"), t=spark.read.parquet(f"{d}/{table}.parquet"))


def _ranges(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return _made(spark, d, sql).withColumnsRenamed({"a": "start", "b": "end"})


def q_range_owner(spark, d):
    points = _made(spark, d, PLACES).distinct().withColumnRenamed("place", "start")
    return intervals.owner(points, _ranges(spark, d, RANGES)).withColumnRenamed("start", "place")


def q_interval_overlap(spark, d):
    met = intervals.overlaps(_ranges(spark, d, RANGES), _ranges(spark, d, SHORT))
    return met.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.col("a_start") * F.col("b_end") % 1009).alias("sum"))


def q_containing(spark, d):
    held = intervals.containing(_ranges(spark, d, SHORT), _ranges(spark, d, RANGES))
    return held.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


def q_merged_ranges(spark, d):
    return relate.merge_ranges(_ranges(spark, d, SHORT), saver(spark)).withColumnsRenamed({"start": "first", "end": "last"})


def q_edit_conflicts(spark, d):
    edits_ = _ranges(spark, d, SHORT).select("path", "start", "end").distinct()
    return relate.edit_conflicts(edits_, saver(spark)).select("path", F.col("start").alias("first"), F.col("end").alias("last"))


def q_offset_remap(spark, d):
    offsets = _made(spark, d, PLACES).withColumnRenamed("place", "offset")
    return relate.remap(offsets, _ranges(spark, d, EDITS), saver(spark)).withColumnRenamed("offset", "old")


def q_latest_before(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    points = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("asked")).distinct()
    marks = e.where("event_type = 'click'").select("user_id", F.col("ts").alias("mark"))
    return relate.latest_before(points, marks, ["user_id"], "asked", "mark", saver(spark)).select("user_id", "asked", "latest")


def q_spent_budget(spark, d):
    rows = _made(spark, d, COSTS).withColumnsRenamed({"part": "function", "cost": "lines"})
    return budgets.spent(rows, saver(spark), BUDGET).select("path", F.col("function").alias("part"), "ordinal", "accepted")


def q_reached_nodes(spark, d):
    roots = spark.read.parquet(f"{d}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("node"))
    return closures.reachable(roots, _made(spark, d, NEXT), saver(spark))


def q_dead_functions(spark, d):
    return relate.dead_statics(_made(spark, d, FUNCTIONS, "part"), _made(spark, d, CALLS), saver(spark))


def q_wrapped_texts(spark, d):
    text = X.wrapped(F.col("content"))
    return documents(spark, d).select("path", F.md5(text.cast("binary")).alias("md5"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))


def q_packed_words(spark, d):
    words = F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.element_at(F.split("p_name", " "), 1), F.lit("_"), i.cast("string"), F.when(i % 7 == 3, F.repeat(F.lit("x"), (i % 5).cast("int") * 15)).otherwise(""), F.lit(".c")))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", X.packed(words, "SRCS = ").alias("packed"))


def _committed(spark: SparkSession, d: str) -> Versions:
    """Documents as version 1; in version 2 some are in their messy form and some are gone; in version 3 those are back."""
    log = Versions(spark, fresh_folder(spark, "versions"))
    log.commit(documents(spark, d), 0)
    log.commit(messy(spark, d).where("path like '%3'").unionByName(documents(spark, d).where("path like '%7'").withColumn("content", F.lit(None).cast("string"))), 1)
    log.commit(documents(spark, d).where("path like '%7'"), 2)
    return log


def q_files_as_of(spark, d):
    return _committed(spark, d).as_of(2).select("path", "version", F.md5(F.col("content").cast("binary")).alias("md5"))


def q_reverted_files(spark, d):
    """A commit that later ones built upon is refused whole; the last one is taken back."""
    log = _committed(spark, d)
    number, clash = log.revert(2)
    taken, _ = log.revert(3)
    last = log.as_of().groupBy("version").agg(F.count("*").alias("n"))
    refused = clash.agg(F.lit(-1).cast("long").alias("version"), F.count("*").alias("n"))
    return last.unionByName(refused).withColumn("taken", F.lit(taken if number is None else number).cast("long"))


def q_late_writer(spark, d):
    """Two writers plan on version 1: the second may write what the first left alone, and nothing else."""
    log = Versions(spark, fresh_folder(spark, "versions"))
    log.commit(documents(spark, d), 0)
    log.commit(messy(spark, d).where("path like '%3'"), 1)
    _, refused = log.commit(messy(spark, d).where("path like '%3' or path like '%4'"), 1)
    log.commit(messy(spark, d).where("path like '%4'"), 1)
    return refused.select("path", F.lit("refused").alias("status")).unionByName(log.as_of().where("version > 1").select("path", F.concat(F.lit("version "), F.col("version").cast("string")).alias("status")))


def _counts(files: DataFrame) -> DataFrame:
    """(key, counts) of files (key, content): the rules of lines."""
    found = lines.line_rules(files.select(F.col("key").alias("path"), "content")).groupBy("path", "rule_id").agg(F.count("*").alias("n"))
    each = found.groupBy(F.col("path").alias("key")).agg(F.sort_array(F.collect_list(F.struct("rule_id", "n"))).alias("counts"))
    return files.select("key").join(each, "key", "left").select("key", F.coalesce("counts", F.array().cast("array<struct<rule_id: string, n: bigint>>")).alias("counts"))


def q_cached_counts(spark, d):
    """Counts by rule, first of the documents, then kept up to date as some take their messy form and some go."""
    keyed = lambda f: f.withColumn("key", F.sha2("content", 256))
    before = keyed(documents(spark, d))
    after = keyed(messy(spark, d).where("path like '%3' or path like '%4'").unionByName(documents(spark, d).where("path not like '%3' and path not like '%4' and path not like '%5'")))
    cache = ResultCache(spark, fresh_folder(spark, "cache"))
    none = spark.createDataFrame([], "rule_id string, n long")
    nothing = before.limit(0)
    totals = saver(spark)(refreshed(cache, none, nothing, before, _counts))
    return refreshed(cache, totals, before, after, _counts)


def q_project_scan(spark, d):
    """Documents written as files in a folder for each language, and that folder read as a project, but for one language."""
    root = fresh_folder(spark, "project")
    text = spark.read.parquet(f"{d}/documents.parquet").select("lang", F.translate("text", "\r\n", "  ").alias("value"))
    text.write.partitionBy("lang").text(root)
    tree.register(spark)
    found = spark.read.format("project_tree").load(root).where("path like 'lang=%' and path like '%.txt'").where(~F.col("path").startswith("lang=de/"))
    return found.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.sum("bytes").alias("bytes"), F.sum(F.size(F.split(F.decode("content", "UTF-8"), "\n")) - 1).cast("long").alias("n_lines"))


QUERIES = {k.removeprefix("q_"): v for k, v in list(globals().items()) if k.startswith("q_")}
_BY_START = "WINDOW w AS (PARTITION BY path ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_PACK = r"""list_reduce(list_prepend('SRCS = ', words), lambda acc, w, i: CASE
  WHEN length(replace(string_split(acc, chr(10))[-1], chr(9), '    ')) + length(w) + (CASE WHEN acc[-1] = ' ' THEN 0 ELSE 1 END) + (CASE WHEN i = len(words) + 1 THEN 0 ELSE 2 END) <= 80
  THEN acc || (CASE WHEN acc[-1] = ' ' THEN '' ELSE ' ' END) || w ELSE acc || ' ' || chr(92) || chr(10) || chr(9) || w END)"""
ORACLE = {
    "range_owner": f"WITH r AS ({RANGES}), p AS (SELECT DISTINCT * FROM ({PLACES})), f AS (SELECT p.path, place, min({{'a': a, 'b': b, 'n': name}}).n AS owner FROM p JOIN r ON p.path = r.path AND a <= place AND place < b GROUP BY ALL) SELECT p.path, p.place, owner FROM p LEFT JOIN f ON p.path = f.path AND p.place = f.place",
    "interval_overlap": f"WITH x AS (SELECT DISTINCT path, a, b FROM ({RANGES})), y AS (SELECT DISTINCT path, a, b FROM ({SHORT})) SELECT x.path, count(*) AS n, sum(x.a * y.b % 1009)::BIGINT AS sum FROM x JOIN y ON x.path = y.path AND x.a < y.b AND y.a < x.b GROUP BY x.path",
    "containing": f"WITH x AS (SELECT DISTINCT path, a, b FROM ({SHORT})), c AS (SELECT DISTINCT * FROM ({RANGES})), h AS (SELECT DISTINCT x.path, x.a, x.b, c.name FROM x JOIN c ON x.path = c.path AND c.a <= x.a AND x.b <= c.b) SELECT path, count(*) AS n, count(DISTINCT name) AS n_names FROM h GROUP BY path",
    "merged_ranges": f"WITH r AS (SELECT path, a, b, max(b) OVER w AS behind FROM ({SHORT}) {_BY_START}), g AS (SELECT *, count(*) FILTER (WHERE behind IS NULL OR a > behind) OVER (PARTITION BY path ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM r) SELECT path, min(a) AS first, max(b) AS last FROM g GROUP BY path, part",
    "edit_conflicts": f"WITH r AS (SELECT path, a, b, max(b) OVER w AS behind, max(a) OVER w AS latest FROM (SELECT DISTINCT path, a, b FROM ({SHORT})) {_BY_START}) SELECT path, a AS first, b AS last FROM r WHERE a < behind OR (a = latest AND a = b)",
    "offset_remap": f"WITH p AS (SELECT DISTINCT * FROM ({PLACES})), e AS (SELECT path, b, length(replacement) - (b - a) AS delta FROM ({EDITS})) SELECT p.path, p.place AS old, (p.place + coalesce(sum(delta), 0))::BIGINT AS new FROM p LEFT JOIN e ON p.path = e.path AND e.b <= p.place GROUP BY p.path, p.place",
    "latest_before": "WITH p AS (SELECT DISTINCT user_id, ts AS asked FROM events WHERE event_type = 'purchase') SELECT user_id, asked, (SELECT max(ts) FROM events e WHERE e.user_id = p.user_id AND event_type = 'click' AND ts < asked) AS latest FROM p",
    "spent_budget": f"WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY path, part ORDER BY ordinal, cost) AS i FROM ({COSTS})), s AS (SELECT path, part, 0::BIGINT AS i, min(used) AS now, NULL::BIGINT AS ordinal, NULL::BOOLEAN AS accepted FROM c GROUP BY path, part UNION ALL SELECT c.path, c.part, c.i, CASE WHEN now + cost <= {BUDGET} THEN now + cost ELSE now END, c.ordinal, now + cost <= {BUDGET} FROM s JOIN c ON c.path = s.path AND c.part = s.part AND c.i = s.i + 1) SELECT path, part, ordinal, accepted FROM s WHERE i > 0",
    "reached_nodes": f"WITH RECURSIVE e AS ({NEXT}), r AS (SELECT o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r",
    "dead_functions": f"WITH RECURSIVE f AS ({FUNCTIONS}), e AS (SELECT DISTINCT * FROM ({CALLS})), r AS (SELECT path, name FROM f WHERE NOT is_static UNION SELECT e.path, e.dst FROM r JOIN e ON e.path = r.path AND e.src = r.name) SELECT path, name FROM f WHERE is_static AND (path, name) NOT IN (SELECT path, name FROM r)",
    "packed_words": rf"WITH w AS (SELECT p_partkey, list_transform(range(1, p_size + 1), lambda i: string_split(p_name, ' ')[1] || '_' || i || (CASE WHEN i % 7 = 3 THEN repeat('x', (i % 5)::INT * 15) ELSE '' END) || '.c') AS words FROM part) SELECT p_partkey, {_PACK} AS packed FROM w",
}
# line by line: up to the last blank among the first 81 characters, or the whole first word where it is longer
_CUT = "CASE WHEN length(rest) <= 80 THEN length(rest) WHEN contains(left(rest, 81), ' ') THEN 81 - strpos(reverse(left(rest, 81)), ' ') WHEN contains(rest, ' ') THEN strpos(rest, ' ') - 1 ELSE length(rest) END"
ORACLE["wrapped_texts"] = rf"""WITH RECURSIVE d AS (SELECT 'doc' || doc_id AS path, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS t FROM documents),
  s AS (SELECT path, 0 AS i, ''::VARCHAR AS line, t AS rest FROM d UNION ALL SELECT path, i + 1, left(rest, {_CUT}), substr(rest, {_CUT} + 2) FROM s WHERE rest <> ''),
  l AS (SELECT path, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE i > 0), '') AS body FROM s GROUP BY path)
  SELECT path, md5(body) AS md5, len(string_split(body, chr(10))) AS n_lines FROM l"""
_SIDES = f"d AS (SELECT 'doc' || doc_id AS path, text AS content, {MESSY} AS messy FROM documents)"
ORACLE |= {
    "project_scan": "SELECT 'lang=' || lang AS folder, sum(strlen(text) + 1)::BIGINT AS bytes, count(*) AS n_lines FROM documents WHERE lang <> 'de' GROUP BY lang",
    "files_as_of": f"WITH {_SIDES} SELECT path, CASE WHEN path LIKE '%3' THEN 2 ELSE 1 END AS version, md5(CASE WHEN path LIKE '%3' THEN messy ELSE content END) AS md5 FROM d WHERE path NOT LIKE '%7'",
    "reverted_files": f"WITH {_SIDES}, v AS (SELECT CASE WHEN path LIKE '%3' THEN 2 ELSE 1 END AS version, count(*) AS n FROM d WHERE path NOT LIKE '%7' GROUP BY 1 UNION ALL SELECT -1, count(*) FROM d WHERE path LIKE '%7') SELECT version, n, 4::BIGINT AS taken FROM v",
    "late_writer": f"WITH {_SIDES} SELECT path, 'refused' AS status FROM d WHERE path LIKE '%3' UNION ALL SELECT path, CASE WHEN path LIKE '%3' THEN 'version 2' ELSE 'version 3' END FROM d WHERE path LIKE '%3' OR path LIKE '%4'",
    "cached_counts": f"WITH {_SIDES}, f AS (SELECT path, CASE WHEN path LIKE '%3' OR path LIKE '%4' THEN messy ELSE content END AS content FROM d WHERE path NOT LIKE '%5'), l AS (SELECT path, unnest(string_split(content, chr(10))) AS text FROM f) SELECT 'LINE_TOO_LONG' AS rule_id, count(*) AS n FROM l WHERE {WIDTH} > 80 HAVING count(*) > 0 UNION ALL SELECT 'TRAILING_SPACE', count(*) FROM l WHERE text[-1] IN (' ', chr(9)) HAVING count(*) > 0",
}
