"""Source files as rows: scans, gates, filters, manifests.  Inputs are never written to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_kind, valid_path
from . import tree

#: Names that are neither source nor unexpected, and folders that are not entered.
CONTROL = (".gitignore", ".lintignore", "policy.toml")
PRUNED = r"(^|/)(\.git|\.svn|\.hg|node_modules|target)(/|$)"
MAX_FILES, MAX_FILE_BYTES, MAX_BYTES = 128, 1 << 20, 4 << 20


def scan(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """(path, kind, bytes, content, content_hash, failure) of all files below root; other kinds have kind null.

    Files of more than ``most`` bytes are not opened; they keep their row, with
    their failure.  See ``tree`` for what is not entered.
    """
    tree.register(spark)
    found = spark.read.format("project_tree").load(root)
    files = found.where(~F.regexp_extract("path", "[^/]+$", 0).isin(*CONTROL))
    if most is None:
        return gate(files.select("path", "content"))
    listed = spark.read.format("project_tree").option("content", "false").load(root).where(F.col("bytes") > most).where(~F.regexp_extract("path", "[^/]+$", 0).isin(*CONTROL))
    large = listed.select("path", "kind", F.col("bytes").cast("int").alias("bytes"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("content_hash"), F.lit("too large").alias("failure"))
    return gate(files.where(F.col("bytes") <= most).select("path", "content")).unionByName(large)


def gate(files: DataFrame) -> DataFrame:
    """files (path, content as bytes).  A file with NUL bytes or invalid UTF-8 keeps its row, with its failure and without content."""
    has_nul = F.locate("\x00", F.col("content").cast("string")) > 0
    failure = F.when(~F.is_valid_utf8(F.col("content").cast("string")), "invalid UTF-8").when(has_nul, "NUL byte")
    rows = files.select("path", "content", failure.alias("failure"))
    text = F.when(F.col("failure").isNull(), F.col("content").cast("string"))
    return rows.select("path", file_kind(F.col("path")).alias("kind"), F.octet_length("content").alias("bytes"), text.alias("content"), F.sha2("content", 256).alias("content_hash"), "failure")


def classified(files: DataFrame) -> DataFrame:
    """files of ``scan`` or ``gate`` with ``class``, in path order: error (it can't be read), control, processable or unexpected; a path that stands twice counts once."""
    name = F.regexp_extract("path", "[^/]+$", 0)
    known = F.when(F.col("failure").isNotNull(), "error").when(name.isin(*CONTROL) | F.col("path").rlike(PRUNED), "control").when(F.col("kind").isNotNull(), "processable").otherwise("unexpected")
    return files.withColumn("class", known).dropDuplicates(["path"]).orderBy("path")


def from_json(requests: DataFrame, column: str = "request") -> DataFrame:
    """(request_id, path, content, failure) of {"files": [{"path", "source"}]}; bounds and repeated paths fail the request."""
    kind = "struct<files: array<struct<path: string, source: string>>>"
    files = requests.withColumn("_r", F.from_json(column, kind)["files"])
    size = F.aggregate(F.col("_r"), F.lit(0).cast("long"), lambda n, f: n + F.coalesce(F.octet_length(f.source), F.lit(0)))
    failure = (
        F.when(F.col("_r").isNull(), "not a request")
        .when(F.size("_r") > MAX_FILES, "too many files")
        .when(F.exists("_r", lambda f: F.octet_length(f.source) > MAX_FILE_BYTES), "a file is too large")
        .when(size > MAX_BYTES, "too many bytes")
        .when(F.size(F.array_distinct(F.transform("_r", lambda f: f.path))) < F.size("_r"), "a path is given twice")
        .when(F.exists("_r", lambda f: ~valid_path(f.path)), "a path is not allowed")
    )
    return files.withColumn("failure", failure).select("request_id", F.explode_outer(F.when(F.col("failure").isNull(), F.col("_r"))).alias("f"), "failure").select("request_id", "f.path", F.col("f.source").alias("content"), "failure")


def _segment(text: str) -> str:
    """One part of a gitignore pattern as a regular expression: '*' and '?' don't cross a slash, a backslash takes the next character as it is."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            i += 1
            out += re.escape(text[i])
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            inside = text[i + 1 : end]
            out += f"[{'^' + inside[1:] if inside[0] == '!' else inside}]"
            i = end
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
        i += 1
    return out


def _decided(path: Column, patterns: list[str], folder: bool) -> Column:
    """What the last pattern that matches this very path says; false if none does."""
    out = F.lit(False)
    for line in patterns:
        p = re.sub(r"(?<!\\)\s+$", "", line)
        if not p or p.startswith("#"):
            continue
        back = p.startswith("!")
        p = p[back:]
        only_folders, p = p.endswith("/"), p.removesuffix("/")
        if only_folders and not folder:
            continue
        anchored, parts = "/" in p, p.strip("/").split("/")
        body = "/".join("**" if x == "**" else _segment(x) for x in parts)
        body = body.replace("**/", "(?:.*/)?").replace("/**", "/.*").replace("**", ".*")
        out = F.when(path.rlike(f"^{'' if anchored else '(?:.*/)?'}{body}$"), F.lit(not back)).otherwise(out)
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """gitignore patterns as one expression: the last pattern that matches decides, '!' takes a path back, but not out of a folder that is ignored."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below_ignored = F.exists(above, lambda f: _decided(f, patterns, True))
    return F.when((F.instr(path, "/") > 0) & below_ignored, F.lit(True)).otherwise(_decided(path, patterns, False))


def nul_paths(output: bytes, most: int = 16 << 20) -> list[str]:
    """The relative paths of a version control's NUL-delimited output; what is too long, no UTF-8 or leaves the tree is an error."""
    if len(output) > most or (output and not output.endswith(b"\0")):
        raise ValueError("the output is too long or cut off")
    paths = [p.decode() for p in output.split(b"\0") if p]
    for p in paths:
        if p.startswith("/") or ".." in p.split("/"):
            raise ValueError(f"{p} leaves the tree")
    return sorted(set(paths))


def scoped(sources: DataFrame, paths: list[str]) -> DataFrame:
    """The sources that a version control names as changed or staged; names that are gone count nothing."""
    return sources.join(sources.sparkSession.createDataFrame([(p,) for p in paths], "path string"), "path", "left_semi")


def import_batch(found: DataFrame, depth: int, entries: int, most: int) -> DataFrame:
    """found (path, content as bytes) with ``status``: taken, or why not (hidden, too deep, too large, no UTF-8 or too many entries)."""
    hidden = F.col("path").rlike(r"(^|/)\.")
    status = F.when(hidden, "hidden").when(F.size(F.split("path", "/")) - 1 > depth, "too deep").when(F.octet_length("content") > most, "too large").when(~F.is_valid_utf8(F.col("content").cast("string")), "no UTF-8").otherwise("taken")
    rows = found.withColumn("status", status)
    count = rows.agg((F.count_if(F.col("status") == "taken") > entries).alias("many"))
    return rows.crossJoin(F.broadcast(count)).withColumn("status", F.when(F.col("many") & (F.col("status") == "taken"), "too many entries").otherwise(F.col("status"))).drop("many")  # one row


STORED = "struct<files: array<struct<path: string, content: string>>>"


def serialized(sources: DataFrame, most: int = 2 << 20) -> DataFrame:
    """sources (project, path, content): (project, data), its files in path order as JSON; null where it takes more than ``most`` bytes."""
    whole = sources.groupBy("project").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("path", "content"))).alias("files"))).alias("data"))
    return whole.withColumn("data", F.when(F.octet_length("data") <= most, F.col("data")))


def deserialized(stored: DataFrame) -> DataFrame:
    """(project, path, content) of ``serialized``; what can't be read is absent."""
    return stored.select("project", F.inline(F.from_json("data", STORED)["files"])).select("project", "path", "content")


def cache_key(namespace: str, config: str, tool: str) -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(namespace), "path", "content_hash", F.lit(config), F.lit(tool)), 256)


def misses(sources: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """The sources whose result the cache (key, result) does not hold."""
    return sources.withColumn("key", key).join(cache.select("key"), "key", "left_anti")


def stale(planned: DataFrame, current: DataFrame) -> DataFrame:
    """Planned writes (path, content_hash) whose file has changed since: must be empty before anything is written."""
    return planned.join(current.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def folders(paths: DataFrame) -> DataFrame:
    """(folder, n_files): every folder above a path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return paths.where(F.instr("path", "/") > 0).select(F.explode(above).alias("folder")).groupBy("folder").agg(F.count("*").alias("n_files"))


def moved(paths: DataFrame, old: str, new: str) -> DataFrame:
    """(path, new_path) of what is or is below old."""
    inside = (F.col("path") == old) | F.col("path").startswith(old + "/")
    return paths.where(inside).select("path", F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 30)).alias("new_path"))


def clashes(paths: DataFrame) -> DataFrame:
    """(key, n): paths that differ in case alone."""
    return paths.groupBy(F.lower("path").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
