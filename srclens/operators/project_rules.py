"""Rules over a whole project and over what other tools say of it; articles and a report for readers."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .facts import view
from .lines import lines
from .makefile import RULE, assignments

#: Folders that belong to the system with all below them, and folders that hold other people's.
SYSTEM = ("/Applications", "/Library", "/System", "/bin", "/boot", "/dev", "/etc", "/lib", "/lib64", "/private/etc", "/private/var/db", "/private/var/root", "/private/var/vm", "/proc", "/root", "/run", "/sbin", "/sys", "/usr")
BROAD = ("/Users", "/Volumes", "/home", "/media", "/mnt", "/opt", "/private", "/private/tmp", "/private/var", "/srv", "/tmp", "/var")
#: Articles on rules, by locale; English stands in where one is missing.
ARTICLES = {
    ("LINE_TOO_LONG", "en"): "A line takes at most 80 columns; tabs go to the next stop of four.",
    ("LINE_TOO_LONG", "fr"): "Une ligne tient en 80 colonnes au plus ; une tabulation va au prochain multiple de quatre.",
    ("LINE_TOO_LONG", "de"): "Eine Zeile hat höchstens 80 Spalten; ein Tabulator reicht bis zum nächsten Vielfachen von vier.",
    ("LINE_TOO_LONG", "es"): "Una línea ocupa 80 columnas como máximo; un tabulador llega al siguiente múltiplo de cuatro.",
    ("TRAILING_SPACE", "en"): "Blanks and tabs at the end of a line go.",
    ("TRAILING_SPACE", "fr"): "Pas d'espace ni de tabulation en fin de ligne.",
    ("TOO_MANY_FUNCS", "en"): "A file holds at most five functions.",
    ("TOO_MANY_LINES", "en"): "A function's body has at most 25 lines.",
    ("INVALID_HEADER", "en"): "A file begins with a header of eleven lines of 80 columns.",
}


def unsupported(reported: DataFrame, supported: list[str], guidance: dict[str, str]) -> DataFrame:
    """reported diagnostics of rules that no rewrite mends, with what can be done by hand."""
    spark = reported.sparkSession
    known = spark.createDataFrame([(r,) for r in supported], "rule_id string")
    advice = spark.createDataFrame(list(guidance.items()), "rule_id string, advice string")
    out = reported.join(known, "rule_id", "left_anti").join(advice, "rule_id", "left")
    return out.select("path", "line", F.lit("info").alias("severity"), "rule_id", F.coalesce("advice", F.lit("mend it by hand")).alias("message"))


def guard_proofs(files: DataFrame) -> DataFrame:
    """files (path, content): (path, guard, status) of each header.

    status: unique if the guard's name stands in its own file alone; shared if
    other files hold it; duplicate if another header has the same file name;
    dynamic if a Makefile defines names while it runs, so that nothing is proved.
    """
    name = F.regexp_extract("path", "[^/]+$", 0)
    heads = files.where(F.col("path").endswith(".h")).select("path", X.guard_name(name).alias("guard"))
    words = files.select("path", F.explode(F.array_distinct(X.identifiers(F.col("content")))).alias("guard"))
    others = words.withColumnRenamed("path", "other").join(heads, "guard").where("other <> path").select("path").distinct().withColumn("shared", F.lit(True))
    twice = heads.groupBy("guard").agg(F.count("*").alias("n"))
    dynamic = files.where((F.lower(name) == "makefile") & F.col("content").rlike(r"-D\s*\$|-D\s*['\"]?\$\(|\$\(shell\b")).agg((F.count("*") > 0).alias("dynamic"))
    status = F.when(F.col("dynamic"), "dynamic").when(F.col("n") > 1, "duplicate").when(F.col("shared"), "shared").otherwise("unique")
    return heads.join(twice, "guard").join(others, "path", "left").crossJoin(F.broadcast(dynamic)).select("path", "guard", status.alias("status"))  # one row


def makefile_rules(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """sources (path, content) and their logical lines: (path, line, rule_id) of the name, its rule, the default rule and the layout."""
    own = assignments(rows)
    named = own.where("name = 'NAME'").select("path").distinct()
    hit = F.col("text").rlike(RULE) & ~F.col("text").startswith("\t") & ~F.col("text").rlike(r"^\s*[A-Za-z0-9_.]+\s*(:::=|::=|:=|\+=|\?=|!=|=)")
    rules = rows.where(hit).select("path", "line", F.split(F.trim(F.regexp_extract("text", RULE, 1)), r"\s+").alias("targets"))
    built = rules.where(F.exists("targets", lambda t: t.isin("$(NAME)", "${NAME}"))).select("path").distinct()
    concrete = rules.where(F.exists("targets", lambda t: ~t.startswith(".") & ~t.contains("%")))
    first = concrete.groupBy("path").agg(F.min_by(F.struct("line", "targets"), "line").alias("r"))
    default = first.where(~F.array_contains("r.targets", "all")).select("path", F.col("r.line").alias("line"), F.lit("MAKEFILE_DEFAULT_RULE").alias("rule_id"))
    gone = lambda have, rule: sources.select("path").join(have, "path", "left_anti").select("path", F.lit(1).alias("line"), F.lit(rule).alias("rule_id"))
    text = lines(sources).withColumn("content", F.regexp_replace("text", "\r$", ""))
    layout = text.select("path", "line", F.explode(F.filter(F.array(F.when(X.visual_width(F.col("content")) > 80, "MAKEFILE_LINE_TOO_LONG"), F.when(F.col("content").rlike(r"\\[ \t]+$"), "MAKEFILE_TRAILING_AFTER_BACKSLASH")), lambda x: x.isNotNull())).alias("rule_id"))
    return gone(named, "MAKEFILE_NAME_MISSING").unionByName(gone(built, "MAKEFILE_NAME_RULE_MISSING")).unionByName(default).unionByName(layout)


def preflight(files: DataFrame, checker_version: str | None = None, verified: str = "") -> DataFrame:
    """files (path, kind): advisories on a project (path '') and on its files: no Makefile, no policy, a README to be read by people, a checker of another release."""
    flags = files.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in (("makefile", F.col("kind") == "makefile"), ("policy", F.col("path").endswith("policy.toml")), ("c", F.col("kind").isin("c_source", "c_header")))))
    rules = [(~F.col("makefile") & F.col("c"), "info", "MAKEFILE_ABSENT"), (~F.col("policy"), "info", "POLICY_ABSENT")]
    if checker_version is not None and checker_version != verified:
        rules.append((F.lit(True), "warning", "CHECKER_NOT_VERIFIED"))
    told = F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule_id"))) for c, s, r in rules))
    own = flags.select(F.explode(F.filter(told, lambda x: x.isNotNull())).alias("t")).select(F.lit("").alias("path"), "t.severity", "t.rule_id")
    readme = files.where("kind = 'markdown'").select("path", F.lit("info").alias("severity"), F.lit("README_PRESENT").alias("rule_id"))
    return own.unionByName(readme)


def recovery_rows(facts: DataFrame) -> DataFrame:
    """What a C file's scan could not read; inside a call of va_arg a type stands where a value should, which is no fault."""
    rows = view(facts, "recovery")
    varied = view(facts, "call").where("name = 'va_arg'").select("path", "line").distinct().withColumn("varied", F.lit(True))
    severity = F.when(F.col("varied"), "info").otherwise("warning")
    return rows.join(varied, ["path", "line"], "left").select("path", "line", severity.alias("severity"), F.lit("PARSER_RECOVERY").alias("rule_id"), F.col("name").alias("message"))


def leak_rows(leaks: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Loss records and memory errors at the place in the sources that they name; without one they stand at line 0 of the run."""
    def at(rows: DataFrame, rule: str, severity: str, message: Column) -> DataFrame:
        return rows.select(F.coalesce("file", "path").alias("path"), F.coalesce("line", F.lit(0)).alias("line"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule_id"), message.alias("message"))

    out = at(leaks, "MEMORY_LEAK", "error", F.concat(F.col("bytes").cast("string"), F.lit(" bytes")))
    return out if errors is None else out.unionByName(at(errors, "MEMORY_ERROR", "error", F.col("what")))


def normal_path(path: Column) -> Column:
    """An absolute path without '.', '..' and repeated slashes."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def protected(path: Column, homes: tuple[str, ...] = ()) -> Column:
    """Why a folder (an absolute path) may not be worked on without being asked: root, home, system or broad; null if it may."""
    p = normal_path(path)
    system = F.lit(False)
    for s in SYSTEM:
        system = system | (p == s) | p.startswith(s + "/")
    return F.when(p == "/", "root").when(p.isin(*(h.rstrip("/") or "/" for h in homes)), "home").when(system | p.startswith("/var/"), "system").when(p.isin(*BROAD), "broad")


def articles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, tag, a) for (r, tag), a in ARTICLES.items()], "rule_id string, locale string, article string")


def explain(rules: DataFrame, spark: SparkSession) -> DataFrame:
    """rules (rule_id, locale): each with its article in that locale, else in English, else null."""
    all_ = articles(spark)
    english = all_.where("locale = 'en'").select("rule_id", F.col("article").alias("english"))
    out = rules.join(all_, ["rule_id", "locale"], "left").join(english, "rule_id", "left")
    return out.select("rule_id", "locale", F.coalesce("article", "english").alias("article"))


def report(rows: DataFrame, files: DataFrame, shown: int = 3) -> DataFrame:
    """rows of diagnostics, files (path, content): (severity, rule_id, n, n_paths, text), a group's first occurrences with their lines and a caret, ready to print."""
    w = Window.partitionBy("severity", "rule_id").orderBy("path", "line", "message")
    groups = rows.groupBy("severity", "rule_id").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"))
    first = rows.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= shown)
    with_line = first.join(files.select("path", "content"), "path", "left").withColumn("source", F.get(F.split("content", "\n", -1), F.col("line") - 1)).drop("content")
    place = F.concat(F.lit("  "), X.escape_inline(F.col("path")), F.lit(":"), F.col("line").cast("string"))
    mark = F.concat(F.lit("\n    | "), X.escape_inline(F.col("source")), F.lit("\n    | ^"), F.when(F.col("message") != "", F.concat(F.lit(" "), X.escape_inline(F.col("message")))).otherwise(""))
    text = with_line.withColumn("text", F.concat(place, F.coalesce(mark, F.lit("")))).groupBy("severity", "rule_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("rows"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("\n  and "), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise("")
    title = F.concat(F.col("severity"), F.lit(" ["), F.col("rule_id"), F.lit("] "), F.col("n").cast("string"), F.when(F.col("n") == 1, " occurrence in ").otherwise(" occurrences in "), F.col("n_paths").cast("string"), F.when(F.col("n_paths") == 1, " file\n").otherwise(" files\n"))
    return groups.join(text, ["severity", "rule_id"]).select("severity", "rule_id", "n", "n_paths", F.concat(title, F.array_join(F.transform("rows", lambda r: r["text"]), "\n"), more).alias("text"))
