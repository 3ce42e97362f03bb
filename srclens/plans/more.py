"""Queries over operators on sources, plans, headers, settings and reports, with SQL for DuckDB beside them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import edits, headers, lines, project_rules, relate, report, semantics, transforms
from ..operators.facts import facts, functions, view
from ..operators.makefile import artifact, formatted, logical, source_refs, source_status, without_missing
from ..sources import files, logs, project
from ..tables import saver
from . import fixtures
from .queries import DIAG, D, M, WIDTH, documents, line_diagnostics, longs, messy, of_suppliers, per_supplier, values

#: Both engines read this: pages as files of several kinds.
PAGE_PATH = "CASE page_id % 7 WHEN 0 THEN 'src/page' || page_id || '.c' WHEN 1 THEN 'inc/page' || page_id || '.h' WHEN 2 THEN 'lib' || page_id || '/Makefile' WHEN 3 THEN 'doc' || page_id || '/README.md' WHEN 4 THEN 'build/page' || page_id || '.o' WHEN 5 THEN 'src/keep' || page_id || '.o' ELSE 'SRC/page' || (page_id - 6) || '.C' END"
PATTERNS = ["# objects", "*.o", "!keep*.o", "/build/", "doc?*/", "\\#odd"]


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.expr(PAGE_PATH).alias("path"), F.col("html").alias("content"))


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _named(spark, d, table: dict[str, str]) -> DataFrame:
    return per_supplier(spark, d, table)


# sources


def q_file_kinds(spark, d):
    return _pages(spark, d).groupBy(F.coalesce(X.file_kind(F.col("path")), F.lit("none")).alias("kind")).agg(F.count("*").alias("n"))


def q_bytes_gate(spark, d):
    raw = _docs(spark, d).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.encode("text", "UTF-8"), F.expr("X'00'"))).when(F.col("doc_id") % 7 == 1, F.concat(F.encode("text", "UTF-8"), F.expr("X'C3'"))).otherwise(F.encode("text", "UTF-8")).alias("content"))
    out = files.gate(raw)
    return out.select("path", F.col("bytes").cast("long").alias("bytes"), "failure", F.when(F.col("failure").isNull(), F.col("content_hash")).alias("content_hash"))


def q_classified_files(spark, d):
    extra = F.when(F.col("page_id") % 9 == 0, F.expr("X'00'")).otherwise(F.encode("content", "UTF-8"))
    path = F.when(F.col("page_id") % 13 == 0, F.concat(F.lit("a/.git/"), "path")).otherwise(F.col("path"))
    rows = files.gate(_pages(spark, d).select(path.alias("path"), extra.alias("content")))
    return files.classified(rows.unionByName(rows)).groupBy("class").agg(F.count("*").alias("n"))


def q_ignored_paths(spark, d):
    return _pages(spark, d).where(~files.ignored(F.col("path"), PATTERNS)).select("page_id", "path")


def q_json_requests(spark, d):
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("text is not null")
    item = F.struct(F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".c")).alias("path"), F.col("text").alias("source"))
    sent = turns.groupBy(F.col("conv_id").alias("request_id")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("files"))).alias("request"))
    return files.from_json(sent).select("request_id", "path", F.md5(F.col("content").cast("binary")).alias("md5"), "failure")


def q_vcs_scope(spark, d):
    names = [f"src/page{i}.c" for i in range(0, 400, 14)] + ["gone.c"]
    return files.scoped(_pages(spark, d), files.nul_paths("\x00".join(names).encode() + b"\x00")).select("page_id", "path")


def q_cache_misses(spark, d):
    src = documents(spark, d).select("path", F.sha2("content", 256).alias("content_hash"))
    key = files.cache_key("lint", "cfg", "tool 1")
    cache = src.where("path like '%5'").select(key.alias("key"), F.lit("{}").alias("result"))
    return files.misses(src, cache, key).select("path", "key")


def q_compiler_report(spark, d):
    log = {"src/a.c": "src/a.c:3:7: warning: unused variable 'x' [-Wunused-variable]\nsrc/a.c:9:1: note: here\n", "src/b.c": "inc/b.h:4:2: error: unknown type name 'q'\n", "src/c.c": "src/c.c:5:1: warning: leak [-Wanalyzer-malloc-leak]\n", "src/d.c": "./src/d.c:2:4: warning: do not use this [bugprone-branch-clone]\n", "src/e.c": "src/e.c:1:10: fatal error: q.h: No such file or directory\n", "src/f.c": "cc1: internal trouble\n"}
    return longs(logs.compiler_report(_named(spark, d, log).withColumnRenamed("content", "output").withColumn("exit_code", F.lit(1))).select("path", "line", "column", "severity", "rule_id"), "line", "column").withColumnRenamed("column", "col")


# text


def _halfway() -> Column:
    """The byte behind the first half of a text's characters."""
    return F.octet_length(F.left(F.col("content"), F.floor(F.char_length("content") / 2).cast("int")))


def q_positions(spark, d):
    rows = messy(spark, d).withColumn("p", lines.position(F.col("content"), _halfway()))
    return rows.select("path", *(F.col(f"p.{c}").cast("long").alias(c) for c in ("line", "byte_col", "visual_col")))


def q_column_offsets(spark, d):
    """There and back: the offset of a position's line and column is where it was taken."""
    rows = messy(spark, d).withColumn("p", lines.position(F.col("content"), _halfway()))
    back = [X.offset_of(F.col("content"), F.col("p.line"), F.col(f"p.{c}"), v).cast("long").alias(n) for c, v, n in (("visual_col", True, "by_width"), ("byte_col", False, "by_byte"))]
    return rows.select("path", *back)


#: Both engines read this: a part as C code, piece by piece, as it is and with what is hidden blanked.
PIECES = [("int\tx;\t", False), ("// {name} \\\n more \" of it", True), ("\nchar\t*s = ", False), ('"{type} \\" // {brand}"', True), (" + u8(", False), ("L'\\''", True), (" , ", False), ("/* {name} * / \n\t'{type} **/", True), (" x\" unclosed\nu'\n", False)]


def _code(masked: bool) -> str:
    own = [p for p in PIECES]
    sql = lambda t: "concat('" + t.replace("'", "''").replace("{name}", "', p_name, '").replace("{type}", "', p_type, '").replace("{brand}", "', p_brand, '").replace("\\", "', chr(92), '").replace("\n", "', chr(10), '").replace("\t", "', chr(9), '") + "')"
    return "concat(" + ", ".join(f"regexp_replace({sql(t)}, '[^' || chr(10) || ']', ' ', 'g')" if hidden and masked else sql(t) for t, hidden in own) + ")"


def q_masked_sources(spark, d):
    code = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.expr(_code(False)).alias("code"))
    return code.select("p_partkey", X.masked(F.col("code")).alias("code"))


def q_splices(spark, d):
    return messy(spark, d).select("path", F.md5(X.remove_splices(F.replace("content", F.lit("e "), F.lit("e\\\n"))).cast("binary")).alias("md5"))


def q_ansi(spark, d):
    return documents(spark, d).select("path", F.md5(X.strip_ansi(F.replace("content", F.lit(" the "), F.lit(" \x1b[1;31mthe\x1b[0m "))).cast("binary")).alias("md5"))


def q_escaped(spark, d):
    return messy(spark, d).select("path", F.md5(X.escape_inline(F.concat(F.col("content"), F.lit("\x1b\x07\x85"))).cast("binary")).alias("md5"))


def q_durations(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", X.duration(F.col("p_partkey") * F.col("p_partkey") * 0.0001).alias("took"))


def q_messages(spark, d):
    n = F.col("n_chars") % 3
    tag = F.concat(F.upper("lang"), F.lit("_XX.UTF-8"))
    text = X.fill(F.lit("{n} {form} in {path}"), {"n": n, "form": X.plural(n, X.locale_of(tag))})
    return _docs(spark, d).select("doc_id", X.locale_of(tag).alias("locale"), text.alias("message"))


def q_declared_commas(spark, d):
    text = F.expr("repeat('x(a, b[1, 2]), ', p_size % 5) || '{1, 2}, y)), z'")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", X.comma_count(text).cast("long").alias("n"))


#: Both engines read this: a part as code of one of six kinds, of which every second is trivia.
TRIVIAL = "CASE p_size % 6 WHEN 0 THEN '' WHEN 1 THEN concat('/* ', p_name, ' open') WHEN 2 THEN concat('/* ', p_name, ' **/ // ', p_type, chr(10)) WHEN 3 THEN concat('int a; // ', p_name) WHEN 4 THEN concat(chr(9), '//', chr(10), '/**/', chr(10), '/* // */') ELSE concat('/ * ', p_name, ' */') END"


def q_trivia_sources(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", X.trivia_only(F.expr(TRIVIAL)).alias("trivia"))


# reports


def q_scores(spark, d):
    f = messy(spark, d).select(F.col("path"), (F.abs(F.hash("path")) * 0 + F.char_length("path") % 4).alias("part"), F.when(F.instr("content", "\r") > 0, "carriage return").alias("failure"), F.lit(True).alias("changed"))
    counts = report.summary(f, line_diagnostics(spark, d)).withColumns({"n_blocked": F.lit(2), "hard_fail": F.lit(False)})
    return report.score(counts.unionByName(counts.withColumns({"n_files": F.lit(0).cast("long"), "hard_fail": F.lit(True)}))).select("n_files", "score", "grade")


def q_distinct_rows(spark, d):
    rows = line_diagnostics(spark, d)
    return report.distinct(rows.unionByName(rows)).groupBy("rule_id").agg(F.count("*").alias("n"))


def q_json_reports(spark, d):
    f = messy(spark, d).select("path", F.lit(True).alias("changed"), F.lit(None).cast("string").alias("failure"))
    kind = "struct<schema: int, path: string, diagnostics: array<struct<line: bigint, rule_id: string>>>"
    read = report.report_json(f, line_diagnostics(spark, d)).select(F.from_json("report", kind).alias("r"))
    return read.select("r.path", F.col("r.schema").cast("long").alias("version"), F.size("r.diagnostics").cast("long").alias("n"), F.aggregate("r.diagnostics", F.lit(0).cast("long"), lambda a, x: a + x["line"]).alias("lines"))


def q_human_report(spark, d):
    return project_rules.report(line_diagnostics(spark, d), messy(spark, d)).select("severity", "rule_id", "n", "n_paths", F.element_at(F.split("text", "\n"), 1).alias("title"), (F.size(F.split("text", "\n  doc")) - 1).cast("long").alias("shown"))


def q_run_summary(spark, d):
    f = messy(spark, d).select("path", F.lit(None).cast("string").alias("failure"), F.lit(True).alias("changed"), F.create_map(F.lit("A"), F.lit(2).cast("long"), F.lit("B"), F.char_length("path").cast("long")).alias("fixes"))
    return report.summary(f, line_diagnostics(spark, d)).select("n_files", "n_changed", "n_fixes", "n_error", "n_warning")


def q_groups_by_source(spark, d):
    rows = line_diagnostics(spark, d).withColumn("source", F.when(F.col("line") % 2 == 0, "native").otherwise("official")).withColumn("help", F.lit("h"))
    return report.by_rule(rows).select("severity", "rule_id", "source", "n", "n_paths")


def q_underlined_headings(spark, d):
    text = F.concat(F.lit("Title\n===\n\nwords "), F.translate("text", "\n\r#`~", "     "), F.lit("\n\nPart\n---\n\n- item\n---\n#### Four\n"))
    rows = lines.lines(_docs(spark, d).select(F.col("doc_id").alias("path"), text.alias("content")))
    return lines.headings(rows).groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "level"))), lambda h: h["level"].cast("string")), "").alias("levels"))


def q_markers(spark, d):
    rows = line_diagnostics(spark, d).withColumn("column", F.lit(None).cast("int"))
    return longs(project.markers(rows).groupBy("severity", "code").agg(F.sum("startLineNumber").alias("total"), F.max("startColumn").alias("most")), "total", "most", "severity")


def q_articles(spark, d):
    asked = _docs(spark, d).select(F.col("lang").alias("locale"), F.when(F.col("doc_id") % 2 == 0, "LINE_TOO_LONG").otherwise("TOO_MANY_FUNCS").alias("rule_id")).distinct()
    return project_rules.explain(asked, spark).select("rule_id", "locale", F.col("article").isNotNull().alias("found"), (F.col("locale") != "en").alias("asked_other"))


def q_unsupported_rules(spark, d):
    rows = line_diagnostics(spark, d)
    return project_rules.unsupported(rows, ["TRAILING_SPACE"], {"LINE_TOO_LONG": "break the line"}).groupBy("rule_id", "message").agg(F.count("*").alias("n"))


def q_preflight(spark, d):
    src = _pages(spark, d).select("path", X.file_kind(F.col("path")).alias("kind"))
    return project_rules.preflight(src, "3.3.59", "3.3.51").groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


# plans and files


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("path", "content", F.sha2("content", 256).alias("content_hash"))


def q_stale_writes(spark, d):
    now = _hashed(messy(spark, d))
    planned = _hashed(documents(spark, d))
    return files.stale(planned, now).select("path")


def q_undone(spark, d):
    before, after = _hashed(documents(spark, d)), _hashed(messy(spark, d))
    manifest = project.undo_manifest(before, after, "run 1")
    current = after.where("path not like '%3'").withColumn("content_hash", F.when(F.col("path").like("%4"), F.lit("other")).otherwise(F.col("content_hash")))
    return project.undo(manifest, current).select("path", "status", F.md5(F.col("content").cast("binary")).alias("md5"))


def q_quarantine(spark, d):
    src = _pages(spark, d).select("path", X.file_kind(F.col("path")).alias("kind"), F.sha2("content", 256).alias("content_hash"))
    return project.quarantine_plan(src).select("path", "target")


def q_moved_paths(spark, d):
    return files.moved(_pages(spark, d).select("path"), "src", "lib/src").select("path", "new_path")


def q_path_clashes(spark, d):
    return files.clashes(_pages(spark, d)).select(F.col("key").alias("portable"), "n")


def q_allowed_paths(spark, d):
    paths = _pages(spark, d).select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), "path")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("a/../"), "path")).otherwise(F.col("path")).alias("path"))
    return paths.select("page_id", X.valid_path(F.col("path")).alias("allowed"))


def q_import_batch(spark, d):
    found = _pages(spark, d).select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit(".hidden/"), "path")).otherwise(F.concat(F.repeat(F.lit("d/"), (F.col("page_id") % 11).cast("int")), "path")).alias("path"), F.encode("content", "UTF-8").alias("content"))
    return files.import_batch(found, depth=6, entries=10**6, most=10_000).groupBy("status").agg(F.count("*").alias("n"))


def q_stored_projects(spark, d):
    whole = files.serialized(documents(spark, d).withColumn("project", F.substring("path", -1, 1)), 1 << 30)
    back = files.deserialized(whole.unionByName(spark.createDataFrame([("bad", "{")], whole.schema)))
    return back.groupBy("project").agg(F.count("path").alias("n"))


def q_edits_applied(spark, d):
    """Each document's first and sixth character are replaced; every fifth has edits that conflict, short ones have none."""
    src = documents(spark, d)
    # where a character ends, in bytes
    end = lambda n: F.octet_length(F.left(F.col("content"), F.lit(n))).cast("long")
    long = src.where(F.char_length("content") > 10)
    one = lambda a, b, t, rows=long: rows.select("path", end(a).alias("start"), end(b).alias("end"), F.lit(t).alias("replacement"))
    made = one(0, 1, "<<").unionByName(one(5, 6, "")).unionByName(one(0, 1, "<<")).unionByName(one(0, 4, "x", long.where("path like '%5'")))
    return edits.applied(src, made).select("path", "status", F.md5(F.col("content").cast("binary")).alias("md5"))


def q_approved_plans(spark, d):
    plans = _hashed(documents(spark, d)).select("path", F.col("content_hash").alias("original_hash"), F.md5(F.col("content").cast("binary")).alias("replacement_hash"))
    return edits.approved(plans, plans.where("path like '%2'")).select("path")


def q_name_mentions(spark, d):
    names = spark.createDataFrame([("the",), ("de",), ("und",), ("que_",)], "name string")
    rows = documents(spark, d).select("path", F.lit(0).cast("long").alias("start"), F.col("content").alias("text"))
    return edits.mentions(rows, names, X.identifiers).groupBy("name").agg(F.count("*").alias("n"))


# headers


def _headed(spark, d, kind):
    src = _docs(spark, d).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 9, F.repeat(F.lit("x"), 60)).otherwise(""), F.lit(".c")).alias("name"), F.col("text").alias("content"))
    return src.select("doc_id", "name", headers.ensure(kind, F.col("content"), F.col("name"), F.lit("login"), F.lit("login@42.fr"), F.lit("2024/01/02 03:04:05")).alias("h")).select("doc_id", "name", "h.content", "h.status")


def q_c_headers(spark, d):
    return _headed(spark, d, "c").select("doc_id", "status", F.md5(F.col("content").cast("binary")).alias("md5"))


def q_makefile_headers(spark, d):
    return _headed(spark, d, "makefile").select("doc_id", "status", F.md5(F.col("content").cast("binary")).alias("md5"))


def q_header_updates(spark, d):
    new = headers.update("c", F.col("content"), F.lit("new.c"), F.lit("other"), F.lit("2025/06/07 08:09:10"))
    rows = _headed(spark, d, "c").select("doc_id", "status", "content", new.alias("new"))
    line = lambda c, k: F.get(F.split(c, "\n", 12), F.lit(k))
    return rows.select("doc_id", headers.is_valid("c", F.col("new")).alias("valid"), F.rtrim(F.substring(line("new", 3), 1, 40)).alias("name_line"), F.rtrim(F.substring(line("new", 8), 1, 50)).alias("update_line"), F.when(F.col("status") == "inserted", line("new", 7) == line("content", 7)).otherwise(F.col("new") == F.col("content")).alias("kept"))


def q_header_diagnostics(spark, d):
    return headers.diagnostics(_headed(spark, d, "c").select(F.col("name").alias("path"), "content"), "c").select("path", "rule_id")


# C and Makefiles over small sources


def _shapes(spark, d):
    return saver(spark)(facts(_named(spark, d, fixtures.SHAPES_C)))


def q_c_macros(spark, d):
    return view(_shapes(spark, d), "macro").select("path", "name", F.col("flag").alias("called"), "text")


def q_c_enums_and_arrays(spark, d):
    return semantics.constants_and_arrays(_shapes(spark, d)).select("path", "fact", "name", F.col("value").cast("long").alias("value"), "class")


def q_c_returns(spark, d):
    f = _shapes(spark, d)
    own = functions(f).where("kind = 'definition'").select("path", F.col("name").alias("owner"), "returns_pointer")
    return view(f, "return").select("path", "owner", "text").join(own, ["path", "owner"])


def q_c_null_directives(spark, d):
    return semantics.null_state(_shapes(spark, d)).groupBy("path", "provides").agg(F.count("*").alias("n"))


def q_c_pointer_returns(spark, d):
    return semantics.pointer_returns(_shapes(spark, d)).select("path", F.col("function").alias("name"), "null_known")


def q_c_zero_returns(spark, d):
    return semantics.zero_returns(_shapes(spark, d)).select("path", "rule_id", "message")


def q_c_vla_corrections(spark, d):
    arrays = semantics.constants_and_arrays(_shapes(spark, d))
    reported = arrays.where("fact = 'array'").select("path", "start")
    kept, wrong = semantics.vla_corrections(reported, arrays)
    return kept.select("path", F.lit("kept").alias("rule_id")).unionByName(wrong.select("path", "rule_id")).groupBy("path", "rule_id").agg(F.count("*").alias("n"))


def q_c_declaration_facts(spark, d):
    kinds = ["declaration_split", "shared_declaration", "inert_local", "pointer_star", "initial_block"]
    return _shapes(spark, d).where(F.col("fact").isin(kinds)).groupBy("path", "owner", "fact").agg(F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_list("name"))).alias("names"))


def q_c_recovery(spark, d):
    f = facts(_named(spark, d, fixtures.BROKEN_C))
    return longs(project_rules.recovery_rows(f).select("path", "line", "severity", "message"), "line")


def q_c_recovered_functions(spark, d):
    return functions(facts(_named(spark, d, fixtures.BROKEN_C))).where("kind = 'definition'").select("path", "name")


def q_c_rewrite_cases(spark, d):
    """One small file a rewrite, each run alone."""
    rows = []
    for k, (rule, before, _) in enumerate(fixtures.REWRITE_CASES):
        asked = (rule,) if rule not in transforms.PHASES else ()
        only = frozenset() if asked else frozenset([rule])
        rows.append(transforms.fixed(_named(spark, d, {f"case{k}.c": before}), asked, only).select("path", "content", "changed"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def q_c_reported_rewrites(spark, d):
    """Rewrites at places that a checker names."""
    from ..operators import rewrites as R

    def run(frames):
        cases = fixtures.reported_cases(R)
        for f in frames:
            for key in f["s_suppkey"]:
                yield pd.DataFrame([(key, name, R.apply_edits(src, edit(R.View(src)))) for name, src, edit in cases], columns=["s_suppkey", "name", "content"])

    return spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey").mapInPandas(run, "s_suppkey long, name string, content string")


def q_markdown_headings(spark, d):
    text = F.concat(F.lit("# Title\n\n"), F.translate("text", "#`~", "   "), F.lit("\n### Jump\n```\n# code\n```\n#### Next\n"))
    rows = lines.lines(_docs(spark, d).select(F.col("doc_id").alias("path"), text.alias("content")))
    h = lines.headings(rows)
    return h.groupBy("path").agg(F.count("*").alias("n"), F.sum("level").cast("long").alias("levels")).join(lines.heading_jumps(h).groupBy("path").agg(F.count("*").alias("jumps")), "path")


_DOC = "'doc' || doc_id"
_PAGES = f"WITH p AS (SELECT page_id, {PAGE_PATH} AS path, html AS content FROM pages)"
_KIND = "CASE WHEN path LIKE '%.c' THEN 'c_source' WHEN path LIKE '%.h' THEN 'c_header' WHEN lower(regexp_extract(path, '[^/]+$')) = 'makefile' THEN 'makefile' WHEN regexp_matches(path, '(^|/)README(\\.|$)') THEN 'markdown' END"
_IGNORED = "(regexp_matches(path, '\\.o$') AND NOT regexp_matches(path, '(^|/)keep[^/]*\\.o$')) OR path LIKE 'build/%' OR regexp_matches(path, '^doc.[^/]*/')"
_N = "CASE WHEN doc_id % 10 = 9 THEN repeat('x', 60) ELSE '' END"


def _framed(kind: str, left: str, right: str) -> str:
    a, b = headers.KINDS[kind][:2]
    return f"'{a}' || {left} || repeat(' ', (80 - {len(a) + len(b) + len(right)} - strlen({left}))::INT) || '{right}{b}'"


def _header(kind: str) -> str:
    edge, lead, ends = headers.KINDS[kind][2:]
    left = ["''", "''", f"'{lead}' || name", "''", f"'{lead}By: login <login@42.fr>'", "''", *(f"'{lead}{w}: 2024/01/02 03:04:05 by login'" for w in ("Created", "Updated")), "''"]
    rows = [f"'{edge}'", *(_framed(kind, f"({x})", r) for x, r in zip(left, ends, strict=True)), f"'{edge}'"]
    name = f"SELECT *, {_DOC} || {_N} || '.c' AS name FROM documents"
    return f"WITH n AS ({name}), s AS (SELECT *, CASE WHEN doc_id % 10 = 9 THEN 'too_long' ELSE 'inserted' END AS status FROM n) SELECT doc_id, status, md5(CASE WHEN status = 'inserted' THEN {' || chr(10) || '.join(rows)} || chr(10) || chr(10) || text ELSE text END) AS md5 FROM s"


_HALF = f"{M}, h AS (SELECT path, substr(content, 1, length(content) // 2) AS head, string_split(substr(content, 1, length(content) // 2), chr(10))[-1] AS text FROM d)"
ORACLE = {
    "file_kinds": f"{_PAGES} SELECT coalesce({_KIND}, 'none') AS kind, count(*) AS n FROM p GROUP BY 1",
    "bytes_gate": f"SELECT {_DOC} AS path, (strlen(text) + (doc_id % 7 < 2)::INT)::BIGINT AS bytes, CASE doc_id % 7 WHEN 0 THEN 'NUL byte' WHEN 1 THEN 'invalid UTF-8' END AS failure, CASE WHEN doc_id % 7 > 1 THEN sha256(text) END AS content_hash FROM documents",
    "classified_files": f"{_PAGES}, q AS (SELECT DISTINCT CASE WHEN page_id % 13 = 0 THEN 'a/.git/' || path ELSE path END AS path, page_id % 9 = 0 AS bad FROM p) SELECT CASE WHEN bad THEN 'error' WHEN contains(path, '/.git/') THEN 'control' WHEN {_KIND} IS NOT NULL THEN 'processable' ELSE 'unexpected' END AS class, count(*) AS n FROM q GROUP BY 1",
    "run_summary": f"{DIAG}, c AS (SELECT count(*) AS n_files, count(*) AS n_changed, sum(2 + length(path))::BIGINT AS n_fixes FROM d), e AS (SELECT count(*) FILTER (WHERE severity = 'error') AS n_error, count(*) FILTER (WHERE severity = 'warning') AS n_warning FROM g) SELECT * FROM c, e",
    "groups_by_source": f"{DIAG} SELECT severity, rule_id, CASE WHEN line % 2 = 0 THEN 'native' ELSE 'official' END AS source, count(*) AS n, count(DISTINCT path) AS n_paths FROM g GROUP BY ALL",
    "underlined_headings": "SELECT doc_id AS path, '124' AS levels FROM documents",
    "ignored_paths": f"{_PAGES} SELECT page_id, path FROM p WHERE NOT ({_IGNORED})",
    "json_requests": "SELECT conv_id AS request_id, 'turn' || turn || '.c' AS path, md5(text) AS md5, NULL::VARCHAR AS failure FROM conversations WHERE text IS NOT NULL",
    "vcs_scope": f"{_PAGES} SELECT page_id, path FROM p WHERE page_id % 14 = 0 AND page_id < 400",
    "cache_misses": f"{D} SELECT path, sha256('lint' || chr(0) || path || chr(0) || sha256(content) || chr(0) || 'cfg' || chr(0) || 'tool 1') AS key FROM d WHERE path NOT LIKE '%5'",
    "compiler_report": of_suppliers(values("path, line, col, severity, rule_id", ("src/a.c", 3, 7, "warning", "CC_UNUSED_VARIABLE"), ("src/b.c", 0, 0, "error", "CC_STRICT"), ("src/c.c", 5, 1, "warning", "CC_ANALYZER_MALLOC_LEAK"), ("src/d.c", 2, 4, "warning", "TIDY_BUGPRONE_BRANCH_CLONE"), ("src/e.c", 0, 0, "info", "CC_CONFIGURATION_INCOMPLETE"), ("src/f.c", 0, 0, "error", "CC_REJECTED"))),
    "positions": f"{_HALF} SELECT path, len(string_split(head, chr(10)))::BIGINT AS line, (strlen(text) + 1)::BIGINT AS byte_col, ({WIDTH} + 1)::BIGINT AS visual_col FROM h",
    "column_offsets": f"{_HALF} SELECT path, strlen(head)::BIGINT AS by_width, strlen(head)::BIGINT AS by_byte FROM h",
    "masked_sources": f"SELECT p_partkey, {_code(True)} AS code FROM part",
    "splices": rf"{M} SELECT path, md5(regexp_replace(replace(content, 'e ', 'e' || chr(92) || chr(10)), '(\\|\?\?/)\r?\n', '', 'g')) AS md5 FROM d",
    "ansi": f"{D} SELECT path, md5(content) AS md5 FROM d",
    "escaped": f"{M} SELECT path, md5(replace(replace(replace(content, chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') || chr(92) || 'u{{1b}}' || chr(92) || 'u{{7}}' || chr(92) || 'u{{85}}') AS md5 FROM d".replace("{{", "{").replace("}}", "}"),
    "durations": "WITH t AS (SELECT p_partkey, (p_partkey * p_partkey)::DOUBLE * 0.0001 AS s FROM part) SELECT p_partkey, CASE WHEN s < 0.001 THEN printf('%.0f µs', s * 1e6) WHEN s < 1 THEN printf('%.0f ms', s * 1e3) WHEN s < 60 THEN printf('%.2f s', s) ELSE printf('%d min %.1f s', floor(s / 60)::BIGINT, s - floor(s / 60) * 60) END AS took FROM t",
    "messages": "WITH t AS (SELECT doc_id, n_chars % 3 AS n, CASE WHEN lower(lang) IN ('en', 'fr', 'es', 'de') THEN lower(lang) ELSE 'en' END AS locale FROM documents) SELECT doc_id, locale, n || ' ' || CASE WHEN n = 1 OR (n = 0 AND locale = 'fr') THEN 'one' ELSE 'other' END || ' in {path}' AS message FROM t",
    "declared_commas": "SELECT p_partkey, (p_size % 5 + 2)::BIGINT AS n FROM part",
    "trivia_sources": "SELECT p_partkey, p_size % 2 = 0 AS trivia FROM part",
    "scores": f"{DIAG}, s0 AS (SELECT path, content AS t0 FROM d), c AS (SELECT count(*) AS n_files, count(*) FILTER (WHERE contains(t0, chr(13))) AS n_failed FROM s0), e AS (SELECT count(*) FILTER (WHERE severity = 'error') AS n_error, count(*) FILTER (WHERE severity = 'warning') AS n_warning FROM g), t AS (SELECT n_files, greatest(0, 100 - least(8 * n_error, 45) - least(8 * n_failed, 30) - least(5 * n_warning, 25) - 20 - least(n_files, 10)) AS score FROM c, e) SELECT n_files, score::INT AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade FROM t UNION ALL SELECT 0, 0, 'INCOMPLETE'",
    "distinct_rows": f"{DIAG} SELECT rule_id, count(*) AS n FROM g GROUP BY 1",
    "json_reports": f"{DIAG} SELECT d.path, 2::BIGINT AS version, count(g.line) AS n, coalesce(sum(g.line), 0)::BIGINT AS lines FROM d LEFT JOIN g USING (path) GROUP BY d.path",
    "human_report": f"{DIAG} SELECT severity, rule_id, count(*) AS n, count(DISTINCT path) AS n_paths, severity || ' [' || rule_id || '] ' || count(*) || ' occurrences in ' || count(DISTINCT path) || ' files' AS title, 3::BIGINT AS shown FROM g GROUP BY severity, rule_id",
    "markers": f"{DIAG} SELECT CASE severity WHEN 'error' THEN 8 ELSE 4 END::BIGINT AS severity, rule_id AS code, sum(line)::BIGINT AS total, 1::BIGINT AS most FROM g GROUP BY 1, 2",
    "articles": "SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'LINE_TOO_LONG' ELSE 'TOO_MANY_FUNCS' END AS rule_id, lang AS locale, true AS found, lang <> 'en' AS asked_other FROM documents",
    "unsupported_rules": f"{DIAG} SELECT rule_id, 'break the line' AS message, count(*) AS n FROM g WHERE rule_id = 'LINE_TOO_LONG' GROUP BY 1",
    "preflight": f"{_PAGES} SELECT 'POLICY_ABSENT' AS rule_id, 'info' AS severity, 1::BIGINT AS n UNION ALL SELECT 'CHECKER_NOT_VERIFIED', 'warning', 1 UNION ALL SELECT 'README_PRESENT', 'info', count(*) FROM p WHERE page_id % 7 = 3",
    "stale_writes": f"{M}, o AS (SELECT {_DOC} AS path, text FROM documents) SELECT path FROM o JOIN d USING (path) WHERE text <> content",
    "undone": f"{M}, o AS (SELECT {_DOC} AS path, text FROM documents), c AS (SELECT path, text FROM o JOIN d USING (path) WHERE text <> content) SELECT path, CASE WHEN path LIKE '%3' THEN 'missing' WHEN path LIKE '%4' THEN 'conflict' ELSE 'restored' END AS status, CASE WHEN path NOT LIKE '%3' AND path NOT LIKE '%4' THEN md5(text) END AS md5 FROM c",
    "quarantine": f"{_PAGES} SELECT path, '.quarantine/' || substr(sha256(content), 1, 12) || '-' || regexp_extract(path, '[^/]+$') AS target FROM p WHERE {_KIND} IS NULL",
    "moved_paths": f"{_PAGES} SELECT path, 'lib/' || path AS new_path FROM p WHERE path LIKE 'src/%'",
    "path_clashes": f"{_PAGES} SELECT lower(path) AS portable, count(*) AS n FROM p GROUP BY 1 HAVING count(*) > 1",
    "allowed_paths": "SELECT page_id, page_id % 3 = 2 AS allowed FROM pages",
    "import_batch": f"{_PAGES}, q AS (SELECT strlen(content) AS bytes, CASE WHEN page_id % 5 = 0 THEN '.hidden/' || path ELSE repeat('d/', (page_id % 11)::INT) || path END AS path FROM p) SELECT CASE WHEN path LIKE '.%' OR path LIKE '%/.%' THEN 'hidden' WHEN len(string_split(path, '/')) - 1 > 6 THEN 'too deep' WHEN bytes > 10000 THEN 'too large' ELSE 'taken' END AS status, count(*) AS n FROM q GROUP BY 1",
    "edits_applied": f"{D} SELECT path, CASE WHEN length(content) <= 10 THEN 'unchanged' WHEN path LIKE '%5' THEN 'conflict' ELSE 'applied' END AS status, md5(CASE WHEN path LIKE '%5' OR length(content) <= 10 THEN content ELSE '<<' || substr(content, 2, 4) || substr(content, 7) END) AS md5 FROM d",
    "approved_plans": f"{D} SELECT path FROM d WHERE path LIKE '%2'",
    "name_mentions": f"{D}, w AS (SELECT DISTINCT path, unnest(list_filter(regexp_split_to_array(content, '[^A-Za-z0-9_]+'), lambda x: x IN ('the', 'de', 'und', 'que_'))) AS name FROM d) SELECT name, count(*) AS n FROM w GROUP BY 1",
    "c_headers": _header("c"),
    "makefile_headers": _header("makefile"),
    "header_updates": f"SELECT doc_id, doc_id % 10 <> 9 AS valid, CASE WHEN doc_id % 10 <> 9 THEN '/*   new.c' ELSE rtrim(substr(string_split(text, chr(10))[4], 1, 40)) END AS name_line, CASE WHEN doc_id % 10 <> 9 THEN '/*   Updated: 2025/06/07 08:09:10 by other' ELSE rtrim(substr(string_split(text, chr(10))[9], 1, 50)) END AS update_line, true AS kept FROM documents",
    "header_diagnostics": f"SELECT {_DOC} || {_N} || '.c' AS path, 'INVALID_HEADER' AS rule_id FROM documents WHERE doc_id % 10 = 9",
    "c_macros": of_suppliers(values("path, name, called, text", ("shapes.c", "SIZE", False, "4"), ("shapes.c", "TWICE", True, "( x ) ( ( x ) + ( x ) )"))),
    "c_enums_and_arrays": of_suppliers(values("path, fact, name, value, class", ("shapes.c", "enum_constant", "RED", 0, None), ("shapes.c", "enum_constant", "BLUE", 4, None), ("shapes.c", "enum_constant", "GREY", 5, None), ("shapes.c", "array", "table", 6, "constant"), ("shapes.c", "array", "free_size", None, "variable"))),
    "c_returns": of_suppliers(values("path, owner, text, returns_pointer", ("shapes.c", "first", "( 0 )", True), ("shapes.c", "second", "( 0 )", True), ("shapes.c", "third", "( p == 0 )", False))),
    "c_null_directives": of_suppliers(values("path, provides, n", ("shapes.c", True, 1), ("shapes.c", False, 1))),
    "c_pointer_returns": of_suppliers(values("path, name, null_known", ("shapes.c", "first", True), ("shapes.c", "second", False))),
    "c_zero_returns": of_suppliers(values("path, rule_id, message", ("shapes.c", "POINTER_ZERO_WITHOUT_NULL", "second"))),
    "c_vla_corrections": of_suppliers(values("path, rule_id, n", ("shapes.c", "VLA_FALSE_POSITIVE", 1), ("shapes.c", "kept", 1))),
    "c_declaration_facts": of_suppliers(values("path, owner, fact, n, names", ("shapes.c", "first", "initial_block", 1, ""), ("shapes.c", "third", "initial_block", 1, ""), ("shapes.c", "third", "declaration_split", 2, "kept,unused"), ("shapes.c", "third", "inert_local", 2, "free_size,unused"), ("shapes.c", "first", "pointer_star", 1, ""), ("shapes.c", "third", "shared_declaration", 1, ""), ("shapes.c", "third", "pointer_star", 1, ""))),
    "c_recovery": of_suppliers(values("path, line, severity, message", ("arms.c", 5, "warning", "conditional"), ("cut.c", 1, "warning", "syntax"), ("odd.c", 3, "warning", "unknown"))),
    "c_recovered_functions": of_suppliers(values("path, name", ("arms.c", "one"), ("arms.c", "two"), ("cut.c", "good"), ("odd.c", "f"))),
    "c_rewrite_cases": of_suppliers(values("path, content, changed", *((f"case{k}.c", after, True) for k, (_, _, after) in enumerate(fixtures.REWRITE_CASES)))),
    "c_reported_rewrites": f"SELECT s_suppkey, v.* FROM supplier, ({values('name, content', *fixtures.REPORTED)}) v",
    "markdown_headings": "SELECT doc_id AS path, 3::BIGINT AS n, 8::BIGINT AS levels, 1::BIGINT AS jumps FROM documents",
    "stored_projects": f"{D} SELECT right(path, 1) AS project, count(*) AS n FROM d GROUP BY 1",
}
QUERIES = {k.removeprefix("q_"): v for k, v in list(globals().items()) if k.startswith("q_")}
