import hypothesis.strategies as st
from hypothesis import given, settings
from pyspark.sql import functions as F

from srclens.operators import facts, intervals, lexer, lines, relate, report
from srclens.sources import files, logs, project
from srclens.streaming import ingest
from srclens.tables import saver


def test_scan(spark, tmp_path):
    (tmp_path / "p/.git").mkdir(parents=True)
    for name, data in {"a.c": b"int a;\n", "b.h": b"\xff", "c.c": b"a\x00b", ".git/x.c": b"", "odd.txt": b"t"}.items():
        (tmp_path / "p" / name).write_bytes(data)
    got = {r["path"]: (r["kind"], r["bytes"], r["content"], r["failure"]) for r in files.scan(spark, str(tmp_path / "p")).collect()}
    assert got == {"a.c": ("c_source", 7, "int a;\n", None), "b.h": ("c_header", 1, None, "invalid UTF-8"), "c.c": ("c_source", 3, None, "NUL byte"), "odd.txt": (None, 1, "t", None)}


def test_tree(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, In, LessThanOrEqual, StringStartsWith

    from srclens.functions import text as X
    from srclens.sources import tree

    root = tmp_path / "p"
    made = {"a.c": 7, "src/b.h": 1, "src/deep/Makefile": 30, "src/deep/big.c": 5000, "lib/vendored/.git/HEAD": 3, "lib/vendored/x.c": 3, "lib/y.c": 3, ".git/z.c": 1, "node_modules/m/w.c": 1, "README.md": 4, "README": 2, "odd.C": 1, "é/ü.c": 2}
    for name, size in made.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * size)
    (root / "link.c").symlink_to(root / "a.c")
    (root / "loop").symlink_to(root)
    want = {n: s for n, s in made.items() if not n.startswith(("lib/vendored", ".git", "node_modules"))}
    tree.register(spark)
    found = spark.read.format("project_tree").load(str(root))
    rows = found.select("path", "bytes", F.octet_length("content").alias("n"), F.col("kind").eqNullSafe(X.file_kind(F.col("path"))).alias("same")).collect()
    assert {r["path"]: r["bytes"] for r in rows} == want and all(r["n"] == r["bytes"] and r["same"] for r in rows)
    assert {r["path"] for r in spark.read.format("project_tree").load(f"file://{root}").where("kind = 'c_source' and bytes <= 100").collect()} == {"a.c", "lib/y.c", "é/ü.c"}
    small = {r["path"]: (r["bytes"], r["failure"]) for r in files.scan(spark, str(root), most=1000).collect()}
    assert small == {n: (s, "too large" if s > 1000 else None) for n, s in want.items()}

    def entered(*filters):
        reader = tree.TreeReader(str(root))
        left = list(reader.pushFilters(list(filters)))
        assert not left
        return [p.path for p in reader.partitions()], sorted(r for p in reader.partitions() for b in reader.read(p) for r in b.column(0).to_pylist())

    assert entered()[0] == ["", "lib/", "src/", "src/deep/", "é/"]
    assert entered(StringStartsWith(("path",), "src/de")) == (["src/deep/"], ["src/deep/Makefile", "src/deep/big.c"])
    assert entered(EqualTo(("path",), "lib/y.c")) == (["lib/"], ["lib/y.c"])
    assert entered(In(("path",), ("lib/y.c", "é/ü.c"))) == (["lib/", "é/"], ["lib/y.c", "é/ü.c"])
    assert entered(EqualTo(("kind",), "makefile"), LessThanOrEqual(("bytes",), 30)) == (["src/deep/"], ["src/deep/Makefile"])
    plan = found.where("kind = 'c_source' and path like 'src/%' and bytes <= 10")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan


def test_requests(spark):
    rows = [(1, '{"files": [{"path": "a.c", "source": "x"}]}'), (2, "nonsense"), (3, '{"files": [{"path": "a", "source": ""}, {"path": "a", "source": ""}]}'), (4, '{"files": [{"path": "../a", "source": ""}]}')]
    got = {(r["request_id"], r["path"], r["failure"]) for r in files.from_json(spark.createDataFrame(rows, "request_id int, request string")).collect()}
    assert got == {(1, "a.c", None), (2, None, "not a request"), (3, None, "a path is given twice"), (4, None, "a path is not allowed")}


def test_ignored(spark):
    rows = [("a.o",), ("x/a.o",), ("keep.o",), ("build/x/y.c",), ("src/build.c",), ("doc/a.txt",), ("doc/x/a.txt",)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").where(files.ignored(F.col("p"), ["*.o", "!keep.o", "build/", "/doc/*.txt", "# no"])).collect()]
    assert got == ["a.o", "x/a.o", "build/x/y.c", "doc/a.txt"]


def test_compiler_log(spark):
    text = "a.c:3:7: warning: unused variable 'x' [-Wunused-variable]\n/usr/include/x.h:9:1: error: bad\na.c:1:1: note: here\nx/a.c:2:2: warning: w [bugprone-foo.Bar]\n"
    got = sorted(logs.compiler(logs.numbered(spark.createDataFrame([("a.c", text)], "path string, output string"))).select("line", "column", "severity", "rule_id").collect())
    assert [tuple(r) for r in got] == [(0, 0, "error", "CC_STRICT"), (0, 0, "warning", "TIDY_BUGPRONE_FOO_BAR"), (3, 7, "warning", "CC_UNUSED_VARIABLE")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1 \t\n\r\\\"'/*#{}();=é世﻿")), max_size=60))
def test_tokens_give_the_source_back(source):
    found = list(lexer.tokenize(source))
    assert "".join(t.text for t in found) == source
    assert all(a.end == b.start for a, b in zip(found, found[1:], strict=False))
    assert lexer.mask(source).count("\n") == source.count("\n") and len(lexer.mask(source)) == len(source)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("int fx(){};,=*[]1 \n#")), max_size=80))
def test_facts_of_anything(source):
    facts.Scan("a.c", source)


def test_ranges(spark):
    r = spark.createDataFrame([("a", 0, 5, "f"), ("a", 3, 9000, "g"), ("a", 9000, 9000, "none")], "path string, start long, end long, name string")
    p = spark.createDataFrame([("a", 4), ("a", 5), ("a", 8999), ("a", 9000), ("b", 1)], "path string, start long")
    assert {(x["path"], x["start"], x["owner"]) for x in intervals.owner(p, r).collect()} == {("a", 4, "f"), ("a", 5, "g"), ("a", 8999, "g"), ("a", 9000, None), ("b", 1, None)}
    assert [tuple(x) for x in relate.merge_ranges(spark.createDataFrame([("a", 0, 2), ("a", 2, 4), ("a", 6, 7), ("a", 1, 3)], "path string, start long, end long"), saver(spark)).collect()] == [("a", 0, 4), ("a", 6, 7)]
    both = intervals.overlaps(r.select("path", "start", "end"), r.select("path", "start", "end")).collect()
    assert len(both) == 4
    edits = spark.createDataFrame([("a", 0, 2, "xyz"), ("a", 1, 3, ""), ("a", 5, 5, "q"), ("a", 5, 5, "r")], "path string, start long, end long, replacement string")
    assert sorted((x["start"], x["end"]) for x in relate.edit_conflicts(edits, saver(spark)).collect()) == [(1, 3), (5, 5)]
    new = relate.remap(spark.createDataFrame([("a", 2), ("a", 4), ("a", 9)], "path string, offset long"), edits.where("start <> 1"), saver(spark))
    assert {(x["offset"], x["new"]) for x in new.collect()} == {(2, 3), (4, 5), (9, 12)}


def test_merge_and_traces(spark):
    kind = "path string, rule_id string, start long"
    native, official = spark.createDataFrame([("a", "R", 1), ("a", "R", 2)], kind), spark.createDataFrame([("a", "R", 1), ("a", "S", 9)], kind)
    assert {tuple(x) for x in relate.official_merge(native, official).select("rule_id", "start", "source").collect()} == {("R", 1, "official"), ("R", 2, "native"), ("S", 9, "official")}
    t = spark.createDataFrame([("a", 1, "m", None), ("a", 1, "m", "x"), ("a", 2, "m", None)], "path string, start long, message string, tag string")
    assert relate.trace_dedup(t).count() == 2


def test_score(spark):
    cols = "n_files int, n_failed int, n_changed int, n_error int, n_warning int, n_info int, n_blocked int, hard_fail boolean"
    rows = [(0, 0, 0, 0, 0, 0, 0, False), (3, 0, 0, 0, 0, 0, 0, False), (3, 0, 1, 1, 1, 1, 0, False), (3, 9, 20, 99, 99, 99, 9, False), (3, 0, 0, 0, 0, 0, 0, True)]
    got = [(r["score"], r["grade"]) for r in report.score(spark.createDataFrame(rows, cols)).collect()]
    assert got == [(0, "INCOMPLETE"), (100, "A"), (84, "B"), (0, "F"), (59, "F")]


def test_include_sort_and_headings(spark):
    text = '#include "b.h"\n#include <z.h>\n#include <a.h>\n// c\n#include "a.h"\n'
    rows = lines.lines(spark.createDataFrame([("a.c", text)], "path string, content string"))
    assert [r["text"] for r in lines.sort_includes(rows).orderBy("line").collect()] == ["#include <a.h>", "#include <z.h>", '#include "b.h"', "// c", '#include "a.h"', ""]
    md = lines.lines(spark.createDataFrame([("m", "# a\n```\n# no\n```\n### b\n## c")], "path string, content string"))
    assert [tuple(r) for r in lines.heading_jumps(lines.headings(md)).select("line", "level").collect()] == [(5, 3)]
    offsets = spark.createDataFrame([("aé\n\tb", 0), ("aé\n\tb", 2), ("aé\n\tb", 5)], "t string, o int").select(lines.position(F.col("t"), F.col("o")).alias("p"))
    assert [None if r["p"] is None else tuple(r["p"]) for r in offsets.collect()] == [(1, 1, 1), None, (2, 2, 5)]


def test_streamed_findings(spark, tmp_path):
    spark.createDataFrame([("a", "x" * 90 + "\nok"), ("b", "ok ")], "path string, content string").write.parquet(str(tmp_path / "in"))
    q = ingest.findings(ingest.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("found").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT rule_id, n FROM found").collect()} == {("LINE_TOO_LONG", 1), ("TRAILING_SPACE", 1)}


def test_archives_in_pieces(spark, monkeypatch):
    """The pieces of a project are its archive, byte for byte, also past the places where ZIP64 begins; no row holds more than a file."""
    import io
    import zipfile

    made = {p: {f"{'é' if i % 3 else ''}f{i}.c": f"int a{i};é\n" * (i % 7) for i in range(n)} for p, n in (("a", 60), ("b", 1), ("c", 0))}
    rows = [(p, f, c) for p, own in made.items() for f, c in own.items()]
    pieces = project.archives(spark.createDataFrame([*rows, *rows[:5]], "project string, path string, content string"), saver(spark))
    got = pieces.collect()
    for p in ("a", "b"):
        whole = b"".join(r["data"] for r in sorted((r for r in got if r["project"] == p), key=lambda r: r["at"]))
        assert whole == project.archive(made[p])
        assert {n: zipfile.ZipFile(io.BytesIO(whole)).read(n).decode() for n in zipfile.ZipFile(io.BytesIO(whole)).namelist()} == made[p]
    assert len(got) == 2 * len(rows) + 2 and max(len(r["data"]) for r in got) < 250
    assert sorted(tuple(r) for r in project.opened(pieces).collect()) == sorted(rows)
    for limits in ({"FAR": 500}, {"MANY": 3}):
        for k, v in limits.items():
            monkeypatch.setattr(project, k, v)
            monkeypatch.setattr(zipfile, {"FAR": "ZIP64_LIMIT", "MANY": "ZIP_FILECOUNT_LIMIT"}[k], v)
        own, at, parts, listed = made["a"], 0, b"", b""
        for f in sorted(own):
            entry, record = project._entry(f, own[f], at)
            at, parts, listed = at + len(entry), parts + entry, listed + record
        assert parts + listed + project._end(len(own), len(listed), at) == project.archive(own)
