"""Operators that split hot keys, against brute force, and what they cost in rows and rounds."""

import random

import pytest
from pyspark.sql import functions as F

from srclens.functions import text as X
from srclens.operators import budgets, closures, edits, intervals, relate, scans
from srclens.sources import logs
from srclens.tables import saver

RANGE = "path string, start long, end long"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ranges_made(seed, n, low, high, longest):
    r = random.Random(seed)
    return [(r.choice(["a", "b", None]), s := r.randint(low, high), s + r.choice([0, 1, r.randint(0, longest)])) for _ in range(n)]


@pytest.mark.parametrize("low,high,longest", [(0, 60, 20), (-70, 70, 130), (10**12, 10**12 + 50, 10**12)])
def test_intervals(spark, low, high, longest):
    a, b = ranges_made(1, 60, low, high, longest), ranges_made(2, 60, low, high, longest)
    x, y = spark.createDataFrame(a, RANGE), spark.createDataFrame([(*t, f"n{i}") for i, t in enumerate(b)], f"{RANGE}, name string")
    met = {(p, s, e, t, f) for p, s, e in a for q, t, f in b if p == q and p and s < f and t < e}
    assert set(rows_of(intervals.overlaps(x, y))) == met and intervals.overlaps(x, y).count() == len(met)
    held = {(p, s, e, f"n{i}") for p, s, e in a for i, (q, t, f) in enumerate(b) if p == q and p and t <= s and e <= f}
    assert set(rows_of(intervals.containing(x, y))) == held
    first = {(p, s): min(((t, f, f"n{i}") for i, (q, t, f) in enumerate(b) if p == q and p and t <= s < f), default=(None,))[-1] for p, s, _ in a}
    got = intervals.owner(x.select("path", "start").distinct(), y)
    assert {(r["path"], r["start"]): r["owner"] for r in got.collect()} == first


def test_intervals_over_borders_of_cells_and_batches(spark):
    """Ranges that end, begin and lie across cell borders, at the longest that is short, in batches of five rows; names stand for several ranges."""
    r = random.Random(8)
    edge = 1 << intervals.CELL
    place = lambda: r.choice([-edge, 0, edge, 5 * edge]) + r.choice([-2, -1, 0, 1, 2, r.randint(-300, 300)])
    made = lambda: [(r.choice(["a", "b", None]), s := place(), s + r.choice([0, 1, 2, 300, intervals.SHORT - 1, intervals.SHORT, intervals.SHORT + 1])) for _ in range(90)]
    a, b = made(), made()
    named = [(*t, f"n{i % 20}") for i, t in enumerate(b)]
    x, y = spark.createDataFrame([*a, *a[:9]], RANGE), spark.createDataFrame([*named, *named[:9]], f"{RANGE}, name string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for short in (True, False):  # without long ranges nothing goes through the nodes
            fits = f"end - start < {intervals.SHORT}" if short else "true"
            x2, y2 = x.where(fits), y.where(fits)
            a2, b2 = ([t for t in d if not short or t[2] - t[1] < intervals.SHORT] for d in (a, named))
            met = sorted({(p, s, e, t, f) for p, s, e in a2 for q, t, f, _ in b2 if p == q and p and s < f and t < e})
            assert rows_of(intervals.overlaps(x2, y2)) == sorted(met, key=repr)
            held = {(p, s, e, n) for p, s, e in a2 for q, t, f, n in b2 if p == q and p and t <= s and e <= f}
            assert rows_of(intervals.containing(x2, y2)) == sorted(held, key=repr)
            asks = [(p, s, i) for i, (p, s, _) in enumerate(a2)] + [("a", None, -1)]
            own = [(i, min(((t, f, n) for q, t, f, n in b2 if p == q and p and s is not None and t <= s < f), default=(None,))[-1]) for p, s, i in asks]
            got = intervals.owner(spark.createDataFrame(asks, "path string, start long, i long"), y2)
            assert rows_of(got.select("i", "owner")) == sorted(own, key=repr) and got.columns == ["path", "start", "i", "owner"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_short_ranges_are_shuffled_about_once(spark):
    """Under 80 bytes a range, compressed; with a row for each dyadic node it was several times as much."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    n = 20_000
    r = spark.range(n).select(F.concat(F.lit("s"), F.col("id") % 20).alias("path"), F.pmod(F.xxhash64("id"), F.lit(140_000)).alias("start"), F.concat(F.lit("n"), "id").alias("name"))
    r = r.select("path", "start", (F.col("start") + 30 + F.pmod(F.xxhash64("name"), F.lit(1470))).alias("end"), "name")
    for made in (intervals.overlaps(r, r), intervals.owner(r.select("path", "start"), r), intervals.containing(r, r)):
        before = written()
        made.write.format("noop").mode("overwrite").save()
        assert written() - before < 2 * n * 80


def test_nodes_are_few_and_whole(spark):
    long = spark.createDataFrame([(0, 10**12), (12345, 10**12 + 99), (-(10**12), 10**12), (5, 5), (7, 6)], "s long, e long").withColumn("nodes", intervals.nodes("s", "e"))
    for r in long.collect():
        nodes = r["nodes"] or []
        assert len(nodes) < 100
        parts = sorted((n["node"] << n["level"], (n["node"] + 1) << n["level"]) for n in nodes)
        assert all(p[1] == q[0] for p, q in zip(parts, parts[1:], strict=False))
        assert not parts if r["e"] <= r["s"] else (parts[0][0], parts[-1][1]) == (r["s"], r["e"])


def test_a_path_of_many_ranges_is_spread(spark):
    n = intervals.dealt(spark.range(100_000).select(F.lit("hot").alias("path"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 300).alias("end")), "start", "end")
    parts = n.repartition(16, *intervals.KEY).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in parts) < 2 * sum(r["count"] for r in parts) / 16


@pytest.mark.parametrize("own", [True, False])
def test_running(spark, own):
    r = random.Random(4)
    made = [(r.choice(["hot"] * 8 + ["b", None]), i, r.choice([None, 1, 2, 5])) for i in range(400)]
    got = scans.running(spark.createDataFrame(made, "k string, at long, v long"), ["k"], ["at"], saver(spark), {"total": "v"}, {"latest": "v"}, {"most": "v"}, own=own)
    want = []
    for k, at, v in made:
        before = [w for j, b, w in made if j == k and (b < at or (own and b == at)) and w is not None]
        want.append((k, at, v, sum(before) if before else None, before[-1] if before else None, max(before, default=None)))
    assert rows_of(got) == sorted(want, key=repr)


def test_a_hot_key_lies_in_many_pieces(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("user"), F.lit(7).alias("at"))
    cut = scans.in_pieces(rows, ["user"], ["at"], saver(spark)).groupBy("piece").count().collect()
    assert len(cut) == 3 and max(r["count"] for r in cut) < 15_000


def test_latest_before_and_remap(spark):
    r = random.Random(9)
    points, marks = ([(r.choice(["hot", "hot", "hot", "b", None]), r.randint(0, 90)) for _ in range(200)] for _ in range(2))
    got = relate.latest_before(spark.createDataFrame(points, "k string, at long").distinct(), spark.createDataFrame(marks, "k string, m long"), ["k"], "at", "m", saver(spark))
    want = {(k, at, max((m for j, m in marks if j == k and m < at), default=None) if k else None) for k, at in points}
    assert set(rows_of(got)) == want
    edits = [("p", s := r.randint(0, 500), s + r.randint(0, 5), r.choice([None, "", "xy", "é" * 4])) for _ in range(150)]
    offsets = [("p", r.randint(0, 600)) for _ in range(100)] + [("none", 3)]
    moved = relate.remap(spark.createDataFrame(offsets, "path string, offset long"), spark.createDataFrame(edits, f"{RANGE}, replacement string"), saver(spark))
    shift = lambda p, o: sum(len((t or "").encode()) - (e - s) for q, s, e, t in edits if q == p and e <= o)
    assert set(rows_of(moved)) == {(p, o, o + shift(p, o)) for p, o in offsets}


def test_merge_and_conflicts(spark):
    made = [r for r in ranges_made(3, 120, 0, 400, 9) if r[0]]
    x = spark.createDataFrame(made, RANGE)
    want = []
    for p in ("a", "b"):
        for _, s, e in sorted(r for r in made if r[0] == p):
            if want and want[-1][0] == p and s <= want[-1][2]:
                want[-1] = (p, want[-1][1], max(e, want[-1][2]))
            else:
                want.append((p, s, e))
    assert rows_of(relate.merge_ranges(x, saver(spark))) == sorted(want, key=repr)
    clashes, behind = [], {}
    for p, s, e in sorted(set(made)):
        high, latest = behind.get(p, (-1, -1))
        if s < high or (s == latest and s == e):
            clashes.append((p, s, e))
        behind[p] = (max(high, e), s)
    assert rows_of(relate.edit_conflicts(x.distinct(), saver(spark))) == sorted(clashes, key=repr)


def test_merged_ranges_of_many_equal_ones(spark):
    """Equal ranges lie on both sides of a border between pieces."""
    made = [(f"p{k}", s, s + 5) for k in range(12) for s in (0, 10, 20) for _ in range(100 + 37 * k)]
    code = [(f"p{k}", "int a;\n\nint b;\nint c;\n\nint d;\n") for k in range(40)]
    files = spark.createDataFrame(code, "path string, content string")
    gone = spark.createDataFrame([(p, *r) for p, _ in code for r in [(0, 6), *[(15, 17)] * 40]], RANGE)
    # as with large tables, whose partitions are not put together again
    sizes = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        got = rows_of(relate.merge_ranges(spark.createDataFrame(made, RANGE), saver(spark)))
        done = edits.applied(files, edits.deletions(files, gone, saver(spark))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted({*made}, key=repr)
    assert {(r["content"], r["status"]) for r in done} == {("int b;\nint d;\n", "applied")} and len(done) == 40


@pytest.mark.parametrize("block", [0, 3, 10])
def test_budget(spark, block):
    r = random.Random(block)
    rows = [("p", g, i, r.choice([None, -3, 0, 1, 2, 3, 4, 9, 30]), u) for g, u in (("hot", 0), ("b", 20), (None, 26), ("d", -5)) for i in range(900 if g == "hot" else 6)]
    r.shuffle(rows)
    got = budgets.spent(spark.createDataFrame(rows, "path string, function string, ordinal long, lines long, used long"), saver(spark), 25, block)
    want = []
    for g, u in (("hot", 0), ("b", 20), (None, 26), ("d", 0)):
        for _, _, i, n, _ in sorted(x for x in rows if x[1] == g and x[2] is not None) if g else sorted((x for x in rows if x[1] is None), key=lambda x: x[2]):
            cost = max(n or 0, 0)
            want.append(("p", g, i, n, u + cost <= 25))
            u += cost if u + cost <= 25 else 0
    assert rows_of(got) == sorted(want, key=repr)


class Rounds:
    def __init__(self, save):
        self.save, self.n = save, 0

    def __call__(self, df):
        self.n += 1
        return self.save(df)


def reached(roots, edges):
    out, todo = set(), list(roots)
    while todo:
        if (v := todo.pop()) not in out:
            out.add(v)
            todo += [b for a, b in edges if a == v]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reachable(spark, seed):
    r = random.Random(seed)
    n = 40
    edges = [(i, r.randrange(n)) for i in range(n) if r.random() < 0.8] + [(r.randrange(n), r.randrange(n)) for _ in range(6)] + [(n, n), (n + 1, n + 2), (n + 2, n + 1), (None, 3), (3, None)]
    roots = [r.randrange(n), n + 1, None]
    got = closures.reachable(spark.createDataFrame([(x,) for x in roots], "node long"), spark.createDataFrame(edges, "src long, dst long"), saver(spark))
    assert {x[0] for x in got.collect()} == reached([x for x in roots if x is not None], [e for e in edges if None not in e])


def test_a_long_chain_takes_few_rounds(spark):
    rounds = Rounds(saver(spark))
    edges = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert closures.reachable(spark.createDataFrame([(17,)], "node long"), edges, rounds).count() == 10_001 - 17
    assert rounds.n < 40


def pack(words: list[str], first: str, rest: str = "\t", most: int = 80) -> str | None:
    """Words on lines of at most ``most`` columns joined by ' \\\\'; None if one doesn't fit."""
    lines, line = [], first
    for k, w in enumerate(words):
        tail = 0 if k == len(words) - 1 else 2
        joined = line + w if line == "" or line.endswith((" ", "\t")) else f"{line} {w}"
        if len(joined.expandtabs(4)) + tail <= most:
            line = joined
            continue
        lines.append(line)
        line = rest + w
        if len(line.expandtabs(4)) + tail > most:
            return None
    return " \\\n".join([*lines, line])


def test_packed_and_wrapped(spark):
    r = random.Random(2)
    cases = [[f"{'w' * r.randint(1, 30)}{i}.c" for i in range(r.randint(0, 40))] for _ in range(60)] + [["x" * 75], ["x" * 76], ["x" * 77], ["a", "y" * 76], ["a", "y" * 77], ["y" * 74, "b"], ["y" * 75, "b"], []]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, words array<string>")
    for first in ("SRCS = ", "A_VERY_LONG_NAME_OF_A_VARIABLE_THAT_TAKES_ALMOST_ALL_OF_THE_LINE_UP_TO_HERE = ", "S\t"):
        got = {x["i"]: x["p"] for x in frame.select("i", X.packed(F.col("words"), first).alias("p")).collect()}
        assert got == {i: pack(c, first) if c else first for i, c in enumerate(cases)}
    texts = ["", " ", "one", "x" * 200 + " y", "a " * 100, "b\n\tc  d", "w" * 80 + " " + "v" * 81 + " u"] + [" ".join("z" * r.randint(1, 90) for _ in range(30)) for _ in range(20)]

    def wrap(t):
        lines = []
        for w in t.split():
            if lines and len(lines[-1]) + 1 + len(w) <= 80:
                lines[-1] += " " + w
            else:
                lines.append(w)
        return "\n".join(lines)

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.wrapped(F.col("t")).alias("w")).collect()
    assert {x["i"]: x["w"] for x in got} == {i: wrap(t) for i, t in enumerate(texts)}


def test_masked_like_the_tokens(spark):
    from srclens.operators import lexer

    r = random.Random(6)
    parts = ["int a;", "//", "/*", "*/", '"', "'", "\\", "\n", "\r\n", "u8", "L", "x1", "0x1e+3", " ", "\t", "é", "😀", "/", "*", ".5", "#", '"s"', "'c'", "// c \\\n d\n", "/* b\n */", "﻿"]
    codes = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    codes += ["/*" + "* " * 50_000 + "*/x", "//" + "\\ " * 20_000, '"' + "a" * 200_000 + '"', "/*" * 20_000, '"' * 20_001, "'\\''" * 5000]
    got = spark.createDataFrame(list(enumerate(codes)), "i int, code string").select("i", X.masked(F.col("code")).alias("m"), X.trivia_only(F.col("code")).alias("t")).collect()
    for row in got:
        code = codes[row["i"]]
        tokens = list(lexer.tokenize(code))
        assert row["m"] == lexer.mask(code), repr(code[:99])
        if "\\" not in code and "\ufeff" not in code:
            assert row["t"] == all(t.kind in lexer.TRIVIA for t in tokens), repr(code[:99])


def test_a_log_larger_than_a_split(spark, tmp_path):
    records = [(f"f{i}", 10 + i, i % 3) for i in range(4000)]
    text = "preamble\n"
    for f, n, extra in records:
        text += f"==9== {n:,} bytes in 1 blocks are definitely lost in loss record 1 of 1\n" + "==9==    at 0x1: malloc (in /x.so)\n" * (1 + extra) + f"==9==    by 0x2: {f} (é{f}.c:{n})\r\n==9== \n==9==    by 0x3: other (o.c:1)\n"
    (tmp_path / "run.log").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 10
        lines = logs.read(spark, str(tmp_path), saver(spark))
        places = [(x["at"], x["line"]) for x in lines.orderBy("at").collect()]
        data = text.encode()
        assert [data[at : at + len(line.encode())] for at, line in places] == [line.encode() for _, line in places] and len(places) == text.count("\n")
        got = logs.leaks(lines, saver(spark)).orderBy("record").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(x["record"], x["bytes"], x["function"], x["file"], x["line"]) for x in got] == [(i, n, f, f"é{f}.c", n) for i, (f, n, _) in enumerate(records, 1)]
