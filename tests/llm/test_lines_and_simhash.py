import random

import pytest
import xxhash

from srclens.llm import fingerprint, line_dedup, simhash

SCHEMA = "doc_id long, text string, doc string, text64 long, key string, pos int, line string, owner long, fp long"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "k", 2, "l", 3, 4) for d, t in rows], SCHEMA)


def strip(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def lines_brute(rows):
    owner = {}
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(strip(x)) >= 10:
                    owner[strip(x)] = min(owner.get(strip(x), d), d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if d is None or len(strip(x)) < 10 or owner[strip(x)] == d]
        out.append((d, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2)])
def test_lines(spark, batches, fanout):
    r = random.Random(3)
    pool = [f"a line number {i}" for i in range(12)] + ["short", "", "  ", "É à long line", "é à long line", "\tA LINE number 3 \r"]
    rows = [(d, "\n".join(r.choice(pool) for _ in range(r.randint(0, 7)))) for d in r.sample(range(100), 40)]
    rows += [(5, None), (6, ""), (None, "a line number 1\nx"), rows[0], rows[0], (200, rows[3][1]), (300, "x" * 100_000 + "\n" + "a line number 1\n" * 3000)]
    got = line_dedup.dedup_lines(docs(spark, rows), batches=batches, fanout=fanout).select("doc", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == lines_brute(rows)


def test_lines_of_string_ids(spark):
    r = random.Random(8)
    rows = [(r.choice("abcé日-") * r.randint(1, 3) + str(d), "\n".join(f"a line number {r.randint(0, 20)}" for _ in range(4))) for d in range(60)]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    got = line_dedup.dedup_lines(frame, batches=4, fanout=2).select("doc", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == lines_brute(rows)
    assert len(line_dedup.borders(frame.selectExpr("doc_id as doc"), 4)) == 3


def test_runs_are_dropped_when_a_batch_fails(spark, monkeypatch):
    monkeypatch.setattr(line_dedup.LineIndex, "compact", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        line_dedup.dedup_lines(docs(spark, [(1, "a line number 1"), (2, "a line number 1")]))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_runs_")]


def test_lines_keep_other_columns(spark):
    got = line_dedup.without_repeated_lines(docs(spark, [(1, "the same line\nb"), (2, "the same line\nc"), (3, None)])).collect()
    assert sorted((x["doc_id"], x["text"], x["doc"], x["pos"]) for x in got if x["text"] is not None) == [(1, "the same line\nb", "x", 2), (2, "c", "x", 2)]
    assert [x["doc_id"] for x in got if x["text"] is None] == [3]
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []


def test_runs_are_compacted(spark):
    index = line_dedup.LineIndex(spark, fanout=2)
    ws = line_dedup.Workspace(spark, "test")
    for b in range(4):
        batch = spark.createDataFrame([(b * 10 + i, i, 0) for i in range(b + 2)], "doc long, h1 long, h2 long")
        known = {(x["h1"], x["owner"]) for x in index.owners(batch, ws, f"o{b}").collect()}
        assert known == {(i, max(0, i - 1) * 10 + i) for i in range(b + 1) if b}
    assert [len(x) for x in index.levels] == [0, 0, 1]
    index.drop()


def fp_brute(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ("", "  ", "A", "a b", "a b c", "É é\x85x a b\x0bc\x1cd " * 40, "w " * 70_000, None):
        assert fingerprint.fingerprint((text or "").encode()) == fp_brute(text)


@pytest.mark.parametrize("limit", [4096, 2])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "LIMIT", limit)
    r = random.Random(1)
    fps = [r.getrandbits(64) for _ in range(30)]
    for base in fps[:6]:
        for _ in range(12):
            f = base
            for b in r.sample(range(64), r.randint(0, 4)):
                f ^= 1 << b
            fps.append(f)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    signed = {f - (1 << 64) if f >> 63 else f for f in fps}
    ws = simhash.Workspace(spark, "test")
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), ws)
    got = {x["node"] % (1 << 64): x["component"] % (1 << 64) for x in simhash.components(links, ws).collect()}
    groups = {}
    for f in root:
        groups.setdefault(find(f), set()).add(f)
    mine = {}
    for f in root:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_near_duplicates(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(9, long), (4, long), (4, long), (7, long + " tail"), (1, None), (2, " "), (3, "other words here"), (None, long), (None, "only one without id")]
    got = {(x["doc"], x["component"]) for x in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert {(9, 4), (4, 4), (1, 1), (2, 1), (3, 3), (None, 4), (None, None)} <= got
    kept = [x["doc_id"] for x in simhash.one_of_each(docs(spark, rows)).collect()]
    assert kept.count(4) == 2 and 9 not in kept and 3 in kept and 2 not in kept and kept.count(None) == 2
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_another_text_of_an_id_stays(spark):
    a, b = "one two three four five six", "something else that no other document says here"
    rows = [(3, a), (5, a), (5, b), (None, a), (5, None), (6, None), (7, b)]
    kept = [(x["doc_id"], x["text"]) for x in simhash.one_of_each(docs(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(3, a), (5, b), (None, a), (5, None)], key=repr)
