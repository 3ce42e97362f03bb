import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from srclens.llm import decontaminate, mixing
from tests.oracle import DATA, same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, n):
    wins = {}
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - n + 1)):
                wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, got = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (of := wins.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    got |= of
        out.append((d, len(w), len(hit), sorted(map(str, got))))
    return sorted(out, key=repr)


def test_contamination(spark):
    r = random.Random(5)
    pool = [f"w{i}" for i in range(30)] + ["the", "of"] * 20
    items = [(i, " ".join(r.choice(pool) for _ in range(r.choice([2, 4, 9])))) for i in range(12)] + [(20, None), (21, ""), (None, "w1 w2 w3 w4"), (3, "of the of the"), (22, "the the the the the")]
    rows = []
    for d in range(30):
        parts = [r.choice(pool) for _ in range(r.randint(0, 12))]
        if r.random() < 0.7:
            parts += (r.choice(items)[1] or "").upper().split() + [r.choice(pool) for _ in range(3)]
        rows.append((d, ", ".join(parts)))
    rows += [(50, None), (51, "..."), rows[4], (None, rows[5][1]), (52, "the " * 2000)]
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, t1 int, term int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, n=4).select("doc", "n_words", "n_hit", "items").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, items, 4)
    kept = decontaminate.without_contaminated(docs, bench, n=4)
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"] for x in kept.collect()), key=repr) == sorted((d for d, _, h, _ in brute(rows, items, 4) if not h), key=repr)
    for a, b in ((docs.limit(0), bench), (docs, bench.limit(0))):
        assert all(x["n_hit"] == 0 for x in decontaminate.contamination(a, b).collect())


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three"), (2, "three four"), (3, "nine ten")], "item_id long, text string")
    assert [tuple(x) for x in decontaminate.contamination(docs, bench, n=3).select("n_hit", "items").collect()] == [(4, ["1", "2"])]


def test_words_in_pieces(monkeypatch):
    text = "Ab, cÉd 12 " * 30 + "x" * 100 + " y"
    monkeypatch.setattr(decontaminate, "CHUNK", 16)
    parts = list(decontaminate.words_of(text.encode()))
    assert [w.decode() for _, p in parts for w in p] == words(text)
    assert all(b == sum(len(p) for _, p in parts[:i]) for i, (b, _) in enumerate(parts))


def test_postings_in_pieces(spark):
    filler = ("z" * 200 + " ") * 40
    texts = ["a b x a c b a " * 9, "a", "", "b a", ("b a c a b " + filler) * 700]
    assert len(texts[-1]) > 2 * decontaminate.CHUNK
    rows = decontaminate._rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    got = decontaminate.postings(rows, {b"a": 0, b"b": 1, b"c": 2}, {0, 1}).join(rows.drop("text"), ["t1", "t2"]).collect()
    ids = {"a": 0, "b": 1}
    expected = [(d, i, ids[w]) for d, t in enumerate(texts) for i, w in enumerate(t.split()) if w in ids]
    assert sorted((x["doc"], x["pos"], x["term"]) for x in got) == sorted(expected)


def near_brute(rows, items, n, slop):
    out = set()
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            need = Counter(w[k : k + n])
            size = sum(need.values())
            for d, text in rows:
                v = words(text)
                for a in range(len(v)):
                    for e in range(a + size, min(len(v), a + size + slop) + 1):
                        if not need - Counter(v[a:e]):
                            out.add((d, str(i)))
    return out


def test_proximity(spark):
    r = random.Random(2)
    pool = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(r.choice(pool) for _ in range(r.choice([1, 2, 3, 5])))) for i in range(6)] + [(9, "alpha beta"), (10, "a a a")]
    rows = [(d, " ".join(r.choice(pool + ["x"] * 6) for _ in range(r.randint(0, 25)))) for d in range(20)]
    rows += [(30, "alpha x x beta"), (31, "alpha " + "x " * 20 + "beta"), (32, "beta alpha"), (33, "a x a"), (34, "a x a a"), (35, None)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(docs, bench, slop=3, n=4).collect()
    assert {(x["doc"], x["item"]) for x in got} == near_brute(rows, items, 4, 3)
    exact = {(x["doc"], i) for x in decontaminate.contamination(docs, bench, n=4).collect() for i in x["items"]}
    assert {(x["doc"], x["item"]) for x in got if x["exact"]} == exact
    assert all(x["length"] <= 4 + 3 for x in got)
    assert decontaminate.matches(docs, bench.limit(0), slop=3).collect() == []


def test_rarest_term_with_many_places(spark):
    """All terms stand in 100,000 places; the postings of the others decide."""
    rows = [(d, "one two three four five " * 500 + ("two one three" if d == 7 else "")) for d in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "three four five one two three"), (2, "two one three"), (3, "five four")], "item_id long, text string")
    got = {x["doc"]: (x["n_hit"], x["items"]) for x in decontaminate.contamination(docs, bench, n=6).collect()}
    assert got == {d: (2499, ["1", "2"]) if d == 7 else (2496, ["1"]) for d, _ in rows}


def test_the_postings_decide(spark):
    """Without one term's postings no window that holds it is found."""
    rows = decontaminate._rows(spark.createDataFrame([(1, "a b c d x a b c d")], "doc_id long, text string"), "doc_id", "text")
    block = decontaminate.Windows([(1, b"a b c d")], 4)
    seeds, terms = block.seeds(spark, np.array([2, 2, 2, 2]))
    index = decontaminate.postings(rows, block.vocabulary, set(range(4)))
    found = decontaminate.candidates(index, seeds)
    assert sorted(x["start"] for x in decontaminate.intersect(found, seeds, index).collect()) == [0, 5]
    for term in range(4):
        assert decontaminate.intersect(found, seeds, index.where(f"term <> {term} or pos > 4")).count() == 1


def fill(budget, caps, weights):
    got, left = [0] * len(caps), list(range(len(caps)))
    while left:
        w = sum(weights[i] for i in left)
        full = [i for i in left if caps[i] * w <= weights[i] * budget]
        if not full:
            for i in left:
                got[i] = weights[i] * budget // w
            break
        for i in full:
            got[i] = caps[i]
            budget -= caps[i]
            left.remove(i)
    return got


def test_budgets(spark):
    leaves = [("a", "en", "s1", 100), ("a", "en", "s2", 5), ("a", "de", "s1", 10), ("b", "en", "s3", 1000), ("c", "en", "s4", 3)]
    weights = {("a",): 3, ("b",): 1, ("c",): 1, ("a", "de"): 9, ("a", "en", "s2"): 2}
    got = {tuple(x)[:3]: x["allotment"] for x in mixing.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), 150, weights, 1).collect()}
    a, b, c = fill(150, [115, 1000, 3], [3, 1, 1])
    de, en = fill(a, [10, 105], [9, 1])
    s1, s2 = fill(en, [100, 5], [1, 2])
    assert got == {("a", "de", "s1"): de, ("a", "en", "s1"): s1, ("a", "en", "s2"): s2, ("b", "en", "s3"): b, ("c", "en", "s4"): c}


def test_mix(spark):
    r = random.Random(2)
    rows = [(i, "w " * r.randint(0, 9), r.choice(["en", "de", None]), r.choice(["src0", "src9", None]), 1) for i in range(80)] + [(3, "a b", "en", "src0", 1), (None, "c", "en", "src0", 1), (7, None, "en", "src0", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, domain int").drop("domain")
    out = mixing.mix(docs, budget=400, epochs=3).collect()
    leaf = {tuple(x)[:3]: x for x in mixing.budgets(docs.selectExpr(f"{mixing.DOMAIN} AS domain", "coalesce(lang, '') AS lang", "coalesce(source, '') AS source", "size(regexp_extract_all(coalesce(text, ''), '\\\\S+', 0)) AS n").groupBy("domain", "lang", "source").sum("n").withColumnRenamed("sum(n)", "tokens"), 400, mixing.WEIGHTS, 3).collect()}
    for key, x in leaf.items():
        own = [(o["doc"], o["n_tokens"], o["epochs"]) for o in out if (o["domain"], o["lang"], o["source"]) == key]
        whole, rest = divmod(x["allotment"], x["tokens"])
        all_ = [(d, len((t or "").split())) for d, t, lang, s, _ in rows if (lang or "") == key[1] and (s or "") == key[2]]
        order = sorted(all_, key=lambda p: (hashlib.md5(f"{mixing.SEED}:{whole}:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p))
        expected, total = [], 0
        for d, n in order:
            total += n
            e = whole + (rest > 0 and total <= rest)
            if e:
                expected.append((d, n, e))
        assert sorted(own, key=repr) == sorted(expected, key=repr)
    assert mixing.mix(docs.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["op2_embedding_near_dedup", "op4_mixing", "op5_decontaminate", "op7_warc", "op8_line_dedup", "op9_substring_dedup", "op10_suffix_array_dedup"])
def test_against_sql(spark, name):
    from srclens.llm import registry

    same(registry.QUERIES[name](spark, DATA), registry.ORACLE[name])
