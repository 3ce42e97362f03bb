import collections
import hashlib
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from srclens.llm import common, passages, repeats, rolling, suffix_dedup
from srclens.llm.suffix_sort import suffix_array

SCHEMA = "doc_id long, text string, t1 long, anchor string, content long, start string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, "a", 2, "s", 3) for d, t in rows], SCHEMA)


def test_suffix_array():
    r = np.random.default_rng(0)
    for _ in range(400):
        s = r.integers(0, r.integers(1, 5), r.integers(0, 60))
        assert suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_sliding_min_and_spans():
    r = np.random.default_rng(0)
    h = r.integers(0, 1 << 60, 50).astype(np.uint64)
    for w in (1, 2, 7, 50, 51):
        assert rolling.sliding_min(h, w).tolist() == [int(h[i : i + w].min()) for i in range(len(h) - w + 1)]
    data = np.frombuffer(b"abcabcab", np.uint8)
    sums = rolling.prefix(rolling.BYTE[data])
    a = rolling.spans(sums, np.array([0, 3, 1]), np.array([3, 6, 4]))
    assert a[0] == a[1] != a[2]


def test_long_texts_in_pieces(monkeypatch):
    text = np.frombuffer(b"  one two\tthree " * 50 + b"x" * 300 + b" end", np.uint8)
    whole = repeats.word_units(text, np.array([len(text)]))
    monkeypatch.setattr(repeats, "PIECE", 16)
    parts = repeats.word_units(text, np.array([len(text)]))
    assert whole.values.tolist() == parts.values.tolist() and len(whole.values) == 152
    i = np.arange(150)
    assert whole.digests(i, i + 2).tolist() == parts.digests(i, i + 2).tolist()
    assert b"".join(p.tobytes() for p in repeats.pieces(text)) == text.tobytes()


def bytes_brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - width + 1):
            seen[t[i : i + width]] = seen.get(t[i : i + width], 0) + 1
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        hit = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                hit[i : i + width] = [True] * width
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((d, len(t), sum(hit), spans, hashlib.sha256(bytes(b for b, h in zip(t, hit, strict=True) if not h)).hexdigest()))
    return sorted(out, key=repr)


def words_brute(rows, width):
    texts = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, texts, strict=True):
        for i in range(len(w) - width + 1):
            if d is not None:
                first[tuple(w[i : i + width])] = min(d, first.get(tuple(w[i : i + width]), d))
    out = []
    for (d, _), w in zip(rows, texts, strict=True):
        hit = [False] * len(w)
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                hit[i : i + width] = [True] * width
        out.append((d, len(w), sum(hit), hashlib.sha256(b" ".join(x for x, h in zip(w, hit, strict=True) if not h)).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    base = [" ".join(r.choice(["ab", "c", "dé", "eee", "f"]) for _ in range(40)) for _ in range(4)]
    rows = []
    for d in range(25):
        words = []
        for _ in range(r.randint(0, 3)):
            t = r.choice(base).split()
            i = r.randint(0, 30)
            words += t[i : i + r.randint(1, 30)] + [f"u{r.randint(0, 99)}"]
        rows.append((d * 3 % 25, r.choice([" ", "\n"]).join(words)))
    return [*rows, (90, None), (91, ""), rows[1], rows[1], (95, rows[2][1]), (None, rows[2][1]), (None, "q r s t u v"), (96, "a" * 300), (97, "zz " * 60), (98, "  ab  ")]


@pytest.mark.parametrize("limit", [1 << 20, 40])
def test_suffix_dedup(spark, limit):
    rows = corpus(limit)
    got = suffix_dedup.dedup_bytes(docs(spark, rows), width=12, gram=5, limit=limit).select("doc", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == bytes_brute(rows, 12)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    rows = corpus(seed)
    out = passages.dedup_passages(docs(spark, rows), width=6, gram=3).collect()
    assert sorted(((x["doc"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in out), key=repr) == words_brute(rows, 6)
    assert all(hashlib.sha256(x["kept"].encode()).hexdigest() == x["kept_sha256"] for x in out)


def test_empty_tables(spark):
    assert suffix_dedup.dedup_bytes(docs(spark, [])).collect() == []
    assert passages.dedup_passages(docs(spark, [])).collect() == []


def test_anchors_dealt_anew_at_full_width(spark):
    """One passage in many documents with other surroundings, exact copies of one text and near copies of another; small limits deal all of them anew."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    passage, base = " ".join(word() for _ in range(100)), [word() for _ in range(200)]
    rows = [(d, " ".join([*(word() for _ in range(r.randint(0, 40))), passage, *(word() for _ in range(r.randint(0, 40)))])) for d in range(60)]
    rows += [(100 + d, " ".join(base)) for d in range(30)]
    rows += [(200 + d, " ".join(word() if i in (20 + d, 150) else w for i, w in enumerate(base))) for d in range(30)]
    want = bytes_brute(rows, 400)
    for limit in (1 << 20, 5000, 500):
        got = suffix_dedup.dedup_bytes(docs(spark, rows), limit=limit).select("doc", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert len({tuple(sorted(x.items())) for x in [{"removed": w[2]} for w in want]}) > 5


def test_planted_passages_of_over_50_words(spark, tmp_path):
    """In two documents each: one of 400 bytes goes from both, the first holder too, one of 399 stays, as do other documents; n_bytes is the input's length."""
    r = random.Random(9)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    long, short = text(57) + "yy", text(57) + "y"
    assert (len(long), len(short)) == (400, 399)
    ends = {d: (f"{text(9)} {d}", f"{d} {text(9)}") for d in range(1, 6)}
    planted = {1: long, 2: long, 3: short, 4: short, 5: text(57)}
    docs(spark, [(d, a + planted[d] + b) for d, (a, b) in ends.items()]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: tuple(x)[1:] for x in suffix_dedup.query(spark, str(tmp_path)).collect()}
    for d, (a, b) in ends.items():
        gone = planted[d] == long
        assert got[d] == (len(a + planted[d] + b), 400 * gone, int(gone), hashlib.sha256((a + planted[d] * (not gone) + b).encode()).hexdigest())


def test_hot_anchor_sends_few_rows(spark):
    """A batch sends one row of a hot anchor to the task that decides; the others are dealt out by text."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = repeats.keyed(docs(spark, [(d, f"{text} {d}") for d in range(500)]).coalesce(1), "doc_id", "text")
    got = repeats.runs(rows, 100, 20, repeats.byte_units).where(f"known <> {repeats.SURE}").groupBy("anchor").count()
    assert got.agg({"count": "max"}).collect()[0][0] == 1


@pytest.mark.parametrize("bits", [1 << 26, 1 << 12])
def test_key_filter(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    r = np.random.default_rng(1)
    t1, t2 = r.integers(-(1 << 63), 1 << 63, (2, 4000), dtype=np.int64)
    keys = spark.createDataFrame(list(zip(t1[:2000].tolist(), t2[:2000].tolist(), strict=True)), "t1 long, t2 long")
    words = common.key_filter(keys)
    got = common.may_hold(words, t1, t2)
    assert got[:2000].all() and len(words) * 64 <= bits
    assert got[2000:].mean() < (0.05 if bits > 1 << 12 else 0.9)
    assert not common.may_hold(common.key_filter(keys.limit(0)), t1, t2).any()


def test_texts_longer_than_a_piece(spark):
    """A repeated stretch over the border of two pieces, in both operators."""
    r = np.random.default_rng(7)
    words = ["".join(w) for w in r.choice(list("abcdefghij"), (400_000, 6)).tolist()]
    whole, part = " ".join(words), " ".join(words[280_000:320_000])
    assert len(whole) > rolling.PIECE > len(" ".join(words[:285_000])) and len(" ".join(words[:315_000])) > rolling.PIECE
    rows = [(1, whole), (2, part), (3, " ".join(words[:100]) + " other words")]
    got = {x["doc"]: x for x in suffix_dedup.dedup_bytes(docs(spark, rows), texts=False).collect()}
    at = len(" ".join(words[:280_000])) + 1
    assert [(s["a"], s["b"]) for s in got[1]["spans"]] == [(0, 700), (at, at + len(part))]
    assert (got[2]["n_removed"], got[3]["n_removed"]) == (len(part), 700)
    got = {x["doc"]: x for x in passages.dedup_passages(docs(spark, rows), texts=False).collect()}
    assert [(got[d]["n_words"], got[d]["n_removed"]) for d in (1, 2, 3)] == [(400_000, 0), (40_000, 40_000), (102, 100)]


def test_a_run_takes_few_calls():
    """What Python does for each run is its digest; the rest is done for all runs of a block together."""
    data = np.random.default_rng(3).integers(97, 123, 200_000).astype(np.uint8)
    units, calls = repeats.byte_units(data, np.array([len(data)])), []
    repeats.runs_of(units, 400, 128)  # tables of powers
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        n = len(repeats.runs_of(units, 400, 128)[0])
    finally:
        sys.setprofile(None)
    assert n > 1000 and len(calls) < 3 * n


def test_runs_against_plain_loops(monkeypatch):
    monkeypatch.setattr(repeats, "LONGEST", 16)
    r = np.random.default_rng(4)
    for k in range(60):
        texts = [r.integers(97, 98 + k % 4, r.integers(0, 90)).astype(np.uint8) for _ in range(r.integers(1, 6))]
        data, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
        want = []
        for i, t in enumerate(texts):
            h = rolling.windows(rolling.BYTE[t], 5)
            low, s = [int(h[p : p + 8].min()) for p in range(len(t) - 11)], 0
            for e in range(1, len(low) + 1):
                if e == len(low) or low[e] != low[s] or e - s == 16:
                    want.append((i, s, e - s, low[s], e - s > 1 and int((h[s : e + 7] == low[s]).sum()) > 1))
                    s = e
        text, start, n, anchor, _, twice = repeats.runs_of(repeats.byte_units(data, ends), 12, 5)
        assert list(zip(text.tolist(), start.tolist(), n.tolist(), anchor.tolist(), twice.tolist(), strict=True)) == want


def test_repeated_against_all_windows():
    """Stretches that are equal as a whole, in part and not at all; periodic texts."""
    r = random.Random(6)
    for width in (3, 12, 40):
        for _ in range(30):
            base = [r.choice(b"abc") for _ in range(150)]
            texts = [bytes(r.choice(b"abc") if r.random() < 0.02 else c for c in base[r.randint(0, 30) :]) for _ in range(4)] + [b"ab" * 40, b"a" * 60]
            seen = collections.Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
            got = suffix_dedup.repeated(texts, [False] * 6, width)
            assert [g.tolist() for g in got] == [[seen[t[i : i + width]] > 1 for i in range(len(t) - width + 1)] for t in texts]


def test_spans_of_many_texts():
    r = random.Random(8)
    lengths = [r.choice([0, 5, 30, 200]) for _ in range(40)]
    ranges = [None if n < 12 else [(a := r.randint(0, n - 12), r.randint(a + 1, n - 11)) for _ in range(r.randint(0, 6))] for n in lengths]
    column = pa.array([x and [{"a": a, "b": b} for a, b in x] for x in [[(0, 9)], *ranges]], suffix_dedup.PAIRS).slice(1)
    text, lo, hi = suffix_dedup.spans_of(column, np.array(lengths), 12)
    want = [(i, a, b) for i, x in enumerate(ranges) for a, b in repeats.union_of([(a, b + 11) for a, b in x or []])]
    assert list(zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True)) == want
