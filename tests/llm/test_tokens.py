import hashlib
import itertools
import random
import struct
import zlib
from bisect import bisect_left
from collections import Counter

import pytest

duck = pytest.importorskip("duckdb")
public = pytest.importorskip("public_tokenizers")

from srclens.llm import alignment, packing, vocabulary  # noqa: E402
from srclens.llm.common import Workspace  # noqa: E402

SCHEMA = "doc_id long, text string, doc string, length int, key string, block int, item long"
ODD = [
    None, "", " ", "  two  spaces ", "a\nb\n\nc", "\n lead", "tab\tin\r\n", "don't we'll I'M", "x<|endoftext|>y <|startoftext|> z", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ISTANBUL", "T̈ é ́x",
    "a b c\x85d\x1ce", "▁low ▁ line", "日本語 テキスト 中文", "한국어 한", "🙂 👩‍👩‍👧 ok", "1234 56.78, 9", "Ǆ ǅ ǆ ʼn ſ ß ẞ", "K Å Ω", "word..., end.!?", "\x00\x01", "﻿bom", "é." * 40, "ÉCOLE, Ünïcode; ça: va!", "a." * 3, "no-break here", "▁", "x▁ y",
]


def texts(folder="sf0.001"):
    return [r[0] for r in duck.sql(f"SELECT text FROM '/root/testdata/{folder}/documents.parquet' ORDER BY doc_id").fetchall()]


def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "k", 2, 3) for d, t in rows], SCHEMA)


def tokenizer(path, plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = plain
    return t


def word_ids_plain(t, text):
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_word_by_word():
    path = packing.default_path()
    t, w = tokenizer(path), vocabulary.WordIds(path)
    letters = " ".join(f"{chr(c)} {chr(c)}a a{chr(c)}. E{chr(c)}x," for c in range(33, 0x2C0))
    for text in [*ODD[1:], letters, *texts()]:
        assert w.text(text) + struct.pack("<I", 1) == struct.pack(f"<{len(x := word_ids_plain(t, text))}I", *x), text[:80]


def test_marks_behind_letters():
    """Runs of marks behind letters need no whole tokenizer, and give its ids."""
    path, r = packing.default_path(), random.Random(5)
    t, w = tokenizer(path), vocabulary.WordIds(path)
    marks = lambda most: "".join(r.choice(vocabulary.TAIL) for _ in range(r.randint(1, most)))
    words = [r.choice(["Schen", "été", "x", "THE", "ſtraße", "don"]) + marks(4) for _ in range(600)]
    mixed = [r.choice([w_, marks(3) + w_, w_ + "'s", w_ + "a1", "'ll" + marks(2), w_ + "' "]) for w_ in words]
    for text in (" ".join(words), " ".join(mixed)):
        assert w.text(text) == struct.pack(f"<{len(x := word_ids_plain(t, text)) - 1}I", *x[:-1])
    fresh = vocabulary.WordIds(path)
    fresh.tokenizer = None
    assert fresh.text(" ".join(words)) == w.text(" ".join(words))


def test_chunks_are_those_of_the_cut():
    """Whatever was met before: white space at a chunk's edge, at the ends of a text, or several in a row."""
    r = random.Random(6)
    bits = ["a", "b.", "é", " ", " ", " ", "\n", "\t", "\0", "\u00a0", "\u3000", "\x1c"]
    odd, known = set(), {}
    for text in ["x\t", "\tb", "x\t b", "a \tb", "\u00a0", "a \u00a0", *ODD[2:], *("".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(4000))]:
        chunks = vocabulary.chunks_of(" " + text, odd, known)
        assert chunks == vocabulary.CUT.split(" " + text), repr(text)
        known |= dict.fromkeys(chunks)


def aligned_plainly(rows):
    """Groups, links and counts from whole texts, token by token."""
    import sentencepiece

    path_a, path_b = alignment.default_paths()
    a, b = tokenizer(path_a, True), sentencepiece.SentencePieceProcessor(model_file=path_b)
    stand = {v: k for k, v in vocabulary._byte_letters().items()}
    entry = {i: bytes(stand.get(ord(c), ord(c)) for c in p) for p, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for _, text in rows:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        da, db = [entry[i] for i in x], [piece(i) for i in y]
        if not text or not b"".join(da) == b"".join(db) == (" " + text).encode():
            found.append((0, 0, []))
            continue
        ends = [list(itertools.accumulate(map(len, d))) for d in (da, db)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        at = [[bisect_left(cuts, e) for e in own] for own in ends]
        groups = [([], []) for _ in cuts]
        for side, ids in enumerate((x, y)):
            for i, g in zip(ids, at[side], strict=True):
                groups[g][side].append(i)
        found.append((len(x), len(y), groups))
    count = Counter((g[0][-1], g[1][-1]) for f in found for g in f[2])
    high = Counter()
    for (_, q), n in count.items():
        high[q] = max(high[q], n)
    out = []
    for (doc, _), (n, m, groups) in zip(rows, found, strict=True):
        links = [(g[0][-1], g[1][-1]) for g in groups]
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc, n, m, len(groups), len(links), sum(count[p] == high[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("words", [500_000, 20])
def test_aligned(spark, monkeypatch, words):
    monkeypatch.setattr(alignment, "BLOCK_WORDS", words)
    rows = [(i, t) for i, t in enumerate([*ODD, *texts()[:60], "a long one. " * 20_000])]
    rows += [(None, "no id here"), (3, "same words"), (3, "same words")]
    out = alignment.aligned(docs(spark, rows), *alignment.default_paths())
    got = out.select("doc", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digest").collect()
    assert sorted(map(tuple, got), key=repr) == aligned_plainly(rows)
    assert alignment.aligned(docs(spark, rows[:1]).where("doc_id < 0"), *alignment.default_paths()).count() == 0


def check_packing(got, rows, t, length=4096):
    """Every piece once and as it should be, sequences without gaps; the number of sequences."""
    want = Counter()
    for doc, text in rows:
        ids = word_ids_plain(t, text)
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            want[doc, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter(tuple(r[:5]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_sequences(spark):
    rows = [*enumerate([*ODD, *texts()])] + [(None, "no id"), (7, "again"), (7, "again"), (9000, "far " * 9000), (9001, "w " * 4095), (9002, "w " * 4096)]
    t = tokenizer(packing.default_path())
    got = packing.sequences(docs(spark, rows), packing.default_path()).collect()
    n = check_packing(got, rows, t)
    assert n == -(-sum(r[3] for r in got) // 4096)
    small = packing.sequences(docs(spark, rows[:40]), packing.default_path(), length=50, group=7, group_bins=3).collect()
    assert check_packing(small, rows[:40], t, 50) <= 1.05 * sum(r[3] for r in small) / 50 + 1
    assert packing.sequences(docs(spark, rows[:1]).where("doc_id < 0"), packing.default_path()).count() == 0


def test_search_beats_best_fit():
    saved = 0
    for seed in range(40):
        r = random.Random(seed)
        lengths = [r.randint(20, 60) for _ in range(60)]
        bins = packing.best_fit(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(60)) and all(sum(lengths[i] for i in b) <= 100 for b in bins)
        search = packing.Search([[(i, lengths[i]) for i in b] for b in bins], 100)
        before = sum(f * f for f in search.fill)
        search.run()
        assert sorted(p for b in search.result() for p, _ in b) == list(range(60)) and max(search.fill) <= 100 and sum(f * f for f in search.fill) >= before
        saved += len(bins) - len(search.result())
    assert saved > 0


def test_moves_one_by_one():
    # one for one fills both bins; two for one and one for two do too; the rest moves and empties a bin
    for bins, left in [([[60, 30], [70, 40]], [100, 100]), ([[50, 25, 20], [75, 30]], [100, 100]), ([[45, 25, 20], [90]], [90, 90]), ([[10], [80]], [90])]:
        items = itertools.count()
        search = packing.Search([[(next(items), n) for n in b] for b in bins], 100)
        search.run()
        assert sum(f for f in search.fill) == sum(map(sum, bins)) and len([f for f in search.fill if f]) <= len(left)


def test_one_group_of_equal_lengths_is_split(spark):
    items = spark.range(3000).selectExpr("id as item", "cast(51 as long) as length")
    out = packing.packed(items, Workspace(spark, "packing"), 100, group=200, group_bins=50).collect()
    assert len(out) == 3000
