import zlib
from functools import partial

import duckdb
import numpy as np

import corpus_pipeline
from srclens.llm import bytenet, fingerprint, mixing, quality
from tests.llm.test_decontaminate_and_mixing import brute
from tests.llm.test_lines_and_simhash import lines_brute
from tests.oracle import DATA
from tests.oracle import rows as rows_of


def as_bytes(*texts):
    return [np.frombuffer(t.encode(), np.uint8) for t in texts]


def test_gradients():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in bytenet.init(3).items()}
    p["b"] = r.normal(0, 0.2, len(p["b"]))  # away from the kink at 0
    texts = [r.integers(1, 256, n).astype(np.uint8) for n in (700, 130, 5, 0, 256)]
    y, w, step = np.array([1, 0, 0, 1, 1]), np.ones(5), 1e-5
    _, g = bytenet.gradients(p, texts, y, w)
    for k in p:
        for _ in range(6):
            i = tuple(r.integers(0, n) for n in p[k].shape) if k != "e" else (int(texts[0][r.integers(0, 700)]), int(r.integers(0, bytenet.DIM)))
            old, ends = p[k][i], []
            for d in (step, -step):
                p[k][i] = old + d
                ends.append(bytenet.gradients(p, texts, y, w)[0])
            p[k][i] = old
            assert abs((ends[0] - ends[1]) / (2 * step) - g[k][i]) < 5e-4 + 0.02 * abs(g[k][i])


def test_scores_do_not_depend_on_neighbours():
    p = bytenet.init(1)
    texts = as_bytes("", "a" * 128, "b" * 500, "c " * 200_000, "d")
    alone = np.concatenate([bytenet.score(p, [t]) for t in texts])
    assert np.allclose(alone, bytenet.score(p, texts), atol=1e-5)


def plain_score(p, text):
    """The network by plain loops over one text: every filter at every step, pooled over chunks of two halves."""
    b = bytenet
    halves = -(-(len(text) + b.STEP) // b.HALF)
    padded = [*text.tolist(), *[0] * (halves * b.HALF + b.WIDTH - len(text))]
    value = [[float(p["b"][f])] * (halves * b.SLOTS) for f in range(b.FILTERS)]
    for f in range(b.FILTERS):
        for s in range(halves * b.SLOTS - 1):  # the last step sees padding alone
            for w in range(b.WIDTH):
                for k in range(b.DIM):
                    value[f][s] += float(p["e"][padded[s * b.STEP + w], k]) * float(p["w"][w * b.DIM + k, f])
    chunks = [[max(0.0, max(value[f][h * b.SLOTS : (h + 2) * b.SLOTS])) for h in range(halves)] for f in range(b.FILTERS)]
    pooled = [max(c) for c in chunks] + [sum(c) / halves for c in chunks]
    hidden = [np.tanh(sum(v * float(p["h"][i, j]) for i, v in enumerate(pooled)) + float(p["c"][j])) for j in range(b.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(h * float(p["o"][j]) for j, h in enumerate(hidden)) + float(p["d"][0]))))


def test_scores_by_plain_loops():
    p = bytenet.train(as_bytes("good words here " * 20, "###junk### " * 30), np.array([1, 0]), steps=5)
    texts = as_bytes("", "a", "x" * 123, "good words here " * 20, "é### " * 70, "y" * 124, "z" * 256)
    assert np.allclose(bytenet.score(p, texts), [plain_score(p, t) for t in texts], atol=1e-5)


def test_a_very_long_text():
    p = bytenet.init(2)
    long = as_bytes("words of all kinds " * 300_000)[0]
    assert abs(bytenet.score(p, [long])[0] - bytenet.score(p, [long[: 19 * 128 * 60]])[0]) < 1e-3  # a text that repeats has the same pools


def test_learns(spark, monkeypatch):
    monkeypatch.setattr(quality.bytenet, "train", partial(bytenet.train, steps=120))
    r = np.random.default_rng(0)
    word = lambda: "".join(r.choice(list("etaoin"), r.integers(2, 7)))
    rows = [(i, " ".join(word() + ("###" if i % 3 == 0 else "") for _ in range(40)), int(i % 3 != 0)) for i in range(300)]
    extra = [(1000, None), (1001, ""), (None, "x y"), (rows[1][0], rows[1][1])]
    docs = spark.createDataFrame([(d, t, 9.0) for d, t, _ in rows] + [(d, t, 9.0) for d, t in extra], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows] + [(1001, 7), (2000, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {x["doc"]: x["score"] for x in quality.scores(docs, model).collect()}
    held = [(got[d] >= 0.5) == q for d, _, q in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    assert len(held) > 50 and np.mean(held) > 0.95 and got[1000] == got[1001]
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("score = 9.0").count() == kept.count()
    assert quality.scores(docs.limit(0), model).collect() == []
    untaught = quality.fit(docs, labels.limit(0))
    assert quality.scores(docs, untaught).count() == docs.count()


def test_stages_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality.bytenet, "train", partial(bytenet.train, steps=60))
    table = lambda df: sorted(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)
    ws, docs, done = corpus_pipeline.Workspace(spark, "test"), spark.read.parquet(f"{DATA}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, ws.save(stage(spark, docs, DATA), f"s{k}")
        done.append((before, docs))
    first, lines, near, bench, mix = done
    model = quality.fit(first[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    good = {r["doc_id"] for r in first[0].collect() if bytenet.score(model, as_bytes(r["text"] or ""))[0] >= 0.5}
    assert table(first[1]) == [r for r in table(first[0]) if r[0] in good]
    texts = {d: t for d, _, _, t in lines_brute([(r[0], r[1]) for r in table(lines[0])])}
    assert table(lines[1]) == sorted([(r[0], texts[r[0]], r[2], r[3], len(texts[r[0]])) for r in table(lines[0])], key=repr)
    rows = table(near[0])
    fps = np.array([fingerprint.fingerprint(r[1].encode()) for r in rows], np.uint64)
    group = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min(group[j] for j in np.flatnonzero(np.bitwise_count(fps ^ f) <= 3)) for f in fps]
        if new == group:
            break
        group = new
    first_of = {}
    for g, r in zip(group, rows, strict=True):
        first_of[g] = min(first_of.get(g, r[0]), r[0])
    assert table(near[1]) == [r for g, r in zip(group, rows, strict=True) if first_of[g] == r[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, _, h, _ in brute([(r[0], r[1]) for r in table(bench[0])], items, 10) if not h}
    assert table(bench[1]) == [r for r in table(bench[0]) if r[0] in clean]
    assert mix[1].columns == ["doc_id", *mixing.LEVELS, "n_tokens", "epochs"] and 0 < mix[1].count() <= mix[0].count()
    sql = duckdb.connect()
    sql.register("documents", mix[0].toPandas())
    assert rows_of(mix[1].toPandas(), mix[1].columns) == rows_of(sql.sql(mixing.ORACLE).df(), mix[1].columns)


def test_pipeline_of_empty_tables(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
