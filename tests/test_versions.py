"""Commits of several writers, reads of the past, and results kept by content."""

import threading

import pytest
from pyspark.sql import functions as F

from srclens.sources.cache import ResultCache, refreshed
from srclens.sources.versions import Versions


def files(spark, **contents):
    return spark.createDataFrame(list(contents.items()), "path string, content string")


def state(df):
    return {r["path"]: r["content"] for r in df.collect()}


@pytest.fixture
def log(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/log")


def test_commits_and_the_past(spark, log):
    assert log.latest() == 0 and log.as_of().count() == 0
    assert log.commit(files(spark, a="1", b="2", c="3"), 0)[0] == 1
    assert log.commit(files(spark, a="1!", b=None), 1)[0] == 2
    number, clash = log.commit(files(spark, b="late", d="4"), 1)
    assert number is None and [r[0] for r in clash.collect()] == ["b"]
    assert log.commit(files(spark, d="4"), 1)[0] == 3
    assert [state(log.as_of(v)) for v in range(4)] == [{}, dict(a="1", b="2", c="3"), dict(a="1!", c="3"), dict(a="1!", c="3", d="4")]
    assert log.revert(2)[0] == 4 and state(log.as_of()) == dict(a="1", b="2", c="3", d="4")
    number, clash = log.revert(1)
    assert number is None and {r[0] for r in clash.collect()} == {"a", "b"}
    assert [(e.version, e.base) for e in log.entries()] == [(1, 0), (2, 1), (3, 1), (4, 2)]


def test_what_was_broken_off_counts_nothing(spark, log, monkeypatch):
    log.commit(files(spark, a="1"), 0)
    monkeypatch.setattr(Versions, "_claim", lambda self, entry: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        log.commit(files(spark, a="2"), 1)
    assert state(log.as_of()) == {"a": "1"}


@pytest.mark.parametrize("same", [True, False])
def test_two_writers_at_once(spark, tmp_path, same):
    """Both have read the log before either claims a number: one entry is made of each number, and the other writer looks again."""
    root = f"file://{tmp_path}/log"
    Versions(spark, root).commit(files(spark, a="0", b="0"), 0)
    gate, out = threading.Barrier(2), {}

    class Waiting(Versions):
        waited = False

        def _claim(self, entry):
            if not self.waited:
                self.waited = True
                gate.wait(60)
            return super()._claim(entry)

    def write(name, path):
        out[name] = Waiting(spark, root).commit(files(spark, **{path: name}), 1)[0]

    threads = [threading.Thread(target=write, args=("x", "a")), threading.Thread(target=write, args=("y", "a" if same else "b"))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    last = Versions(spark, root)
    assert [e.version for e in last.entries()] == ([1, 2] if same else [1, 2, 3])
    if same:
        (winner,) = [k for k, v in out.items() if v]
        assert out == {"x": None, "y": None} | {winner: 2} and state(last.as_of()) == {"a": winner, "b": "0"}
    else:
        assert sorted(out.values()) == [2, 3] and state(last.as_of()) == {"a": "x", "b": "y"}


def test_only_new_contents_are_evaluated(spark, tmp_path):
    seen = []

    def evaluate(df):
        rows = [(r["key"], [("LONG", len(r["content"]))] if r["content"] else []) for r in df.collect()]
        seen.append(sorted(k for k, _ in rows))
        return spark.createDataFrame(rows, "key string, counts array<struct<rule_id: string, n: bigint>>")

    keyed = lambda **c: files(spark, **c).withColumn("key", F.concat(F.lit("k"), "content"))
    cache = ResultCache(spark, f"file://{tmp_path}/cache", 3)
    none = spark.createDataFrame([], "rule_id string, n long")
    one, two, three = keyed(a="x", b="xx", c="xx", d=""), keyed(a="x", b="xxx", c="", e="xx"), keyed(a="xxx")
    total = lambda df: {r["rule_id"]: r["n"] for r in df.collect()}
    t1 = refreshed(cache, none, one.limit(0), one, evaluate)
    assert total(t1) == {"LONG": 5}
    t2 = refreshed(cache, t1, one, two, evaluate)
    assert total(t2) == {"LONG": 6}
    assert total(refreshed(cache, t2, two, three, evaluate)) == {"LONG": 3}
    assert seen == [["k", "kx", "kxx"], ["kxxx"], []]
    assert cache.table().count() == 4
    cache.drop()


def test_a_lookup_does_not_shuffle_the_cache(spark, tmp_path):
    cache = ResultCache(spark, f"file://{tmp_path}/cache", 3)
    cache.add(spark.range(500).select(F.col("id").cast("string").alias("key"), F.array(F.struct(F.lit("R").alias("rule_id"), F.col("id").alias("n"))).alias("counts")))
    plan = cache.found(spark.range(900).select(F.col("id").cast("string").alias("key")))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in text and text.count("Exchange") <= 1
    assert plan.where("counts is not null").count() == 500
    cache.drop()
