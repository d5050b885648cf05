"""Versioned tables with competing writers, and the read-through cache."""

import datetime as dt
import hashlib
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from wellspring.functions import entities
from wellspring.functions import text as X
from wellspring.sources.cache import Cache, query_key
from wellspring.sources.versioned import Conflict, Table, set_status, upsert

RUN = "run_id bigint, status string, progress map<string,string>, started_at timestamp, completed_at timestamp, error string"


def runs(spark):
    return spark.createDataFrame([(1, "queued", None, None, None, None), (2, "queued", {"pages": "3"}, None, None, None)], RUN)


def test_versions(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    assert t.version() == 0 and t.put(runs(spark), 0) and t.version() == 1
    assert t.update(set_status("crawling", 1, {"pages": "5"}, "2024-01-01 00:00:00")) == 2
    assert t.update(set_status("crawling", 1, now="2024-02-01 00:00:00")) == 3
    assert t.update(set_status("failed", 2, {"step": "x"}, "2024-01-02 00:00:00", "no pages")) == 4
    got = {r.run_id: r for r in t.read().collect()}
    assert got[1].started_at == dt.datetime(2024, 1, 1) and got[1].progress == {"pages": "5", "current_step": "crawling"} and got[1].completed_at is None
    assert got[2].progress == {"pages": "3", "step": "x", "current_step": "failed"} and got[2].error == "no pages" and got[2].completed_at == dt.datetime(2024, 1, 2)
    assert {r.status for r in t.read(1).collect()} == {"queued"}


def test_one_of_two_writers_wins(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.put(runs(spark), 0)
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda i: Table(spark, t.folder).put(runs(spark).withColumn("status", F.lit(f"by {i}")), 1), range(4)))
    assert sum(won) == 1 and t.version() == 2
    assert {r.status for r in t.read().collect()} == {f"by {won.index(True)}"}
    assert len([f for f in os.listdir(t.folder) if f.startswith("data-")]) == 2  # the losers' files are gone


def test_losers_apply_their_change_to_the_new_version(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.put(spark.createDataFrame([(1, 0)], "k bigint, n bigint"), 0)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: Table(spark, t.folder).update(lambda d: d.withColumn("n", F.col("n") + 1), tries=20), range(3)))
    assert t.read().first().n == 3 and t.version() == 4


def test_conflict_after_all_tries(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"))
    t.put(runs(spark), 0)

    def slow(d):  # another writer commits while this one works
        other = Table(spark, t.folder)
        other.put(other.read(), other.version())
        return d

    with pytest.raises(Conflict):
        t.update(slow, tries=2, pause=0)
    with pytest.raises(ValueError):
        Table(spark, str(tmp_path / "none")).read()


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, v string")
    new = spark.createDataFrame([("b", 3, None), ("b", 5, "w"), ("c", 4, "z")], old.schema)
    assert sorted(map(tuple, upsert(old, new, "k").collect())) == [("a", 1, "x"), ("b", 5, "w"), ("c", 4, "z")]


def test_second_run_computes_no_row(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    wanted = docs.select(X.content_hash(F.col("text")).alias("key"), "doc_id", "text")
    cache = Cache(spark, str(tmp_path / "c"), "embedding array<float>")

    def embed(missing):
        def seen(batches):
            for b in batches:
                calls.add(b.num_rows)
                yield b

        return entities.hashed_vectors(missing.select("key", "text").mapInArrow(seen, "key string, text string"), "key", "text").select("key", "embedding")

    first = cache.through(wanted, embed).collect()
    distinct = len({r.key for r in first})
    assert len(first) == docs.count() > distinct == calls.value and not any(r.cached for r in first)
    second = cache.through(wanted, embed).collect()
    assert calls.value == distinct and all(r.cached for r in second)
    assert {r.doc_id: r.embedding for r in first} == {r.doc_id: r.embedding for r in second}
    assert all(sum(v * v for v in r.embedding) == pytest.approx(1, abs=1e-5) for r in first if r.text.split())
    more = wanted.union(spark.createDataFrame([("new", 10**6, "one more text"), (None, 7, "keyless")], wanted.schema))
    third = {r.doc_id: r for r in cache.through(more, embed).collect()}
    assert calls.value == distinct + 1 and not third[10**6].cached and third[7].embedding is None


def test_rows_expire(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"), "n bigint", hours=24)
    keys = spark.createDataFrame([("q one", ["b", "a"]), ("q two", ["a"])], "q string, p array<string>").select(query_key(F.col("q"), F.col("p")).alias("key"))
    assert hashlib.sha256(b"q one:a,b").hexdigest()[:16] in {r.key for r in keys.collect()}
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    run = lambda n, now, w=keys: sorted((r.n, r.cached) for r in cache.through(w, lambda m: m.withColumn("n", F.lit(n)), now).collect())
    assert run(1, day(1)) == [(1, False)] * 2
    assert run(2, day(2)) == [(1, True)] * 2  # exactly a day old still counts
    assert run(3, day(2, 1), keys.limit(1)) == [(3, False)]
    assert run(4, day(2, 2)) == [(3, True), (4, False)]
    assert cache.rows().count() == 4
