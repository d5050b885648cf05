"""Streaming runs over files give what the batch forms give."""

import pytest
from pyspark.sql import functions as F

from wellspring.streaming import events as S

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events"))
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").coalesce(1).write.mode("overwrite").option("maxRecordsPerFile", 300).parquet(path)
    return path


def run(spark, files, build, mode, name):
    e = spark.read.parquet(files)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(files)
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name), e


def test_tumbling_equals_batch(spark, files):
    got, e = run(spark, files, S.tumbling, "complete", "tumbling")
    assert sorted(map(str, got.collect())) == sorted(map(str, S.tumbling(e).collect()))


def test_sliding_equals_batch(spark, files):
    got, e = run(spark, files, S.sliding, "complete", "sliding")
    assert sorted(map(str, got.collect())) == sorted(map(str, S.sliding(e).collect()))


def test_dedupe_emits_no_key_twice_within_watermark(spark, files):
    got, e = run(spark, files, S.first_seen, "append", "dedupe")
    keys = {(r.user_id, r.event_type) for r in got.collect()}
    assert keys == {(r.user_id, r.event_type) for r in e.collect()}


def test_rate_limit(spark, files):
    got, e = run(spark, files, S.rate_limited_alerts, "append", "alerts")
    want, last = [], {}
    for r in sorted(e.filter("value > 90").collect(), key=lambda r: (r.ts, r.event_id)):
        if r.user_id not in last or (r.ts - last[r.user_id]).total_seconds() >= 24 * 3600:
            want.append((r.user_id, r.ts))
            last[r.user_id] = r.ts
    assert sorted((r.user_id, r.ts) for r in got.collect()) == sorted(want)
