"""Scheduled snapshots, running rates and sessions: streams against tables and plain Python."""

import datetime as dt
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wellspring.functions import schedule as X
from wellspring.streaming import snapshots as S

DDL = "event_id bigint, user_id bigint, frequency string, ts timestamp, event_type string, value double"
T = lambda s: dt.datetime.fromisoformat(s)


def stream_of(spark, path, batches, ddl=DDL):
    """A file stream of one batch a file, in order."""
    import os
    import time

    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, ddl).coalesce(1)
        df.write.parquet(f"{path}/stage{i}")
        part = next(f for f in os.listdir(f"{path}/stage{i}") if f.endswith(".parquet"))
        os.makedirs(f"{path}/in", exist_ok=True)
        os.rename(f"{path}/stage{i}/{part}", f"{path}/in/{i:03d}.parquet")
        os.utime(f"{path}/in/{i:03d}.parquet", (time.time() - 1000 + i, time.time() - 1000 + i))
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def run(df, path, mode, sink=None):
    got = []
    q = df.writeStream.outputMode(mode).foreachBatch(sink or (lambda b, i: got.append((i, b.collect())))).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return got


TIMES = ["2024-01-01 05:59:59", "2024-01-01 06:00:00", "2024-01-07 23:00:00", "2024-01-08 00:10:00", "2024-01-31 12:00:00", "2024-02-05 05:00:00", "2024-02-29 08:00:00", "2024-12-30 07:00:00", "2024-09-02 06:30:00"]


def test_next_runs(spark):
    df = spark.createDataFrame([(T(x),) for x in TIMES], "ts timestamp")
    for r in df.select("ts", X.next_weekly(F.col("ts")).alias("w"), X.next_monthly(F.col("ts")).alias("m"), X.monthly_after(F.col("ts")).alias("a")).collect():
        assert (r.w, r.m) == (S.next_run("weekly", r.ts), S.next_run("monthly", r.ts))
        assert r.a == S._covering("monthly", r.ts) > r.ts and r.w > r.ts and r.w.weekday() == r.m.weekday() == 0 and r.w.hour == 6
        assert r.w - r.ts <= dt.timedelta(days=7) and (r.m.month - r.ts.month) % 12 == 1 and r.m.day <= 7


@pytest.fixture(scope="module")
def history():
    """Three users over four months; a silent stretch, rows at a run's own time, rows out of order within the delay."""
    rows, base = [], T("2024-01-03 10:00:00")
    for i in range(130):
        rows.append((i, i % 3, "", base + dt.timedelta(hours=21 * i + (5 if i % 7 == 3 else 0)), "view", float(i * 37 % 101)))
    rows = [r for r in rows if not (r[1] == 2 and T("2024-02-01") < r[3] < T("2024-03-15"))]
    return rows + [(900, 0, "", T("2024-01-08 06:00:00"), "view", 50.0), (901, 0, "", T("2024-02-05 06:00:00"), "view", 70.0)]


def plain_snapshots(rows, until):
    out = []
    by = defaultdict(list)
    for _, u, f, ts, _, v in rows:
        by[u, f].append((ts, v))
    for (u, f), own in by.items():
        due, before, last = S.next_run(f, min(own)[0]), dt.datetime.min, None
        while due <= until:
            v = [x for t, x in own if before <= t < due]
            score = round(sum(v) / len(v), 6) if v else last
            out.append((u, f, due, len(v), score, None if last is None else round(score - last, 6)))
            before, last, due = due, score, due + dt.timedelta(days=7) if f == "weekly" else S.next_run(f, due)
    return sorted(out)


def as_rows(rows):
    return sorted((r.user_id, r.frequency, r.run_at, r.n, r.score, None if r.delta is None or r.delta != r.delta else r.delta) for r in rows)


def same(a, b):
    assert [x[:4] for x in a] == [x[:4] for x in b]
    for x, y in zip(a, b):
        assert x[4:] == pytest.approx(y[4:], abs=2e-6) if None not in x[4:] else x[5] == y[5] and x[4] == pytest.approx(y[4])


def both(rows):
    return [(*r[:2], f, *r[3:]) for r in rows for f in ("weekly", "monthly")]


def test_table_equals_a_loop(spark, history):
    df = spark.createDataFrame(both(history), DDL)
    for until in (max(r[3] for r in history), T("2024-02-05 06:00:00"), T("2024-02-05 05:59:00")):
        same(as_rows(S.snapshots(df, until).collect()), plain_snapshots(both(history), until))
    assert S.snapshots(df.limit(0), T("2024-02-05 06:00:00")).count() == 0


def test_stream_equals_table(spark, history, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.STATE_STORE)
    try:
        rows = both(sorted(history, key=lambda r: r[3] + dt.timedelta(hours=(r[0] % 4) * 5)))  # up to fifteen hours late
        step = len(rows) // 6
        batches = [rows[i : i + step] for i in range(0, len(rows), step)]
        got = [r for _, b in run(S.snapshot_stream(stream_of(spark, str(tmp_path), batches), "16 hours"), str(tmp_path), "append") for r in b]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    until = max(r[3] for r in history) - dt.timedelta(hours=16)
    want = as_rows(S.snapshots(spark.createDataFrame(both(history), DDL), until).collect())
    assert len(want) > 40
    same(as_rows(got), want)


def test_each_batch_of_rates_equals_a_recount(spark, tmp_path):
    kinds = ["click", "signup", "purchase", "view", "error"]
    row = lambda i, u, at: (i, u, "", T(at), kinds[i % 5], float(i))
    batches = [
        [row(i, i % 2, f"2024-01-01 0{i}:00:00") for i in range(8)],
        [row(8, 0, "2024-01-01 03:30:00"), row(9, 1, "2024-01-01 09:00:00"), row(10, 0, "2024-01-02 01:30:00")],
        [row(11, 1, "2024-01-01 22:00:00"), row(12, 0, "2024-01-02 04:00:00")],
        [row(14, 1, "2024-01-02 05:00:00")],
        [row(13, 0, "2024-01-01 23:00:00"), row(15, 1, "2024-01-02 06:00:00")],  # the first day is closed by now
    ]
    got = run(S.running_rates(stream_of(spark, str(tmp_path), batches), delay="2 hours"), str(tmp_path), "update")
    seen = defaultdict(list)
    for i, own in enumerate(batches):
        touched = set()
        for r in own:
            if r[0] != 13:
                key = (r[3].replace(hour=0, minute=0), r[1])
                seen[key].append(r)
                touched.add(key)
        out = {(r.start, r.user_id): r for b, rows in got if b == i for r in rows}
        assert set(out) == touched, i
        for k, r in out.items():
            done = [x for x in seen[k] if x[4] != "error"]
            assert (r.completed, r.failed) == (len(done), len(seen[k]) - len(done))
            for kind in kinds[:3]:
                assert r[f"{kind}_rate"] == pytest.approx(sum(x[4] == kind for x in done) / len(done) if done else 0, abs=1e-6)


def test_a_late_row_merges_two_sessions(spark, tmp_path):
    at = lambda i, m: (i, 1, "", T("2024-01-01 10:00:00") + dt.timedelta(minutes=m), "purchase", 1.0)
    batches = [[at(0, 0), at(1, 40)], [at(2, 100)], [at(3, 20)], [at(4, 600)], [at(5, 700)]]
    got = run(S.sessions(stream_of(spark, str(tmp_path), batches), delay="2 hours"), str(tmp_path), "append")
    out = sorted((r.start.minute + 60 * (r.start.hour - 10), r.n) for _, b in got for r in b)
    assert out[:2] == [(0, 3), (100, 1)]
    table = spark.createDataFrame([r for b in batches for r in b], DDL)
    assert sorted((r.start.minute + 60 * (r.start.hour - 10), r.n) for r in S.sessions(table).collect())[:2] == out[:2]
    edge = spark.createDataFrame([at(0, 0), at(1, 30), at(2, 61)], DDL)  # exactly the gap apart is the same session
    assert sorted(r.n for r in S.sessions(edge).collect()) == [1, 2]
