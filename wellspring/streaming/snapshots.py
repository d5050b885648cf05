"""Scheduled snapshots, running rates and sessions that give on a stream what they give on a table.

A snapshot schedule is kept as keyed state with an event-time timer: the timer of a key fires when the watermark passes its next
run, the run's snapshot is emitted, and the timer moves on to the run after it, with or without new rows. The state holds one sum a
pending run, so late rows within the watermark go to the run they belong to.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import schedule as X

SNAPSHOT = "user_id bigint, frequency string, run_at timestamp, n bigint, score double, delta double"
COLUMNS = [x.split()[0] for x in SNAPSHOT.split(", ")]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def both_schedules(events: DataFrame) -> DataFrame:
    """events once for the weekly and once for the monthly schedule."""
    return events.withColumn("frequency", F.explode(F.array(F.lit("weekly"), F.lit("monthly"))))


def snapshots(events: DataFrame, until: dt.datetime | None = None) -> DataFrame:
    """events (user_id, frequency, ts, value) of a table -> SNAPSHOT, one row for each run at or before ``until`` (default: the last ts).

    The first run follows a key's first event. A run covers the rows since the run before; its score is their mean, or the last score where
    there are none; delta is null at the first. Rows are summed by run before anything is ordered, so a key costs its runs.
    """
    ts = F.col("ts")
    run = F.when(F.col("frequency") == "weekly", X.next_weekly(ts)).otherwise(X.monthly_after(ts))
    sums = events.withColumn("run_at", run).groupBy("user_id", "frequency", "run_at").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.min("ts").alias("first"))
    first = F.min("first").over(Window.partitionBy("user_id", "frequency"))
    start = F.when(F.col("frequency") == "weekly", X.next_weekly(first)).otherwise(X.next_monthly(first))
    sums = sums.withColumn("start", start).withColumn("run_at", F.greatest("run_at", "start")).groupBy("user_id", "frequency", "start", "run_at").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    end = F.lit(until).cast("timestamp") if until else F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp")
    keys = sums.select("user_id", "frequency", "start").distinct().filter(F.col("start") <= end)
    weeks = F.sequence("start", end, F.expr("INTERVAL 7 DAYS"))
    months = F.transform(F.sequence(F.trunc("start", "month"), F.trunc(end, "month"), F.expr("INTERVAL 1 MONTH")), lambda m: X.first_of_month(m))
    due = keys.select("user_id", "frequency", F.explode(F.when(F.col("frequency") == "weekly", weeks).otherwise(months)).alias("run_at")).filter(F.col("run_at") <= end)
    r = due.join(sums.drop("start"), ["user_id", "frequency", "run_at"], "left")
    order = Window.partitionBy("user_id", "frequency").orderBy("run_at")
    r = r.withColumn("score", F.last(F.round(F.col("v") / F.col("n"), 6), ignorenulls=True).over(order))
    delta = F.round(F.col("score") - F.lag("score").over(order), 6)
    return r.select("user_id", "frequency", "run_at", F.coalesce("n", F.lit(0)).alias("n"), "score", delta.alias("delta"))


def next_run(frequency: str, ts: dt.datetime, weekday: int = X.DAY, hour: int = X.HOUR) -> dt.datetime:
    """The first run after a key's first event at ts (see functions.schedule)."""
    if frequency == "weekly":
        ahead = (weekday - ts.weekday()) % 7
        if not ahead and ts.hour >= hour:
            ahead = 7
        return ts.replace(hour=hour, minute=0, second=0, microsecond=0) + dt.timedelta(days=ahead)
    month = dt.datetime(ts.year + ts.month // 12, ts.month % 12 + 1, 1, hour)
    return month + dt.timedelta(days=(weekday - month.weekday()) % 7)


class Snapshots(StatefulProcessor):
    """State of a key: its next run, its last score, and (n, sum) of each pending run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", "run_at timestamp, score double")
        self.sums = handle.getMapState("sums", "run_at timestamp", "n bigint, v double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frequency = key[1]
        table = pd.concat(list(rows))
        if self.plan.exists():
            due, score = self.plan.get()
        else:
            due, score = next_run(frequency, table["ts"].min().to_pydatetime()), None
            self.plan.update((due, score))
            self.handle.registerTimer(_millis(due))
        run = table["ts"].map(lambda t: max(due, _covering(frequency, t.to_pydatetime())))
        for at, own in table["value"].groupby(run):
            at = at.to_pydatetime()
            n, v = self.sums.getValue((at,)) if self.sums.containsKey((at,)) else (0, 0.0)
            self.sums.updateValue((at,), (n + len(own), v + float(own.sum())))
        yield pd.DataFrame(columns=COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, last = self.plan.get()
        out = []
        while _millis(due) <= timerValues.getCurrentWatermarkInMs():  # the watermark may have passed several runs
            n, v = self.sums.getValue((due,)) if self.sums.containsKey((due,)) else (0, 0.0)
            score = round(v / n, 6) if n else last
            out.append((key[0], key[1], due, n, score, None if last is None else round(score - last, 6)))
            if n:
                self.sums.removeKey((due,))
            due, last = due + dt.timedelta(days=7) if key[1] == "weekly" else next_run("monthly", due), score
        self.plan.update((due, last))
        self.handle.registerTimer(_millis(due))
        yield pd.DataFrame(out, columns=COLUMNS).astype({"delta": "Float64"})

    def close(self) -> None:
        pass


def _millis(t: dt.datetime) -> int:
    return int(t.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def _covering(frequency: str, ts: dt.datetime) -> dt.datetime:
    if frequency == "weekly":
        return next_run(frequency, ts)
    own = ts.replace(day=1, hour=X.HOUR, minute=0, second=0, microsecond=0)
    own += dt.timedelta(days=(X.DAY - own.weekday()) % 7)
    return own if ts < own else next_run(frequency, ts)


def snapshot_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streaming form of snapshots(), in append mode; the session's state store must be STATE_STORE and its time zone UTC."""
    keyed = events.select("user_id", "frequency", "ts", "value").withWatermark("ts", delay).groupBy("user_id", "frequency")
    return keyed.transformWithStateInPandas(Snapshots(), SNAPSHOT, "Append", "EventTime")


def running_rates(events: DataFrame, length: str = "1 day", delay: str = "2 hours") -> DataFrame:
    """Rates of a user's window as rows arrive (update mode on a stream): of completed rows, how many were clicks, signups, purchases.

    Errors are failed, not completed. On a stream a row later than the watermark changes nothing.
    """
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    done = F.col("event_type") != "error"
    r = e.groupBy(F.window("ts", length), "user_id").agg(
        F.count_if(done).alias("completed"), F.count_if(~done).alias("failed"), *[F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "signup", "purchase")], F.sum(F.when(done, F.col("value"))).alias("_v")
    )
    rate = lambda x: F.round(F.coalesce(F.try_divide(F.col(x), F.col("completed")), F.lit(0.0)), 6)
    return r.select(F.col("window.start").alias("start"), "user_id", "completed", "failed", rate("click").alias("click_rate"), rate("signup").alias("signup_rate"), rate("purchase").alias("purchase_rate"), F.round(F.try_divide(F.col("_v"), F.col("completed")), 6).alias("mean_value"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Stretches of a user's rows at most ``gap`` apart, with a late row joining or merging those it falls between."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    s = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.max("ts").alias("last"))
    return s.select("user_id", F.col("w.start").alias("start"), "last", "n", "purchases")
