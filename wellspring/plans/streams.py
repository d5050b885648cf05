"""Batch forms of the scheduled, running and session operators over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import schedule as X
from ..streaming import snapshots as S
from .base import query

_FIRST = "(date_trunc('month', {0}) + to_days(CAST((8 - isodow(date_trunc('month', {0}))) % 7 AS INT)) + INTERVAL 6 HOUR)"
_MONTH = _FIRST.format("(date_trunc('month', {0}) + INTERVAL 1 MONTH)")
_WEEK = "(CASE WHEN isodow({0}) = 1 AND hour({0}) < 6 THEN date_trunc('day', {0}) ELSE date_trunc('day', {0}) + to_days(CAST(8 - isodow({0}) AS INT)) END + INTERVAL 6 HOUR)"
_TEXT = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def events(t):
    return t("events").withColumn("ts", F.col("ts").cast("timestamp"))


def text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("next_runs", f"SELECT event_id, {_TEXT.format(_WEEK.format('ts'))} AS weekly, {_TEXT.format(_MONTH.format('ts'))} AS monthly FROM events")
def next_runs(t):
    """The next weekly and monthly run after each event: Mondays at six."""
    ts = F.col("ts")
    return events(t).select("event_id", X.next_weekly(ts).alias("weekly"), X.next_monthly(ts).alias("monthly")).select("event_id", text("weekly"), text("monthly"))


@query("scheduled_snapshots", f"""WITH e AS (SELECT user_id, f AS frequency, ts, value FROM events, (SELECT unnest(['weekly', 'monthly']) AS f)),
k AS (SELECT user_id, frequency, CASE frequency WHEN 'weekly' THEN {_WEEK.format('ts')} ELSE {_MONTH.format('ts')} END AS start FROM (SELECT user_id, frequency, min(ts) AS ts FROM e GROUP BY ALL)),
s AS (SELECT user_id, frequency, greatest(start, CASE WHEN frequency = 'weekly' THEN {_WEEK.format('ts')} WHEN ts < {_FIRST.format('ts')} THEN {_FIRST.format('ts')} ELSE {_MONTH.format('ts')} END) AS run_at, count(*) AS n, avg(value) AS v FROM e JOIN k USING (user_id, frequency) GROUP BY ALL),
u AS (SELECT max(ts) AS until FROM events), d AS (SELECT user_id, frequency, unnest(CASE frequency WHEN 'weekly' THEN generate_series(start, until, INTERVAL 7 DAY) ELSE list_transform(generate_series(date_trunc('month', start), until, INTERVAL 1 MONTH), lambda m: {_FIRST.format('m')}) END) AS run_at, until FROM k, u),
r AS (SELECT d.user_id, d.frequency, d.run_at, coalesce(s.n, 0) AS n, last_value(round(s.v, 6) IGNORE NULLS) OVER (PARTITION BY d.user_id, d.frequency ORDER BY d.run_at) AS score FROM d LEFT JOIN s USING (user_id, frequency, run_at) WHERE d.run_at <= until)
SELECT user_id, frequency, {_TEXT.format('run_at')} AS run_at, n, score, round(score - lag(score) OVER (PARTITION BY user_id, frequency ORDER BY run_at), 6) AS delta FROM r""")
def scheduled_snapshots(t):
    """Weekly and monthly snapshots of every user's mean value."""
    return S.snapshots(S.both_schedules(events(t))).withColumn("run_at", text("run_at"))


@query("running_rates", f"""WITH r AS (SELECT date_trunc('day', ts) AS start, user_id, count(*) FILTER (WHERE event_type <> 'error') AS completed, count(*) FILTER (WHERE event_type = 'error') AS failed,
{", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS {k}" for k in ("click", "signup", "purchase"))}, avg(value) FILTER (WHERE event_type <> 'error') AS v FROM events GROUP BY ALL)
SELECT {_TEXT.format('start')} AS start, user_id, completed, failed, {", ".join(f"round(coalesce({k} / nullif(completed, 0), 0), 6) AS {k}_rate" for k in ("click", "signup", "purchase"))}, round(v, 6) AS mean_value FROM r""")
def running_rates(t):
    """Rates by user and day after all rows have come."""
    return S.running_rates(events(t)).withColumn("start", text("start"))


@query("stream_sessions", f"""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, {_TEXT.format('min(ts)')} AS start, {_TEXT.format('max(ts)')} AS last, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM s GROUP BY user_id, session""")
def stream_sessions(t):
    """Sessions of each user: rows at most half an hour apart."""
    s = S.sessions(events(t))
    return s.withColumns({"start": text("start"), "last": text("last")})
