"""Fix, delta, trend and alert queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import monitoring as M
from .base import query

REASONS = list(M.IMPACT)
#: Fixes: orders are the failed questions, their priority the site, order size the reason.
FIX = f"q AS (SELECT o_orderpriority AS site, o_orderkey % 5 AS r FROM orders), f AS (SELECT site, CASE r {' '.join(f'WHEN {i} THEN {chr(39)}{n}{chr(39)}' for i, n in enumerate(REASONS))} END AS reason, count(*) AS n, CASE r {' '.join(f'WHEN {i} THEN {v[1]}' for i, v in enumerate(M.IMPACT.values()))} END AS base FROM q GROUP BY site, r), x AS (SELECT site, reason, n, CAST(round(base * CASE WHEN n % 7 <= 1 THEN 1.0 WHEN n % 7 = 2 THEN 1.5 WHEN n % 7 = 3 THEN 1.8 WHEN n % 7 = 4 THEN 2.0 ELSE 2.2 END, 4) AS DOUBLE) AS expected FROM f)"


def fixes(t):
    r = (F.col("o_orderkey") % 5 + 1).cast("int")
    q = t("orders").select(F.col("o_orderpriority").alias("site"), F.element_at(F.array(*map(F.lit, REASONS)), r).alias("reason"), F.element_at(F.array(*[F.lit(v[1]) for v in M.IMPACT.values()]), r).alias("base"))
    f = q.groupBy("site", "reason", "base").agg(F.count(F.lit(1)).alias("n"))
    return f.select("site", "reason", "n", F.round(F.col("base") * M.question_multiplier(F.col("n") % 7), 4).alias("expected"))


@query("fix_groups", f"WITH {FIX} SELECT * FROM x")
def fix_groups(t):
    return fixes(t)


@query("impact_totals", f"WITH {FIX}, p AS (SELECT site, expected * pow(0.8, row_number() OVER (PARTITION BY site ORDER BY expected DESC, reason) - 1) AS p FROM x) SELECT site, round(least(30, sum(p)), 4) AS total, count(*) AS fixes FROM p GROUP BY site")
def impact_totals(t):
    return M.impact_totals(fixes(t), "site")


@query("action_center", f"WITH {FIX}, r AS (SELECT site, reason, expected, row_number() OVER (PARTITION BY site ORDER BY expected DESC, reason) AS rank, expected >= 5 AS quick_win FROM x) SELECT * FROM r WHERE rank <= 3 OR quick_win")
def action_center(t):
    r = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("expected"), "reason"))
    return fixes(t).select("site", "reason", "expected", r.cast("bigint").alias("rank"), (F.col("expected") >= 5).alias("quick_win")).filter("rank <= 3 OR quick_win")


DAILY = "d AS (SELECT user_id, CAST(ts AS DATE) AS day, round(avg(value), 4) AS score FROM events GROUP BY ALL), dl AS (SELECT *, lag(score) OVER w AS prev, round(score - lag(score) OVER w, 4) AS delta FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day))"


@query("score_delta", f"WITH {DAILY} SELECT user_id, CAST(day AS VARCHAR) AS day, score, delta, CASE WHEN delta >= 0.5 THEN 'improved' WHEN delta <= -0.5 THEN 'declined' ELSE 'stable' END AS direction, CASE WHEN abs(delta) >= 10 THEN 'major' WHEN abs(delta) >= 5 THEN 'moderate' WHEN abs(delta) >= 1 THEN 'minor' ELSE 'negligible' END AS significance FROM dl WHERE prev IS NOT NULL")
def score_delta(t):
    d = M.deltas(M.daily(t("events"))).filter("prev IS NOT NULL")
    return d.select("user_id", F.col("day").cast("string").alias("day"), "score", "delta", M.direction(F.col("delta")).alias("direction"), M.significance(F.col("delta")).alias("significance"))


@query("score_trend", f"WITH {DAILY} SELECT user_id, round(avg(score), 8) AS mean, min(score) AS least, max(score) AS most, round(arg_max(score, day) - arg_min(score, day), 4) AS change, CASE WHEN arg_max(score, day) - arg_min(score, day) > 5 THEN 'improving' WHEN arg_max(score, day) - arg_min(score, day) < -5 THEN 'declining' ELSE 'stable' END AS trend FROM d GROUP BY user_id")
def score_trend(t):
    change = F.max_by("score", "day") - F.min_by("score", "day")
    return M.daily(t("events")).groupBy("user_id").agg(F.round(F.avg("score"), 8).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.round(change, 4).alias("change"), F.when(change > 5, "improving").when(change < -5, "declining").otherwise("stable").alias("trend"))


@query("alert_rules", f"WITH {DAILY}, a AS (SELECT user_id, CAST(day AS VARCHAR) AS day, CASE WHEN prev >= 40 AND score < 40 THEN 'critical' WHEN delta < -5 THEN 'drop' WHEN delta >= 10 THEN 'improvement' END AS alert FROM dl) SELECT * FROM a WHERE alert IS NOT NULL")
def alert_rules(t):
    return M.alerts(M.deltas(M.daily(t("events")))).select("user_id", F.col("day").cast("string").alias("day"), "alert")
