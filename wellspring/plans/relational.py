"""Relational queries on the order tables and events, and the batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import events as S
from .base import query


@query("latest_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_group(t):
    last = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return t("orders").groupBy("o_custkey").agg(last.alias("x")).select("o_custkey", "x.o_orderkey", "x.o_totalprice")


@query("semi_join", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_join(t):
    return t("customer").join(t("orders").filter("o_totalprice > 200000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_nationkey")


@query("anti_join", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_nationkey")


@query("three_way_join", "SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY n_name")
def three_way_join(t):
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("filter_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value <= 10) AS low FROM events GROUP BY event_type")
def filter_counts(t):
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 10).alias("low"))


@query("case_buckets", "SELECT CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM orders GROUP BY 1")
def case_buckets(t):
    p = F.col("o_totalprice")
    return t("orders").groupBy(F.when(p < 50000, "small").when(p < 150000, "medium").otherwise("large").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("daily_histogram", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY 1")
def daily_histogram(t):
    e = t("events")
    last = e.agg(F.max("ts").alias("last"))
    return e.join(F.broadcast(last)).filter("ts >= last - INTERVAL 14 DAYS").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("json_predicate", "SELECT user_id, count(*) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 50 GROUP BY user_id")
def json_predicate(t):
    return t("events").filter(F.get_json_object("props", "$.k").cast("int") >= 50).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_counts", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def distinct_counts(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("approx_distinct")
def approx_distinct(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@query("paginate", "SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 25 OFFSET 50")
def paginate(t):
    """The third page of 25: the limit is the feature."""
    return t("events").select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").offset(50).limit(25)


@query("prev_row_delta", "SELECT event_id, user_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS delta FROM events")
def prev_row_delta(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", "user_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("delta"))


@query("top_by_count", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
def top_by_count(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query("count_subquery", "SELECT count(*) AS customers FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 10)")
def count_subquery(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 10").agg(F.count(F.lit(1)).alias("customers"))


@query("prefix_lookup", "SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '12%'")
def prefix_lookup(t):
    """The least order whose key as text begins with a prefix: a filtered minimum in place of a sorted limit of one."""
    return t("orders").filter(F.col("o_orderkey").cast("string").like("12%")).agg(F.min("o_orderkey").alias("o_orderkey"))


@query("stream_tumbling", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS correct FROM events GROUP BY ALL")
def stream_tumbling(t):
    """Batch form; tests/test_streaming.py compares the streaming run with it."""
    return S.tumbling(t("events")).select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n", "correct")


@query("stream_sliding", "WITH d AS (SELECT event_id, value, date_trunc('day', ts) AS day FROM events), w AS (SELECT day - to_days(CAST(i AS INT)) AS start, value FROM d, unnest(range(7)) AS u(i)) SELECT CAST(CAST(start AS DATE) AS VARCHAR) AS start, count(*) AS n, round(avg(CAST(value > 50 AS INT)), 6) AS accuracy FROM w GROUP BY start")
def stream_sliding(t):
    return S.sliding(t("events")).select(F.to_date("window.start").cast("string").alias("start"), "n", "accuracy")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(t):
    return S.first_seen(t("events")).select("user_id", "event_type")


@query("stream_alerts", "WITH e AS (SELECT user_id, ts, value, event_id, CAST(ts AS DATE) AS day FROM events WHERE value > 90) SELECT user_id, CAST(day AS VARCHAR) AS day, min(ts) AS first_ts, count(*) AS n FROM e GROUP BY user_id, day")
def stream_alerts(t):
    """At most one alert a user and day, with the alerts it stands for."""
    return S.daily_alerts(t("events")).select("user_id", F.col("day").cast("string").alias("day"), "first_ts", "n")
