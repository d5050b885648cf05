"""Simulation results and their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals as S

RRF_UNIT = 0.02
# Category weights, difficulty multipliers, pillar weights, expected signals by category.
CATEGORY_WEIGHTS = {"identity": 0.25, "offerings": 0.30, "contact": 0.15, "trust": 0.15, "differentiation": 0.15}
DIFFICULTY = {"easy": 1.0, "medium": 1.2, "hard": 1.5}
PILLARS = {"technical": 12, "structure": 18, "schema": 13, "authority": 12, "entity": 13, "retrieval": 22, "coverage": 10}
SIGNALS = {
    "identity": ["business description", "founding year", "headquarters location"],
    "offerings": ["product names", "pricing tiers", "feature descriptions"],
    "contact": ["email address", "contact form", "getting started guide"],
    "trust": ["customer count", "case studies", "years in business"],
    "differentiation": ["unique value", "core values", "competitive advantages"],
}


def lookup(key: Column, values: dict[str, float]) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def contexts(hits: DataFrame, docs: DataFrame, q: str = "item_id", most: int = 5, chars: int = 2000) -> DataFrame:
    """hits (q, doc_id, rank) and docs (doc_id, text, page) -> chunks, mean and best relevance, pages and a preview.

    Relevance is the fused score of a single ranked list over RRF_UNIT, at most 1.
    """
    h = hits.filter(F.col("rank") <= most).join(docs, "doc_id")
    rel = F.least(0.5 / (60 + F.col("rank")) / RRF_UNIT, F.lit(1.0))
    parts = F.array_sort(F.collect_list(F.struct("rank", F.substring("text", 1, chars).alias("t"))))
    return h.groupBy(q).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.avg(rel).alias("avg_rel"),
        F.max(rel).alias("max_rel"),
        F.array_sort(F.collect_set("page")).alias("pages"),
        F.substring(F.array_join(F.transform(parts, lambda s: s["t"]), "\n\n"), 1, chars).alias("preview"),
    )


def match_signals(ctx: DataFrame, category: str = "category", expected: dict[str, list[str]] = SIGNALS) -> DataFrame:
    """ctx with matches: array of (signal, found, confidence) of its category's expected signals."""
    out = None
    for c, names in expected.items():
        one = F.array(*[F.struct(F.lit(s).alias("signal"), S.found(S.confidence(F.col("preview"), s)).alias("found"), S.confidence(F.col("preview"), s).alias("confidence")) for s in names])
        out = F.when(F.col(category) == c, one) if out is None else out.when(F.col(category) == c, one)
    return ctx.withColumn("matches", out)


def answerability(d: DataFrame) -> DataFrame:
    """chunks, avg_rel, max_rel, matches -> signals, score, answerability, confidence."""
    hit = F.filter("matches", lambda m: m["found"])
    d = d.withColumn("signals_found", F.size(hit)).withColumn("signals_total", F.size("matches"))
    sig = F.when(F.col("signals_total") > 0, F.col("signals_found") / F.col("signals_total")).otherwise(0.5)
    conf = F.when(F.size(hit) > 0, F.aggregate(hit, F.lit(0.0), lambda a, m: a + m["confidence"]) / F.size(hit)).otherwise(0.0)
    none = F.coalesce(F.col("chunks"), F.lit(0)) == 0
    score = F.when(none, 0.0).otherwise(0.4 * F.col("avg_rel") + 0.4 * sig + 0.2 * conf)
    d = d.withColumn("signal_score", sig).withColumn("signal_confidence", conf).withColumn("score", F.round(score, 6))
    s = F.col("score")
    return d.withColumn("answerability", F.when(s >= 0.7, "fully").when(s >= 0.3, "partially").otherwise("not")).withColumn(
        "confidence", F.when(none | ((F.col("max_rel") >= 0.7) & (sig >= 0.7)), "high").when((F.col("max_rel") >= 0.4) | (sig >= 0.4), "medium").otherwise("low")
    )


def question_points(d: DataFrame) -> DataFrame:
    """Base of relevance, signals and confidence, times difficulty (at most 1), times category weight."""
    base = 0.4 * F.col("avg_rel") + 0.4 * F.col("signal_score") + 0.2 * F.col("signal_confidence")
    adj = F.least(F.lit(1.0), base * lookup(F.col("difficulty"), DIFFICULTY))
    return d.withColumn("adjusted", F.round(adj, 6)).withColumn("weighted", F.round(adj * lookup(F.col("category"), CATEGORY_WEIGHTS), 6))


def criteria(d: DataFrame) -> DataFrame:
    """One row: the four criteria (35, 35, 20, 10 points), their total, category part, total and coverage."""
    asked = F.col("signals_total") > 0
    conf = F.avg(lookup(F.col("confidence"), {"high": 1.0, "medium": 0.6, "low": 0.3}))
    a = d.agg(
        F.avg("avg_rel").alias("rel"),
        F.coalesce(F.try_divide(F.sum(F.when(asked, F.col("signals_found"))), F.sum(F.when(asked, F.col("signals_total")))), F.lit(0.0)).alias("sig"),
        conf.alias("conf"),
        F.size(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("n_pages"),
        F.avg("max_rel").alias("best"),
        F.count_if(F.col("answerability") == "fully").alias("full"),
        F.count_if(F.col("answerability") == "partially").alias("part"),
        F.count(F.lit(1)).alias("n"),
        *[F.coalesce(F.avg(F.when(F.col("category") == c, F.col("score"))) * w, F.lit(0.0)).alias(f"c_{c}") for c, w in CATEGORY_WEIGHTS.items()],
    )
    quality = 0.3 * F.least(F.lit(1.0), F.col("n_pages") / 10) + 0.7 * F.col("best")
    points = 35 * F.col("rel") + 35 * F.col("sig") + 20 * F.col("conf") + 10 * quality
    cats = reduce(lambda x, y: x + y, [F.col(f"c_{c}") for c in CATEGORY_WEIGHTS]) * 100
    return a.select(
        F.round(35 * F.col("rel"), 4).alias("relevance"), F.round(35 * F.col("sig"), 4).alias("signals"), F.round(20 * F.col("conf"), 4).alias("confidence"), F.round(10 * quality, 4).alias("sources"),
        F.round(0.7 * points + 0.3 * cats, 4).alias("total"), F.round((F.col("full") + 0.5 * F.col("part")) / F.col("n"), 6).alias("coverage"),
    )


def roll_up(pages: DataFrame, site: str, page: str, pillars: list[str]) -> DataFrame:
    """Site scores: mean over pages with the first page counted twice."""
    first = F.row_number().over(Window.partitionBy(site).orderBy(page)) == 1
    p = pages.withColumn("_w", F.when(first, 2).otherwise(1))
    return p.groupBy(site).agg(*[F.round(F.sum(F.col(x) * F.col("_w")) / F.sum("_w"), 6).alias(x) for x in pillars])


def total_v2(sites: DataFrame, weights: dict[str, int] = PILLARS) -> DataFrame:
    """Points of the evaluated pillars (null: not evaluated), rescaled to 100 if some are missing."""
    points = reduce(lambda a, b: a + b, [F.coalesce(F.col(p) * w / 100, F.lit(0.0)) for p, w in weights.items()])
    there = reduce(lambda a, b: a + b, [F.when(F.col(p).isNotNull(), F.lit(float(w))).otherwise(0.0) for p, w in weights.items()])
    return sites.withColumn("evaluated", there).withColumn("total", F.round(F.coalesce(F.try_divide(points * 100, there), F.lit(0.0)), 4))


def path_forward(fixes: DataFrame, site: str, gap: Column, most: int = 5, least: int = 3) -> DataFrame:
    """fixes (site, fix, impact, gap) by falling impact until the gap is covered and ``least`` are taken; at most ``most``."""
    w = Window.partitionBy(site).orderBy(F.desc("impact"), "fix")
    f = fixes.filter(F.col("impact") > 0).withColumn("step", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("impact").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return f.filter((F.col("step") <= most) & ~((F.col("before") >= gap) & (F.col("step") > least)))
