"""Fixes for questions that a site answers badly: which, why, what to do, and what it would bring.

Input rows are question results: question_id, question, category, weight, chunks, avg_rel, signals_found, signals_total, matches (signal,
found), score, answerability (not, contradictory, partially, fully), confidence (high, medium, low), and the columns of ``by`` (a site, a
run). A fix is a reason with the questions it affects; these stay rows, as one reason may affect any number of them.
Re-scoring reads the affected rows alone: each is scored again as if the fix's text were on the site.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Severity, typical gain and priority of each reason; phrases that its text may add; pages to put it on.
REASONS = {
    "missing_definition": ("critical", 0.3, 1),
    "missing_pricing": ("high", 0.25, 1),
    "missing_contact": ("high", 0.2, 1),
    "missing_location": ("medium", 0.15, 2),
    "missing_features": ("high", 0.2, 1),
    "missing_social_proof": ("medium", 0.15, 2),
    "buried_answer": ("medium", 0.15, 2),
    "fragmented_info": ("medium", 0.1, 3),
    "no_dedicated_page": ("medium", 0.15, 2),
    "poor_headings": ("low", 0.1, 3),
    "not_citable": ("medium", 0.1, 3),
    "vague_language": ("medium", 0.1, 3),
    "outdated_info": ("high", 0.2, 2),
    "inconsistent": ("critical", 0.25, 1),
    "trust_gap": ("medium", 0.15, 2),
    "no_authority": ("medium", 0.1, 3),
    "unverified_claims": ("medium", 0.1, 2),
    "render_required": ("high", 0.2, 1),
    "blocked_by_robots": ("critical", 0.3, 1),
}
PHRASES = {
    "missing_definition": ["company description", "business type", "value proposition", "what we do", "who we are"],
    "missing_pricing": ["pricing", "price", "cost", "plan", "subscription", "free trial", "per month", "per year"],
    "missing_contact": ["email", "phone", "contact", "address", "hours", "get in touch"],
    "missing_location": ["location", "address", "headquarters", "service area", "serving", "located"],
    "missing_features": ["feature", "capability", "functionality", "includes", "supports"],
    "missing_social_proof": ["testimonial", "review", "case study", "customer", "client", "results"],
    "trust_gap": ["certified", "award", "recognition", "featured in", "trusted by"],
}
GENERIC_PHRASES = ["content added", "information provided"]
HARD, MIDDLE = ["render_required", "blocked_by_robots"], ["no_dedicated_page", "missing_social_proof", "no_authority"]
PAGES = {"missing_pricing": "/pricing", "missing_contact": "/contact", "missing_features": "/features", "missing_social_proof": "/testimonials", "no_authority": "/about", "missing_definition": "/about", "missing_location": "/locations"}
CATEGORY_PAGES = {"identity": "/about", "offerings": "/services", "contact": "/contact", "trust": "/testimonials", "differentiation": "/why-us"}
LOW_SCORE, PARTIAL_SCORE = 0.5, 0.7
MAX_FIXES, TOP_FIXES, MAX_PHRASES = 10, 5, 5
BOOST, MAX_RELEVANCE = 0.3, 0.95

#: A first text for each reason, to be replaced by the caller's own.
TEXTS = {
    "missing_definition": "Say in one sentence who we are and what we do, and for whom.",
    "missing_pricing": "A table of every plan with its price per month and per year, and how long the free trial lasts.",
    "missing_contact": "Email, phone and opening hours on one contact page.",
    "missing_location": "Headquarters, other places, and the service area.",
    "missing_features": "A list of each feature with what it includes.",
    "missing_social_proof": "One customer story with results, and a review with a name under it.",
    "trust_gap": "By whom the firm is certified, and each award with its year.",
}


def either(pairs: list[tuple[Column, Column | str]], other: Column | str | None = None) -> Column:
    """The value of the first condition that holds."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = reduce(lambda w, p: w.when(p[0], as_col(p[1])) if w is not None else F.when(p[0], as_col(p[1])), pairs, None)
    return out if other is None else out.otherwise(as_col(other))


def problems(results: DataFrame) -> DataFrame:
    """Questions not answered, contradicted, or answered with too low a score."""
    a, s = F.col("answerability"), F.col("score")
    return results.filter(a.isin("not", "contradictory") | ((a == "partially") & (s < PARTIAL_SCORE)) | ((a == "fully") & (s < LOW_SCORE)))


def diagnosed(results: DataFrame) -> DataFrame:
    """Problems with reasons: the first two that apply."""
    c, text = F.col("category"), F.lower("question")
    empty = F.coalesce(F.col("chunks"), F.lit(0)) == 0
    gap = either([(c == "offerings", "missing_features"), (c == "contact", "missing_contact"), (c == "trust", "missing_social_proof"), (c == "identity", "missing_definition")], "no_dedicated_page")
    share = F.when(F.col("signals_total") > 0, F.col("signals_found") / F.col("signals_total")).otherwise(0.0)
    lacks = either([(F.contains(text, F.lit(w)), f"missing_{w}") for w in ("pricing", "contact", "location")] + [(c == "trust", "trust_gap")], "missing_definition")
    found = F.array_compact(
        F.array(
            F.when(F.col("answerability") == "contradictory", "inconsistent"),
            F.when(empty, gap).when(F.coalesce(F.col("avg_rel"), F.lit(0.0)) < 0.4, "buried_answer"),
            F.when(share < 0.3, lacks).when(share < 0.6, "fragmented_info"),
        )
    )
    last = F.when(F.col("confidence") == "low", F.array(F.lit("vague_language"))).otherwise(F.array(F.lit("buried_answer")))
    return problems(results).withColumn("reasons", F.slice(F.when(F.size(found) > 0, found).otherwise(last), 1, 2))


def affected(results: DataFrame, once: bool = False) -> DataFrame:
    """A row for each problem and reason; a reason that applies to a question twice counts twice, unless ``once``."""
    own = F.array_distinct("reasons") if once else F.col("reasons")
    return diagnosed(results).select("*", F.explode(own).alias("reason")).drop("reasons")


def lookup(key: Column, values: dict) -> Column:
    return either([(key == k, F.lit(v)) for k, v in values.items()])


def plan(rows: DataFrame, by: list[str] | None = None, most: int = MAX_FIXES) -> DataFrame:
    """affected rows -> (by, rank, reason, severity, priority, questions, impact, effort, target_url, categories): the first ``most`` fixes.

    In order of priority, then falling impact, then the first question. Grouped by reason first, so what is ranked is at
    most a row a reason.
    """
    by = by or []
    r = F.col("reason")
    g = rows.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("questions"), F.avg("weight").alias("_w"), F.array_sort(F.collect_set("category")).alias("categories"), F.min("question_id").alias("_first"))
    n = F.col("questions")
    impact = F.least(F.lit(0.5), lookup(r, {k: v[1] for k, v in REASONS.items()}) * F.least(F.lit(1.5), 1 + (n - 1) * 0.1) * F.col("_w"))
    own = F.coalesce(lookup(r, PAGES), *[F.when(F.array_contains("categories", c), F.lit(u)) for c, u in CATEGORY_PAGES.items()])
    g = g.withColumns({"severity": lookup(r, {k: v[0] for k, v in REASONS.items()}), "priority": lookup(r, {k: v[2] for k, v in REASONS.items()}), "impact": F.round(impact, 9), "effort": either([(r.isin(HARD), "high"), (r.isin(MIDDLE) | (n > 3), "medium")], "low"), "target_url": own})
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("priority", F.desc("impact"), "_first", "reason"))
    g = g.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= most)
    return g.select(*by, "rank", "reason", "severity", "priority", "questions", "impact", "effort", "target_url", "categories")


def phrases(reason: str, text: str) -> list[str]:
    """Up to five of the reason's phrases that its text holds; two general ones if there is none."""
    found = [p for p in PHRASES.get(reason, []) if p in text.lower()]
    return (found or GENERIC_PHRASES)[:MAX_PHRASES]


def patched(rows: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """affected rows with new_signals, patched_signals, patched_score, patched_answerability and delta."""
    texts = TEXTS | (texts or {})
    r = F.col("reason")
    added = either([(r == k, F.array(*map(F.lit, phrases(k, texts.get(k, ""))))) for k in REASONS])
    known = F.coalesce(F.transform(F.filter("matches", lambda m: m["found"]), lambda m: F.lower(m["signal"])), F.array().cast("array<string>"))
    new = F.filter(added, lambda s: ~F.array_contains(known, s))
    relevance = F.coalesce(F.col("avg_rel"), F.lit(0.0))
    better = F.least(F.lit(MAX_RELEVANCE), relevance + BOOST)
    signals = F.least(F.col("signals_total"), F.col("signals_found") + F.size(new))
    ratio = F.when(F.col("signals_total") > 0, signals / F.col("signals_total")).otherwise(0.5)
    gains = (better > relevance).cast("int") + (signals > F.col("signals_found")).cast("int")
    confidence = F.least(F.lit(1.0), F.coalesce(lookup(F.col("confidence"), {"high": 1.0, "medium": 0.6, "low": 0.3}), F.lit(0.5)) + gains * 0.15)
    score = F.round(0.4 * better + 0.4 * ratio + 0.2 * confidence, 6)
    out = rows.withColumns({"new_signals": new, "patched_signals": signals, "patched_score": score})
    s = F.col("patched_score")
    return out.withColumns({"patched_answerability": either([(s >= 0.7, "fully"), (s >= 0.3, "partially")], "not"), "delta": F.round(s - F.col("score"), 6)})


def estimates(results: DataFrame, by: list[str] | None = None, top: int = TOP_FIXES, texts: dict[str, str] | None = None) -> DataFrame:
    """(by, rank, reason, questions, improved, least, expected, most, confidence) of the first ``top`` fixes, in points of 100 over all questions; each question once a fix."""
    by = by or []
    all_ = results.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    first = plan(affected(results), by, top).select(*by, "rank", "reason")
    p = patched(affected(results, once=True), texts).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("questions"), F.sum("delta").alias("_d"), F.count_if(F.col("delta") > 0.01).alias("improved"), F.count_if(F.col("delta") > 0.05).alias("_much"))
    x = p.join(F.broadcast(first), [*by, "reason"]) if not by else p.join(first, [*by, "reason"])
    x = x.join(all_, by) if by else x.join(F.broadcast(all_))
    points = F.col("_d") / F.col("_all") * 100
    level = either([(F.col("_much") > 0.7 * F.col("questions"), "high"), (F.col("_much") > 0.3 * F.col("questions"), "medium")], "low")
    band = lambda f: F.round(F.greatest(F.lit(0.0), points * f), 6)
    return x.select(*by, "rank", "reason", "questions", "improved", band(0.8).alias("least"), band(1.0).alias("expected"), F.round(points * 1.2, 6).alias("most"), level.alias("confidence"))


def totals(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sums of estimates; confidence is high where most are, low where there is none."""
    by = by or []
    high = F.count_if(F.col("confidence") == "high")
    level = F.when(F.count(F.lit(1)) == 0, "low").when(high > F.count(F.lit(1)) / 2, "high").otherwise("medium")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("fixes"), *[F.round(F.coalesce(F.sum(c), F.lit(0.0)), 6).alias(c) for c in ("least", "expected", "most")], level.alias("confidence"))


# Other sources' fixes in the same terms


def effort_level(effort: Column) -> Column:
    """low, medium or high of a level or a description such as "2-4 hours"; medium where neither is known."""
    e = F.lower(F.coalesce(effort, F.lit("")))
    hours = F.try_to_number(F.regexp_extract(e, r"(\d+)", 1), F.lit("9999999999"))
    by_hours = F.when(hours <= 1, "low").when(hours <= 4, "medium").when(hours.isNotNull(), "high").otherwise("medium")
    return F.when(e.isin("low", "medium", "high"), e).when(F.contains(e, F.lit("minute")), "low").when(F.contains(e, F.lit("hour")), by_hours).when(F.contains(e, F.lit("day")) | F.contains(e, F.lit("week")), "high").otherwise("medium")


def priority_number(priority: Column) -> Column:
    """1 to 4 of critical, high, medium or low; a number as it is; 3 where neither is known."""
    p = F.lower(F.coalesce(priority.cast("string"), F.lit("")))
    return F.coalesce(lookup(p, {"critical": 1, "high": 2, "medium": 3, "low": 4}), p.try_cast("int"), F.lit(3))


def impact_level(priority: Column) -> Column:
    return F.when(priority == 1, "critical").when(priority == 2, "high").when(priority == 3, "medium").otherwise("low")
