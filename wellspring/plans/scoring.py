"""Simulation and scoring queries: benchmark items are the questions, documents the corpus, source the site."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as X
from ..operators import retrieval as R
from ..operators import scoring as G
from .base import query
from .retrieval import bm25_sql

CATS = list(G.CATEGORY_WEIGHTS)
CAT_SQL = "CASE item_id % 5 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CATS)) + " END"
DIF_SQL = "CASE item_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END"


def _conf_sql(s: str) -> str:
    words = [w for w in s.split() if len(w) > 3]
    exact = " OR ".join([f"contains(lower(preview), '{s}')"] + [f"regexp_matches(preview, '{p}')" for p in S.keys_of(s)])
    share = "(" + " + ".join(f"CAST(contains(lower(preview), '{w}') AS INT)" for w in words) + f") / {len(words)}.0"
    return f"CASE WHEN {exact} THEN 1.0 ELSE {share} END"


SIG_SQL = " UNION ALL ".join(f"SELECT item_id, category, difficulty, '{s}' AS signal, CAST({_conf_sql(s)} AS DOUBLE) AS confidence FROM ctx WHERE category = '{c}'" for c, names in G.SIGNALS.items() for s in names)
CTX = f"""{bm25_sql(k=5)},
hx AS (SELECT item_id, rank, least(0.5 / (60 + rank) / 0.02, 1.0) AS rel, substr(text, 1, 2000) AS tx, source FROM hits JOIN documents USING (doc_id)),
ctx AS (SELECT item_id, {CAT_SQL} AS category, {DIF_SQL} AS difficulty, count(*) AS chunks, avg(rel) AS avg_rel, max(rel) AS max_rel, list_sort(list_distinct(list(source))) AS pages,
  substr(string_agg(tx, chr(10) || chr(10) ORDER BY rank), 1, 2000) AS preview FROM hx GROUP BY item_id),
sg AS (SELECT *, confidence >= 0.6 AS found FROM ({SIG_SQL})),
sa AS (SELECT item_id, count(*) FILTER (WHERE found) AS signals_found, count(*) AS signals_total, coalesce(avg(confidence) FILTER (WHERE found), 0) AS signal_confidence FROM sg GROUP BY item_id),
q0 AS (SELECT *, signals_found / signals_total AS signal_score FROM ctx JOIN sa USING (item_id)),
q1 AS (SELECT *, round(0.4 * avg_rel + 0.4 * signal_score + 0.2 * signal_confidence, 6) AS score FROM q0),
qr AS (SELECT *, CASE WHEN score >= 0.7 THEN 'fully' WHEN score >= 0.3 THEN 'partially' ELSE 'not' END AS answerability,
  CASE WHEN max_rel >= 0.7 AND signal_score >= 0.7 THEN 'high' WHEN max_rel >= 0.4 OR signal_score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM q1)"""


def results(t, k: int = 5):
    """One row a question: context, signal matches, score."""
    d = t("documents")
    ctx = G.contexts(R.bm25(d, t("benchmark"), k=k), d.select("doc_id", "text", F.col("source").alias("page")))
    ctx = ctx.withColumn("category", F.element_at(F.array(*map(F.lit, CATS)), (F.col("item_id") % 5 + 1).cast("int")))
    ctx = ctx.withColumn("difficulty", F.element_at(F.array(*map(F.lit, G.DIFFICULTY)), (F.col("item_id") % 3 + 1).cast("int")))
    return G.answerability(G.match_signals(ctx))


@query("signal_match", f"WITH {CTX} SELECT item_id, signal, found, round(confidence, 6) AS confidence FROM sg")
def signal_match(t):
    m = results(t).select("item_id", F.explode("matches").alias("m"))
    return m.select("item_id", "m.signal", "m.found", F.round("m.confidence", 6).alias("confidence"))


@query("simulate_questions", f"WITH {CTX} SELECT item_id, category, difficulty, chunks, round(avg_rel, 6) AS avg_rel, round(max_rel, 6) AS max_rel, signals_found, signals_total, score, answerability, confidence FROM qr")
def simulate_questions(t):
    r = results(t)
    return r.select("item_id", "category", "difficulty", "chunks", F.round("avg_rel", 6).alias("avg_rel"), F.round("max_rel", 6).alias("max_rel"), F.col("signals_found").cast("bigint").alias("signals_found"), F.col("signals_total").cast("bigint").alias("signals_total"), "score", "answerability", "confidence")


@query("category_difficulty_scores", f"WITH {CTX} SELECT category, difficulty, round(100 * avg(score), 4) AS mean_score, count(*) AS n FROM qr GROUP BY GROUPING SETS ((category), (difficulty), ())")
def category_difficulty_scores(t):
    """Category, difficulty and overall means in one pass of grouping sets."""
    return results(t).groupingSets([["category"], ["difficulty"], []], "category", "difficulty").agg(F.round(100 * F.avg("score"), 4).alias("mean_score"), F.count(F.lit(1)).alias("n"))


@query("coverage_summary", f"""WITH {CTX} SELECT round(100 * sum(score * w) / sum(w), 4) AS overall, round(100 * (count(*) FILTER (WHERE answerability = 'fully') + 0.5 * count(*) FILTER (WHERE answerability = 'partially')) / count(*), 4) AS coverage,
  round(avg(CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END), 4) AS confidence,
  round(avg(CASE WHEN category IN ('identity', 'contact', 'trust') THEN CAST(answerability <> 'not' AS INT) END), 4) AS entity_coverage,
  round(avg(CASE WHEN category NOT IN ('identity', 'contact', 'trust') THEN CAST(answerability <> 'not' AS INT) END), 4) AS product_coverage
FROM (SELECT *, CASE difficulty WHEN 'easy' THEN 1.0 WHEN 'medium' THEN 1.2 ELSE 1.5 END AS w FROM qr)""")
def coverage_summary(t):
    r = results(t).withColumn("w", G.lookup(F.col("difficulty"), G.DIFFICULTY))
    some = (F.col("answerability") != "not").cast("int")
    entity = F.col("category").isin("identity", "contact", "trust")
    return r.agg(
        F.round(100 * F.sum(F.col("score") * F.col("w")) / F.sum("w"), 4).alias("overall"),
        F.round(100 * (F.count_if(F.col("answerability") == "fully") + 0.5 * F.count_if(F.col("answerability") == "partially")) / F.count(F.lit(1)), 4).alias("coverage"),
        F.round(F.avg(G.lookup(F.col("confidence"), {"high": 1.0, "medium": 0.6, "low": 0.3})), 4).alias("confidence"),
        F.round(F.avg(F.when(entity, some)), 4).alias("entity_coverage"),
        F.round(F.avg(F.when(~entity, some)), 4).alias("product_coverage"),
    )


@query("signal_frequency", f"WITH {CTX}, c AS (SELECT signal, found, count(*) AS n FROM sg GROUP BY ALL) SELECT signal, found, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY found ORDER BY n DESC, signal) AS rank FROM c) WHERE rank <= 5")
def signal_frequency(t):
    c = results(t).select(F.explode("matches").alias("m")).groupBy("m.signal", "m.found").agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("found").orderBy(F.desc("n"), "signal"))
    return c.withColumn("rank", r.cast("bigint")).filter("rank <= 5")


@query("gap_analysis", f"WITH {CTX}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score, item_id) AS rank, avg(score) OVER (PARTITION BY category) AS mean FROM qr) SELECT category, item_id, score, rank, mean < 0.5 AS weak FROM r WHERE rank <= 3 AND score < 0.5")
def gap_analysis(t):
    w = Window.partitionBy("category")
    r = results(t).withColumn("rank", F.row_number().over(w.orderBy("score", "item_id")).cast("bigint")).withColumn("weak", F.avg("score").over(w) < 0.5)
    return r.filter("rank <= 3 AND score < 0.5").select("category", "item_id", "score", "rank", "weak")


@query("compare_runs", f"""WITH {CTX}, two AS (SELECT item_id, category, score, round(0.4 * max_rel + 0.4 * signal_score, 6) AS prev FROM qr)
SELECT category, count(*) AS n, count(*) FILTER (WHERE score > prev) AS improved, count(*) FILTER (WHERE score < prev) AS regressed, round(100 * (avg(score) - avg(prev)), 4) AS delta FROM two GROUP BY category""")
def compare_runs(t):
    """The run against one scored without signal confidence and by best relevance."""
    r = results(t)
    prev = r.select("item_id", F.round(0.4 * F.col("max_rel") + 0.4 * F.col("signal_score"), 6).alias("prev"))
    j = r.join(prev, "item_id")
    return j.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > F.col("prev")).alias("improved"), F.count_if(F.col("score") < F.col("prev")).alias("regressed"), F.round(100 * (F.avg("score") - F.avg("prev")), 4).alias("delta"))


_W = "CASE category WHEN 'identity' THEN 0.25 WHEN 'offerings' THEN 0.30 ELSE 0.15 END"
_ADJ = "least(1.0, (0.4 * avg_rel + 0.4 * signal_score + 0.2 * signal_confidence) * CASE difficulty WHEN 'easy' THEN 1.0 WHEN 'medium' THEN 1.2 ELSE 1.5 END)"


@query("question_scores", f"WITH {CTX} SELECT item_id, CAST(round({_ADJ}, 6) AS DOUBLE) AS adjusted, CAST(round({_ADJ} * {_W}, 6) AS DOUBLE) AS weighted FROM qr")
def question_scores(t):
    return G.question_points(results(t)).select("item_id", "adjusted", "weighted")


@query("criterion_scores", f"""WITH {CTX}, a AS (SELECT avg(avg_rel) AS rel, sum(signals_found) / sum(signals_total) AS sig, avg(CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 ELSE 0.3 END) AS conf, len(list_distinct(flatten(list(pages)))) AS np, avg(max_rel) AS best,
  count(*) FILTER (WHERE answerability = 'fully') AS f, count(*) FILTER (WHERE answerability = 'partially') AS p, count(*) AS n FROM qr),
c AS (SELECT sum(m * w) AS cats FROM (SELECT avg(score) AS m, {_W} AS w FROM qr GROUP BY category)),
z AS (SELECT *, 0.3 * least(1.0, np / 10) + 0.7 * best AS q FROM a, c)
SELECT round(35 * rel, 4) AS relevance, round(35 * sig, 4) AS signals, round(20 * conf, 4) AS confidence, round(10 * q, 4) AS sources, round(0.7 * (35 * rel + 35 * sig + 20 * conf + 10 * q) + 0.3 * 100 * cats, 4) AS total, round((f + 0.5 * p) / n, 6) AS coverage FROM z""")
def criterion_scores(t):
    return G.criteria(results(t))


# Site pillars: per-page raw scores derived from the id, null where a pillar was not evaluated.
PRIMES = dict(zip(G.PILLARS, (7, 11, 13, 17, 19, 23, 29)))
RAW_SQL = ", ".join(f"CASE WHEN source = 'src{i}' THEN NULL ELSE (doc_id * {p}) % 101 END AS {k}" for i, (k, p) in enumerate(PRIMES.items()))
SITE_SQL = f"pg AS (SELECT source AS site, doc_id, {RAW_SQL} FROM documents), pw AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY site ORDER BY doc_id) = 1 THEN 2 ELSE 1 END AS w FROM pg), si AS (SELECT site, {', '.join(f'round(sum({k} * w) / sum(w), 6) AS {k}' for k in PRIMES)} FROM pw GROUP BY site)"
V2_SQL = f"{SITE_SQL}, v2 AS (SELECT *, {' + '.join(f'CASE WHEN {k} IS NULL THEN 0 ELSE {w} END' for k, w in G.PILLARS.items())} AS evaluated, {' + '.join(f'coalesce({k} * {w} / 100, 0)' for k, w in G.PILLARS.items())} AS points FROM si), tot AS (SELECT *, round(points * 100 / evaluated, 4) AS total FROM v2)"
_GRADE = "CASE " + " ".join(f"WHEN total >= {n} THEN '{g}'" for n, g in X.GRADES) + " ELSE 'F' END"
_LEVEL = "CASE " + " ".join(f"WHEN total >= {n} THEN '{g}'" for n, g in X.LEVELS) + " ELSE 'low' END"


def sites(t):
    d = t("documents").select(F.col("source").alias("site"), "doc_id", *[F.when(F.col("source") == f"src{i}", None).otherwise((F.col("doc_id") * p) % 101).alias(k) for i, (k, p) in enumerate(PRIMES.items())])
    return G.total_v2(G.roll_up(d, "site", "doc_id", list(PRIMES)))


@query("pillar_rollup", f"WITH {SITE_SQL} SELECT * FROM si")
def pillar_rollup(t):
    return sites(t).select("site", *PRIMES)


@query("score_v2", f"WITH {V2_SQL} SELECT site, CAST(evaluated AS DOUBLE) AS evaluated, total, {_GRADE} AS grade FROM tot")
def score_v2(t):
    return sites(t).select("site", "evaluated", "total", X.letter_grade(F.col("total")).alias("grade"))


@query("milestones", f"WITH {V2_SQL} SELECT site, total, {_LEVEL} AS level, CASE WHEN total < 40 THEN 40 WHEN total < 55 THEN 55 WHEN total < 70 THEN 70 WHEN total < 85 THEN 85 END AS milestone FROM tot")
def milestones(t):
    return sites(t).select("site", "total", X.level(F.col("total")).alias("level"), X.next_milestone(F.col("total")).alias("milestone"))


FIX_SQL = " UNION ALL ".join(f"SELECT site, total, '{k}' AS fix, round((100 - {k}) * {w} / 100, 4) AS impact FROM tot WHERE {k} < 60" for k, w in G.PILLARS.items())


@query("path_forward", f"WITH {V2_SQL}, fx AS ({FIX_SQL}), st AS (SELECT *, row_number() OVER w AS step, coalesce(sum(impact) OVER (PARTITION BY site ORDER BY impact DESC, fix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fx WHERE impact > 0 WINDOW w AS (PARTITION BY site ORDER BY impact DESC, fix)) SELECT site, fix, impact, step FROM st WHERE step <= 5 AND NOT (before >= 70 - total AND step > 3)")
def path_forward(t):
    s = sites(t)
    fixes = s.select("site", "total", F.explode(F.array(*[F.struct(F.lit(k).alias("fix"), F.when(F.col(k) < 60, F.round((100 - F.col(k)) * w / 100, 4)).alias("impact")) for k, w in G.PILLARS.items()])).alias("f")).select("site", "total", "f.fix", "f.impact").filter("impact IS NOT NULL")
    return G.path_forward(fixes, "site", 70 - F.col("total")).select("site", "fix", "impact", F.col("step").cast("bigint").alias("step"))
