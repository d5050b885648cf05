"""Fix queries over the simulated benchmark questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fixes as X
from .base import query
from .scoring import CAT_SQL, CATS, CTX, results

_GAP = "CASE category WHEN 'offerings' THEN 'missing_features' WHEN 'contact' THEN 'missing_contact' WHEN 'trust' THEN 'missing_social_proof' WHEN 'identity' THEN 'missing_definition' ELSE 'no_dedicated_page' END"
_LACKS = "CASE WHEN contains(lower(question), 'pricing') THEN 'missing_pricing' WHEN contains(lower(question), 'contact') THEN 'missing_contact' WHEN contains(lower(question), 'location') THEN 'missing_location' WHEN category = 'trust' THEN 'trust_gap' ELSE 'missing_definition' END"


def _case(key: str, values: dict) -> str:
    q = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in values.items()) + " END"


def _phrases() -> str:
    return "CASE reason " + " ".join(f"WHEN '{k}' THEN {X.phrases(k, X.TEXTS.get(k, ''))}" for k in X.REASONS) + " END"


FIXES = f"""{CTX},
rs AS (SELECT b.item_id AS question_id, coalesce(b.text, '') AS question, {CAT_SQL.replace('item_id', 'b.item_id')} AS category, 1.0::DOUBLE AS weight, coalesce(q.chunks, 0) AS chunks, coalesce(q.avg_rel, 0) AS avg_rel, coalesce(q.signals_found, 0) AS signals_found,
  coalesce(q.signals_total, 0) AS signals_total, coalesce(q.score, 0) AS score, coalesce(q.answerability, 'not') AS answerability, coalesce(q.confidence, 'high') AS confidence FROM benchmark b LEFT JOIN qr q USING (item_id)),
pr AS (SELECT *, CASE WHEN signals_total > 0 THEN signals_found / signals_total ELSE 0 END AS share FROM rs WHERE answerability IN ('not', 'contradictory') OR (answerability = 'partially' AND score < {X.PARTIAL_SCORE}) OR (answerability = 'fully' AND score < {X.LOW_SCORE})),
di AS (SELECT *, list_filter([CASE WHEN answerability = 'contradictory' THEN 'inconsistent' END, CASE WHEN chunks = 0 THEN {_GAP} WHEN avg_rel < 0.4 THEN 'buried_answer' END, CASE WHEN share < 0.3 THEN {_LACKS} WHEN share < 0.6 THEN 'fragmented_info' END], lambda x: x IS NOT NULL) AS found FROM pr),
dg AS (SELECT * EXCLUDE (found), CASE WHEN len(found) > 0 THEN found[:2] WHEN confidence = 'low' THEN ['vague_language'] ELSE ['buried_answer'] END AS reasons FROM di),
af AS (SELECT * EXCLUDE (reasons), unnest(reasons) AS reason FROM dg), ao AS (SELECT DISTINCT * FROM af),
gr AS (SELECT reason, count(*) AS questions, avg(weight) AS w, min(question_id) AS first, list_distinct(list(category)) AS cats FROM af GROUP BY reason),
fx AS (SELECT *, {_case('reason', {k: v[0] for k, v in X.REASONS.items()})} AS severity, {_case('reason', {k: v[2] for k, v in X.REASONS.items()})} AS priority, round(least(0.5, {_case('reason', {k: v[1] for k, v in X.REASONS.items()})}::DOUBLE * least(1.5, 1 + (questions - 1) * 0.1) * w), 9) AS impact FROM gr),
pl AS (SELECT *, row_number() OVER (ORDER BY priority, impact DESC, first, reason) AS rank FROM fx),
pt AS (SELECT *, (SELECT count(*) FROM (SELECT unnest({_phrases()}) AS s) WHERE NOT EXISTS (SELECT 1 FROM sg WHERE sg.item_id = question_id AND sg.found AND lower(sg.signal) = s)) AS added, least({X.MAX_RELEVANCE}, avg_rel + {X.BOOST})::DOUBLE AS better FROM ao),
ps AS (SELECT *, least(signals_total, signals_found + added) AS patched_signals FROM pt),
pp AS (SELECT *, round(0.4 * better + 0.4 * CASE WHEN signals_total > 0 THEN patched_signals / signals_total ELSE 0.5 END + 0.2 * least(1.0, {_case('confidence', {'high': 1.0, 'medium': 0.6, 'low': 0.3})}::DOUBLE + ((better > avg_rel)::INT + (patched_signals > signals_found)::INT) * 0.15), 6) AS patched_score FROM ps)"""


def questions(t):
    """Results of every benchmark item, those without any hit too."""
    b = t("benchmark").select(F.col("item_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("question"), F.element_at(F.array(*map(F.lit, CATS)), (F.col("item_id") % 5 + 1).cast("int")).alias("category"), F.lit(1.0).alias("weight"))
    r = results(t).select(F.col("item_id").alias("question_id"), "chunks", "avg_rel", "signals_found", "signals_total", "matches", "score", "answerability", "confidence")
    return b.join(r, "question_id", "left").fillna({"chunks": 0, "avg_rel": 0.0, "signals_found": 0, "signals_total": 0, "score": 0.0, "answerability": "not", "confidence": "high"})


@query("question_problems", f"WITH {FIXES} SELECT question_id, answerability, array_to_string(reasons, ',') AS reasons FROM dg")
def question_problems(t):
    """Questions to mend, each with its one or two reasons."""
    return X.diagnosed(questions(t)).select("question_id", "answerability", F.array_join("reasons", ",").alias("reasons"))


@query("fix_plan", f"""WITH {FIXES} SELECT rank, reason, severity, priority::BIGINT AS priority, questions, impact, CASE WHEN reason IN {tuple(X.HARD)} THEN 'high' WHEN reason IN {tuple(X.MIDDLE)} OR questions > 3 THEN 'medium' ELSE 'low' END AS effort,
coalesce({_case('reason', X.PAGES)}, {", ".join(f"CASE WHEN list_contains(cats, '{c}') THEN '{u}' END" for c, u in X.CATEGORY_PAGES.items())}) AS target_url FROM pl WHERE rank <= {X.MAX_FIXES}""")
def fix_plan(t):
    """Fixes by reason, in order."""
    return X.plan(X.affected(questions(t))).drop("categories").withColumn("priority", F.col("priority").cast("bigint"))


@query("patched_questions", f"""WITH {FIXES} SELECT question_id, reason, round(score, 6) AS score, patched_score, round(patched_score - score, 6) AS delta, patched_signals::BIGINT AS patched_signals,
CASE WHEN patched_score >= 0.7 THEN 'fully' WHEN patched_score >= 0.3 THEN 'partially' ELSE 'not' END AS patched_answerability FROM pp""")
def patched_questions(t):
    """Each affected question scored again as if the fix were made."""
    return X.patched(X.affected(questions(t), once=True)).select("question_id", "reason", "score", "patched_score", "delta", F.col("patched_signals").cast("bigint").alias("patched_signals"), "patched_answerability")


@query("patched_plan", f"""WITH {FIXES}, es AS (SELECT reason, count(*) AS questions, sum(round(patched_score - score, 6)) / (SELECT count(*) FROM benchmark) * 100 AS points, count(*) FILTER (WHERE round(patched_score - score, 6) > 0.01) AS improved, count(*) FILTER (WHERE round(patched_score - score, 6) > 0.05) AS much FROM pp GROUP BY reason)
SELECT rank, reason, es.questions, improved, round(greatest(0, points * 0.8), 6) AS least, round(greatest(0, points), 6) AS expected, round(points * 1.2, 6) AS most, CASE WHEN much > 0.7 * es.questions THEN 'high' WHEN much > 0.3 * es.questions THEN 'medium' ELSE 'low' END AS confidence
FROM es JOIN pl USING (reason) WHERE rank <= {X.TOP_FIXES}""")
def patched_plan(t):
    """What the first five fixes would bring, from their re-scored questions, with a band of a fifth either way."""
    return X.estimates(questions(t))
