"""Problem filter, reasons, fixes and re-scoring on hand-written question results against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from wellspring.operators import fixes as X

DDL = "site string, question_id int, question string, category string, weight double, chunks int, avg_rel double, signals_found int, signals_total int, matches array<struct<signal:string,found:boolean>>, score double, answerability string, confidence string"
M = lambda *names: [(n, True) for n in names] + [("other", False)]
ROWS = [
    ("a", 1, "What is the pricing?", "offerings", 1.0, 0, 0.0, 0, 3, [], 0.0, "not", "high"),
    ("a", 2, "How to contact them?", "contact", 1.2, 3, 0.3, 1, 3, M("Email"), 0.35, "partially", "medium"),
    ("a", 3, "Who are they?", "identity", 1.0, 5, 0.8, 3, 3, M("x", "y", "z"), 0.9, "fully", "high"),
    ("a", 4, "Who are they?", "identity", 1.0, 5, 0.8, 2, 3, M("x", "y"), 0.45, "fully", "low"),
    ("a", 5, "Any awards?", "trust", 0.8, 2, 0.6, 0, 4, [("award", False)], 0.4, "partially", "low"),
    ("a", 6, "Odd?", "trust", 1.0, 2, 0.6, 3, 4, M("p"), 0.8, "contradictory", "low"),
    ("a", 7, "Why them?", "differentiation", 1.0, None, None, 0, 0, None, 0.0, "not", "low"),
    ("a", 8, "Fine?", "trust", 1.0, 2, 0.7, 3, 4, M("p"), 0.69, "partially", "low"),
    ("a", 9, "Good?", "trust", 1.0, 2, 0.7, 3, 4, M("p"), 0.7, "partially", "low"),
    ("b", 10, "Where is the LOCATION?", "contact", 1.0, 4, 0.9, 0, 2, None, 0.2, "not", "medium"),
]


def plain_reasons(r):
    _, _, text, cat, _, chunks, rel, found, total, _, score, ans, conf = r
    if not (ans in ("not", "contradictory") or (ans == "partially" and score < 0.7) or (ans == "fully" and score < 0.5)):
        return None
    out = ["inconsistent"] if ans == "contradictory" else []
    if not chunks:
        out.append({"offerings": "missing_features", "contact": "missing_contact", "trust": "missing_social_proof", "identity": "missing_definition"}.get(cat, "no_dedicated_page"))
    elif rel < 0.4:
        out.append("buried_answer")
    share = found / total if total else 0
    if share < 0.3:
        t = text.lower()
        out.append(next((f"missing_{w}" for w in ("pricing", "contact", "location") if w in t), "trust_gap" if cat == "trust" else "missing_definition"))
    elif share < 0.6:
        out.append("fragmented_info")
    return (out or (["vague_language"] if conf == "low" else ["buried_answer"]))[:2]


def plain_patch(r, reason):
    _, _, _, _, _, _, rel, found, total, matches, score, _, conf = r
    rel = rel or 0.0
    better = min(0.95, rel + 0.3)
    new = [s for s in X.phrases(reason, X.TEXTS.get(reason, "")) if not any(f and m.lower() == s for m, f in matches or [])]
    signals = min(total, found + len(new))
    c = min(1.0, {"high": 1.0, "medium": 0.6, "low": 0.3}[conf] + 0.15 * ((better > rel) + (signals > found)))
    s = 0.4 * better + 0.4 * (signals / total if total else 0.5) + 0.2 * c
    return signals, s, s - score


def rows_of(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        total = r.randint(0, 5)
        found = r.randint(0, total)
        out.append((r.choice("ab"), i, r.choice(["pricing", "a contact", "the location", "other"]), r.choice([*X.CATEGORY_PAGES, "odd"]), r.choice([0.5, 1.0, 2.0]), r.choice([0, 1, 5]), r.random(), found, total, [(s, r.random() < 0.5) for s in ("Price", "email", "award")], r.random(), r.choice(["not", "contradictory", "partially", "fully"]), r.choice(["high", "medium", "low"])))
    return out


@pytest.mark.parametrize("rows", [ROWS, rows_of(150, 1)])
def test_reasons(spark, rows):
    got = {r.question_id: r.reasons for r in X.diagnosed(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {r[1]: plain_reasons(r) for r in rows if plain_reasons(r)}


def test_reasons_by_hand(spark):
    got = {r.question_id: r.reasons for r in X.diagnosed(spark.createDataFrame(ROWS, DDL)).collect()}
    assert got == {1: ["missing_features", "missing_pricing"], 2: ["buried_answer", "fragmented_info"], 4: ["vague_language"], 5: ["trust_gap"], 6: ["inconsistent"], 7: ["no_dedicated_page", "missing_definition"], 8: ["vague_language"], 10: ["missing_location"]}


@pytest.mark.parametrize("rows", [ROWS, rows_of(150, 2)])
def test_plan(spark, rows):
    got = X.plan(X.affected(spark.createDataFrame(rows, DDL)), ["site"]).orderBy("site", "rank").collect()
    for site in {r[0] for r in rows}:
        by = {}
        for r in sorted((r for r in rows if r[0] == site), key=lambda r: r[1]):
            for reason in plain_reasons(r) or []:
                by.setdefault(reason, []).append(r)
        fixes = []
        for reason, own in by.items():
            _, typical, priority = X.REASONS[reason]
            impact = min(0.5, typical * min(1.5, 1 + 0.1 * (len(own) - 1)) * sum(r[4] for r in own) / len(own))
            effort = "high" if reason in X.HARD else "medium" if reason in X.MIDDLE or len(own) > 3 else "low"
            url = X.PAGES.get(reason) or next((u for c, u in X.CATEGORY_PAGES.items() if any(r[3] == c for r in own)), None)
            fixes.append((priority, -round(impact, 9), own[0][1], reason, len(own), effort, url))
        mine = [g for g in got if g.site == site]
        assert [(g.priority, -g.impact, g.reason, g.questions, g.effort, g.target_url) for g in mine] == [(f[0], pytest.approx(f[1]), *f[3:]) for f in sorted(fixes)[:10]]
        assert [g.rank for g in mine] == list(range(1, len(mine) + 1))


def test_rescoring_affected_rows_equals_a_full_run(spark):
    rows = rows_of(150, 3)
    df = spark.createDataFrame(rows, DDL)
    got = {(r.question_id, r.reason): r for r in X.patched(X.affected(df, once=True)).collect()}
    want = {(r[1], reason): plain_patch(r, reason) for r in rows for reason in plain_reasons(r) or []}
    assert set(got) == set(want)
    for k, (signals, score, delta) in want.items():
        assert got[k].patched_signals == signals and got[k].patched_score == pytest.approx(score, abs=1e-6) and got[k].delta == pytest.approx(delta, abs=2e-6)
        assert got[k].patched_answerability == ("fully" if got[k].patched_score >= 0.7 else "partially" if got[k].patched_score >= 0.3 else "not")
    est = {(r.site, r.reason): r for r in X.estimates(df, ["site"]).collect()}
    for site in "ab":
        n = sum(r[0] == site for r in rows)
        top = [r.reason for r in X.plan(X.affected(df), ["site"], 5).filter(F.col("site") == site).collect()]
        assert {k[1] for k in est if k[0] == site} == set(top)
        for reason in top:
            d = [v[2] for (q, why), v in want.items() if why == reason and rows[q][0] == site]
            e = est[site, reason]
            points = sum(d) / n * 100
            assert (e.questions, e.improved) == (len(d), sum(x > 0.01 for x in d))
            assert (e.least, e.expected, e.most) == pytest.approx((max(0, points * 0.8), max(0, points), points * 1.2), abs=1e-3)
            much = sum(x > 0.05 for x in d)
            assert e.confidence == ("high" if much > len(d) * 0.7 else "medium" if much > len(d) * 0.3 else "low")
    t = X.totals(X.estimates(df, ["site"]), ["site"]).collect()
    assert all(r.fixes == 5 and r.least <= r.expected <= r.most for r in t)


def test_phrases_and_empty(spark):
    assert X.phrases("missing_pricing", "PRICING: cost, plan, subscription, price per month") == ["pricing", "price", "cost", "plan", "subscription"]
    assert X.phrases("buried_answer", "price") == X.phrases("missing_pricing", "nothing") == X.GENERIC_PHRASES
    none = spark.createDataFrame([], DDL)
    assert X.plan(X.affected(none), ["site"]).count() == X.estimates(none, ["site"]).count() == 0
    assert X.totals(X.estimates(none)).first().confidence == "low"


def test_terms_of_other_sources(spark):
    efforts = {"Low": "low", "HIGH": "high", "5 minutes": "low", "1 hour": "low", "2-4 hours": "medium", "8 hours": "high", "some hours": "medium", "2 days": "high", "a week": "high", "unknown": "medium", None: "medium"}
    df = spark.createDataFrame([(k,) for k in efforts], "e string")
    assert {r.e: r.x for r in df.select("e", X.effort_level(F.col("e")).alias("x")).collect()} == efforts
    priorities = {"critical": 1, "High": 2, "medium": 3, "low": 4, "2": 2, "odd": 3, None: 3}
    df = spark.createDataFrame([(k,) for k in priorities], "p string")
    got = {r.p: (r.n, r.i) for r in df.select("p", X.priority_number(F.col("p")).alias("n")).withColumn("i", X.impact_level(F.col("n"))).collect()}
    assert {k: n for k, (n, _) in got.items()} == priorities and got["critical"][1] == "critical" and got["low"][1] == "low"
