"""Hand-made pages for the measures that the driver's pages leave at zero."""

from pyspark.sql import functions as F

from wellspring.functions import schema as S

GOOD = """<html><head><script type="application/ld+json">{"@graph":[{"@type":"Article","headline":"h","author":"a","datePublished":"2024-01-01","image":"i"},{"@type":"FAQPage","mainEntity":[{"q":1},{"q":2},{"q":3}]}]}</script>
<script type="application/ld+json">{bad</script></head><body><p>By Anna Schmidt, PhD. We tested 40 sites.</p>
<img src="a" alt="A red panda asleep"><img src="b" alt=""><img src="c"><img src="d" alt="img"><a href="https://www.nature.com/x">n</a><a href="https://blog.org/">b</a></body></html>"""


def pages(spark):
    return spark.createDataFrame([(1, GOOD), (2, "<p>plain</p>"), (3, None)], "page_id bigint, html string")


def test_instances_and_completeness(spark):
    x = S.instances(pages(spark)).withColumn("c", S.completeness(F.col("type"), F.col("json"))).withColumn("n", S.faq_pairs(F.col("json"))).collect()
    assert {(r.type, round(r.c, 4), r.n) for r in x} == {("Article", 77.5, 0), ("FAQPage", 85.0, 0)}  # pairs need a name
    assert spark.range(1).select(S.faq_points(F.lit(True), F.lit(3))).first()[0] == 80.0
    assert [spark.range(1).select(S.freshness(F.lit(d).cast("int"))).first()[0] for d in (None, 10, 30, 100, 400)] == ["unknown", "fresh", "recent", "stale", "very_stale"]


Q = [{"@type": "Question", "name": f"q{i}", "acceptedAnswer": {"text": "a"}} for i in range(5)]
LD = {
    1: [{"@type": ["BlogPosting", "Article"], "headline": "h", "author": {"name": "Ann", "jobTitle": "Editor"}, "datePublished": "2024-01-01", "dateModified": "2024-05-20T08:00:00+02:00"}, {"@type": "FAQPage", "mainEntity": Q}, {"@type": "Organization", "name": "O", "url": "u"}],
    2: [{"@type": "Article", "headline": " ", "author": [], "datePublished": "2024-01-01"}, {"@type": "FAQPage", "mainEntity": {"name": "one"}}],
    3: [{"@type": "NewsArticle", "author": ["Bo", "Cy"], "dateModified": "soon"}, {"@type": "Thing", "a": 1}, {"noType": 1}],
    4: [{"@type": "HowTo", "name": "n", "step": [1], "dateModified": "2023-11-30"}, {"@type": "LocalBusiness", "dateModified": "2024-02-20T00:00:00.123Z"}, {"@type": "FAQPage", "mainEntity": []}],
    5: [{"@type": "Person", "name": "", "dateModified": {"@value": "2024-04-01"}, "author": {"name": None}}, {"@type": "Article", "author": "Di"}],
    6: [{"@type": "Product", "name": "p"}] * 8,
}


def plain_pillar(objects, now):
    """Parts and total from the objects of a page."""
    import datetime as dt
    import re

    has = lambda d, f: d.get(f) is not None and d.get(f) != [] and not (isinstance(d[f], str) and not d[f].strip())
    kinds, pairs, author, modified, published, days, errors = [], 0, None, False, False, None, 0
    for d in objects:
        k = d.get("@type")
        k = k[0] if isinstance(k, list) else k
        if not k:
            continue
        kinds.append(k)
        errors += sum(not has(d, f) for f in S.REQUIRED.get(k, [])) + sum(isinstance(d.get(f), str) and not d[f].strip() for f in ("name", "headline", "description"))
        if k == "FAQPage":
            e = d.get("mainEntity", [])
            pairs += sum(bool(q.get("name")) for q in ([e] if isinstance(e, dict) else e))
        a = d.get("author")
        name = a.get("name") if isinstance(a, dict) else a if isinstance(a, str) else a[0] if a else None
        if name and author is None:
            author = bool(isinstance(a, dict) and (a.get("jobTitle") or a.get("description")))
        m = d.get("dateModified")
        m = m.get("@value") if isinstance(m, dict) else m
        published |= bool(d.get("datePublished"))
        if m:
            modified = True
            t = m.split("+")[0].split("Z")[0][:19]
            if re.fullmatch(r"\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d)?", t):
                days = (now - dt.datetime.fromisoformat(t)).days
    level = "unknown" if days is None else "fresh" if days < 30 else "recent" if days < 90 else "stale" if days < 180 else "very_stale"
    parts = {
        "faq": 0 if "FAQPage" not in kinds else 100 if pairs >= 5 else 80 if pairs >= 3 else 50 if pairs else 25,
        "author": 0 if not set(kinds) & set(S.ARTICLES) else 30 if author is None else 100 if author else 70,
        "modified": (30 if published else 0) if not modified else {"fresh": 100, "recent": 80, "stale": 40}.get(level, 20),
        "organization": 100 if set(kinds) & {"Organization", "LocalBusiness"} else 0,
        "how_to": 100 if "HowTo" in kinds else 50,
        "validation": max(0, 100 - 20 * errors),
    }
    return parts, sum(v * S.PARTS[k] / 100 for k, v in parts.items())


def test_pillar(spark):
    import datetime as dt
    import json

    now = dt.datetime(2024, 6, 1, 12)
    wrap = lambda i, o: f'<script type="application/ld+json">{json.dumps({"@graph": o} if i % 2 else o)}</script>'
    df = spark.createDataFrame([(i, wrap(i, o)) for i, o in LD.items()] + [(9, "<p>none</p>"), (10, None)], "page_id bigint, html string")
    got = {r.page_id: r for r in S.pillar(S.analysis(df, F.lit(now))).collect()}
    assert set(got) == set(LD)
    for i, objects in LD.items():
        parts, total = plain_pillar(objects, now)
        assert {k: got[i][f"{k}_score"] for k in parts} == parts, i
        assert abs(got[i].total - total) < 1e-6 and got[i].level == ("full" if total >= 70 else "partial" if total >= 40 else "limited")
    assert (got[1].days, got[1].freshness, got[1].author.name, got[1].types) == (12, "fresh", "Ann", ["BlogPosting", "FAQPage", "Organization"])
    assert got[4].freshness == "stale" and got[3].freshness == "unknown" and got[6].validation_score == 0


def test_images(spark):
    r = S.image_scores(pages(spark)).collect()
    assert len(r) == 1 and (r[0].images, r[0].decorative, r[0].missing, r[0].poor, r[0].good) == (4, 1, 1, 1, 1)
    assert abs(r[0].score - (100 - 50 / 3 - 30 / 3)) < 1e-9


def test_authority(spark):
    r = {x.page_id: x for x in S.authority(pages(spark)).collect()}
    assert (r[1].byline, r[1].credentials, r[1].external, r[1].authoritative, r[1].original) == ("Anna Schmidt", True, 2, 1, True)
    assert r[2].byline is None and not r[2].original
