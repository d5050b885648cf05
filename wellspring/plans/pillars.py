"""Pillar queries: technical, structure, crawler access, density, citation context, entity scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import schema as S
from .base import query
from .calibration import MEAS  # noqa: F401
from .pages import ART, MAIN_TEXT, STRIP, _c  # noqa: F401
from .scoring import CTX, results

TTFB = "CASE WHEN {0} < 200 THEN 100.0 WHEN {0} < 500 THEN 100 - ({0} - 200) / 300.0 * 20 WHEN {0} < 1000 THEN 80 - ({0} - 500) / 500.0 * 30 WHEN {0} < 1500 THEN 50 - ({0} - 1000) / 500.0 * 25 ELSE greatest(0.0, 25 - least(1.0, ({0} - 1500) / 1000.0) * 25) END"


def ttfb(ms):
    return F.when(ms < 200, 100.0).when(ms < 500, 100 - (ms - 200) / 300 * 20).when(ms < 1000, 80 - (ms - 500) / 500 * 30).when(ms < 1500, 50 - (ms - 1000) / 500 * 25).otherwise(F.greatest(F.lit(0.0), 25 - F.least(F.lit(1.0), (ms - 1500) / 1000) * 25))


@query("ttfb_score", f"SELECT event_id, CAST(round({TTFB.format('(value * 20)')}, 6) AS DOUBLE) AS score FROM events")
def ttfb_score(t):
    """Event values as response times, piecewise linear from 100 down to 0."""
    return t("events").select("event_id", F.round(ttfb(F.col("value") * 20), 6).alias("score"))


#: Crawler weights: search 60 %, direct 40 %; a site blocks a crawler when its key meets the crawler's number.
CRAWLERS = [("search", "s1", 35), ("search", "s2", 20), ("search", "s3", 5), ("direct", "d1", 12), ("direct", "d2", 5), ("direct", "d3", 8), ("direct", "d4", 5)]


@query("crawler_access", f"WITH c(class, name, w, i) AS (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {chr(39)}{n}{chr(39)}, {w}, {i})' for i, (c, n, w) in enumerate(CRAWLERS))}), a AS (SELECT s_suppkey, class, sum(CASE WHEN (s_suppkey + i) % 4 = 0 THEN 0 ELSE w END) / sum(w) AS share FROM supplier, c GROUP BY s_suppkey, class) SELECT s_suppkey, round(100 * sum(CASE class WHEN 'search' THEN 0.6 ELSE 0.4 END * share), 6) AS score FROM a GROUP BY s_suppkey")
def crawler_access(t):
    """Allowed weight by class of crawler, search counting 0.6 and direct 0.4."""
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.lit(w).alias("w"), F.lit(i).alias("i")) for i, (c, n, w) in enumerate(CRAWLERS)])
    x = t("supplier").select("s_suppkey", F.explode(rows).alias("c")).select("s_suppkey", "c.*")
    a = x.groupBy("s_suppkey", "class").agg((F.sum(F.when((F.col("s_suppkey") + F.col("i")) % 4 == 0, 0).otherwise(F.col("w"))) / F.sum("w")).alias("share"))
    return a.groupBy("s_suppkey").agg(F.round(100 * F.sum(F.when(F.col("class") == "search", 0.6).otherwise(0.4) * F.col("share")), 6).alias("score"))


@query("technical_pillar", f"SELECT page_id, CAST(round(0.35 * CASE WHEN page_id % 7 = 0 THEN 40 ELSE 100 END + 0.30 * {TTFB.format('(page_id * 37 % 2000)')} + 0.15 * (page_id % 5) * 25 + 0.10 * CASE WHEN length({MAIN_TEXT}) >= 1000 THEN 100 WHEN length({MAIN_TEXT}) >= 500 THEN 80 ELSE 40 END + 0.10 * CASE WHEN url LIKE 'https://%' THEN 100 ELSE 0 END, 6) AS DOUBLE) AS technical FROM pages")
def technical_pillar(t):
    """35 crawler access, 30 response time, 15 llms.txt, 10 content without scripts, 10 https."""
    i, n = F.col("page_id"), F.length(H.main_text(F.col("html")))
    s = 0.35 * F.when(i % 7 == 0, 40).otherwise(100) + 0.30 * ttfb(i * 37 % 2000) + 0.15 * (i % 5) * 25 + 0.10 * F.when(n >= 1000, 100).when(n >= 500, 80).otherwise(40) + 0.10 * F.when(F.col("url").startswith("https://"), 100).otherwise(0)
    return t("pages").select("page_id", F.round(s, 6).alias("technical"))


_DENS = {"identity": 5.0, "offerings": 15.0, "contact": 5.0, "trust": 20.0, "differentiation": 30.0}


@query("competitive_density", f"WITH {CTX}, dn AS (SELECT category, 0.6 * CASE category {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in _DENS.items())} END + 0.4 * 55 AS density FROM qr) SELECT coalesce(category, 'all') AS category, round(avg(density), 6) AS density, round(100 - avg(density), 6) AS inverse FROM dn GROUP BY GROUPING SETS ((category), ())")
def competitive_density(t):
    """0.6 of the category's density and 0.4 of the site type's (mixed: 0.55), by category and over all."""
    from ..operators.scoring import lookup

    d = results(t).select("category", (0.6 * lookup(F.col("category"), _DENS) + 0.4 * 55).alias("density"))
    a = d.groupingSets([["category"], []], "category").agg(F.round(F.avg("density"), 6).alias("density"), F.round(100 - F.avg("density"), 6).alias("inverse"))
    return a.withColumn("category", F.coalesce("category", F.lit("all")))


@query("citation_context", f"WITH {CTX}, m AS (SELECT category, round(avg(score), 6) AS m FROM qr GROUP BY category) SELECT (SELECT category FROM m ORDER BY m DESC, category LIMIT 1) AS strongest, (SELECT category FROM m ORDER BY m, category LIMIT 1) AS weakest, CASE WHEN avg(m) >= 0.70 THEN 'high' WHEN avg(m) >= 0.40 THEN 'moderate' ELSE 'low' END AS likelihood FROM m")
def citation_context(t):
    m = results(t).groupBy("category").agg(F.round(F.avg("score"), 6).alias("m"))
    p = F.avg("m")
    return m.agg(F.min_by("category", F.struct(-F.col("m"), F.col("category"))).alias("strongest"), F.min_by("category", F.struct("m", "category")).alias("weakest"), F.when(p >= 0.70, "high").when(p >= 0.40, "moderate").otherwise("low").alias("likelihood"))


@query("entity_presence", "SELECT c_custkey, least(30, 15 + CASE WHEN c_custkey * 97 % 20000 > 10000 THEN 5 WHEN c_custkey * 97 % 20000 > 5000 THEN 3 WHEN c_custkey * 97 % 20000 > 2000 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 80 > 50 THEN 5 WHEN c_custkey % 80 > 20 THEN 3 WHEN c_custkey % 80 > 5 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 0 END + CASE WHEN c_custkey % 15 > 10 THEN 2 WHEN c_custkey % 15 > 5 THEN 1 ELSE 0 END) AS score FROM customer")
def entity_presence(t):
    """Encyclopedia presence by length, citations, infobox and sections, at most 30; the lookups are derived columns here."""
    k = F.col("c_custkey")
    n, c, s = k * 97 % 20000, k % 80, k % 15
    score = 15 + F.when(n > 10000, 5).when(n > 5000, 3).when(n > 2000, 1).otherwise(0) + F.when(c > 50, 5).when(c > 20, 3).when(c > 5, 1).otherwise(0) + F.when(k % 2 == 0, 2).otherwise(0) + F.when(s > 10, 2).when(s > 5, 1).otherwise(0)
    return t("customer").select("c_custkey", F.least(F.lit(30), score).alias("score"))


@query("entity_reinforcement", f"""WITH p AS (SELECT page_id, lower({STRIP.format("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}) AS h1, lower({STRIP.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}) AS title, {MAIN_TEXT} AS m FROM pages),
f AS (SELECT page_id, contains(h1, 'the') AS in_h1, contains(title, 'the') AS in_title, contains(lower(substr(m, 1, 600)), 'the') AS early, len(regexp_extract_all(lower(m), 'the')) * 500.0 / greatest(1, len(regexp_extract_all(m, '[^\\s]+'))) AS rate FROM p)
SELECT page_id, CASE WHEN rate >= 2 THEN 5 WHEN rate >= 1 THEN 3 WHEN rate >= 0.5 THEN 1 ELSE 0 END + CASE WHEN in_h1 THEN 4 ELSE 0 END + CASE WHEN early THEN 2 ELSE 0 END + CASE WHEN in_title THEN 2 ELSE 0 END AS score FROM f""")
def entity_reinforcement(t):
    """Mentions of a brand ("the" stands in) per 500 words, in the h1, the title and early on."""
    h = F.col("html")
    inner = lambda tag: F.lower(H.strip_tags(F.regexp_extract(h, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)))
    p = t("pages").select("page_id", inner("h1").alias("h1"), inner("title").alias("title"), H.main_text(h).alias("m"))
    rate = F.regexp_count(F.lower("m"), F.lit("the")) * 500.0 / F.greatest(F.lit(1), F.regexp_count("m", F.lit(r"[^\s]+")))
    s = F.when(rate >= 2, 5).when(rate >= 1, 3).when(rate >= 0.5, 1).otherwise(0) + F.when(F.contains("h1", F.lit("the")), 4).otherwise(0) + F.when(F.contains(F.lower(F.substring("m", 1, 600)), F.lit("the")), 2).otherwise(0) + F.when(F.contains("title", F.lit("the")), 2).otherwise(0)
    return p.select("page_id", s.alias("score"))


@query("image_alt")
def image_alt(t):
    return S.image_scores(t("pages"))


@query("schema_org")
def schema_org(t):
    """Structured data of each page, JSON-LD and microdata, with the completeness of its fields."""
    return S.scored(t("pages")).withColumn("completeness", F.round("completeness", 4))


@query("schema_pillar")
def schema_pillar(t):
    """Schema richness of each page as of the latest event; a page without structured data has the optional half of its how-to part alone."""
    as_of = F.lit(t("events").agg(F.max("ts")).first()[0])
    found = S.pillar(S.analysis(t("pages"), as_of)).select("page_id", "schemas", *[f"{k}_score" for k in S.PARTS], "total", "level")
    none = {"schemas": 0, "how_to_score": 50.0, "total": 50.0 * S.PARTS["how_to"] / 100, "level": "limited"} | {f"{k}_score": 0.0 for k in S.PARTS if k != "how_to"}
    return t("pages").select("page_id").join(found, "page_id", "left").fillna(none)


@query("authority_signals", r"""SELECT page_id, len(regexp_extract_all(html, '(?i)href="(https?://[^"]+)"')) AS external, regexp_matches(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '\b(PhD|Ph\.D|MD|M\.D\.|MBA|Professor)\b') AS credentials, regexp_matches(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '(?i)\b(our (data|research|study|survey)|we (found|analyzed|surveyed|measured|tested))\b') AS original FROM pages""")
def authority_signals(t):
    return S.authority(t("pages")).select("page_id", "external", "credentials", "original")
