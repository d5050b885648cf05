"""Page queries: extraction measures, headings, links, page and site types, link graph, generated questions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U
from .base import query
from .texts import HOST, PART, _types

# DuckDB fragments
STRIP = r"trim(regexp_replace(regexp_replace({0}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
CLEAN = f"regexp_replace({{0}}, '{H.REMOVED}', ' ', 'g')"
MAIN = r"regexp_extract(html, '(?is)<main\b[^>]*>(.*?)</main>', 1)"
ART = r"regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article>', 1)"
MAIN_TEXT = f"CASE WHEN {MAIN} <> '' THEN {STRIP.format(CLEAN.format(MAIN))} WHEN {ART} <> '' THEN {STRIP.format(CLEAN.format(ART))} ELSE {STRIP.format(CLEAN.format('html'))} END"
HEADS = f"""h AS (SELECT page_id, i AS pos, CAST(substr(x, 3, 1) AS INT) AS level, {STRIP.format('x')} AS text FROM (SELECT page_id, unnest(r) AS x, unnest(range(len(r))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\\b[^>]*>.*?</h[1-6]>') AS r FROM pages)))"""
LINKS = f"""l AS (SELECT page_id, i AS pos, regexp_extract(x, '(?i)href="([^"]*)"', 1) AS href, {STRIP.format('x')} AS text FROM (SELECT page_id, unnest(r) AS x, unnest(range(len(r))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*href="[^"]*"[^>]*>.*?</a>') AS r FROM pages)))"""


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _sum(text: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INT)" for w in words) + ")"


@query("html_clean", f"SELECT page_id, md5({MAIN_TEXT}) AS main_md5, length({MAIN_TEXT}) AS main_chars, length({STRIP.format(CLEAN.format('html'))}) AS visible_chars FROM pages")
def html_clean(t):
    m = H.main_text(F.col("html"))
    return t("pages").select("page_id", F.md5(m.cast("binary")).alias("main_md5"), F.length(m).cast("bigint").alias("main_chars"), F.length(H.visible(F.col("html"))).cast("bigint").alias("visible_chars"))


@query("page_gate", f"WITH p AS (SELECT page_id, {MAIN_TEXT} AS m, strlen(html) AS size FROM pages) SELECT page_id, least(length(m), 100000) AS content_size, round(strlen(substr(m, 1, 100000)) / size, 6) AS compression FROM p WHERE length(m) >= 50")
def page_gate(t):
    """Pages of at least 50 characters, cut at 100,000, with the share of the page that is content."""
    p = t("pages").select("page_id", H.main_text(F.col("html")).alias("m"), F.octet_length("html").alias("size")).filter(F.length("m") >= 50)
    return p.select("page_id", F.least(F.length("m"), F.lit(100_000)).cast("bigint").alias("content_size"), F.round(F.octet_length(F.substring("m", 1, 100_000)) / F.col("size"), 6).alias("compression"))


@query("html_metadata", rf"""SELECT page_id, {STRIP.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS lang,
  regexp_extract(html, '(?i)<meta[^>]*charset="?([a-z0-9-]+)', 1) AS charset, len(regexp_extract_all(html, '(?i)<a\b')) AS links, len(regexp_extract_all(html, '(?i)<img\b')) AS images, len(regexp_extract_all({STRIP.format(CLEAN.format('html'))}, '[\p{{L}}\p{{N}}_]+')) AS words FROM pages""")
def html_metadata(t):
    h = F.col("html")
    words = F.regexp_count(H.visible(h), F.lit(r"[\p{L}\p{N}_]+")).cast("bigint")
    return t("pages").select("page_id", H.strip_tags(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.regexp_extract(h, r'(?i)<html[^>]*lang="([^"]*)"', 1).alias("lang"), F.regexp_extract(h, r'(?i)<meta[^>]*charset="?([a-z0-9-]+)', 1).alias("charset"), H.count(h, "a").alias("links"), H.count(h, "img").alias("images"), words.alias("words"))


@query("crawl_stats", f"WITH p AS (SELECT {HOST} AS site, {MAIN_TEXT} AS m, strlen(html) AS size FROM pages) SELECT site, count(*) AS pages, CAST(sum(length(m)) AS BIGINT) AS chars, round(avg(strlen(m) / size), 6) AS compression, count(*) FILTER (WHERE length(m) < 50) AS dropped FROM p GROUP BY site")
def crawl_stats(t):
    p = t("pages").select(F.coalesce(U.domain(F.col("url")), F.lit("")).alias("site"), H.main_text(F.col("html")).alias("m"), F.octet_length("html").alias("size"))
    return p.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("m")).cast("bigint").alias("chars"), F.round(F.avg(F.octet_length("m") / F.col("size")), 6).alias("compression"), F.count_if(F.length("m") < 50).alias("dropped"))


@query("heading_audit", f"""WITH {HEADS}, x AS (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY pos) AS prev, row_number() OVER (PARTITION BY page_id, lower(text) ORDER BY pos) AS n FROM h),
a AS (SELECT page_id, count(*) AS headings, count(*) FILTER (WHERE level = 1) AS h1, count(*) FILTER (WHERE level > prev + 1) AS skips, count(*) FILTER (WHERE n > 1 AND text <> '') AS duplicates, count(*) FILTER (WHERE text = '') AS empty, count(*) FILTER (WHERE length(text) > 200) AS long,
  bool_or({_any('lower(text)', H.FAQ)}) AS faq, bool_or({_any('lower(text)', H.HOW_TO)}) AS how_to, count(*) FILTER (WHERE ends_with(text, '?')) AS questions FROM x GROUP BY page_id)
SELECT page_id, headings, h1, skips, duplicates, faq, how_to, questions, greatest(0, 100 - CASE WHEN h1 = 0 THEN 20 WHEN h1 > 1 THEN 10 ELSE 0 END - 5 * skips - 2 * duplicates - 2 * empty - long) AS score FROM a""")
def heading_audit(t):
    h = t("pages").select("page_id", F.posexplode(H.headings(F.col("html"))).alias("pos", "h")).select("page_id", "pos", "h.level", "h.text")
    w = Window.partitionBy("page_id").orderBy("pos")
    h = h.withColumn("prev", F.lag("level").over(w)).withColumn("n", F.row_number().over(Window.partitionBy("page_id", F.lower("text")).orderBy("pos")))
    low = F.lower("text")
    a = h.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("headings"), F.count_if(F.col("level") == 1).alias("h1"), F.count_if(F.col("level") > F.col("prev") + 1).alias("skips"), F.count_if((F.col("n") > 1) & (F.col("text") != "")).alias("duplicates"),
        F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.length("text") > 200).alias("long"), F.bool_or(H.has_any(low, H.FAQ)).alias("faq"), F.bool_or(H.has_any(low, H.HOW_TO)).alias("how_to"), F.count_if(F.endswith("text", F.lit("?"))).alias("questions"),
    )
    score = F.greatest(F.lit(0), 100 - F.when(F.col("h1") == 0, 20).when(F.col("h1") > 1, 10).otherwise(0) - 5 * F.col("skips") - 2 * F.col("duplicates") - 2 * F.col("empty") - F.col("long"))
    return a.select("page_id", "headings", "h1", "skips", "duplicates", "faq", "how_to", "questions", score.alias("score"))


_INT = "(substr(href, 1, 1) IN ('/', '#', '?') OR href = '')"
_GEN = ", ".join(f"'{x}'" for x in H.GENERIC)


@query("link_audit", f"""WITH {LINKS}, a AS (SELECT page_id, count(*) AS links, count(*) FILTER (WHERE {_INT}) AS internal, count(*) FILTER (WHERE text = '') AS empty, count(*) FILTER (WHERE lower(text) IN ({_GEN})) AS generic,
  count(*) FILTER (WHERE length(text) >= 3 AND lower(text) NOT IN ({_GEN}) AND NOT regexp_matches(lower(text), '^https?://')) AS good FROM l GROUP BY page_id)
SELECT page_id, links, internal, generic, good, CAST(greatest(0, CASE WHEN good / links >= 0.8 THEN least(100, s + 5) ELSE s END) AS DOUBLE) AS score FROM
(SELECT *, 100.0 - CASE WHEN internal < 5 THEN (5 - internal) * 5 WHEN internal > 50 THEN least(20, (internal - 50) * 0.5) ELSE 0 END - CASE WHEN empty > 3 THEN least(10, empty * 2) ELSE 0 END - CASE WHEN generic > 5 THEN least(10, generic) ELSE 0 END AS s FROM a)""")
def link_audit(t):
    x = t("pages").select("page_id", F.explode(H.links(F.col("html"))).alias("l")).select("page_id", "l.href", "l.text")
    low = F.lower("text")
    a = x.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"), F.count_if(F.substring("href", 1, 1).isin("/", "#", "?") | (F.col("href") == "")).alias("internal"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(low.isin(H.GENERIC)).alias("generic"),
        F.count_if((F.length("text") >= 3) & ~low.isin(H.GENERIC) & ~low.rlike("^https?://")).alias("good"),
    )
    i = F.col("internal")
    s = 100.0 - F.when(i < 5, (5 - i) * 5.0).when(i > 50, F.least(F.lit(20.0), (i - 50) * 0.5)).otherwise(0.0) - F.when(F.col("empty") > 3, F.least(F.lit(10), F.col("empty") * 2)).otherwise(0) - F.when(F.col("generic") > 5, F.least(F.lit(10), F.col("generic"))).otherwise(0)
    s = F.when(F.col("good") / F.col("links") >= 0.8, F.least(F.lit(100.0), s + 5)).otherwise(s)
    return a.select("page_id", "links", "internal", "generic", "good", F.greatest(F.lit(0.0), s).alias("score"))


@query("js_dependency", f"""WITH p AS (SELECT page_id, length({MAIN_TEXT}) AS n, {_sum('lower(html)', H.FRAMEWORKS)} AS m, {_any(f"lower({STRIP.format('html')})", H.LOADING)} AS l, length({STRIP.format("regexp_extract(html, '(?is)<noscript[^>]*>(.*?)</noscript>', 1)")}) > 100 AS f FROM pages)
SELECT page_id, score, score < 50 AS dependent FROM (SELECT page_id, greatest(0, least(100, 100 - CASE WHEN n < 100 THEN 60 WHEN n < 500 THEN 40 WHEN n < 1000 THEN 20 ELSE 0 END - CASE WHEN m > 0 THEN 30 ELSE 0 END - CASE WHEN l THEN 15 ELSE 0 END + CASE WHEN f THEN 10 ELSE 0 END - CASE WHEN m > 2 THEN 10 ELSE 0 END)) AS score FROM p)""")
def js_dependency(t):
    h = F.col("html")
    fallback = F.length(H.strip_tags(F.regexp_extract(h, r"(?is)<noscript[^>]*>(.*?)</noscript>", 1))) > 100
    s = H.js_score(F.length(H.main_text(h)), H.count_any(F.lower(h), H.FRAMEWORKS), H.has_any(F.lower(H.strip_tags(h)), H.LOADING), fallback)
    return t("pages").select("page_id", s.alias("score")).withColumn("dependent", F.col("score") < 50)


@query("answer_first", f"""WITH p AS (SELECT page_id, substr({MAIN_TEXT}, 1, 500) AS c, length({STRIP.format("regexp_extract(html, '(?is)<p[^>]*>(.*?)</p>', 1)")}) AS n FROM pages),
f AS (SELECT page_id, n, regexp_matches(c, '{H.DEFINITION}') AS d, regexp_matches(c, '{H.NUMBER}') AS k, {_any('lower(c)', H.DIRECT)} AS a FROM p)
SELECT page_id, d AS has_definition, k AS has_number, a AS direct_answer, least(100, 50 + CASE WHEN n >= 50 AND (d OR k OR a) THEN 30 ELSE 0 END + CASE WHEN d THEN 10 ELSE 0 END + CASE WHEN k THEN 5 ELSE 0 END) AS score FROM f""")
def answer_first(t):
    h = F.col("html")
    f = t("pages").select("page_id", F.substring(H.main_text(h), 1, 500).alias("c"), F.length(H.strip_tags(F.regexp_extract(h, r"(?is)<p[^>]*>(.*?)</p>", 1))).alias("n"))
    f = f.select("page_id", "n", F.col("c").rlike(H.DEFINITION).alias("has_definition"), F.col("c").rlike(H.NUMBER).alias("has_number"), H.has_any(F.lower("c"), H.DIRECT).alias("direct_answer"))
    d, k, a = F.col("has_definition"), F.col("has_number"), F.col("direct_answer")
    return f.select("page_id", d, k, a, F.least(F.lit(100), 50 + F.when((F.col("n") >= 50) & (d | k | a), 30).otherwise(0) + F.when(d, 10).otherwise(0) + F.when(k, 5).otherwise(0)).alias("score"))


def _c(tag: str) -> str:
    return rf"len(regexp_extract_all(html, '(?i)<{tag}\b'))"


@query("extractable_formats", f"""WITH f AS (SELECT page_id, {_c('table')} AS tables, {_c('t(?:h|head)')} AS heads, {_c('(?:li|dd)')} AS items, {_c('dl')} AS dls, {_c('(?:pre|code)')} AS codes FROM pages)
SELECT page_id, tables, items, dls, codes, CAST(least(100, 50.0 + least(15, least(tables, heads) * 5) + least(20, items * 0.5) + least(10, dls * 5) + least(5, codes * 2)) AS DOUBLE) AS score FROM f""")
def extractable_formats(t):
    h = F.col("html")
    f = t("pages").select("page_id", H.count(h, "table").alias("tables"), H.count(h, "t(?:h|head)").alias("heads"), H.count(h, "(?:li|dd)").alias("items"), H.count(h, "dl").alias("dls"), H.count(h, "(?:pre|code)").alias("codes"))
    s = 50.0 + F.least(F.lit(15), F.least("tables", "heads") * 5) + F.least(F.lit(20.0), F.col("items") * 0.5) + F.least(F.lit(10), F.col("dls") * 5) + F.least(F.lit(5), F.col("codes") * 2)
    return f.select("page_id", "tables", "items", "dls", "codes", F.least(F.lit(100.0), s).alias("score"))


@query("readability", rf"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<p\b[^>]*>.*?</p>')) AS x FROM pages), q AS (SELECT page_id, {STRIP.format('x')} AS t FROM p),
n AS (SELECT page_id, len(regexp_extract_all(t, '[^\s]+')) AS words, greatest(1, len(regexp_extract_all(t, '[.!?](?:\s|$)'))) AS sentences FROM q WHERE t <> '')
SELECT page_id, count(*) AS paragraphs, round(avg(words), 4) AS mean_words, round(avg(sentences), 4) AS mean_sentences, count(*) FILTER (WHERE words > 150) AS walls, round(avg(CAST(words <= 100 AND sentences <= 4 AS INT)), 6) AS good_share FROM n GROUP BY page_id""")
def readability(t):
    """Paragraph sizes: words, sentences, walls of text and the share within 100 words and 4 sentences."""
    p = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<p\b[^>]*>.*?</p>"), 0)).alias("x")).select("page_id", H.strip_tags(F.col("x")).alias("t")).filter("t <> ''")
    n = p.select("page_id", F.regexp_count("t", F.lit(r"[^\s]+")).alias("words"), F.greatest(F.lit(1), F.regexp_count("t", F.lit(r"[.!?](?:\s|$)"))).alias("sentences"))
    return n.groupBy("page_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.round(F.avg("words"), 4).alias("mean_words"), F.round(F.avg("sentences"), 4).alias("mean_sentences"), F.count_if(F.col("words") > 150).alias("walls"), F.round(F.avg(((F.col("words") <= 100) & (F.col("sentences") <= 4)).cast("int")), 6).alias("good_share"))


@query("site_type", f"""WITH p AS (SELECT {HOST} AS site, CASE WHEN lower({PART.format(3)}) IN ('', '/', '/index.html', '/index.php') THEN 'homepage' {_types(f'lower({PART.format(3)})')} ELSE 'unknown' END AS ty FROM pages),
s AS (SELECT site, 3 * CAST(regexp_matches(site, '^(blog|news)[.]') AS INT) + 2.0 * avg(CAST(ty IN ('blog_post', 'blog_index') AS INT)) AS news, 3 * CAST(regexp_matches(site, '^docs?[.]') AS INT) + 2.0 * avg(CAST(ty = 'documentation' AS INT)) AS docs, 3 * CAST(regexp_matches(site, '^(shop|store)[.]') AS INT) + 2.0 * avg(CAST(ty IN ('product', 'pricing') AS INT)) AS commerce FROM p GROUP BY site)
SELECT site, CASE WHEN greatest(news, docs, commerce) < 0.5 THEN 'mixed' WHEN news >= docs AND news >= commerce THEN 'news' WHEN docs >= commerce THEN 'docs' ELSE 'commerce' END AS site_type, round(coalesce(least(0.95, greatest(news, docs, commerce) / nullif(news + docs + commerce, 0)), 0), 6) AS confidence FROM s""")
def site_type(t):
    """The kind with most evidence from host and page types; mixed below 0.5; confidence is its share, at most 0.95."""
    p = t("pages").select(F.coalesce(U.domain(F.col("url")), F.lit("")).alias("site"), U.page_type(F.col("url")).alias("ty"))
    share = lambda *types: 2.0 * F.avg(F.col("ty").isin(*types).cast("int"))
    s = p.groupBy("site").agg(share("blog_post", "blog_index").alias("news"), share("documentation").alias("docs"), share("product", "pricing").alias("commerce"))
    host = lambda pattern: 3 * F.col("site").rlike(pattern).cast("int")
    s = s.select("site", (F.col("news") + host("^(blog|news)[.]")).alias("news"), (F.col("docs") + host("^docs?[.]")).alias("docs"), (F.col("commerce") + host("^(shop|store)[.]")).alias("commerce"))
    best = F.greatest("news", "docs", "commerce")
    kind = F.when(best < 0.5, "mixed").when(F.col("news") == best, "news").when(F.col("docs") == best, "docs").otherwise("commerce")
    return s.select("site", kind.alias("site_type"), F.round(F.coalesce(F.least(F.lit(0.95), F.try_divide(best, F.col("news") + F.col("docs") + F.col("commerce"))), F.lit(0.0)), 6).alias("confidence"))


@query("heading_questions", f"""WITH {HEADS}, m AS (SELECT page_id, pos, CASE WHEN regexp_matches(text, '(?i)pricing|plans|cost') THEN 'pricing' WHEN regexp_matches(text, '(?i)features?|capabilities') THEN 'features' WHEN regexp_matches(text, '(?i)team|leadership|founders?') THEN 'team' WHEN regexp_matches(text, '(?i)security|privacy|compliance') THEN 'security' WHEN regexp_matches(text, '(?i)on|er') THEN 'topic' END AS kind FROM h)
SELECT page_id, kind, pos FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM m WHERE kind IS NOT NULL) WHERE n <= 2""")
def heading_questions(t):
    """The first pattern that fits a heading makes its question; two headings a page."""
    kinds = [("pricing", "(?i)pricing|plans|cost"), ("features", "(?i)features?|capabilities"), ("team", "(?i)team|leadership|founders?"), ("security", "(?i)security|privacy|compliance"), ("topic", "(?i)on|er")]
    h = t("pages").select("page_id", F.posexplode(H.headings(F.col("html"))).alias("pos", "h"))
    kind = None
    for name, pattern in kinds:
        fits = F.col("h.text").rlike(pattern)
        kind = F.when(fits, name) if kind is None else kind.when(fits, name)
    m = h.select("page_id", F.col("pos").cast("bigint").alias("pos"), kind.alias("kind")).filter("kind IS NOT NULL")
    return m.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).filter("n <= 2").drop("n")
