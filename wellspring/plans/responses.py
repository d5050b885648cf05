"""The response parser over documents: each text read for its own first word as the company and one domain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import responses as R
from .base import query

DOMAIN = "example.com"
_Q = lambda s: s.replace("'", "''")
_COMPANY = "coalesce(nullif(regexp_extract(text, '[A-Za-z]+', 0), ''), chr(0))"
_COUNT = lambda p: f"len(regexp_extract_all(low, {p}))"
_SUM = lambda words: "(" + " + ".join(f"contains(low, '{_Q(w)}')::INT" for w in words) + ")"
_CITED = " + ".join(f"len(regexp_extract_all(text, '(?i){_Q(p)}'))" for p, _ in R.CITATIONS)
_URLS = f"regexp_extract_all(text, '{R.URL}')"

PARSED = f"""
a AS (SELECT doc_id, text, lower(text) AS low, {_COMPANY} AS company FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
b AS (SELECT *, {_CITED} AS cited, {_COUNT("regexp_escape(lower(company))")} AS names, {_COUNT(f"regexp_escape('{DOMAIN}')")} AS domains, {_COUNT(f"'https?://(?:www[.])?' || regexp_escape('{DOMAIN}') || '[^\\s]*'")} AS sites,
  {_SUM(R.PRAISE)} AS good, {_SUM(R.BLAME)} AS bad, {_SUM(R.HEDGES)} AS h, {_SUM(R.CERTAINTIES)} AS s, {" + ".join(f"regexp_matches(text, '{_Q(p)}')::INT" for p in R.CLAIMS)} AS claims FROM a),
c AS (SELECT *, CASE WHEN h = 0 AND s = 0 THEN 'unknown' WHEN h > 2 * s THEN 'low' WHEN s > 2 * h THEN 'high' WHEN h > s THEN 'uncertain' ELSE 'medium' END AS confidence, coalesce((good - bad) / nullif(good + bad, 0), 0) AS tone FROM b)"""


@query("parsed_responses", f"""WITH {PARSED} SELECT doc_id, names AS company_mentions, domains AS domain_mentions, sites AS url_mentions, greatest(cited, (names > 0)::INT)::BIGINT AS citations, cited > 0 AS explicit_citation,
len(list_filter({_URLS}, lambda u: contains(lower(u), '{DOMAIN}'))) AS company_urls, len(list_filter({_URLS}, lambda u: NOT contains(lower(u), '{DOMAIN}'))) AS external_urls,
len(regexp_extract_all(text, '[.!?]+')) AS sentences, round(tone, 6) AS tone, CASE WHEN tone > 0.3 THEN 'positive' WHEN tone < -0.3 THEN 'negative' WHEN good > 0 AND bad > 0 THEN 'mixed' ELSE 'neutral' END AS sentiment, confidence,
regexp_matches(low, '{_Q("|".join(R.REFUSALS))}') AS refusal, confidence IN ('low', 'uncertain') OR h > 2 AS uncertain, (confidence = 'high' AND cited = 0 AND names + domains + sites > 0) OR (claims >= 3 AND cited = 0) AS risk FROM c""")
def parsed_responses(t):
    """Mentions, citations, URLs, tone, confidence and risk of every document."""
    d = t("documents").select("doc_id", "text", F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0).alias("company"), F.lit(DOMAIN).alias("domain"))
    p = R.parsed(d, "text")
    n = lambda k: F.size(F.filter("mentions", lambda m: m["kind"].isin(k))).cast("bigint")
    size = lambda c: F.size(c).cast("bigint").alias(c)
    return p.select("doc_id", n(["exact", "partial"]).alias("company_mentions"), n(["domain"]).alias("domain_mentions"), n(["url"]).alias("url_mentions"), size("citations"), "explicit_citation", size("company_urls"), size("external_urls"), F.col("n_sentences").cast("bigint").alias("sentences"), F.round("tone", 6).alias("tone"), "sentiment", "confidence", "refusal", "uncertain", "risk")
