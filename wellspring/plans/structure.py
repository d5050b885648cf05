"""Structure queries: answer block, readability, and the structure total of every page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import structure as X
from . import pages as P
from .base import ORACLES, query
from .pages import ART, CLEAN, MAIN, MAIN_TEXT, STRIP

_J = r"regexp_replace(regexp_replace({0}, '(?s)\s*<[^>]*>\s*', '', 'g'), '^\s+|\s+$', '', 'g')"
_BODY = f"CASE WHEN {MAIN} <> '' THEN {MAIN} WHEN {ART} <> '' THEN {ART} ELSE html END"
_PS = lambda h: f"list_transform(regexp_extract_all({h}, '{X.PARAGRAPH}', 1), lambda x: {_J.format('x')})"
_WORDS = f"len(regexp_extract_all({STRIP.format(CLEAN.format('html'))}, '\\S+'))"

ANSWER = rf"""
an0 AS (SELECT page_id, {MAIN_TEXT} AS main, coalesce(list_filter({_PS(r"regexp_extract(html, '(?is)<h1\b[^>]*>.*?</h1>(.*)$', 1)")}, lambda t: length(t) > 30)[1],
  list_filter(list_transform(regexp_extract_all(b, '{X.PARAGRAPH}', 1)[:3], lambda x: {_J.format('x')}), lambda t: length(t) > 30)[1]) AS t FROM (SELECT *, {_BODY} AS b FROM pages)),
an1 AS (SELECT page_id, t, main, len(regexp_extract_all(coalesce(t, ''), '\S+')) AS w, regexp_matches(coalesce(t, ''), '{X.STANDALONE[0]}') OR regexp_matches(coalesce(t, ''), '{X.STANDALONE[1]}') AS alone,
  regexp_matches(coalesce(t, ''), '^\p{{Lu}}') AND regexp_replace(lower(regexp_extract(coalesce(t, ''), '^\s*(\S+)', 1)), '[,.]+$', '') NOT IN {tuple(X.NO_TOPIC)} AS topic, CASE WHEN t <> '' THEN instr(main, t) ELSE 0 END AS spot FROM an0),
answers AS (SELECT *, CASE WHEN spot > 0 THEN greatest(0.0, 100 - (spot - 1) / 10)::DOUBLE ELSE 0 END AS place FROM an1)"""


@query("answer_block", f"""WITH {ANSWER} SELECT page_id, w AS answer_words, w BETWEEN 40 AND 80 AS optimal, alone AS standalone, topic, w >= 30 AND (alone OR topic) AS has_block, round(place, 6) AS place,
CASE WHEN t IS NULL THEN 0 ELSE CASE WHEN w >= 30 AND (alone OR topic) THEN 40 ELSE 0 END + CASE WHEN w BETWEEN 40 AND 80 THEN 25 WHEN w BETWEEN 30 AND 100 THEN 15 ELSE 0 END + alone::INT * 15 + topic::INT * 10 + CASE WHEN place > 80 THEN 10 ELSE 0 END END AS answer_score FROM answers""")
def answer_block(t):
    """The block of 40 to 80 words that answers first: whether there is one, and its score."""
    h = F.col("html")
    p = t("pages").select("page_id", X.first_answer(h).alias("t"), H.main_text(h).alias("main"))
    return p.select("page_id", *[c.alias(k) if k != "answer_words" else c.cast("bigint").alias(k) for k, c in X.answer_parts(F.col("t"), F.col("main")).items()])


_SPLIT = r"list_filter(string_split_regex({0}, '[.!?]+\s+'), lambda s: length(s) > 5)"
READ = rf"""
re0 AS (SELECT page_id, html, {_WORDS} AS n_words, list_filter({_PS('b')}, lambda t: length(t) > 20) AS ps FROM (SELECT *, {_BODY} AS b FROM pages)),
re1 AS (SELECT *, list_transform(ps, lambda p: len(regexp_extract_all(p, '\S+'))) AS sizes, list_transform(ps, lambda p: len({_SPLIT.format('p')})) AS sents, flatten(list_transform(ps, lambda p: list_transform({_SPLIT.format('p')}, lambda s: len(regexp_extract_all(s, '\S+'))))) AS lens FROM re0),
readable AS (SELECT page_id, n_words, len(ps) AS paragraphs, coalesce(list_avg(sizes), 0) AS mean_words, coalesce(list_avg(sents), 0) AS mean_sentences, coalesce(len(list_filter(sizes, lambda n: n <= 80)) / nullif(len(sizes), 0), 0) AS short_share, coalesce(list_avg(lens), 0) AS mean_sentence,
  coalesce(len(list_filter(lens, lambda n: n > 25)) / nullif(len(lens), 0), 0) AS long_share, coalesce(list_max(sizes), 0) AS longest, CASE WHEN n_words > 0 THEN len(regexp_extract_all(html, '(?i)<h[1-6]\b')) / (n_words / 500) ELSE 0 END AS headings_500, CASE WHEN n_words > 0 THEN len(regexp_extract_all(html, '(?i)<(?:ul|ol)\b')) / (n_words / 500) ELSE 0 END AS lists_500 FROM re1)"""
_SCORE = """CASE WHEN n_words = 0 THEN 0 WHEN paragraphs = 0 THEN 50 ELSE greatest(0, least(100, 50 + CASE WHEN mean_sentences BETWEEN 1.5 AND 4 THEN 15 WHEN mean_sentences < 1.5 THEN -5 ELSE 0 END + CASE WHEN mean_sentence BETWEEN 15 AND 22 THEN 15 WHEN mean_sentence > 25 THEN -10 ELSE 0 END
 + CASE WHEN short_share >= 0.7 THEN 10 WHEN short_share >= 0.5 THEN 5 ELSE 0 END - CASE WHEN longest > 150 THEN 15 ELSE 0 END - CASE WHEN long_share > 0.3 THEN 10 ELSE 0 END + CASE WHEN headings_500 >= 2 THEN 5 ELSE 0 END + CASE WHEN lists_500 >= 0.5 THEN 5 ELSE 0 END)) END"""
_SHOWN = ["mean_words", "mean_sentences", "short_share", "mean_sentence", "long_share", "headings_500", "lists_500"]


@query("readability_score", f"WITH {READ} SELECT page_id, paragraphs, longest, {', '.join(f'round({c}, 6) AS {c}' for c in _SHOWN)}, {_SCORE} AS readable_score FROM readable")
def readability_score(t):
    """Paragraph and sentence lengths, walls of text, density of headings and lists, and the score of them."""
    h = F.col("html")
    p = t("pages").select("page_id", "html", X.paragraphs(h).alias("ps"), F.regexp_count(H.visible(h), F.lit(r"\S+")).alias("n_words"))
    p = p.select("page_id", "n_words", *[c.alias(k) for k, c in X.readable_parts(h, F.col("ps"), F.col("n_words")).items()])
    return p.select("page_id", "paragraphs", "longest", *[F.round(c, 6).alias(c) for c in _SHOWN], X.readable_score().alias("readable_score"))


_HEADS = r"list_transform(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>'), lambda x: {'level': CAST(substr(x, 3, 1) AS INT), 'text': " + STRIP.format("x") + "})"
_FAQ = f"""fq AS (SELECT page_id, html, {_HEADS} AS hs FROM pages), fr AS (SELECT page_id, html, len(list_filter(hs, lambda x: x.level <= 4 AND regexp_matches(lower(x.text), '{X.FAQ}'))) > 0 AS named,
  len(list_filter(hs, lambda x: x.level BETWEEN 2 AND 5 AND ends_with(x.text, '?'))) + len(regexp_extract_all(html, '(?i)<details\\b')) + len(regexp_extract_all(html, '(?i)<dt\\b')) AS asked FROM fq),
faq AS (SELECT page_id, CASE WHEN named OR asked >= 3 THEN least(100, 50 + least(30, asked * 5) + CASE WHEN contains(lower(html), 'faqpage') THEN 20 ELSE 0 END) ELSE 0 END AS score FROM fr)"""
_PARTS = {"headings": "heading_audit", "answer_first": "answer_first", "links": "link_audit", "formats": "extractable_formats"}


@query("structure_pillar", f"""WITH {_FAQ}, {", ".join(f"{k}_ AS ({ORACLES[q]})" for k, q in _PARTS.items())}, answer_block_ AS ({ORACLES['answer_block']}), readable_ AS ({ORACLES['readability_score']})
SELECT page_id, round({" + ".join(f"coalesce({k}_.score, 0) * {X.SHARES[k]}" for k in _PARTS)} + answer_score * 0.15 + readable_score * 0.15 + faq.score * 0.15, 4) AS structure FROM pages
{" ".join(f"LEFT JOIN {k}_ USING (page_id)" for k in _PARTS)} JOIN answer_block_ USING (page_id) JOIN readable_ USING (page_id) JOIN faq USING (page_id)""")
def structure_pillar(t):
    """The structure total: headings .20, answer first, answer block, readability and questions .15 each, links and formats .10 each."""
    h = F.col("html")
    j = t("pages").select("page_id", X.faq_score(h).alias("faq"))
    for k, q in _PARTS.items():
        j = j.join(getattr(P, q)(t).select("page_id", F.col("score").alias(k)), "page_id", "left")
    j = j.join(answer_block(t).select("page_id", F.col("answer_score").alias("answer_block")), "page_id").join(readability_score(t).select("page_id", F.col("readable_score").alias("readable")), "page_id")
    total = sum((F.coalesce(F.col(k), F.lit(0)) * w for k, w in X.SHARES.items()), F.lit(0.0))
    return j.select("page_id", F.round(total, 4).alias("structure"))
