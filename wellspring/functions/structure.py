"""Answer block and readability of a page, as column expressions over its markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import html as H

# Patterns of a sentence that stands alone, words that name no topic, shares of the total.
STANDALONE = [r"^[A-Z][^.]+\s+(?:is|are|refers?\s+to|means?|provides?|enables?)\s", r"^[A-Z][^.]+\s+(?:helps?|allows?|lets?|offers?)\s"]
NO_TOPIC = ["the", "a", "an", "in", "on", "at", "for", "when", "if", "as"]
FAQ = r"frequently\s+asked\s+questions?|\bfaq\b|common\s+questions?|questions?\s+(&|and)\s+answers?|q\s*&\s*a"
SHARES = {"headings": 0.20, "answer_first": 0.15, "answer_block": 0.15, "readable": 0.15, "faq": 0.15, "links": 0.10, "formats": 0.10}
PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)</p>"


def joined(h: Column) -> Column:
    """Text between tags, each stretch trimmed, nothing put between them."""
    return F.regexp_replace(F.regexp_replace(h, r"(?s)\s*<[^>]*>\s*", ""), r"^\s+|\s+$", "")


def body(h: Column) -> Column:
    """What main, else article, else the page holds."""
    m, a = H.inner(h, "main"), H.inner(h, "article")
    return F.when(m != "", m).when(a != "", a).otherwise(h)


def first_answer(h: Column) -> Column:
    """The first paragraph of more than 30 characters after the first h1, else among the first three of the body; null without."""
    long = lambda ps: F.get(F.filter(F.transform(ps, joined), lambda t: F.length(t) > 30), F.lit(0))
    after = F.regexp_extract(h, r"(?is)<h1\b[^>]*>.*?</h1>(.*)$", 1)
    return F.coalesce(long(F.regexp_extract_all(after, F.lit(PARAGRAPH), 1)), long(F.slice(F.regexp_extract_all(body(h), F.lit(PARAGRAPH), 1), 1, 3)))


def answer_parts(text: Column, main: Column) -> dict[str, Column]:
    """words, optimal, standalone, topic, place and score of an answer block (null: none) found in main."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_count(t, F.lit(r"\S+"))
    alone = t.rlike(STANDALONE[0]) | t.rlike(STANDALONE[1])
    first = F.regexp_replace(F.lower(F.regexp_extract(t, r"^\s*(\S+)", 1)), "[,.]+$", "")
    topic = t.rlike(r"^\p{Lu}") & ~first.isin(NO_TOPIC)
    at = F.instr(main, t)
    place = F.when((t != "") & (at > 0), F.greatest(F.lit(0.0), 100 - (at - 1) / 10)).otherwise(0.0)
    block = (words >= 30) & (alone | topic)
    size = F.when(words.between(40, 80), 25).when(words.between(30, 100), 15).otherwise(0)
    score = F.when(text.isNull(), 0).otherwise(F.when(block, 40).otherwise(0) + size + F.when(alone, 15).otherwise(0) + F.when(topic, 10).otherwise(0) + F.when(place > 80, 10).otherwise(0))
    return {"answer_words": words, "optimal": words.between(40, 80), "standalone": alone, "topic": topic, "has_block": block, "place": F.round(place, 6), "answer_score": score}


def faq_score(h: Column) -> Column:
    """50 and 5 for each question (at most 30) where a heading names a FAQ or three questions stand in headings, details and dt; 20 more with FAQ data."""
    heads = H.headings(h)
    named = F.exists(heads, lambda x: (x["level"] <= 4) & F.lower(x["text"]).rlike(FAQ))
    asked = F.size(F.filter(heads, lambda x: x["level"].between(2, 5) & F.endswith(x["text"], F.lit("?")))) + H.count(h, "details") + H.count(h, "dt")
    return F.when(named | (asked >= 3), F.least(F.lit(100), 50 + F.least(F.lit(30), asked * 5) + F.when(F.contains(F.lower(h), F.lit("faqpage")), 20).otherwise(0))).otherwise(0)


def paragraphs(h: Column) -> Column:
    """Texts of the body's paragraphs of more than 20 characters."""
    return F.filter(F.transform(F.regexp_extract_all(body(h), F.lit(PARAGRAPH), 1), joined), lambda t: F.length(t) > 20)


def readable_parts(h: Column, ps: Column, n_words: Column) -> dict[str, Column]:
    """Paragraph and sentence measures and the score, of paragraphs ps of a page of n_words words."""
    count = lambda x: F.regexp_count(x, F.lit(r"\S+"))
    split = lambda x: F.filter(F.split(x, r"[.!?]+\s+", -1), lambda s: F.length(s) > 5)
    sizes, sentences = F.transform(ps, count), F.transform(ps, lambda p: F.size(split(p)))
    lengths = F.flatten(F.transform(ps, lambda p: F.transform(split(p), count)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    mean = lambda a: F.coalesce(F.try_divide(total(a), F.size(a)), F.lit(0.0))
    share = lambda a, f: F.coalesce(F.try_divide(F.size(F.filter(a, f)), F.size(a)), F.lit(0.0))
    per = lambda tag: F.when(n_words > 0, H.count(h, tag) / (n_words / 500)).otherwise(0.0)
    return {
        "paragraphs": F.size(ps).cast("bigint"),
        "mean_words": mean(sizes),
        "mean_sentences": mean(sentences),
        "short_share": share(sizes, lambda n: n <= 80),
        "mean_sentence": mean(lengths),
        "long_share": share(lengths, lambda n: n > 25),
        "longest": F.coalesce(F.array_max(sizes), F.lit(0)).cast("bigint"),
        "headings_500": per("h[1-6]"),
        "lists_500": per("(?:ul|ol)"),
    }


def readable_score() -> Column:
    """The score of a row with the columns of readable_parts."""
    c = F.col
    s = 50 + F.when(c("mean_sentences").between(1.5, 4), 15).when(c("mean_sentences") < 1.5, -5).otherwise(0)
    s = s + F.when(c("mean_sentence").between(15, 22), 15).when(c("mean_sentence") > 25, -10).otherwise(0)
    s = s + F.when(c("short_share") >= 0.7, 10).when(c("short_share") >= 0.5, 5).otherwise(0) - F.when(c("longest") > 150, 15).otherwise(0) - F.when(c("long_share") > 0.3, 10).otherwise(0)
    s = s + F.when(c("headings_500") >= 2, 5).otherwise(0) + F.when(c("lists_500") >= 0.5, 5).otherwise(0)
    return F.when(c("n_words") == 0, 0).when(c("paragraphs") == 0, 50).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), s)))
