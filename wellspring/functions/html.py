"""HTML measures that regular expressions express; markup is read as text, nothing is parsed twice."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Framework markers in order, generic anchors, question and how-to cues, definition patterns.
FRAMEWORKS = ['id="root"', 'id="__next"', "data-reactroot", "__next_data__", 'id="app"', "data-v-", "__nuxt__", "ng-app", "ng-version", "_nghost", "svelte-", "window.__initial_state__", "window.__preloaded_state__"]
LOADING = ["loading...", "please wait", "javascript is required", "enable javascript", "this site requires javascript", "noscript"]
GENERIC = ["click here", "click", "here", "read more", "more", "learn more", "continue", "link", "this", "this link", "see more", "view more", "details", "info", "read"]
FAQ = ["faq", "frequently asked", "common questions", "questions and answers", "q&a", "q & a"]
HOW_TO = ["how to", "how do", "step by step", "steps to", "guide to", "tutorial", "instructions"]
DEFINITION = r"(?i)\b(is\s+a|are\s+a|refers\s+to|means|define[ds]?\s+as|known\s+as)\b"
NUMBER = r"\b\d+(?:\.\d+)?%?\b"
DIRECT = ["the answer is", "in short", "simply put", "to summarize", "the main", "yes,", "no,"]
REMOVED = r"(?is)<(script|style|noscript|nav|footer|header|form|iframe|aside)\b.*?</(script|style|noscript|nav|footer|header|form|iframe|aside)>|<!--.*?-->"
TAG = r"(?s)<[^>]*>"


def strip_tags(h: Column) -> Column:
    """Text between tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(h, TAG, " "), r"\s+", " "))


def inner(h: Column, tag: str) -> Column:
    """What the first element of a tag holds; empty if there is none."""
    return F.regexp_extract(h, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)


def visible(h: Column) -> Column:
    """Page text without scripts, styles and page furniture."""
    return strip_tags(F.regexp_replace(h, REMOVED, " "))


def main_text(h: Column) -> Column:
    """Text of main, else article, else the visible page."""
    m, a = inner(h, "main"), inner(h, "article")
    return F.when(m != "", strip_tags(F.regexp_replace(m, REMOVED, " "))).when(a != "", strip_tags(F.regexp_replace(a, REMOVED, " "))).otherwise(visible(h))


def count(h: Column, tag: str) -> Column:
    return F.regexp_count(h, F.lit(rf"(?i)<{tag}\b")).cast("bigint")


def headings(h: Column) -> Column:
    """Array of (level, text) in page order."""
    raw = F.regexp_extract_all(h, F.lit(r"(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>"), 0)
    return F.transform(raw, lambda x: F.struct(F.substring(x, 3, 1).cast("int").alias("level"), strip_tags(x).alias("text")))


def links(h: Column) -> Column:
    """Array of (href, text) in page order."""
    raw = F.regexp_extract_all(h, F.lit(r'(?is)<a\b[^>]*href="[^"]*"[^>]*>.*?</a>'), 0)
    return F.transform(raw, lambda x: F.struct(F.regexp_extract(x, r'(?i)href="([^"]*)"', 1).alias("href"), strip_tags(x).alias("text")))


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def count_any(text: Column, words: list[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def js_score(length: Column, markers: Column, loading: Column, fallback: Column) -> Column:
    """100 less penalties for thin content, frameworks and loading states, within 0 to 100."""
    s = F.lit(100) - F.when(length < 100, 60).when(length < 500, 40).when(length < 1000, 20).otherwise(0)
    s = s - F.when(markers > 0, 30).otherwise(0) - F.when(loading, 15).otherwise(0) + F.when(fallback, 10).otherwise(0) - F.when(markers > 2, 10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), s))
