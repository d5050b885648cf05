"""Text scalar functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokenize(text: Column, least: int = 2) -> Column:
    """Lower-cased words of at least ``least`` characters; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), 0)


def split_words(text: Column) -> Column:
    """White-space words; blank text has none."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def estimate_tokens(text: Column) -> Column:
    """Whole part of 1.3 tokens a word."""
    return F.floor(F.size(split_words(text)) * 13 / 10).cast("bigint")


def content_hash(text: Column) -> Column:
    """First 12 hex digits of md5 over the lower-cased text with collapsed white space."""
    return F.substring(F.md5(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")).cast("binary")), 1, 12)


def question_id(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 8)


def cache_key(model: str, text: Column) -> Column:
    return F.md5(F.concat(F.lit(model + ":"), text).cast("binary"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two word arrays as sets: both empty 1, one empty 0."""
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0)
        .when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    )


def chunk_type(text: Column) -> Column:
    """code, table, list, quote, heading or text, first that fits."""
    lines = F.split(F.trim(text), "\n")
    n = F.size(lines)

    def most(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda x: F.rlike(x, F.lit(pattern)))) > n * 0.5

    return (
        F.when(F.contains(text, F.lit("```")), "code")
        .when((n >= 2) & most(r"\|"), "table")
        .when((n >= 2) & most(r"^\s*([-*•]|\d+[.)])\s"), "list")
        .when(most(r"^\s*>"), "quote")
        .when((n == 1) & F.trim(text).rlike(r"^#{1,6}\s"), "heading")
        .otherwise("text")
    )


def mod_hash(key: Column, modulus: int = 10_000) -> Column:
    """sha256 of key as a 256-bit number modulo ``modulus``, folded digit by digit."""
    digits = F.transform(F.split(F.sha2(key, 256), ""), lambda c: F.conv(c, 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda acc, d: (acc * 16 + d) % modulus)


def letter_grade(score: Column) -> Column:
    """Thirteen steps from A+ to F."""
    out = F.when(score >= 97, "A+")
    for least, grade in GRADES[1:]:
        out = out.when(score >= least, grade)
    return out.otherwise("F")


# Grade steps and milestone levels.
GRADES = [(97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (67, "D+"), (63, "D"), (60, "D-")]
LEVELS = [(85, "optimized"), (70, "high"), (55, "good"), (40, "partial")]


def level(score: Column) -> Column:
    out = None
    for least, name in LEVELS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("low")


def next_milestone(score: Column) -> Column:
    """The least level threshold above score; null at the top."""
    return F.when(score < 40, 40).when(score < 55, 55).when(score < 70, 70).when(score < 85, 85)
