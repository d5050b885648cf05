"""Answers of assistants, read for a company: mentions, citations, URLs, sentiment, confidence, refusal, risk of invention.

Everything is column expressions over a row's own text, company and domain, so a table of answers is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Citation patterns in order with their types, phrases, refusals, words of praise and blame, specific claims, suffixes.
CITATIONS = [
    (r"according to ([^,\.]+)", "direct_quote"),
    (r"as (?:stated|reported|mentioned) by ([^,\.]+)", "attribution"),
    (r"([^,\.]+) (?:states?|reports?|says?|mentions?) that", "attribution"),
    (r"source:\s*([^\n]+)", "source_link"),
    (r"from (?:the )?([^,\.]+) website", "reference"),
    (r"based on (?:information from )?([^,\.]+)", "reference"),
    (r"(?:visit|see|check out|more at)\s+(https?://[^\s]+)", "source_link"),
]
HEDGES = ["i'm not sure", "i don't know", "i cannot confirm", "i'm unable to verify", "it's unclear", "i don't have information", "i cannot find", "may or may not", "might be", "could be"] + [
    "possibly", "perhaps", "it seems", "appears to be", "reportedly", "allegedly", "i believe", "i think", "as far as i know", "to my knowledge",
]
CERTAINTIES = ["definitely", "certainly", "absolutely", "without a doubt", "i can confirm", "it is clear that", "clearly", "obviously", "undoubtedly", "for certain", "in fact", "indeed", "specifically", "precisely"]
REFUSALS = [r"i (?:cannot|can't|am unable to) (?:provide|give|answer)", r"i don't have (?:access to|information about)", r"i'm not able to", r"this is outside (?:my|the scope)", r"i cannot assist with", r"i'm sorry,? but i (?:cannot|can't)"]
PRAISE = "excellent great outstanding impressive innovative leading best top premier trusted reliable recommended praised acclaimed award-winning renowned successful effective efficient quality superior".split()
BLAME = "poor bad disappointing problematic issues complaints criticized concerns lacking limited struggling failed controversial negative unreliable questionable inferior subpar inadequate deficient".split()
CLAIMS = [r"\$[\d,]+", r"\d{4}", r"\d+%", r"founded in \d{4}", r"headquartered in [A-Z][a-z]+"]
SUFFIXES = [" Inc", " Inc.", " LLC", " Ltd", " Ltd.", " Co", " Co.", " Corp", " Corp.", " Corporation", " Company", " Technologies", " Tech", " Software", " Solutions", " Services", " Group", " Holdings"]
#: What a text must hold for a citation pattern that is slow where it does not match.
HINTS = {2: " (?:states?|reports?|says?|mentions?) that"}
URL = r"https?://[^\s<>\"{}|\\^`\[\]]+"


def quoted(text: Column) -> Column:
    """A pattern for text itself."""
    return F.concat(F.lit(r"\Q"), text, F.lit(r"\E"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(text: Column, pattern: Column) -> Column:
    """Array of (pos, text) of the pattern's matches in order; positions count characters from 0."""

    def starts(z: Column) -> Column:
        """Lengths of what stands before each match, summed up."""
        steps = F.transform(z["found"], lambda m, i: F.length(F.get(z["parts"], i)) + F.when(i > 0, F.length(F.get(z["found"], i - 1))).otherwise(0))
        return F.aggregate(steps, F.array().cast("array<int>"), lambda done, n: F.concat(done, F.array(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + n)))

    both = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"))
    return let(both, lambda z: let(starts(z), lambda at: F.transform(z["found"], lambda m, i: F.struct(F.get(at, i).alias("pos"), m.alias("text")))))


def variations(name: Column) -> Column:
    """Forms of a company's name: itself, without a suffix, without The, and its first word of three letters or more (not The)."""
    low = F.lower(name)
    bare = [F.when(F.endswith(low, F.lit(s.lower())), F.trim(F.substring(name, F.lit(1), F.length(name) - len(s)))) for s in SUFFIXES]
    the = F.when(F.startswith(low, F.lit("the ")), F.substring(name, F.lit(5), F.length(name)))
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    at = F.when(F.lower(F.get(words, F.lit(0))) == "the", 1).otherwise(0)
    first = F.when((F.size(words) > at + 1) & (F.length(F.get(words, at)) >= 3), F.get(words, at))
    return F.array_distinct(F.filter(F.array(name, *bare, the, first), lambda x: x.isNotNull() & (x != "")))


def mentions(content: Column, company: Column, domain: Column, branded: Column | None = None) -> Column:
    """Array of (pos, kind, confidence, text) in order: exact, partial, domain, url and branded; the surest at each place."""
    low = F.lower(content)

    def of(pattern: Column, kind: Column | str, sure: Column | float, order: Column | int) -> Column:
        kind, sure, order = (x if isinstance(x, Column) else F.lit(x) for x in (kind, sure, order))
        return F.transform(places(low, pattern), lambda m: F.struct(m["pos"].alias("pos"), (-sure).alias("less"), order.alias("order"), kind.alias("kind"), F.length(m["text"]).alias("n")))

    names = F.flatten(F.transform(variations(company), lambda v, i: of(quoted(F.lower(v)), F.when(F.lower(v) == F.lower(company), "exact").otherwise("partial"), F.when(F.lower(v) == F.lower(company), 1.0).otherwise(F.length(v) / F.length(company)), i)))
    parts = [names, of(quoted(F.lower(domain)), "domain", 1.0, 1000), of(F.concat(F.lit(r"https?://(?:www\.)?"), quoted(F.lower(domain)), F.lit(r"[^\s]*")), "url", 1.0, 1001)]
    if branded is not None:
        parts.append(F.flatten(F.transform(F.coalesce(branded, F.array().cast("array<string>")), lambda b, i: of(quoted(F.lower(b)), "branded", 0.9, i + 1002))))
    one = let(F.array_sort(F.concat(*parts)), lambda every: F.filter(every, lambda m, i: (i == 0) | (m["pos"] != F.get(every, i - 1)["pos"])))
    return F.transform(one, lambda m: F.struct(m["pos"].alias("pos"), m["kind"].alias("kind"), (-m["less"]).alias("confidence"), F.substring(content, m["pos"] + 1, m["n"]).alias("text")))


def citations(content: Column, company: Column) -> Column:
    """Array of (pos, kind, source, url) in order; an implicit one where only the company's name is there."""

    def of(i: int, pattern: str, kind: str) -> Column:
        found = places(content, F.lit(pattern))
        if i in HINTS:
            found = F.when(content.rlike("(?i)" + HINTS[i]), found).otherwise(F.array().cast("array<struct<pos:int,text:string>>"))
        return F.transform(found, lambda m: F.struct(m["pos"].alias("pos"), F.lit(i).alias("order"), F.lit(kind).alias("kind"), F.trim(F.regexp_extract(m["text"], pattern, 1)).alias("source")))

    found = F.array_sort(F.concat(*[of(i, "(?i)" + p, kind) for i, (p, kind) in enumerate(CITATIONS)]))
    at = F.instr(F.lower(content), F.lower(company))
    implicit = F.array(F.struct((at - 1).cast("int").alias("pos"), F.lit(99).alias("order"), F.lit("implicit").alias("kind"), company.alias("source")))
    both = let(found, lambda x: F.when((F.size(x) == 0) & (at > 0), implicit).otherwise(x))
    return F.transform(both, lambda c: F.struct(c["pos"].alias("pos"), c["kind"].alias("kind"), c["source"].alias("source"), F.nullif(F.regexp_extract(c["source"], r"https?://[^\s]+", 0), F.lit("")).alias("url")))


def holding(low: Column, phrases: list[str]) -> Column:
    """The phrases that a lower-cased text holds, in order."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))


def parsed(rows: DataFrame, content: str = "content", company: str = "company", domain: str = "domain", branded: str | None = None) -> DataFrame:
    """rows with sizes, mentions, urls, citations, sentiment, confidence, refusal, uncertain and risk. A null content is empty; a null company or domain is not looked for."""
    c = F.coalesce(F.col(content), F.lit(""))
    never = F.lit("\x00")  # no text holds it
    name, site = F.coalesce(F.nullif(F.col(company), F.lit("")), never), F.coalesce(F.nullif(F.col(domain), F.lit("")), never)
    rows, low = rows.withColumn("_low", F.lower(c)), F.col("_low")
    out = rows.withColumns({"mentions": mentions(c, name, site, F.col(branded) if branded else None), "citations": citations(c, name), "urls": F.regexp_extract_all(c, F.lit(URL), 0), "hedges": holding(low, HEDGES), "certainties": holding(low, CERTAINTIES)})
    kinds = F.transform("mentions", lambda m: m["kind"])
    good, bad = F.size(holding(low, PRAISE)), F.size(holding(low, BLAME))
    tone = F.coalesce(F.try_divide(good - bad, good + bad), F.lit(0.0))
    h, s = F.size("hedges"), F.size("certainties")
    sure = F.when((h == 0) & (s == 0), "unknown").when(h > 2 * s, "low").when(s > 2 * h, "high").when(h > s, "uncertain").otherwise("medium")
    explicit = F.exists("citations", lambda x: x["kind"] != "implicit")
    claims = reduce(lambda a, b: a + b, [c.rlike(p).cast("int") for p in CLAIMS])
    out = out.withColumns(
        {
            "n_chars": F.length(c),
            "n_words": F.regexp_count(c, F.lit(r"\S+")),
            "n_sentences": F.regexp_count(c, F.lit("[.!?]+")),
            "has_company": F.arrays_overlap(kinds, F.array(F.lit("exact"), F.lit("partial"))),
            "has_domain": F.array_contains(kinds, "domain"),
            "has_url": F.array_contains(kinds, "url"),
            "company_urls": F.filter("urls", lambda u: F.contains(F.lower(u), F.lower(site))),
            "external_urls": F.filter("urls", lambda u: ~F.contains(F.lower(u), F.lower(site))),
            "explicit_citation": explicit,
            "tone": tone,
            "sentiment": F.when(tone > 0.3, "positive").when(tone < -0.3, "negative").when((good > 0) & (bad > 0), "mixed").otherwise("neutral"),
            "confidence": sure,
            "refusal": low.rlike("|".join(REFUSALS)),
        }
    )
    out = out.drop("_low")
    return out.withColumns(
        {
            "uncertain": F.col("confidence").isin("low", "uncertain") | (h > 2),
            "risk": ((F.col("confidence") == "high") & ~F.col("explicit_citation") & (F.size("mentions") > 0)) | ((claims >= 3) & ~F.col("explicit_citation")),
        }
    )
