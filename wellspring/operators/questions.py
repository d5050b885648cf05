"""Questions to ask about a site: universal ones, some by its structured data and headings, deduplicated and limited.

What a site adds is found by aggregates with small results: the first place of each known type, and the first two headings that fit
a pattern by two minima. No site's headings are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Universal questions, templates by type of structured data and by heading pattern, limits and weights.
UNIVERSAL = [
    ("UQ-01", "What does {company} do?", "identity", "easy", 1.5),
    ("UQ-02", "Who founded {company} and when was it established?", "identity", "medium", 1.0),
    ("UQ-03", "Where is {company} headquartered and where do they operate?", "identity", "easy", 1.0),
    ("UQ-04", "What products or services does {company} offer?", "offerings", "easy", 1.5),
    ("UQ-05", "What is {company}'s pricing or how much do their services cost?", "offerings", "medium", 1.0),
    ("UQ-06", "Who are the typical customers or target audience for {company}?", "offerings", "medium", 1.0),
    ("UQ-07", "What problems does {company} solve for their customers?", "offerings", "medium", 1.2),
    ("UQ-08", "How can I contact {company} or get in touch with them?", "contact", "easy", 1.0),
    ("UQ-09", "How do I get started with {company} or sign up for their service?", "contact", "easy", 1.2),
    ("UQ-10", "What notable clients or customers does {company} have?", "trust", "medium", 1.0),
    ("UQ-11", "What awards, certifications, or recognition has {company} received?", "trust", "hard", 0.8),
    ("UQ-12", "What is {company}'s track record or history of success?", "trust", "hard", 1.0),
    ("UQ-13", "What makes {company} different from competitors?", "differentiation", "medium", 1.2),
    ("UQ-14", "Why should someone choose {company} over alternatives?", "differentiation", "hard", 1.2),
    ("UQ-15", "What is {company}'s mission, vision, or core values?", "differentiation", "medium", 0.8),
]
BY_TYPE = {
    "Product": [("What are the features of {company}?", "offerings"), ("How much does {company} cost?", "offerings"), ("What are the reviews for {company}?", "trust")],
    "LocalBusiness": [("What are the hours of operation for {company}?", "contact"), ("What is the address of {company}?", "contact"), ("What services does {company} offer?", "offerings")],
    "Organization": [("How many employees does {company} have?", "identity"), ("What is {company}'s annual revenue?", "trust")],
    "SoftwareApplication": [("What platforms does {company} support?", "offerings"), ("What are the system requirements for {company}?", "offerings"), ("Is there a free trial for {company}?", "offerings")],
    "Service": [("How long does {company} take?", "offerings"), ("What is included in {company}?", "offerings")],
    "Article": [("What is the main topic of this article?", "identity"), ("Who wrote this article?", "trust")],
    "FAQPage": [("What are the most common questions about {company}?", "offerings")],
    "HowTo": [("How do I use {company}?", "offerings"), ("What steps are involved in {company}?", "offerings")],
}
BY_HEADING = [
    (r"pricing|plans|cost", "What are {company}'s pricing plans?", "offerings"),
    (r"features?|capabilities", "What features does {company} offer?", "offerings"),
    (r"about\s+us|our\s+story|who\s+we\s+are", "What is {company}'s background and history?", "identity"),
    (r"team|leadership|founders?", "Who are the key people at {company}?", "identity"),
    (r"testimonials?|reviews?|customers?\s+say", "What do customers say about {company}?", "trust"),
    (r"case\s+stud|success\s+stor", "What are some success stories from {company}?", "trust"),
    (r"integrations?|connect|works?\s+with", "What does {company} integrate with?", "offerings"),
    (r"faq|frequently\s+asked", "What are frequently asked questions about {company}?", "offerings"),
    (r"security|privacy|compliance", "How does {company} handle security and privacy?", "trust"),
    (r"support|help|contact", "How can I get support from {company}?", "contact"),
]
MAX_SCHEMA, MAX_HEADINGS, MAX_QUESTIONS = 3, 2, 20
SCHEMA_WEIGHT, HEADING_WEIGHT = 0.8, 0.7


def row(template: str, source: str, category: str, difficulty: str, weight: float) -> Column:
    return F.struct(F.lit(template).alias("question"), F.lit(source).alias("source"), F.lit(category).alias("category"), F.lit(difficulty).alias("difficulty"), F.lit(weight).alias("weight"))


def fitting(text: Column) -> Column:
    """Number of the first heading pattern that fits; null if none does."""
    out = None
    for i, (p, _, _) in enumerate(BY_HEADING):
        fits = text.rlike("(?i)" + p)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return out


def site_types(types: DataFrame) -> DataFrame:
    """types (site, type, place) -> (site, types): those with templates, in order of their first place."""
    known = types.filter(F.col("type").isin(list(BY_TYPE))).groupBy("site", "type").agg(F.min("place").alias("place"))
    own = F.array_sort(F.collect_list(F.struct("place", "type")))  # at most one of each known type
    return known.groupBy("site").agg(own.alias("t")).select("site", F.transform("t", lambda x: x["type"]).alias("types"))


def site_headings(headings: DataFrame) -> DataFrame:
    """headings (site, level, place, text) -> (site, patterns): numbers of the patterns of the first two fitting headings, by level 1 to 3, then place."""
    fits = headings.filter("level <= 3").select("site", F.struct("level", "place", fitting(F.col("text")).alias("pattern")).alias("k")).filter("k.pattern IS NOT NULL")
    first = fits.groupBy("site").agg(F.min("k").alias("one"))
    second = fits.join(first, "site").filter("k > one").groupBy("site").agg(F.min("k").alias("two"))
    both = first.join(second, "site", "left")
    return both.select("site", F.transform(F.array_compact(F.array("one", "two")), lambda k: k["pattern"]).alias("patterns"))


def generated(sites: DataFrame, types: DataFrame, headings: DataFrame) -> DataFrame:
    """sites (site, company) -> (site, number, question, source, category, difficulty, weight) by number, the first of alike questions; a site without a company name has none."""
    s = sites.join(site_types(types), "site", "left").join(site_headings(headings), "site", "left")
    none = F.array(row("", "", "", "", 0.0)).cast("array<struct<question:string,source:string,category:string,difficulty:string,weight:double>>")
    none = F.slice(none, 1, 0)
    per_type = lambda t: F.coalesce(*[F.when(t == k, F.array(*[row(q, "schema", c, "medium", SCHEMA_WEIGHT) for q, c in v])) for k, v in BY_TYPE.items()])
    table = F.array(*[row(q, "heading", c, "medium", HEADING_WEIGHT) for _, q, c in BY_HEADING])
    schema = F.slice(F.coalesce(F.flatten(F.transform("types", per_type)), none), 1, MAX_SCHEMA)
    heading = F.slice(F.coalesce(F.transform("patterns", lambda i: F.get(table, i)), none), 1, MAX_HEADINGS)
    every = F.concat(F.array(*[row(q, "universal", c, d, w) for _, q, c, d, w in UNIVERSAL]), schema, heading)
    x = s.select("site", "company", every.alias("q"))
    x = x.withColumn("q", F.transform("q", lambda r: F.struct(F.replace(r["question"], F.lit("{company}"), F.col("company")).alias("question"), r["source"].alias("source"), r["category"].alias("category"), r["difficulty"].alias("difficulty"), r["weight"].alias("weight"))))
    x = x.withColumn("same", F.transform("q", lambda r: F.regexp_replace(F.trim(F.lower(r["question"])), r"\s+", " ")))
    x = x.withColumn("q", F.slice(F.filter("q", lambda r, i: F.array_position("same", F.get("same", i)) == i + 1), 1, MAX_QUESTIONS))
    return x.select("site", F.posexplode("q").alias("number", "r")).select("site", (F.col("number") + 1).cast("bigint").alias("number"), "r.*")
