"""Structured data of a page (JSON-LD) and the scores built on it, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import microdata

# Required and recommended fields by type, points of the pillar's parts, days of freshness.
REQUIRED = {
    "Article": ["headline", "author", "datePublished"],
    "NewsArticle": ["headline", "author", "datePublished", "dateModified"],
    "BlogPosting": ["headline", "author", "datePublished"],
    "FAQPage": ["mainEntity"],
    "HowTo": ["name", "step"],
    "Product": ["name", "description"],
    "Organization": ["name", "url"],
    "Person": ["name"],
}
RECOMMENDED = {
    "Article": ["dateModified", "description", "image", "publisher"],
    "NewsArticle": ["description", "image", "publisher"],
    "BlogPosting": ["dateModified", "description", "image"],
    "FAQPage": [],
    "HowTo": ["description", "totalTime", "image"],
    "Product": ["image", "offers", "brand", "review"],
    "Organization": ["logo", "description", "contactPoint"],
}
PARTS = {"faq": 27, "author": 20, "modified": 20, "organization": 13, "how_to": 13, "validation": 7}
FRESH, RECENT, STALE = 30, 90, 180
ARTICLES, ORGANIZATIONS = ["Article", "NewsArticle", "BlogPosting"], ["Organization", "LocalBusiness"]
SCRIPT = r'(?is)<script\b[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'


def instances(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, at, type, json): JSON-LD objects in page order, lists and @graph unfolded; unreadable scripts and objects without a type are skipped.

    Of several types of an object the first counts.
    """
    s = pages.select(id_col, F.posexplode(F.regexp_extract_all(html_col, F.lit(SCRIPT), 1)).alias("at", "s")).withColumn("s", F.trim("s"))
    v = s.filter(F.try_parse_json("s").isNotNull())
    body = F.coalesce(F.get_json_object("s", "$.@graph"), F.col("s"))
    rows = F.when(F.startswith(body, F.lit("[")), F.from_json(body, "array<string>")).otherwise(F.array(body))
    x = v.select(id_col, "at", F.posexplode(rows).alias("part", "json"))
    kind = F.get_json_object("json", "$.@type")
    kind = F.when(F.startswith(kind, F.lit("[")), F.get_json_object("json", "$.@type[0]")).otherwise(kind)
    return x.select(id_col, (F.col("at") * 100_000 + F.col("part")).cast("bigint").alias("at"), F.nullif(kind, F.lit("")).alias("type"), "json").filter("type IS NOT NULL")


def field(json: Column, name: str) -> Column:
    """A field as text, null if it is not there, blank, or an empty list."""
    v = F.get_json_object(json, f"$.{name}")
    return F.when((F.trim(v) != "") & (v != "[]"), v)


def completeness(kind: Column, json: Column) -> Column:
    """0 to 100: 0.7 of the share of required and 0.3 of that of recommended fields (a half where none is). Other types 50 with more than two fields, else 25."""
    share = lambda names, none: sum((field(json, n).isNotNull().cast("int") for n in names), F.lit(0)) / len(names) if names else F.lit(none)
    out = None
    for t in REQUIRED:
        value = 100 * (0.7 * share(REQUIRED[t], 1.0) + 0.3 * share(RECOMMENDED.get(t, []), 0.5))
        out = F.when(kind == t, value) if out is None else out.when(kind == t, value)
    return out.otherwise(F.when(F.size(F.json_object_keys(json)) > 2, 50.0).otherwise(25.0))


def errors(kind: Column, json: Column) -> Column:
    """Required fields missing, and blank names, headlines and descriptions."""
    missing = None
    for t, names in REQUIRED.items():
        n = sum((field(json, x).isNull().cast("int") for x in names), F.lit(0))
        missing = F.when(kind == t, n) if missing is None else missing.when(kind == t, n)
    blank = sum((F.coalesce(F.trim(F.get_json_object(json, f"$.{x}")) == "", F.lit(False)).cast("int") for x in ("name", "headline", "description")), F.lit(0))
    return missing.otherwise(0) + blank


def all_instances(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, at, type, json, source) of JSON-LD objects and microdata items, the former first."""
    ld = instances(pages, id_col, html_col).withColumn("source", F.lit("json-ld"))
    typed = F.to_json(F.map_concat(F.create_map(F.lit("@type"), F.col("type")), F.map_filter("properties", lambda k, _: k != "@type")))
    items = microdata.items(pages, id_col, html_col).select(id_col, (F.col("at") + 10**12).alias("at"), "type", typed.alias("json"), F.lit("microdata").alias("source"))
    return ld.unionByName(items)


def scored(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, type, source, completeness, errors) of every instance."""
    kind, json = F.col("type"), F.col("json")
    return all_instances(pages, id_col, html_col).select(id_col, "type", "source", completeness(kind, json).alias("completeness"), errors(kind, json).alias("errors"))


def faq_pairs(json: Column) -> Column:
    """Entries of mainEntity (a list or one object) that have a name."""
    v = F.get_json_object(json, "$.mainEntity")
    rows = F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>")).when(F.startswith(v, F.lit("{")), F.array(v))
    return F.coalesce(F.size(F.filter(rows, lambda x: F.startswith(x, F.lit("{")) & (F.coalesce(F.get_json_object(x, "$.name"), F.lit("")) != ""))), F.lit(0))


def author_of(json: Column) -> Column:
    """(name, credentials) of the author: an object, a text, or the first of a list; null without."""
    a = field(json, "author")
    first = F.get_json_object(json, "$.author[0]")
    name = (
        F.when(F.startswith(a, F.lit("{")), field(json, "author.name"))
        .when(F.startswith(a, F.lit("[")), F.when(F.startswith(first, F.lit("{")), F.get_json_object(first, "$.name")).otherwise(first))
        .otherwise(a)
    )
    known = F.startswith(a, F.lit("{")) & (field(json, "author.jobTitle").isNotNull() | field(json, "author.description").isNotNull())
    return F.when(F.coalesce(name, F.lit("")) != "", F.struct(name.alias("name"), F.coalesce(known, F.lit(False)).alias("credentials")))


def dated(json: Column, names: list[str]) -> Column:
    """The first of the fields that has a value: a text, or an object's @value or name."""
    each = [F.when(F.startswith(field(json, n), F.lit("{")), F.coalesce(F.get_json_object(json, f"$.{n}['@value']"), field(json, f"{n}.name"))).otherwise(field(json, n)) for n in names]
    return F.coalesce(*each)


def moment(text: Column) -> Column:
    """A date, or a date and time to the second without its zone; null for other forms."""
    t = F.substring(F.split_part(F.split_part(text, F.lit("+"), F.lit(1)), F.lit("Z"), F.lit(1)), 1, 19)
    whole = r"^\d{4}-\d{1,2}-\d{1,2}"
    return F.when(t.rlike(whole + r"T\d{1,2}:\d{1,2}:\d{1,2}$"), F.try_to_timestamp(t, F.lit("y-M-d'T'H:m:s"))).when(t.rlike(whole + "$"), F.try_to_timestamp(t, F.lit("y-M-d")))


def freshness(days: Column) -> Column:
    """fresh, recent, stale, very_stale, or unknown."""
    return F.when(days < FRESH, "fresh").when(days < RECENT, "recent").when(days < STALE, "stale").when(days.isNotNull(), "very_stale").otherwise("unknown")


def analysis(pages: DataFrame, as_of: Column, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A row a page with any instance: its kinds, question pairs, first author, dates of its instances, errors.

    days counts from the last instance whose dateModified can be read.
    """
    kind, json = F.col("type"), F.col("json")
    x = all_instances(pages, id_col, html_col).withColumns({"_author": author_of(json), "_mod": dated(json, ["dateModified", "lastModified"]), "_pub": dated(json, ["datePublished", "dateCreated"]), "_err": errors(kind, json)})
    x = x.withColumn("_when", moment(F.col("_mod")))
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    g = x.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("schemas"), F.array_sort(F.collect_set("type")).alias("types"), has(kind == "FAQPage").alias("has_faq"), F.sum(F.when(kind == "FAQPage", faq_pairs(json)).otherwise(0)).alias("faq_count"),
        has(kind.isin(ARTICLES)).alias("has_article"), has(kind == "HowTo").alias("has_how_to"), has(kind.isin(ORGANIZATIONS)).alias("has_organization"),
        F.min_by("_author", F.when(F.col("_author").isNotNull(), F.col("at"))).alias("author"), has(F.col("_mod").isNotNull()).alias("has_modified"), has(F.col("_pub").isNotNull()).alias("has_published"),
        F.max_by("_when", F.when(F.col("_when").isNotNull(), F.col("at"))).alias("_when"), F.sum("_err").cast("bigint").alias("errors"),
    )
    days = F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("_when")) / 86_400)
    return g.withColumn("days", days).withColumn("freshness", freshness(F.col("days"))).drop("_when")


def pillar(found: DataFrame) -> DataFrame:
    """analysis rows with the pillar's six parts (0 to 100 each), total and level. A page without instances is not among them: its total is 6.5."""
    c = F.col
    named = F.coalesce(c("author.name"), F.lit("")) != ""
    parts = {
        "faq": faq_points(c("has_faq"), c("faq_count")),
        "author": F.when(~c("has_article"), 0.0).when(named & c("author.credentials"), 100.0).when(named, 70.0).otherwise(30.0),
        "modified": F.when(~c("has_modified"), F.when(c("has_published"), 30.0).otherwise(0.0)).when(c("freshness") == "fresh", 100.0).when(c("freshness") == "recent", 80.0).when(c("freshness") == "stale", 40.0).otherwise(20.0),
        "organization": F.when(c("has_organization"), 100.0).otherwise(0.0),
        "how_to": F.when(c("has_how_to"), 100.0).otherwise(50.0),
        "validation": F.when(c("schemas") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - c("errors") * 20)),
    }
    total = sum((v * PARTS[k] / 100 for k, v in parts.items()), F.lit(0.0))
    level = F.when(F.col("total") >= 70, "full").when(F.col("total") >= 40, "partial").otherwise("limited")
    return found.withColumns({f"{k}_score": v for k, v in parts.items()} | {"total": F.round(total, 6)}).withColumn("level", level)


def faq_points(has: Column, pairs: Column) -> Column:
    return F.when(~has, 0.0).when(pairs >= 5, 100.0).when(pairs >= 3, 80.0).when(pairs >= 1, 50.0).otherwise(25.0)


def image_scores(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, images, decorative, missing, poor, good, score): alt texts by kind, penalties by share."""
    img = pages.select(id_col, F.explode(F.regexp_extract_all(html_col, F.lit(r"(?is)<img\b[^>]*>"), 0)).alias("t"))
    alt = F.trim(F.regexp_extract("t", r'(?i)\balt="([^"]*)"', 1))
    none = ~F.col("t").rlike(r"(?i)\balt\s*=")
    decorative = ~none & (alt == "")
    poor = (F.length(alt) > 0) & ((F.length(alt) < 5) | F.lower(alt).isin("image", "photo", "picture", "img", "icon", "logo") | alt.rlike(r"(?i)\.(jpe?g|png|gif|webp|svg)$"))
    a = img.groupBy(id_col).agg(F.count(F.lit(1)).alias("images"), F.count_if(decorative).alias("decorative"), F.count_if(none).alias("missing"), F.count_if(~none & poor).alias("poor"))
    n = F.col("images") - F.col("decorative")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), n), F.lit(0.0))
    good = F.col("images") - F.col("decorative") - F.col("missing") - F.col("poor")
    return a.withColumn("good", good).withColumn("score", F.greatest(F.lit(0.0), 100 - 50 * share("missing") - 30 * share("poor")))


def authority(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, byline, credentials, external, authoritative, original): signals of authorship, citations and own data."""
    text = F.regexp_replace(html_col, r"(?s)<[^>]*>", " ")
    hrefs = F.regexp_extract_all(html_col, F.lit(r'(?i)href="(https?://[^"]+)"'), 1)
    trusted = F.filter(hrefs, lambda x: x.rlike(r"(?i)^https?://[^/]*(\.gov|\.edu|\.ac\.uk|nature\.com|who\.int|ieee\.org|acm\.org|arxiv\.org)(/|$)"))
    return pages.select(
        id_col, F.nullif(F.regexp_extract(text, r"\b[Bb]y\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", 1), F.lit("")).alias("byline"), text.rlike(r"\b(PhD|Ph\.D|MD|M\.D\.|MBA|Professor)\b").alias("credentials"),
        F.size(hrefs).cast("bigint").alias("external"), F.size(trusted).cast("bigint").alias("authoritative"), text.rlike(r"(?i)\b(our (data|research|study|survey)|we (found|analyzed|surveyed|measured|tested))\b").alias("original"),
    )
