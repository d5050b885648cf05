"""Sources of a crawl: stored pages, sitemaps, robots.txt and llms.txt, parsed in DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Stored pages (path, html) of a crawl folder, one file a page."""
    return spark.read.text(f"{folder}/pages/*.html", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.json(f"{folder}/manifest.json", multiLine=True)


def fresh(pages: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """The latest fetch of each domain within ``hours`` of as_of."""
    p = pages.filter(F.col("fetched_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    r = F.row_number().over(Window.partitionBy(F.lower("domain")).orderBy(F.desc("fetched_at")))
    return p.withColumn("_n", r).filter("_n = 1").drop("_n")


def sitemap(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """docs (site, xml) -> (site, kind, loc, lastmod, changefreq, priority); the first entry of a loc stays."""
    x = F.regexp_replace(F.col(xml), r"(<\/?)\w+:", "$1")
    entries = F.regexp_extract_all(x, F.lit(r"(?is)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), 1)
    get = lambda tag: F.nullif(F.trim(F.regexp_extract("e", rf"(?is)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    kind = F.when(x.rlike("(?i)<sitemapindex"), "index").otherwise("urlset")
    rows = docs.select("site", kind.alias("kind"), F.posexplode(entries).alias("i", "e")).select("site", "kind", "i", get("loc").alias("loc"), get("lastmod").alias("lastmod"), get("changefreq").alias("changefreq"), get("priority").cast("double").alias("priority")).filter("loc IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("site", "loc").orderBy("i"))
    return rows.withColumn("_n", first).filter("_n = 1").drop("_n", "i")


def robots(docs: DataFrame, agent: str, strict: bool = False) -> DataFrame:
    """docs (site, robots) -> rules (site, line, allow, path) for ``agent``.

    As read literally, groups after a matching one apply too, since only an empty user-agent ends a
    match; ``strict`` keeps to groups that name the agent or *.
    """
    lines = docs.select("site", F.posexplode(F.split("robots", r"\r?\n")).alias("line", "raw"))
    kv = lines.select("site", "line", F.split(F.regexp_replace("raw", r"\s*#.*$", ""), ":", 2).alias("p")).filter(F.size("p") == 2)
    kv = kv.select("site", "line", F.lower(F.trim(F.col("p")[0])).alias("k"), F.trim(F.col("p")[1]).alias("v"))
    mine = (F.col("v") == "*") | F.contains(F.lit(agent.lower()), F.lower("v"))
    mark = F.when(F.col("k") == "user-agent", F.when(F.col("v") == "", 0).when(mine, 1).otherwise(0 if strict else None))
    w = Window.partitionBy("site").orderBy("line")
    on = F.last(mark, ignorenulls=True).over(w)
    rules = kv.withColumn("on", on).filter((F.col("on") == 1) & F.col("k").isin("allow", "disallow") & (F.col("v") != ""))
    return rules.select("site", "line", (F.col("k") == "allow").alias("allow"), F.col("v").alias("path"))


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (site, path) -> with allowed: the longest matching rule decides, else allowed; * matches anything."""
    r = rules.select(F.col("site").alias("_s"), "allow", F.col("path").alias("_p"))
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("_p", r"([.?+()\[\]{}|^\\])", r"\\$1"), r"\*", ".*"))
    hit = urls.join(r, (F.col("site") == F.col("_s")) & F.expr("true"), "left").withColumn("_hit", F.rlike(F.col("path"), pattern))
    best = F.max_by(F.when(F.col("_hit"), F.col("allow")), F.when(F.col("_hit"), F.length("_p")))
    return hit.groupBy("site", "path").agg(F.coalesce(best, F.lit(True)).alias("allowed"))


def llms_txt(docs: DataFrame) -> DataFrame:
    """docs (site, text) -> (site, title, summary, sections, links, quality)."""
    t = F.col("text")
    d = docs.select(
        "site", F.nullif(F.regexp_extract(t, r"(?m)^# (.+)$", 1), F.lit("")).alias("title"), F.nullif(F.regexp_extract(t, r"(?m)^> (.+)$", 1), F.lit("")).alias("summary"),
        F.regexp_extract_all(t, F.lit(r"(?m)^## (.+)$"), 1).alias("sections"), F.regexp_count(t, F.lit(r"\[[^\]]+\]\([^)]+\)")).alias("links"),
    )
    q = F.when(F.col("title").isNotNull(), 20).otherwise(0) + F.when(F.col("summary").isNotNull(), 20).otherwise(0) + F.when(F.size("sections") > 0, 15).otherwise(0) + F.least(F.lit(45.0), 4.5 * F.col("links"))
    return d.withColumn("quality", q)


def write_report(report: DataFrame, path: str, score: str = "total") -> None:
    """Report rows as Parquet: all columns as one JSON document and the score bands beside it."""
    s = F.col(score)
    band = lambda f: F.least(F.lit(100.0), s * f).cast("int")
    report.select(F.to_json(F.struct("*")).alias("report"), band(0.85).alias("low"), band(1.0).alias("typical"), band(1.15).alias("high")).write.parquet(path)
