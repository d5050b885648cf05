"""The link graph of sites, from the pages' own HTML: page classes, topic clusters around pillar pages, link health and scores.

One scan reads the pages; what is shuffled are (page, target) pairs with their number. Both lookups of an edge (is the target a
page, does it link back) are equi-joins whose hot targets AQE splits; counts are aggregated before they meet pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import urls as U

# Words of thin, cluster and pillar pages, links of a pillar, pages of a cluster.
THIN, CLUSTER_WORDS, PILLAR_WORDS, PILLAR_LINKS, CLUSTER_SIZE, SMALL_SITE = 300, 800, 2000, 5, 3, 10
HOMES = ("", "index", "index.html", "home")


def plain(url: Column) -> Column:
    """url for comparison: no closing slashes, fragment or query, lower case."""
    return F.lower(F.substring_index(F.substring_index(F.regexp_replace(url, "/+$", ""), "#", 1), "?", 1))


def tidy(path: Column) -> Column:
    """path without . and .. segments."""
    empty = F.array().cast("array<string>")

    def add(done: Column, seg: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(seg == ".", done).when(seg == "..", up).otherwise(F.concat(done, F.array(seg)))

    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.array_join(F.aggregate(F.split(path, "/"), empty, add), "/")).otherwise(path)


def resolve(href: Column, url: Column) -> Column:
    """The absolute URL that href names on the page at url; null for other schemes and empty links."""
    h, scheme, host, path = F.trim(href), F.lower(U.part(url, 1)), U.part(url, 2), U.part(url, 3)
    root = F.concat(scheme, F.lit("://"), host)
    own = F.regexp_extract(h, "^([^?#]*)", 1)
    rest = F.substring(h, F.length(own) + 1, F.length(h))
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    return (
        F.when(h == "", None)
        .when(h.rlike("(?i)^https?://"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme, F.lit(":"), h))
        .when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(F.startswith(h, F.lit("#")) | F.startswith(h, F.lit("?")), F.concat(root, path, h))
        .when(F.startswith(h, F.lit("/")), F.concat(root, tidy(own), rest))
        .otherwise(F.concat(root, tidy(F.concat(folder, own)), rest))
    )


def site_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (site, url, page_id, words, title, targets): the last page of each URL, its links within the site.

    targets keep repeats. Pages without a host are left out.
    """
    h, url = F.coalesce(F.col("html"), F.lit("")), F.col("url")
    words = F.regexp_count(H.visible(h), F.lit(r"\S+")).cast("int")
    links = F.transform(H.links(h), lambda x: resolve(x["href"], url))
    inside = F.filter(links, lambda x: U.domain(x) == U.domain(url))
    title = H.strip_tags(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1))
    p = pages.select(U.domain(url).alias("site"), plain(url).alias("url"), "page_id", words.alias("words"), title.alias("title"), F.transform(inside, plain).alias("targets")).filter("site IS NOT NULL")
    return p.groupBy("site", "url").agg(F.max_by(F.struct("page_id", "words", "title", "targets"), "page_id").alias("p")).select("site", "url", "p.*")


def edges_of(pages: DataFrame) -> DataFrame:
    """(site, src, dst, n, back): links between pages of a site with their number; back: dst links to src."""
    out = pages.select("site", F.col("url").alias("src"), F.explode("targets").alias("dst")).groupBy("site", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    there = pages.select(F.col("site").alias("_s"), F.col("url").alias("_u"))
    e = out.join(there, (F.col("site") == F.col("_s")) & (F.col("dst") == F.col("_u")), "left_semi")
    back = e.select(F.col("site").alias("_s"), F.col("src").alias("_dst"), F.col("dst").alias("_src"), F.lit(True).alias("_back"))
    both = e.join(back, (F.col("site") == F.col("_s")) & (F.col("src") == F.col("_src")) & (F.col("dst") == F.col("_dst")), "left")
    return both.select("site", "src", "dst", "n", F.coalesce("_back", F.lit(False)).alias("back"))


def classified(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """site_pages without targets, with outbound and inbound links, mutual (whether any link goes both ways) and kind."""
    came = edges.groupBy("site", F.col("dst").alias("url")).agg(F.sum("n").alias("inbound"), F.max("back").alias("mutual"))
    p = pages.join(came, ["site", "url"], "left")
    p = p.withColumns({"outbound": F.size("targets").cast("bigint"), "inbound": F.coalesce("inbound", F.lit(0)), "mutual": F.coalesce("mutual", F.lit(False))})
    w, path = F.col("words"), F.regexp_replace(U.path(F.col("url")), "^/+|/+$", "")
    kind = (
        F.when(w < THIN, "thin")
        .when((w >= PILLAR_WORDS) & (F.col("outbound") >= PILLAR_LINKS), "pillar")
        .when(w.between(CLUSTER_WORDS, PILLAR_WORDS - 1) & (F.col("inbound") > 0), "cluster")
        .when((F.col("inbound") == 0) & ~path.isin(*HOMES), "orphan")
        .otherwise("normal")
    )
    return p.withColumn("kind", kind).drop("targets")


def members(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site, pillar, page, n, back, words): pages that a pillar links to and that are of kind cluster or normal or link back."""
    pillars = classes.filter("kind = 'pillar'").select("site", F.col("url").alias("src"))
    aims = classes.select("site", F.col("url").alias("dst"), "kind", "words")
    e = edges.join(pillars, ["site", "src"], "left_semi").join(aims, ["site", "dst"])
    e = e.filter(F.col("kind").isin("cluster", "normal") | F.col("back"))
    return e.select("site", F.col("src").alias("pillar"), F.col("dst").alias("page"), "n", "back", "words")


def clusters(found: DataFrame, least: int = CLUSTER_SIZE) -> DataFrame:
    """members -> (site, pillar, size, both_ways, ratio, mean_words) of clusters of at least ``least`` links."""
    n = F.col("n")
    c = found.groupBy("site", "pillar").agg(F.sum(n).alias("size"), F.sum(F.when(F.col("back"), n).otherwise(0)).alias("both_ways"), F.sum(n * F.col("words")).alias("_words"))
    return c.filter(F.col("size") >= least).select("site", "pillar", "size", "both_ways", (F.col("both_ways") / F.col("size")).alias("ratio"), (F.col("_words") / F.col("size")).alias("mean_words"))


def scores(classes: DataFrame, edges: DataFrame, found: DataFrame) -> DataFrame:
    """A row a site: pages by kind, links, mutual pairs, clusters, cluster, link and total score, level, issues."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}_pages") for k in ("pillar", "cluster", "orphan", "thin")]
    s = classes.groupBy("site").agg(F.count(F.lit(1)).alias("pages"), *kinds, F.sum("outbound").alias("links"), F.count_if("mutual").alias("_mutual"))
    pairs = edges.filter("back AND src <= dst").groupBy("site").agg(F.count(F.lit(1)).alias("mutual_pairs"))
    c = found.groupBy("site").agg(F.count(F.lit(1)).alias("clusters"), F.avg("ratio").alias("_ratio"))
    s = s.join(pairs, "site", "left").join(c, "site", "left").fillna(0, ["mutual_pairs", "clusters", "_ratio"])
    n, mean = F.col("pages"), F.col("links") / F.col("pages")
    share = F.col("_mutual") / n
    cluster = F.when(F.col("clusters") > 0, 30 + (F.col("pillar_pages") + F.col("cluster_pages")) / n * 30 + F.col("_ratio") * 40).when(n < SMALL_SITE, 50.0).otherwise(0.0)
    density = F.when(mean.between(5, 15), 25).when(((mean >= 3) & (mean < 5)) | ((mean > 15) & (mean <= 25)), 15).when(mean < 3, -10).otherwise(0)
    link = 50 - F.col("orphan_pages") / n * 30 + density + share * 25
    s = s.withColumns({"mutual_share": share, "cluster_score": F.least(F.lit(100.0), cluster), "link_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), link))})
    s = s.withColumn("total_score", F.col("cluster_score") * 0.6 + F.col("link_score") * 0.4)
    level = F.when(F.col("total_score") >= 70, "full").when(F.col("total_score") >= 40, "partial").otherwise("limited")
    issues = F.array_compact(F.array(F.when((F.col("clusters") == 0) & (n >= SMALL_SITE), "no_clusters"), F.when((F.col("mutual_share") < 0.3) & (n >= 5), "few_mutual_links")))
    return s.withColumns({"level": level, "issues": issues}).drop("_mutual", "_ratio")
