"""URL functions as Catalyst expressions; invalid URLs give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File endings and query parameters to drop, docs hosts and paths, page types in order.
SKIP_ENDINGS = ".jpg .jpeg .png .gif .svg .ico .webp .bmp .tiff .pdf .doc .docx .xls .xlsx .ppt .pptx .mp3 .mp4 .avi .mov .wmv .flv .webm .wav .zip .rar .7z .tar .gz .json .xml .csv .txt .log .exe .dmg .apk .ipa".split()
STRIP_PARAMS = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid msclkid dclid ref source mc_cid mc_eid _ga _gl _hsenc _hsmi sessionid sid session".split()
SKIP_URL = r"(?i)(/(feed|rss|atom)/?$|\.(xml|json)$|/wp-admin/|/wp-includes/|/wp-content/uploads/|/cdn-cgi/)|#"
DOCS_HOST = r"^(docs|help|developers?|support|guide|learn)\."
DOCS_PATH = r"^/(docs|documentation|guide|tutorial|api-reference|reference|sdk|manual|getting-started|quickstart|how-to)"
PAGE_TYPES = [
    ("about", r"/about|/company|/team|/who-we-are"),
    ("blog_post", r"/blog/[^/]+|/posts?/[^/]+|/articles?/[^/]+|/news/[^/]+"),
    ("blog_index", r"/blog/?$|/posts/?$|/articles/?$|/news/?$"),
    ("product", r"/products?/|/solutions?/|/features?/"),
    ("service", r"/services?/"),
    ("pricing", r"/pricing|/plans?"),
    ("contact", r"/contact|/support|/help"),
    ("faq", r"/faq|/frequently-asked|/questions"),
    ("documentation", r"/docs?/|/documentation|/guide|/tutorial"),
    ("legal", r"/privacy|/terms|/legal|/cookie"),
]
PARTS = r"^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?"


def part(url: Column, n: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, n)


def domain(url: Column) -> Column:
    """Lower-cased host without www. and port; null if there is none."""
    h = F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), r"^www\.", ""), r":.*$", "")
    return F.nullif(h, F.lit(""))


def path(url: Column) -> Column:
    return part(url, 3)


def depth(url: Column) -> Column:
    """Path segments."""
    p = F.regexp_replace(path(url), r"^/+|/+$", "")
    return F.when(p == "", 0).otherwise(F.size(F.split(p, "/"))).cast("bigint")


def is_internal(url: Column, base: Column) -> Column:
    """Same domain as base or a subdomain of it."""
    d, b = domain(url), F.regexp_replace(F.lower(base), r"^www\.", "")
    return F.coalesce((d == b) | F.endswith(d, F.concat(F.lit("."), b)), F.lit(False))


def surface(url: Column) -> Column:
    """docs or marketing, by host prefix, then path prefix."""
    host = F.regexp_replace(F.lower(part(url, 2)), r":.*$", "")
    return F.when(host.rlike(DOCS_HOST) | F.lower(path(url)).rlike(DOCS_PATH), "docs").otherwise("marketing")


def normalize(url: Column) -> Column:
    """https, bare lower-cased host without default ports, no tracking parameters, others by name; null to skip.

    Parameter values stay percent-coded as they came.
    """
    u = F.trim(url)
    u = F.when(F.startswith(u, F.lit("//")), F.concat(F.lit("https:"), u)).otherwise(u)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(u, 2)), r"^www\.", ""), ":443|:80", "")
    p = part(u, 3)
    p = F.when(p == "", "/").when(p.rlike("^/+$"), "/").otherwise(F.regexp_replace(p, "/+$", ""))
    kv = F.filter(F.split(part(u, 4), "&"), lambda x: x.rlike("^[^=]+=.") & ~F.lower(F.substring_index(x, "=", 1)).isin(STRIP_PARAMS))
    order = F.array_sort(F.transform(kv, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), i.alias("i"), x.alias("x"))))
    query = F.array_join(F.transform(order, lambda s: s["x"]), "&")
    ending = "(" + "|".join(e.replace(".", r"\.") for e in SKIP_ENDINGS) + ")$"
    bad = (part(u, 2) == "") | F.lower(part(u, 3)).rlike(ending) | u.rlike(SKIP_URL)
    full = F.concat(F.lit("https://"), host, p, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(~bad, full)


def page_type(url: Column) -> Column:
    """homepage, else the first type whose pattern fits the path, else unknown."""
    p = F.lower(path(url))
    out = F.when(p.isin("", "/", "/index.html", "/index.php"), "homepage")
    for name, pattern in PAGE_TYPES:
        out = out.when(p.rlike(pattern), name)
    return out.otherwise("unknown")
