"""Microdata items of pages from their markup, by running depth of tags in DataFrames.

A page is cut at its tags. Elements of one name nest by their own running depth, so an opening tag's end is the next tag of that name
at its level; unclosed elements of other names do not disturb it. An element without an end reaches to the end of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOID = "area base br col embed hr img input link meta param source track wbr".split()
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</(script|style)\s*>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or bare; null if it is not there."""
    q = lambda mark: F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{mark}([^{mark}]*){mark}", 1)
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\s\"'>]+)", 1)
    return F.when(tag.rlike(rf'(?is)\s{name}\s*=\s*"'), q('"')).when(tag.rlike(rf"(?is)\s{name}\s*=\s*'"), q("'")).when(tag.rlike(rf"(?is)\s{name}\s*=\s*[^\s\"'>]"), bare)


def decoded(text: Column) -> Column:
    for k, v in ENTITIES.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def pieces(html: Column) -> Column:
    """The page cut before each tag, without comments, scripts and styles."""
    return F.split(F.regexp_replace(html, HIDDEN, " "), r"<(?=[a-zA-Z/])")


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, at, until, tag): opening tags that carry itemtype or itemprop, with the piece that ends each element."""
    p = pages.select(id_col, F.posexplode(pieces(F.col(html_col))).alias("at", "piece")).filter("at > 0")
    name = F.lower(F.regexp_extract("piece", "^/?([a-zA-Z][a-zA-Z0-9:-]*)", 1))
    tag = F.regexp_extract("piece", r"(?s)^((?:[^>\"']|\"[^\"]*\"|'[^']*')*)", 1)
    t = p.select(id_col, "at", name.alias("name"), tag.alias("tag")).filter("name <> ''")
    shut = F.startswith("tag", F.lit("/"))
    lone = F.col("name").isin(VOID) | F.endswith("tag", F.lit("/"))
    t = t.withColumn("step", F.when(shut, -1).when(lone, 0).otherwise(1))
    marked = F.col("tag").rlike(r"(?i)\sitem(type|prop)\s*=")
    names = t.groupBy(id_col, "name").agg(F.max(marked).alias("_m")).filter("_m").drop("_m")
    t = t.join(names, [id_col, "name"], "left_semi")
    depth = F.sum("step").over(Window.partitionBy(id_col, "name").orderBy("at"))
    t = t.withColumn("level", depth + F.when(F.col("step") < 0, 1).otherwise(0))
    nested = t.filter("step <> 0").withColumn("until", F.lead("at").over(Window.partitionBy(id_col, "name", "level").orderBy("at"))).filter("step > 0")
    alone = t.filter("step = 0").withColumn("until", F.col("at"))
    return nested.unionByName(alone).filter(marked).select(id_col, "at", "until", "tag")


def items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages (id without repeats, html) -> (id, at, type, properties): schema.org items in page order.

    An item's properties are those of all elements inside it, nested items' too; the last non-empty value of a name wins. A
    value is the content attribute, or else the element's text with each stretch trimmed. Null pages have no items.
    """
    e = elements(pages, id_col, html_col).cache()
    body = pages.select(id_col, pieces(F.col(html_col)).alias("_pieces"))
    scopes = e.select(id_col, F.col("at").alias("start"), F.coalesce("until", F.lit(2**31 - 1)).alias("end"), F.regexp_extract(attribute(F.col("tag"), "itemtype"), r"schema\.org/(\w+)", 1).alias("type")).filter("type <> ''")
    props = e.select(id_col, "at", "until", attribute(F.col("tag"), "itemprop").alias("name"), attribute(F.col("tag"), "content").alias("content")).filter("name <> ''")
    props = props.join(body.join(props.select(id_col).distinct(), id_col, "left_semi"), id_col)
    size = F.coalesce("until", F.size("_pieces")) - F.col("at")
    texts = F.transform(F.slice("_pieces", F.col("at") + 1, F.greatest(size, F.lit(0))), lambda x: F.trim(F.regexp_replace(decoded(F.regexp_replace(x, r"(?s)^(?:[^>\"']|\"[^\"]*\"|'[^']*')*>?", "")), r"^\s+|\s+$", "")))
    value = F.when(F.coalesce(F.col("content"), F.lit("")) != "", decoded(F.col("content"))).otherwise(F.array_join(texts, ""))
    props = props.select(id_col, "at", "name", value.alias("value")).filter("value <> ''")
    inside = scopes.join(props.withColumnRenamed("at", "_at"), id_col, "left").withColumn("_in", (F.col("_at") > F.col("start")) & (F.col("_at") < F.col("end")))
    last = inside.filter("_in").groupBy(id_col, "start", "name").agg(F.max_by("value", "_at").alias("value"))
    maps = last.groupBy(id_col, "start").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))
    none = F.create_map().cast("map<string,string>")
    return scopes.join(maps, [id_col, "start"], "left").select(id_col, F.col("start").cast("bigint").alias("at"), "type", F.coalesce("properties", none).alias("properties"))
